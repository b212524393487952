"""SQL text equals the column functions, and its plans hold no Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import money as M
from offerlens.functions import similarity as S
from offerlens.functions import sql
from offerlens.functions import text as X

TEXTS = [
    "Amber House Still Water Eau de Parfum 50 ml Tester", "Apă de toaletă  1500 ml", "Naïve Rosé ﬁx 5 ML", "quiet 'gift set', - x", "parfumTester \\ $1 E.d.P.", "1.234,56 lei", "RRP: 1 234,50", "12.5 99.99", "1.013 lei", "", " \t", "ă" * 70, "x - y", "9999 ml 20 ml", "eșantion", "a+b (x) a+b 日本 😀", None,
]


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    frame.createOrReplaceTempView("sql_texts")
    return frame


SINGLE = {
    "plain_letters": X.strip_diacritics, "single_spaces": X.collapse_whitespace, "normalized": X.normalize, "concentration_of": X.concentration, "exclusion_of": X.exclusion, "volume_of": X.volume_ml, "is_tester": X.is_tester,
    "page_slug": X.slug, "comma_price": M.comma_price, "dot_price": M.dot_price, "lei_price": M.lei_price, "sorted_words": S.sorted_words, "letter_places": S.places,
}


def test_functions_of_one_text(spark, rows):
    for name, f in SINGLE.items():
        got = spark.sql(f"SELECT i, {name}(x) AS y FROM sql_texts")
        want = rows.select("i", f(F.col("x")).alias("y"))
        assert got.orderBy("i").collect() == want.orderBy("i").collect(), name
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_functions_of_two(spark, rows):
    rng = random.Random(8)
    pairs = [("".join(rng.choice("ab cé😀") for _ in range(rng.choice([0, 1, 9, 61, 62, 63, 130]))), "".join(rng.choice("ab cé😀") for _ in range(rng.choice([0, 1, 9, 63])))) for _ in range(120)]
    pairs += [(a, b) for a in TEXTS for b in ("Amber House", "a+b", None, "")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    frame.createOrReplaceTempView("sql_pairs")
    for name, f in {"indel_ratio": S.token_sort_ratio, "common_letters": S.common_letters, "core_name": X.core_name}.items():
        got = spark.sql(f"SELECT i, {name}(a, b) AS y FROM sql_pairs").orderBy("i").collect()
        assert got == frame.select("i", f(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect(), name
    money = spark.sql("SELECT discount_percent(p, o) AS y FROM VALUES (80.00, 100.00), (100.00, 80.00), (99.50, 100.00), (NULL, 5.00) t(p, o)")
    assert [r["y"] for r in money.collect()] == [20, None, 0, None]
