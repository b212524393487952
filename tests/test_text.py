import random
from decimal import Decimal

from pyspark.sql import functions as F

from offerlens.functions import money as M
from offerlens.functions import similarity as S
from offerlens.functions import text as X


def check(column, f, cases):
    assert column(f, list(cases)) == list(cases.values())


def test_normalize(column):
    check(column, X.normalize, {"Naïve  Rosé ": "naive rose", "Ștefan ﬁx": "stefan fix", "": "", None: None, "A b": "a b"})


def test_concentration(column):
    check(column, X.concentration, {"E.d.P.": "EDP", "Apă de toaletă": "EDT", "Cologne": "EDC", "Extract de parfum": "Extrait", "Parfum": "Parfum", "X - parfém": "Parfum", "Eau de Parfume": "EDP", "plain": None, None: None})


def test_volume(column):
    check(column, X.volume_ml, {"100ml": 100, "100 ML": 100, "none": None, "SKU12345": None, "5000 ml then 50 ml": None, "50 ml": 50})
    assert column(lambda c: X.volume_ml(F.lit("30 ml"), c), [75, 5000, None], "x int") == [75, None, 30]


def test_tester(column):
    check(column, X.is_tester, {"TESTER": True, "Testerino Cosmetics": False, "parfumTester EDP": True, "parfumtester": False})


def test_exclusion(column):
    words = {"refill": "refill", "gift set": "gift_set", "set cadou": "gift_set", "coffret": "gift_set", "discovery set": "discovery_set", "sample": "sample", "miniature": "miniature", "bundle": "bundle", "decant": "decant", "eșantion": "sample", "mostră": "sample", "rezervă": "refill", "refillable": None, "reincarcabil": None}
    check(column, X.exclusion, words)


def test_core_name(spark):
    rows = spark.createDataFrame(
        [("Xerjoff Erba Gold Apă de parfum 50 ml", "Xerjoff", "erba gold"), ("Alexandria II Parfum 100 ml tester", None, "alexandria ii"), ("Zoologist Perfumes T-Rex", "Zoologist", "t-rex"), ("Corner, Mawj, Unisex, 100 ml", "Corner", "mawj"), ("a+b (x) name", "a+b", "a+b (x) name")],
        "title string, brand string, want string",
    )
    got = rows.select("want", X.core_name(F.col("title"), F.col("brand")).alias("got")).collect()
    assert [r["got"] for r in got][:4] == [r["want"] for r in got][:4]
    got = rows.where("brand IS NOT NULL").limit(1).select(X.core_name_any_brand(F.lit("Christian Dior Sauvage EDT"), F.lit("Dior"))).first()[0]
    assert got == "sauvage"


def test_urls(column):
    check(column, X.url_key, {"https://A.com/Perfume/X/": "/perfume/x", "/a/b?q#f": "/a/b", "": ""})
    check(column, X.slug, {"Jean P. Gaultier ": "jean-p-gaultier", "--": ""})
    hosts = ["www.site.com", "site.com"]
    check(column, lambda c: X.canonical_page(c, hosts, "www.site.com"), {"http://site.com/perfume/A-B/C-D-12.html?x": "https://www.site.com/perfume/A-B/C-D-12.html", "https://other.com/perfume/A/B-1.html": None, "https://site.com/x": None})
    assert [r and tuple(r) for r in column(lambda c: X.product_page(c, hosts), ["https://site.com/perfume/A-B/C-D-12.html"])] == [("A B", "C D")]
    check(column, X.last_segment, {"https://a.com/x/le-male/": "le male"})


def test_small_rules(column):
    check(column, X.shelf_label, {"Perfumes  I Have (3)": "perfumes i have"})
    check(column, X.availability, {"Stoc epuizat": "out_of_stock", "În stoc": "in_stock"})
    check(column, X.concentration_or_p, {"Libre - P": "Parfum", "Libre EDT - P": "EDT", "Libre": None})
    check(column, X.without_brackets, {"Dior (Christian Dior) Sauvage": "Dior Sauvage"})


def test_prices(column):
    d = Decimal
    check(column, M.comma_price, {"625,99 lei": d("625.99"), "RRP: 929,99 lei": d("929.99"), "1.234,56 lei": d("1234.56"), "1 234,56": d("1234.56"), "1301,00 lei": d("1301.00"), "none": None, None: None})
    check(column, M.dot_price, {"999.00 lei": d("999.00"), "x": None})
    check(column, M.lei_price, {"1.013 lei": d("1013.00"), "99 lei": d("99.00")})
    check(column, M.entered_price, {" 12,5 ": d("12.50"), "0": None, "-1": None, "x": None})
    check(column, M.entered_volume, {"50": 50, "0": None, "": None})


def test_discount(spark):
    rows = spark.createDataFrame([("799.00", "850.00", 6), ("87.50", "100.00", 12), ("88.50", "100.00", 12), ("100.00", "100.00", None), ("1.00", None, None), ("1.00", "0.00", None)], "p string, o string, want int")
    got = rows.select("want", M.discount_percent(F.col("p").cast("decimal(10,2)"), F.col("o").cast("decimal(10,2)")).alias("got")).collect()
    assert [r["got"] for r in got] == [6, 12, 12, None, None, None]


def test_similarity(spark):
    pairs = [("erba gold", "erbagold", 200 * 8 / 17), ("erba gold", "erba glod", 200 * 8 / 18), ("xj 1861 naxos", "naxos", 200 * 5 / 18), ("collection noir chergui", "chergui", 200 * 7 / 30), ("b a", "a b", 100.0), ("", "", 100.0), ("", "x", 0.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in rows.select("*", S.token_sort_ratio(F.col("a"), F.col("b")).alias("s"), S.ratio_bound(F.col("a"), F.col("b")).alias("bound")).collect():
        assert abs(r["s"] - r["want"]) < 1e-9
        assert r["bound"] >= r["s"] - 1e-9
    got = rows.limit(1).select(S.words_within(F.lit("naxos"), F.lit("xj 1861 naxos")), S.words_within(F.lit("sauvage elixir"), F.lit("sauvage")), S.words_within(F.lit(""), F.lit("x"))).first()
    assert tuple(got) == (True, False, False)


def test_common_letters(spark):
    """Against the table of all prefixes, over one and several whole numbers of bits; no bound is below the score."""
    rng = random.Random(1)
    some = lambda sizes: "".join(rng.choice("ab c dé😀") for _ in range(rng.choice(sizes)))
    pairs = [(some([0, 1, 5, 20, 61, 62, 63, 64, 130]), some([0, 1, 5, 20, 62, 90])) for _ in range(300)]
    bags = [S.counted_letters(S.sorted_words(F.col(c))) for c in "ab"]
    rows = spark.createDataFrame(pairs, "a string, b string").select("*", S.common_letters(F.col("a"), F.col("b")).alias("n"), S.token_sort_ratio(F.col("a"), F.col("b")).alias("s"), S.letters_bound(*bags).alias("bound"))
    for r in rows.collect():
        best = [0] * (len(r["b"]) + 1)
        for x in r["a"]:
            new = [0]
            for j, y in enumerate(r["b"]):
                new.append(best[j] + 1 if x == y else max(best[j + 1], new[j]))
            best = new
        assert r["n"] == best[-1] and r["bound"] >= r["s"] - 1e-9
