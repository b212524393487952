"""Relations of the star schema on repeated and tied lines, and how often their lines are shuffled."""

import duckdb
import pytest

from offerlens.plans import tables as T

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    from datetime import datetime

    root = str(tmp_path_factory.mktemp("star"))
    rows = [(i % 40, i % 11, i * 7 % 13, i % 5, float(i % 9), 100.0 + i % 17, 0.0, 0.0, "N", "OF"[i % 2], datetime(2020, 1 + i % 7, 1)) for i in range(400)]
    rows += rows[::3] + rows[:50]  # whole rows again
    rows += [(o, p, s, n, q + 1, *rest) for o, p, s, n, q, *rest in rows[:60]]  # of one order, number, part and supplier, but another quantity
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{root}/lineitem.parquet")
    parts = [(i, f"name {i % 4}", f"brand {i % 2}", f"type {i % 3}", i % 3, 9.0) for i in range(11)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{root}/part.parquet")
    return root


def oracle(root, names):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet/*.parquet')")
    return con, lambda columns: sorted(map(tuple, con.execute(T.sql(" ".join(names), f"SELECT {columns} FROM {names[-1]}")).fetchall()))


@pytest.mark.parametrize("made,names,columns", [
    (T.obs, ["obs"], "variant_id, store_id, price, availability, run_id, seq"), (T.offers, ["obs", "offers"], "variant_id, store_id, price, availability, run_id, seq"),
    (T.offered, ["obs", "offers"], "variant_id, store_id"), (T.accords, ["accords"], "item_id, accord, strength, position"), (T.notes, ["notes"], "item_id, name"), (T.edges, ["edges"], "src, dst"),
])
def test_repeated_lines_count_once(spark, shop, made, names, columns):
    con, rows = oracle(shop, names)
    assert sorted(map(tuple, made(spark, shop).selectExpr(*columns.split(", ")).collect())) == rows(columns)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("made,most", [(T.obs, 1), (T.offers, 1), (T.offered, 1), (T.edges, 3)])
def test_lines_are_shuffled_once(spark, shop, made, most):
    assert _shuffles(made(spark, shop)) <= most


def test_more_rows_are_dealt_to_more_tasks(spark, shop, monkeypatch):
    monkeypatch.setattr(T, "TASK_ROWS", 10)
    assert T.obs(spark, shop).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_runs_from_the_last(spark, shop):
    assert [r[0] for r in T.last_runs(spark, shop).limit(2).collect()] == [2020 * 12 + 7, 2020 * 12 + 6]


def _reads_lines(df):
    return any("lineitem" in x for x in df.inputFiles())


def test_a_run_reads_the_lines_once(spark, shop):
    from offerlens.plans import queries as Q

    after = Q._after_run(spark, shop)
    assert after.snapshot.count() and after.variants.count()
    assert not any(_reads_lines(x) for x in (after.snapshot, after.variants, after.history, after.queue))


def test_the_parts_of_the_insights_share_edges_and_accords(spark, shop):
    from offerlens.operators.collection import insights

    items = T.accords(spark, shop).selectExpr("item_id", "'x' AS name", "'y' AS brand").distinct()
    parts = insights(spark.createDataFrame(items.collect(), items.schema), T.accords(spark, shop), T.notes(spark, shop), T.edges(spark, shop))
    assert not any(_reads_lines(parts[x]) for x in ("counts", "dna", "contributors", "accords"))


def test_updated_components_read_the_lines_once(spark, shop):
    from offerlens.plans import queries as Q

    assert not _reads_lines(Q.components_updated(spark, shop))


def test_listings_of_some_runs_are_those_of_all(spark, shop):
    from offerlens.plans import shop as SH

    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(SH.listed(spark, shop, [24247, 24245])) == rows(SH.listed(spark, shop).where("run_id IN (24245, 24247)")) != []
