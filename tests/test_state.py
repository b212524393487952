"""Versions of tables that change together, and runs from pages to the next version of a stored state."""

import json
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from offerlens.operators import offers as O
from offerlens.plans import ingest
from offerlens.sources import pages as P
from offerlens.sources.versions import Conflict, Layout, Versions

LAYOUTS = {"rows": Layout("k long, v string", "k"), "one": Layout("x int"), "facts": Layout("k long", None, True)}


def tables(spark, folder, buckets=8):
    return Versions(spark, str(folder), LAYOUTS, buckets)


def counts(df):
    return {r["v"]: r["count"] for r in df.groupBy("v").count().collect()}


def test_a_commit_rewrites_only_what_it_touches(spark, tmp_path):
    t = tables(spark, tmp_path)
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    assert t.current() == 0 and t.read("rows").count() == t.read("facts").count() == 0
    assert t.commit(0, {"rows": rows, "one": spark.createDataFrame([(1,), (2,)], "x int")}, {"facts": rows.select("k")}) == 1
    only = t.touched(spark.createDataFrame([(5,), (5,), (None,)], "k long").where("k IS NOT NULL"))
    part = t.read("rows", only=only)
    assert len(only) == 1 and {r[0] for r in part.select(t.bucket_of("k")).distinct().collect()} == set(only)
    assert len(part.inputFiles()) < len(t.read("rows").inputFiles())
    n = part.count()
    assert t.commit(1, {"rows": part.withColumn("v", F.lit("new"))}, {"facts": rows.select("k").limit(3)}, only) == 2
    assert counts(t.read("rows")) == {"new": n, "old": 1000 - n} and counts(t.read("rows", 1)) == {"old": 1000}
    assert (t.read("facts").count(), t.read("facts", 1).count(), t.read("one").count()) == (1003, 1000, 2)
    # the second version's folder has only the bucket that changed
    made = sorted(p.name for p in tmp_path.glob("rows/*/bucket=*") if p.parent.stat().st_mtime == max(x.stat().st_mtime for x in (tmp_path / "rows").iterdir()))
    assert made == [f"bucket={only[0]}"]
    with pytest.raises(ValueError, match="were not read"):
        t.commit(2, {"rows": rows}, None, only)
    # a bucket may lose all its rows, and what no kept version names can go
    assert t.commit(2, {"rows": part.limit(0)}, None, only) == 3 and t.read("rows").count() == 1000 - n
    assert len(t.expire(1)) == 1 and t.read("rows").count() == 1000 - n
    assert Versions(spark, str(tmp_path), LAYOUTS, 99).buckets == 8


def test_of_two_writers_one_is_told(spark, tmp_path):
    t = tables(spark, tmp_path)
    row = lambda v: spark.createDataFrame([(1, v)], "k long, v string")

    def write(v):
        try:
            return t.commit(0, {"rows": row(v)}, {"facts": row(v).select("k")})
        except Conflict:
            return v

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, "abcd"))
    assert got.count(1) == 1
    won = "abcd"[got.index(1)]
    assert counts(t.read("rows")) == {won: 1} and t.read("facts").count() == 1 and t.current() == 1


def test_merge_of_a_batch_is_the_upsert(spark):
    old = spark.createDataFrame([(s, v, f"{s}{v}", 1, 1) for s in range(3) for v in range(4)], "store_id long, variant_id long, title string, first_seen_at int, last_seen_at int")
    batch = spark.createDataFrame([(0, 0, None), (1, 3, "new"), (7, 7, "more")], "store_id long, variant_id long, title string")
    known = old.join(batch.select(*O.KEY), O.KEY, "left_semi")
    rows = lambda df: sorted(map(repr, df.select(*old.columns).collect()))
    assert rows(O.merge_batch(old, batch, known, F.lit(9))) == rows(O.upsert_snapshot(old, batch, F.lit(9)))


# -- runs ----------------------------------------------------------------------------------------------------------

FETCH = "perfume_id long, store_slug string, url string, error_status string, error_message string"
AT = lambda day: F.lit(f"2024-05-{day:02} 10:00:00").cast("timestamp_ntz")
EXTRACTORS = {"ld": P.json_ld, "radio": P.radio_combinations}


def ld(name, price, there=True):
    stock = "https://schema.org/InStock" if there else "https://schema.org/OutOfStock"
    return f'<script type="application/ld+json">{json.dumps({"@type": "Product", "name": name, "brand": {"name": "Amber House"}, "offers": {"price": price, "sku": "s", "availability": stock}})}</script>'


def begun(spark, folder):
    t = ingest.open_state(spark, str(folder), 8)
    names = spark.createDataFrame([(1, "Amber House", "Still Water"), (2, "Amber House", "Loud Stone"), (3, "Amber House", "Far Field")], "perfume_id long, brand string, name string")
    nothing = {c: F.lit(None) for c in ("normalized_brand", "normalized_name", "created_at", "updated_at", "last_checked_at")}
    shops = [(1, "one", "n", "b", None, True), (2, "two", "n", "b", "ld", True), (3, "off", "n", "b", "ld", False), (4, "odd", "n", "b", "nobody", True)]
    stores = spark.createDataFrame(shops, "store_id long, slug string, name string, base_url string, extractor string, enabled boolean").withColumns({"last_successful_check": F.lit(None), "last_error": F.lit(None)})
    t.commit(0, {"catalog": names.withColumns(nothing), "stores": stores})
    return t


def go(spark, t, run, pages, fetches, extractors=None):
    frame = spark.createDataFrame(pages, "store_slug string, url string, html string")
    return ingest.store_run(t, frame, spark.createDataFrame([(*f, *[None] * (5 - len(f))) for f in fetches], FETCH), {"one": P.json_ld, **EXTRACTORS} if extractors is None else extractors, run, AT(run))


def results(t, run):
    return {(r["perfume_id"], r["store_id"]): (r["status"], r["offers_found"], r["error_message"]) for r in t.read("results").where(F.col("run_id") == run).collect()}


def test_runs_from_pages(spark, tmp_path):
    t = begun(spark, tmp_path)
    water, stone = ld("Still Water Eau de Parfum 50 ml", "100.00"), ld("Loud Stone Eau de Parfum 30 ml", "80.00")
    pages = [("one", "u/1", water), ("two", "u/2", water.replace("100.00", "90.00")), ("off", "u/3", water), ("two", "u/4", stone), ("two", "unasked", stone), ("odd", "u/5", water)]
    fetches = [(1, "one", "u/1"), (1, "two", "u/2"), (1, "off", "u/3"), (2, "two", "u/4"), (2, "one", None, "store_unavailable", "timed out"), (1, "odd", "u/5"), (2, "two", "u/2")]
    assert go(spark, t, 1, pages, fetches) == 2
    # a page that was fetched for two perfumes is compared with both
    assert results(t, 1) == {(1, 1): ("in_stock", 1, None), (1, 2): ("in_stock", 1, None), (2, 2): ("in_stock", 1, None), (2, 1): ("store_unavailable", 0, "timed out"), (1, 4): ("scraping_error", 0, "no extractor for nobody")}
    head = t.read("runs").first()
    assert (head["run_type"], head["status"], head["perfume_count"], head["store_count"]) == ("all", "completed_with_errors", 2, 3)
    known = {r["slug"]: (r["last_successful_check"] and r["last_successful_check"].day, r["last_error"]) for r in t.read("stores").collect()}
    assert known == {"one": (1, "timed out"), "two": (1, None), "off": (None, None), "odd": (None, "no extractor for nobody")}
    assert {r["perfume_id"]: r["last_checked_at"] and r["last_checked_at"].day for r in t.read("catalog").collect()} == {1: 1, 2: 1, 3: None}
    assert sorted((r["store_id"], r["perfume_id"], r["price"]) for r in t.read("snapshot").collect()) == [(1, 1, D(100)), (2, 1, D(90)), (2, 2, D(80))]
    # the same run again changes nothing
    assert go(spark, t, 1, pages, fetches) == 2 and t.read("results").count() == 5
    # second run: store one's page is broken, store two has nothing any more
    variant = t.read("variants").where("perfume_id = 1").first()["variant_id"]
    alert = spark.createDataFrame([(5, variant, D(120), "RON", True, None, None, 1)], t.layouts["alerts"].schema)
    assert t.commit(2, {"alerts": alert}, None, t.touched(alert.select("perfume_id"))) == 3
    assert go(spark, t, 2, [("one", "u/1", "<p>sorry</p>")], [(1, "one", "u/1"), (1, "two", None)]) == 4
    assert results(t, 2) == {(1, 1): ("scraping_error", 0, "structure not recognised"), (1, 2): ("not_found", 0, None)}
    assert sorted((r["store_id"], r["perfume_id"], r["availability"]) for r in t.read("snapshot").collect()) == [(1, 1, "in_stock"), (2, 1, "out_of_stock"), (2, 2, "in_stock")]
    assert sorted((r["run_id"], r["store_id"], r["availability"], r["price"]) for r in t.read("history").collect()) == [(1, 1, "in_stock", D(100)), (1, 2, "in_stock", D(80)), (1, 2, "in_stock", D(90)), (2, 2, "out_of_stock", D(90))]
    # alerts of a checked perfume are evaluated though it got no new offer: store one still has it for 100
    assert [(r["last_triggered_price"], r["last_triggered_at"].day) for r in t.read("alerts").collect()] == [(D(100), 2)]
    assert t.read("snapshot", 2).where("availability = 'in_stock'").count() == 3  # the version before is as it was


def test_a_run_reads_and_writes_its_perfumes_buckets(spark, tmp_path):
    t = begun(spark, tmp_path)
    before = {p for p in tmp_path.glob("catalog/*/bucket=*")}
    go(spark, t, 1, [("one", "u", ld("Far Field Eau de Parfum 30 ml", "10.00"))], [(3, "one", "u")])
    only = t.touched(spark.createDataFrame([(3,)], "perfume_id long"))
    for name in ("catalog", "snapshot", "variants"):
        assert {int(p.name[7:]) for p in set(tmp_path.glob(f"{name}/*/bucket=*")) - before} == set(only)
    assert t.read("catalog").count() == 3


def test_no_extractors_no_fetches_and_a_second_writer(spark, tmp_path, monkeypatch):
    t = begun(spark, tmp_path)
    assert go(spark, t, 1, [("one", "u", "x")], [(1, "one", "u")], {}) == 2
    assert results(t, 1) == {(1, 1): ("scraping_error", 0, "no extractor for one")}
    assert go(spark, t, 2, [], []) == 3 and results(t, 2) == {}
    assert [r["status"] for r in t.read("runs").where("run_id = 2").collect()] == ["completed"]
    base = t.current()
    monkeypatch.setattr(t, "current", lambda: base)
    assert go(spark, t, 3, [], [(2, "two", None)]) == 4
    with pytest.raises(Conflict):
        go(spark, t, 4, [], [(1, "two", None)])
    monkeypatch.undo()
    assert results(t, 4) == {} and t.read("runs").count() == 3


def test_decisions_on_a_stored_queue(spark, tmp_path):
    t = begun(spark, tmp_path)
    page = ld("Still Water Night Eau de Parfum 50 ml", "100.00")
    go(spark, t, 1, [("one", "u/1", page)], [(1, "one", "u/1")])
    assert results(t, 1) == {(1, 1): ("not_found", 0, None)} and [r["status"] for r in t.read("queue").collect()] == ["pending"]
    decided = spark.createDataFrame([(1, 1, "u/1", "confirmed")], "perfume_id long, store_id long, product_url string, decision string")
    version = ingest.store_decisions(t, decided, AT(2))
    assert [(r["status"], r["resolved_at"].day) for r in t.read("queue").collect()] == [("confirmed", 2)]
    assert [(r["price"], r["perfume_id"]) for r in t.read("snapshot").collect()] == [(D(100), 1)] and [r["run_id"] for r in t.read("history").collect()] == [None]
    assert [r["normalized_alias"] for r in t.read("aliases").collect()] == ["still water night"]
    go(spark, t, 2, [("one", "u/1", page.replace("100.00", "95.00"))], [(1, "one", "u/1")])
    assert results(t, 2) == {(1, 1): ("in_stock", 1, None)} and t.current() == version + 1


def test_a_stream_of_fetches_is_a_run_for_each_batch(spark, tmp_path):
    t = begun(spark, tmp_path / "state")
    schema = "perfume_id long, store_slug string, url string, html string, error_status string, error_message string"
    water = lambda price: ld("Still Water Eau de Parfum 50 ml", price)
    for rows in ([(1, "one", "u/1", water("100.00"), None, None), (1, "two", None, None, "store_unavailable", "timed out")], [(1, "one", "u/1", water("95.00"), None, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    extractors = {"one": P.json_ld, **EXTRACTORS}

    def play(folder):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.run_stream(t, stream, extractors, AT(1)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / folder)).start().awaitTermination(300)

    play("a")
    assert results(t, 1) == {(1, 1): ("in_stock", 1, None), (1, 2): ("store_unavailable", 0, "timed out")} and results(t, 2) == {(1, 1): ("in_stock", 1, None)}
    assert [r["price"] for r in t.read("snapshot").collect()] == [D(95)] and t.read("history").count() == 2
    version = t.current()
    play("b")  # the same micro-batches again
    assert t.current() == version and t.read("history").count() == 2
