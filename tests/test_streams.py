"""Streams give what the batch operators give."""

import random
from datetime import datetime
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from offerlens.operators import health, history
from offerlens.streaming import streams


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_change_only_stream_equals_batch(spark, tmp_path):
    rows = [(s, datetime(2024, 1, 1 + t), t, D(p), a) for s, t, p, a in [(1, 0, "5", "in_stock"), (1, 1, "5", "in_stock"), (1, 2, "6", "in_stock"), (2, 0, "1", "in_stock"), (1, 3, "6", "out_of_stock"), (2, 1, "1", "in_stock")]]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, streams.HISTORY).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append" if i else "overwrite")
    stream = spark.readStream.schema(streams.HISTORY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, streams.change_only(stream), "changes", "append")
    want = history.change_only(spark.createDataFrame(rows, streams.HISTORY), ["series_id"], ["recorded_at", "seq"])
    key = lambda df: sorted(tuple(r) for r in df.select("series_id", "seq", "price", "availability").collect())
    assert key(got) == key(want)


def test_health_stream_equals_batch(spark, tmp_path):
    schema = "store_id long, created_at int, result_id int, status string"
    rows = [(1 + i % 2, i, i, "scraping_error" if i % 5 else "in_stock") for i in range(60)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(spark, streams.store_health(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "health", "update")
    want = health.store_health(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_snapshot_stream(spark, tmp_path):
    """Two runs in one micro-batch, or in two: the later run's row counts, within a run the one in stock."""
    schema = "store_id long, variant_id long, run_id long, seq int, price decimal(10,2), availability string"
    runs = [[(1, 1, 1, 0, D("5"), "in_stock"), (1, 1, 1, 1, D("4"), "out_of_stock")], [(1, 1, 2, 0, D("6"), "out_of_stock"), (1, 2, 2, 1, D("3"), "in_stock")]]
    for files in (1, 2):
        source, versions = str(tmp_path / f"in{files}"), []
        for i, rows in enumerate(runs):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source, mode="append" if i else "overwrite")

        def write(df, number, files=files, versions=versions):
            path = str(tmp_path / f"v{files}-{number}")
            df.write.parquet(path)
            versions.append(path)

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        writer = streams.snapshot_writer(stream, lambda versions=versions: spark.read.parquet(versions[-1]) if versions else None, write)
        writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp{files}")).start().awaitTermination(120)
        last = spark.read.parquet(versions[-1]).orderBy("variant_id").collect()
        assert len(versions) == 3 - files
        assert [(r["variant_id"], r["price"], r["availability"]) for r in last] == [(1, D(6), "out_of_stock"), (2, D(3), "in_stock")]
        assert all(r["first_seen_at"] <= r["last_seen_at"] for r in last)


def test_alert_stream(spark, tmp_path):
    schema = "variant_id long, offer_id long, price decimal(10,2), availability string"
    spark.createDataFrame([(1, 1, D(5), "in_stock"), (1, 2, D(50), "in_stock")], schema).write.parquet(str(tmp_path / "in"))
    alerts = spark.createDataFrame([(9, 1, D(10), True)], "alert_id long, variant_id long, target_price decimal(10,2), enabled boolean")
    got = run(spark, streams.alert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), alerts), "fired", "append")
    assert [(r["alert_id"], r["offer_id"]) for r in got.select("alert_id", "offer_id").collect()] == [(9, 1)]
    assert got.where(F.col("price") > 10).count() == 0


def splits(spark, rows, schema, folder, seed):
    """The rows as a stream of files, shuffled and cut at random; one file for each micro-batch."""
    rng, rest = random.Random(seed), list(rows)
    rng.shuffle(rest)
    while rest:
        n = rng.randint(1, len(rest))
        spark.createDataFrame(rest[:n], schema).coalesce(1).write.parquet(folder, mode="append")
        rest = rest[n:]
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def last_of(spark, df, folder, keys):
    """What an updating stream says last of each key."""
    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[tuple(r[k] for k in keys)] = tuple(r)

    df.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).option("checkpointLocation", folder).start().awaitTermination(180)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_a_split_run_gives_the_same_snapshot(spark, tmp_path, seed):
    schema = "store_id long, variant_id long, run_id long, seq int, price decimal(10,2), availability string"
    rng = random.Random(9)
    rows = [(rng.randint(1, 2), rng.randint(1, 3), rng.randint(1, 3), i, D(rng.randint(1, 9)), rng.choice(["in_stock", "out_of_stock"])) for i in range(40)]
    versions = []

    def write(df, number):
        versions.append(str(tmp_path / f"v{number}"))
        df.write.parquet(versions[-1])

    stream = splits(spark, rows, schema, str(tmp_path / "in"), seed)
    streams.snapshot_writer(stream, lambda: spark.read.parquet(versions[-1]) if versions else None, write).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    want = {}
    for row in sorted(rows, key=lambda r: (r[2], r[5] == "in_stock", -r[4], -r[3])):
        want[row[:2]] = row
    got = spark.read.parquet(versions[-1]).select("store_id", "variant_id", "run_id", "seq", "price", "availability").collect()
    assert sorted(map(tuple, got)) == sorted(want.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_queue_stream(spark, tmp_path, seed):
    """Finds and decisions in any order of arrival equal the batch operators run by run."""
    find = lambda url, run, seq, price: (1, 1, url, run, seq, None, f"name {price}", str(price), 80.0 + seq)
    decide = lambda url, run, what: (1, 1, url, run, 99, what, None, None, None)
    rows = [find("a", 1, 0, 5), find("a", 1, 1, 6), find("a", 3, 0, 7), decide("a", 4, "confirmed"), find("a", 5, 0, 8), decide("a", 6, "rejected"), find("b", 2, 0, 1), find("b", 4, 0, 2), decide("c", 1, "confirmed"), find("c", 2, 0, 3), decide("d", 1, "rejected")]
    got = last_of(spark, streams.review_queue(splits(spark, rows, streams.QUEUE_EVENT, str(tmp_path / "in"), seed)), str(tmp_path / "cp"), ["product_url"])
    assert {k[0]: v[3:] for k, v in got.items()} == {
        "a": ("name 7", "7", 80.0, "confirmed", 1, 3, 4), "b": ("name 2", "2", 80.0, "pending", 2, 4, None), "c": ("name 3", "3", 80.0, "pending", 2, 2, None),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_trigger_stream(spark, tmp_path, seed):
    """Against the alerts' batch evaluation after each run."""
    from offerlens.operators import alerts as alerting

    schema = "variant_id long, store_id long, run_id long, seq int, price decimal(10,2), availability string"
    rng = random.Random(5)
    rows = [(rng.randint(1, 3), rng.randint(1, 2), run, i, D(rng.randint(1, 20)), rng.choice(["in_stock", "out_of_stock"])) for i, run in enumerate([1, 1, 1, 2, 2, 3, 3, 3, 3, 4, 4, 5])]
    alerts = spark.createDataFrame([(v * 10 + n, v, D(t), n < 2, None, None) for v in (1, 2, 3) for n, t in enumerate((4, 11, 30))], "alert_id long, variant_id long, target_price decimal(10,2), enabled boolean, last_triggered_at int, last_triggered_price decimal(10,2)")
    got = last_of(spark, streams.alert_triggers(splits(spark, rows, schema, str(tmp_path / "in"), seed), alerts), str(tmp_path / "cp"), ["alert_id"])
    state, now = alerts, {}
    for run in range(1, 6):
        touched = {r[0] for r in rows if r[2] == run}
        for r in sorted((r for r in rows if r[2] == run), key=lambda r: (r[5] != "in_stock", r[4], r[3]), reverse=True):
            now[r[:2]] = r
        offers = spark.createDataFrame([(r[0], r[1], r[4], r[5]) for r in now.values() if r[0] in touched], "variant_id long, offer_id long, price decimal(10,2), availability string")
        after = alerting.persist_triggers(state, offers, F.lit(run)).collect()
        state = spark.createDataFrame([tuple(r[c] for c in alerts.columns) for r in after], alerts.schema)
    want = {(r["alert_id"],): (r["variant_id"], r["alert_id"], r["last_triggered_at"], str(r["last_triggered_price"])) for r in state.where("last_triggered_at IS NOT NULL").collect()}
    assert got == want and want
