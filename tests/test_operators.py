"""Operators on small tables: golden values, empty input, order independence."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from offerlens.operators import alerts, collection, compare, graph, health, history, matching, offers, overlap, review

OBS = "series long, recorded_at int, seq int, price decimal(10,2), availability string, run_id int"


def obs(spark, rows):
    return spark.createDataFrame([(s, t, q, D(p), a, r) for s, t, q, p, a, r in rows], OBS)


def test_change_only_and_append(spark):
    h = obs(spark, [(1, 1, 1, "799", "in_stock", 1), (1, 2, 2, "799", "in_stock", 2), (1, 3, 3, "749", "in_stock", 3), (1, 4, 4, "749", "out_of_stock", 4)])
    kept = history.change_only(h.orderBy(F.desc("seq")), ["series"], ["recorded_at", "seq"])
    assert sorted(r["seq"] for r in kept.collect()) == [1, 3, 4]
    again = history.append_changes(kept, h.where("seq = 4"), ["series"], ["recorded_at", "seq"])
    assert again.count() == 0
    assert history.append_changes(kept.limit(0), h.where("seq = 4"), ["series"], ["recorded_at", "seq"]).count() == 1


def test_moves_and_drops(spark):
    h = obs(spark, [(1, 5, 1, "799", "in_stock", 1), (1, 4, 2, "749", "in_stock", 2), (2, 1, 1, "10", "in_stock", 2), (3, 1, 1, "5", "in_stock", 1), (3, 2, 2, "5", "out_of_stock", 2)])
    moved = history.moves_of_run(h, ["series"], ["seq"], "run_id").collect()
    assert [(r["seq"], r["recency"]) for r in history.series_history(h, h.where("series = 3"), ["series"], ["recorded_at", "seq"]).orderBy("recency").collect()] == [(2, 1), (1, 2)]
    assert [(r["series"], r["delta"]) for r in moved] == [(1, D("-50.00"))]
    assert history.real_drop(h, ["series"], ["recorded_at", "seq"]).count() == 0  # by time the price rose
    s = history.price_stats(obs(spark, [(1, 1, 1, "799", "", 1), (1, 2, 2, "749", "", 1), (1, 3, 3, "699", "", 1)]), ["series"]).first()
    assert (s["min_price"], s["max_price"], s["avg_price"], s["entries"]) == (D("699.00"), D("799.00"), D("749.00"), 3)


@pytest.mark.parametrize("rows,want", [([("850", "in_stock"), ("799", "in_stock")], "799"), ([("500", "out_of_stock"), ("799", "in_stock")], "799"), ([("1", "out_of_stock")], None), ([], None)])
def test_best_offer(spark, rows, want):
    v = spark.createDataFrame([(1, 100)], "variant_id long, volume_ml int")
    o = spark.createDataFrame([(1, i, D(p), a) for i, (p, a) in enumerate(rows)], "variant_id long, offer_id int, price decimal(10,2), availability string")
    got = compare.best_offer_per_variant(v, o).first()["price"]
    assert got == (None if want is None else D(want))


def test_best_value_is_per_volume(spark):
    b = spark.createDataFrame([("p", 1, 100, D(500)), ("p", 2, 30, D(200))], "perfume string, variant_id long, volume_ml int, price decimal(10,2)")
    assert compare.best_value_per_perfume(b, ["perfume"]).first()["variant_id"] == 1


def test_dashboard_orders(spark):
    rows = spark.createDataFrame([("b", "x", D(1), None), ("A", "y", None, 5), ("c", "z", D(3), 2)], "brand string, name string, price decimal(10,2), last_checked_at int")
    brands = lambda *a: [r["brand"] for r in compare.dashboard_order(rows, *a).collect()]
    assert brands("name") == ["A", "b", "c"]
    assert brands("best_price", "desc") == ["c", "b", "A"]
    assert brands("best_price", "asc") == ["b", "c", "A"]
    assert brands("last_checked", "asc") == ["b", "c", "A"]
    assert brands("unknown", "desc") == ["c", "b", "A"]
    assert compare.search(rows, " A ", "brand", "name").count() == 1
    assert compare.search(rows, "  ", "brand").count() == 3


def test_alerts(spark):
    a = spark.createDataFrame([(1, 1, D(100), True), (2, 1, D(99), True), (3, 1, D(500), False), (4, 2, D(500), True)], "alert_id long, variant_id long, target_price decimal(10,2), enabled boolean")
    o = spark.createDataFrame([(1, 7, D(100), "in_stock"), (2, 8, D(1), "out_of_stock")], "variant_id long, offer_id long, price decimal(10,2), availability string")
    assert [r["alert_id"] for r in alerts.triggered(a, o).collect()] == [1]


def test_health(spark):
    rows = [(1, 3, 3, "store_unavailable"), (1, 2, 2, "scraping_error"), (1, 1, 1, "in_stock"), (2, 2, 2, "in_stock"), (2, 1, 1, "scraping_error"), (3, 1, 1, "scraping_error")]
    r = spark.createDataFrame(rows, "store_id long, created_at int, result_id int, status string")
    got = {x["store_id"]: (x["healthy"], x["total"], x["failing_in_a_row"]) for x in health.store_health(r).collect()}
    assert got == {1: (1, 3, 2), 2: (1, 2, 0), 3: (0, 1, 1)}
    roll = {x["store_id"]: (x["last_successful_check"], x["last_error"]) for x in health.store_rollup(r).collect()}
    assert roll == {1: (1, "store_unavailable"), 2: (2, None), 3: (None, "scraping_error")}


def test_dedup_in_run(spark):
    schema = "store_id long, variant_id long, price decimal(10,2), availability string, ordinal int"
    both = spark.createDataFrame([(1, 1, D(363), "in_stock", 0), (1, 1, D(330), "in_stock", 1), (1, 2, D(330), "out_of_stock", 0), (1, 2, D(363), "in_stock", 1)], schema)
    assert {r["variant_id"]: r["price"] for r in offers.dedup_in_run(both).collect()} == {1: D(330), 2: D(363)}


LADDER = [
    ("Xerjoff", "Erba Gold", "Erba Gold EDP 100 ml", "EDP", "exact", None),
    ("Xerjoff", "Erba Gold", "gift set", "EDP", "rejected", "excluded:gift_set"),
    ("Xerjoff", "Erba Pura", "Erba Pura", "EDP", "rejected", "name_mismatch"),
    ("Xerjoff", "Erba Gold Intense", "Erba Gold Intense", "EDP", "ambiguous", "name_containment_score=69"),
    ("Xerjoff", "Gold Erba", "t", "EDP", "high_confidence", "name_fuzzy_score=100"),
    ("Xerjoff", "ErbaGold", "ErbaGold", "EDP", "high_confidence", "name_fuzzy_score=94"),
    ("Xerjoff", "Erba Glod", "Erba Glod", "EDP", "ambiguous", "name_fuzzy_score=89"),
    ("Xerjoff", "Erba Gold", "Erba Gold", None, "ambiguous", "missing_variant_fields"),
    ("Xerjoff", "Confirmed Alias", "t", "EDP", "exact", "confirmed_name_alias"),
    ("Dior", "Erba Gold", "Erba Gold", "EDP", "rejected", "brand_mismatch"),
]


def test_match_ladder(spark):
    rows = [("Xerjoff", "Erba Gold", ["confirmed alias"], i, b, n, t, c, 100) for i, (b, n, t, c, _, _) in enumerate(LADDER)]
    pairs = spark.createDataFrame(rows, "brand string, name string, aliases array<string>, i int, candidate_brand string, candidate_name string, raw_title string, concentration string, volume_ml int")
    got = [(r["confidence"], r["reason"]) for r in matching.decide(pairs).orderBy("i").collect()]
    assert got == [(c, r) for *_, c, r in LADDER]
    scores = [r["score"] for r in matching.decide(pairs).orderBy("i").collect()]
    assert [s is not None for s in scores] == ["_score=" in (r or "") for *_, r in LADDER]


def test_brand_alias_joins(spark):
    catalog = spark.createDataFrame([(1, "Dior", "Sauvage")], "perfume_id long, brand string, name string")
    found = spark.createDataFrame([("Christian Dior", "Sauvage"), ("Diorissimo", "Sauvage")], "candidate_brand string, candidate_name string")
    assert [r["candidate_brand"] for r in matching.candidate_pairs(catalog, found).collect()] == ["Christian Dior"]


def test_review_queue(spark):
    schema = "perfume_id long, store_id long, product_url string, match_score double, status string, first_seen_at int, last_seen_at int"
    queue = spark.createDataFrame([(1, 1, "a", 80.0, "pending", 1, 1), (2, 1, "b", 80.0, "rejected", 1, 1)], schema)
    found = spark.createDataFrame([(1, 1, "a", 85.0), (2, 1, "b", 85.0), (3, 1, "c", 75.0)], "perfume_id long, store_id long, product_url string, match_score double")
    merged = review.merge_queue(queue, found, F.lit(2))
    got = {r["perfume_id"]: (r["match_score"], r["status"], r["first_seen_at"], r["last_seen_at"]) for r in merged.collect()}
    assert got == {1: (85.0, "pending", 1, 2), 2: (80.0, "rejected", 1, 1), 3: (75.0, "pending", 2, 2)}
    assert review.pending_count(merged).first()[0] == 2
    decided = review.apply_decisions(merged.withColumn("resolved_at", F.lit(None).cast("int")), found.withColumn("decision", F.lit("confirmed")), F.lit(3))
    assert {r["perfume_id"]: (r["status"], r["resolved_at"]) for r in decided.collect()} == {1: ("confirmed", 3), 2: ("rejected", None), 3: ("confirmed", 3)}
    assert review.merge_queue(decided.drop("resolved_at"), found, F.lit(9)).where("last_seen_at = 9").count() == 0


def test_families(spark):
    a = spark.createDataFrame([(1, " Citrus ", 90), (1, "woody", 10)], "item_id long, accord string, strength long")
    got = {r["family"]: r["percentage"] for r in collection.family_shares(collection.with_family(a)).collect()}
    assert got == {"Citrus": D("90.0"), "Woods": D("10.0")}
    other = spark.createDataFrame([(1, "plastic", 3)], "item_id long, accord string, strength long")
    assert [(r["family"], r["percentage"]) for r in collection.family_shares(collection.with_family(other)).collect()] == [("Other", D("100.0"))]
    assert collection.family_shares(collection.with_family(a.limit(0))).count() == 0
    assert collection.family_shares(collection.with_family(a.withColumn("strength", F.lit(0).cast("long")))).count() == 0


def test_rank_attributes(spark):
    a = spark.createDataFrame([(1, "Amber", 50, 0), (2, "amber", 60, 0), (2, "Rose", 90, 1), (2, " ", 99, 2)], "item_id long, accord string, strength long, position int")
    top = collection.rank_attributes(a, 2, "accord", strength="strength", order=["item_id", "position"]).orderBy("place").collect()
    assert [(r["label"], r["item_count"], r["score"], r["collection_percentage"], r["avg_intensity"]) for r in top] == [("Amber", 2, 110, 100, 55), ("Rose", 1, 90, 50, 90)]


def test_import(spark):
    found = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 2, None), ("c", 3, "z")], "url string, ordinal int, parsed string")
    new, counts = collection.import_items(spark.createDataFrame([("c",)], "url string"), found)
    assert [(r["url"], r["parsed"]) for r in new.collect()] == [("a", "x")]
    assert tuple(counts.first()) == (3, 1, 1, 1)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
    assert [tuple(r) for r in graph.cluster_edges(e).collect()] == [(1, 2)]
    one_way = spark.createDataFrame([(1, 2), (3, 1), (8, 9)], "src long, dst long")
    edges = graph.cluster_edges(one_way)
    parts = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert graph.connected_components(edges.limit(0)).count() == 0
    items = spark.createDataFrame([(i, f"n{i}") for i in (1, 2, 3, 8, 9)], "item_id long, name string")
    report = graph.cluster_report(edges, items)
    assert [(r["cluster"], r["number"], r["node"]) for r in report.orderBy("cluster", "number").collect()] == [(1, 1, 1), (1, 2, 3), (1, 3, 2), (2, 1, 9), (2, 2, 8)]
    assert graph.visible_edges(report, edges).count() == 3


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["component"] for r in graph.connected_components(edges).collect()} == {0}


def test_hubs_do_not_change_components(spark, monkeypatch):
    from offerlens.operators import skew

    monkeypatch.setattr(graph, "HUB_EDGES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    edges = spark.createDataFrame([(i, 0) for i in range(1, 60)] + [(i, 100) for i in range(101, 130)] + [(59, 60)], "a long, b long")
    parts = graph.connected_components(edges).groupBy("component").count().collect()
    assert {tuple(r) for r in parts} == {(0, 61), (100, 30)}


def test_join_once_is_a_join(spark):
    from offerlens.operators.skew import join_once

    rows = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 1), (3, 1), (None, 1)], "k int, x int")
    sums = spark.createDataFrame([(1, "a", 100), (2, "b", 1)], "k int, v string, n int")
    for how in ("inner", "left", "left_semi"):
        want = rows.join(sums.drop("n"), "k", how)
        assert sorted(map(str, join_once(rows, sums, ["k"], how=how).collect())) == sorted(map(str, want.collect()))


def test_overlap(spark):
    a = spark.createDataFrame([(1, "x", 3, 0), (1, "y", 4, 1), (2, "X", 6, 0), (2, "y ", 8, 1), (3, "z", 5, 0), (4, "x", 9, 0), (4, "x", 1, 1), (4, "z", 1, 2)], "item_id long, accord string, strength int, position int")
    got = overlap.overlap_report(overlap.vectors(a)).collect()
    assert (got[0]["a"], got[0]["b"], got[0]["percentage"], got[0]["shared"]) == (1, 2, 100.0, "y, x")
    pairs = {(r["a"], r["b"]): r["cosine"] for r in overlap.similar_pairs(overlap.vectors(a), 0.3).collect()}
    assert set(pairs) == {(1, 2), (1, 4), (2, 4), (3, 4)}
    assert abs(pairs[(3, 4)] - 1 / 2**0.5) < 1e-12
    assert overlap.overlap_report(overlap.vectors(a.limit(0))).count() == 0


def test_rows_are_numbered_in_order(spark):
    from offerlens.operators.order import numbered

    rows = spark.range(500).select(F.pmod(F.col("id") * 7919, F.lit(500)).alias("x"))
    got = numbered(rows, F.desc("x")).collect()
    assert all(r["row_number"] == 500 - r["x"] for r in got) and len(got) == 500
    assert numbered(rows.limit(0), "x").count() == 0


def test_catalog_names(spark):
    c = spark.createDataFrame([(1, " Dior ", " Sauvage Élixir ")], "perfume_id long, brand string, name string")
    assert tuple(matching.normalised_catalog(c).first())[1:] == ("Dior", "Sauvage Élixir", "dior", "sauvage elixir")
    named = spark.createDataFrame([(1, "b", "B"), (1, "a", "A"), (3, "x", "X")], "perfume_id long, normalized_alias string, alias string")
    assert matching.with_aliases(c, named).first()["aliases"] == ["a", "b"]
    titles = spark.createDataFrame([("CHRISTIAN DIOR Sauvage", "Dior"), ("Jean P. Gaultier Le Male", "Jean Paul Gaultier"), ("Armani Code", "Dior")], "title string, brand string")
    assert [r[0] for r in titles.select(matching.names_brand(F.col("title"), F.col("brand"))).collect()] == [True, True, False]


def test_replaced_children(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id long, name string")
    new, parents = spark.createDataFrame([(1, "z")], old.schema), spark.createDataFrame([(1,), (2,)], "item_id long")
    assert sorted(map(tuple, offers.replace_children(old, new, "item_id", parents).collect())) == [(1, "z"), (3, "c")]
    assert sorted(map(tuple, offers.replace_children(old, new, "item_id").collect())) == [(1, "z"), (2, "b"), (3, "c")]


def test_queue_takes_the_last_of_equal_keys(spark):
    queue = spark.createDataFrame([], "perfume_id long, store_id long, product_url string, match_score double, status string, first_seen_at int, last_seen_at int")
    found = spark.createDataFrame([(1, 1, "a", 85.0, 0), (1, 1, "a", 75.0, 1)], "perfume_id long, store_id long, product_url string, match_score double, ordinal int")
    assert [r["match_score"] for r in review.merge_queue(queue, found, F.lit(2)).collect()] == [75.0]


def test_health_report_has_every_store(spark):
    stores = spark.createDataFrame([(1, "a"), (2, "b")], "store_id long, name string")
    r = spark.createDataFrame([(1, 1, 1, "in_stock"), (1, 2, 2, "scraping_error")], "store_id long, created_at int, result_id int, status string")
    got = {x["store_id"]: (x["total"], x["failing_in_a_row"], x["strip"]) for x in health.health_report(stores, r).collect()}
    assert got == {1: (2, 1, ["in_stock", "scraping_error"]), 2: (0, 0, [])}


def test_snapshot_versions(spark, tmp_path):
    from offerlens.sources import storage

    root, rows = str(tmp_path / "snap"), spark.range(3)
    assert storage.read_current(spark, root) is None
    storage.write_snapshot(rows, root, 1)
    storage.publish(spark, root, 1)
    storage.write_snapshot(rows.limit(1), root, 2)  # not published: nobody reads it
    assert storage.read_current(spark, root).count() == 3
    storage.publish(spark, root, 2)
    assert storage.read_current(spark, root).count() == 1
    storage.append_facts(spark.createDataFrame([(1, "a")], "run_id long, status string"), str(tmp_path / "runs"))
    storage.append_facts(spark.createDataFrame([(2, "b")], "run_id long, status string"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_deletions_over_a_graph(spark):
    """Everything that hangs on a deleted perfume goes in one call: variants, offers, history, alerts, aliases and queue rows; a store takes its own."""
    from offerlens.operators.offers import delete_graph

    table = lambda kind, *rows: spark.createDataFrame(list(rows), kind)
    tables = {
        "history": table("store_id long, variant_id long, n int", (1, 10, 1), (2, 10, 2), (1, 20, 3), (None, 20, 4)), "offers": table("store_id long, variant_id long", (1, 10), (2, 20), (1, 20)),
        "variants": table("variant_id long, perfume_id long", (10, 1), (20, 2), (30, None)), "catalog": table("perfume_id long", (1,), (2,)), "alerts": table("alert_id long, variant_id long", (5, 10), (6, 20)),
        "aliases": table("perfume_id long, alias string", (1, "a"), (2, "b")), "queue": table("perfume_id long, store_id long", (1, 1), (2, 1), (2, 2)), "stores": table("store_id long", (1,), (2,)),
    }
    links = [("variants", "perfume_id", "catalog", "perfume_id"), ("aliases", "perfume_id", "catalog", "perfume_id"), ("queue", "perfume_id", "catalog", "perfume_id"), ("queue", "store_id", "stores", "store_id"), ("alerts", "variant_id", "variants", "variant_id")]
    links += [(t, "variant_id", "variants", "variant_id") for t in ("offers", "history")] + [(t, "store_id", "stores", "store_id") for t in ("offers", "history")]
    left = delete_graph(tables, {"catalog": table("perfume_id long", (1,), (1,), (9,))}, links)
    rows = lambda x: {name: sorted(map(tuple, df.collect()), key=repr) for name, df in x.items()}
    assert rows(left) == {"history": [(1, 20, 3), (None, 20, 4)], "offers": [(1, 20), (2, 20)], "variants": [(20, 2), (30, None)], "catalog": [(2,)], "alerts": [(6, 20)], "aliases": [(2, "b")], "queue": [(2, 1), (2, 2)], "stores": [(1,), (2,)]}
    both = delete_graph(tables, {"catalog": table("perfume_id long", (1,)), "stores": table("store_id long", (2,))}, links)
    assert rows({k: both[k] for k in ("offers", "queue", "stores", "history")}) == {"offers": [(1, 20)], "queue": [(2, 1)], "stores": [(1,)], "history": [(1, 20, 3), (None, 20, 4)]}
    assert rows(delete_graph(tables, {}, links)) == rows(tables)
    with pytest.raises(ValueError, match="circle"):
        delete_graph(tables, {}, [("offers", "store_id", "stores", "store_id"), ("stores", "store_id", "offers", "store_id")])


def test_components_follow_changes(spark):
    from offerlens.operators.graph import connected_components, update_components

    rng = random.Random(3)
    frame = lambda rows: spark.createDataFrame(sorted(rows), "a long, b long")
    for _ in range(3):
        pair = lambda: tuple(sorted(rng.sample(range(60), 2)))
        old = {pair() for _ in range(30)}
        added = {pair() for _ in range(12)}
        removed = set(rng.sample(sorted(old), 8)) | {(90, 91)}
        now = (old - removed) | added
        got = update_components(connected_components(frame(old)), frame(old), frame(added).unionByName(frame([(7, 7)])), frame(removed))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, connected_components(frame(now)).collect()))
    same = connected_components(frame(old))
    assert sorted(map(tuple, update_components(same, frame(old), frame(old).limit(0), frame(old).limit(0)).collect())) == sorted(map(tuple, same.collect()))


def test_overlap_in_parts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART_ITEMS", 7)
    monkeypatch.setattr(overlap, "TILE", 3)
    monkeypatch.setattr(overlap, "TILE_KEYS", 2)
    rows = [(f"i{i % 40:03}", f"k{(i * i + i // 40) % 9}", float(1 + i * 7 % 11)) for i in range(200)] + [("zero", "k1", 0.0), (None, "k1", 1.0), ("one", None, 1.0), ("one", "k1", 2.0)]
    vecs = spark.createDataFrame(rows, "item string, key string, weight double").groupBy("item", "key").agg(F.max("weight").alias("weight"))
    for threshold in (0.0, 0.72, 0.99):
        got = []
        for share in (0, 1e9):  # all pairs, index
            monkeypatch.setattr(overlap, "MEETINGS", share)
            got.append(sorted(tuple(r) for r in overlap.similar_pairs(vecs, threshold).collect()))
            report = [tuple(r) for r in overlap.overlap_report(vecs, threshold, pairs=9).collect()]
            assert [r[:2] for r in report] == [x[:2] for x in sorted(got[-1], key=lambda r: (-round(r[3] * 100, 1), r[0], r[1]))[:9]]
        assert [(a, b, keys) for a, b, _, _, keys in got[0]] == [(a, b, keys) for a, b, _, _, keys in got[1]] and (threshold == 0.99 or len(got[0]) > 20)
        assert all(abs(x[2] - y[2]) < 1e-9 and abs(x[3] - y[3]) < 1e-12 for x, y in zip(*got, strict=True))


def test_parts_are_not_shuffled_once_for_each_other(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART_ITEMS", 7)
    monkeypatch.setattr(overlap, "MEETINGS", 0)
    rows = [(i % 60, f"k{(i * i + i // 60) % 9}", float(1 + i * 7 % 11)) for i in range(300)]
    vecs = spark.createDataFrame(rows, "item long, key string, weight double").groupBy("item", "key").agg(F.max("weight").alias("weight"))
    got = []
    for groups in (2, 128):  # several parts in a group, and one
        monkeypatch.setattr(overlap, "GROUPS", groups, raising=False)
        pairs = overlap.similar_pairs(vecs, 0.72, with_shared=False)
        assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
        got.append(sorted((r["a"], r["b"], round(r["cosine"], 9)) for r in pairs.collect()))
    x = vecs.alias("x").join(vecs.alias("y"), F.expr("x.key = y.key AND x.item < y.item")).groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("b")).agg(F.sum(F.expr("x.weight * y.weight")).alias("dot"))
    n = {r["item"]: r["n"] for r in vecs.groupBy("item").agg(F.sqrt(F.sum(F.expr("weight * weight"))).alias("n")).collect()}
    want = sorted((r["a"], r["b"], round(r["dot"] / (n[r["a"]] * n[r["b"]]), 9)) for r in x.collect() if r["dot"] / (n[r["a"]] * n[r["b"]]) >= 0.72)
    assert got == [want, want] and len(want) > 20


def test_titles_with_brands(spark):
    from offerlens.operators.matching import titles_with_brands

    titles = [(1, "Christian DIOR sample"), (1, "Christian DIOR sample"), (2, "xdiorx & Ab"), (3, None), (4, ""), (5, "nothing here"), (6, "Éclat d'or éa")]
    brands = [("Dior",), ("Ab",), ("a",), ("ea",), ("Eclat d'Or",), ("",), (None,)]
    got = titles_with_brands(spark.createDataFrame(titles, "i int, title string"), spark.createDataFrame(brands, "brand string"))
    want = [(i, t, b) for i, t in titles if t for b in ("Dior", "Ab", "a", "ea", "Eclat d'Or") if b.lower() in t.lower().replace("é", "e")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_titles_are_not_broadcast(spark):
    from offerlens.operators.matching import titles_with_brands

    titles = spark.createDataFrame([(i, f"amber house {i % 7} noir {i}") for i in range(300)], "i int, title string")
    brands = spark.createDataFrame([("Amber House",), ("noir 1",), ("gone",)], "brand string")
    want = sorted([(i, "Amber House") for i in range(300)] + [(i, "noir 1") for i in range(300) if str(i).startswith("1")])
    for held in (0, 100):
        got = titles_with_brands(titles, brands, held=held)
        assert sorted((r["i"], r["brand"]) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        sides = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "__head" in x]
        assert len(sides) == (1 if held else 0) and all("BuildRight" in x for x in sides), plan


def test_reports_of_perfumes_and_the_queue(spark):
    from offerlens.operators import compare, health, review

    results = spark.createDataFrame([(1, 1, "in_stock", 5), (1, 2, "not_found", 4), (1, 2, "in_stock", 4), (1, 1, "scraping_error", 3), (2, 1, "not_found", 1)], "perfume_id long, store_id long, status string, created_at int")
    best = spark.createDataFrame([(1, 7, 50, "EDP", False, 9.0), (1, 8, 100, "EDP", False, 9.0), (2, 9, 10, "EDP", False, None)], "perfume_id long, variant_id long, volume_ml int, concentration string, tester boolean, price double")
    perfumes = spark.createDataFrame([(1,), (2,), (3,)], "perfume_id long")
    got = compare.perfume_report(perfumes, best, health.latest_statuses(results, ["perfume_id", "store_id"])).orderBy("perfume_id").collect()
    assert [([tuple(x) for x in r["statuses"]], r["in_stock_stores"], r["best_variant_id"]) for r in got] == [([(1, "in_stock"), (2, "in_stock"), (2, "not_found")], 2, 8), ([(1, "not_found")], 0, None), ([], 0, None)]
    queue = spark.createDataFrame([(1, 1, "b", "pending", 5), (1, 1, "a", "pending", 5), (1, 2, "c", "pending", 9), (1, 1, "d", "rejected", 9), (9, 1, "e", "pending", 9)], "perfume_id long, store_id long, product_url string, status string, first_seen_at int")
    listed = review.pending_listed(queue, perfumes.withColumns({"brand": F.lit("B"), "name": F.lit("N")}), spark.createDataFrame([(1, "one"), (2, "two")], "store_id long, store_name string"))
    assert [(r["product_url"], r["store_name"], r["brand"]) for r in listed.collect()] == [("c", "two", "B"), ("a", "one", "B"), ("b", "one", "B")]
    lists = compare.offers_of_variants(spark.createDataFrame([(1,), (2,)], "variant_id long"), spark.createDataFrame([(1, 1, None, "in_stock"), (1, 2, 5.0, "in_stock")], "variant_id long, offer_id long, price double, availability string")).orderBy("variant_id").collect()
    assert [[x["offer_id"] for x in r["offers"]] for r in lists] == [[2, 1], []]


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_few_edges_in_one_task(spark, kind):
    rng = random.Random(4)
    name = {"long": int, "string": lambda i: f"n{i}é", "binary": lambda i: bytes([i % 256, 200 - i % 7])}[kind]
    rows = [(name(rng.randrange(80)), name(rng.randrange(80))) for _ in range(60)] + [(None, name(1)), (name(2), name(2))]
    frame = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    both = [sorted(map(repr, graph.connected_components(frame, few=n).collect())) for n in (0, 1000)]
    assert both[0] == both[1] and both[0]
    assert graph.connected_components(frame.limit(0), few=10).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_dense_pairs_of_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) + 2 * (j == i % 3) for j in range(6)], i % 2) for i in range(60)]
    odd = [(100, None, 0), (101, [0.0] * 6, 0), (102, [float("nan")] * 6, 0), (103, [None] * 6, 0), (104, [1.0], 0), (105, [2.0], 0), (106, [1.0], 1), (107, rows[0][1], None)]
    got = overlap.dense_pairs(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), 0.5).collect()
    cosine = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    want = {(i, j): cosine(x, y) for i, x, m in rows for j, y, n in rows if i < j and m == n and cosine(x, y) >= 0.5} | {(104, 105): 1.0}
    assert {(r["a"], r["b"]) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r["cosine"] - want[r["a"], r["b"]]) < 1e-12 for r in got)
