"""Runs and decisions on whole offers: accepted, excluded, doubtful, delisted, deduplicated, confirmed, rejected."""

from dataclasses import replace
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from offerlens.plans.run import State, apply_decisions, apply_run

MONEY = "decimal(10,2)"
ENTRY = f"price {MONEY}, old_price {MONEY}, currency string, discount_percentage int, availability string"
RAW = f"raw_title string, product_url string, store_product_identifier string, brand string, perfume_name string, concentration string, volume_ml int, tester boolean, price {MONEY}, old_price {MONEY}, currency string, availability string, coupon_code string, coupon_price {MONEY}, perfume_id long, store_id long, ordinal int"
BASE = {
    "raw_title": "Xerjoff Erba Gold Eau de Parfum 100 ml", "product_url": "u/1", "store_product_identifier": "i1", "brand": "Xerjoff", "perfume_name": "Erba Gold", "concentration": "EDP", "volume_ml": 100, "tester": False,
    "price": "799.00", "old_price": None, "currency": "RON", "availability": "in_stock", "coupon_code": None, "coupon_price": None, "perfume_id": 1, "store_id": 1,
}


def raw(spark, *changes):
    rows = [BASE | c for c in changes]
    money = lambda x: None if x is None else D(x)
    return spark.createDataFrame([tuple(money(v) if k in ("price", "old_price", "coupon_price") else v for k, v in r.items()) + (i,) for i, r in enumerate(rows)], RAW)


def state(spark):
    table = lambda kind, rows=(): spark.createDataFrame(list(rows), kind)
    return State(
        table("perfume_id long, brand string, name string, last_checked_at int", [(1, "Xerjoff", "Erba Gold", None), (2, "Dior", "Sauvage", None)]),
        table("perfume_id long, normalized_alias string, alias string"),
        table("variant_id long, perfume_id long, concentration string, volume_ml int, tester boolean"),
        table(f"store_id long, variant_id long, perfume_id long, url string, identifier string, title string, price {MONEY}, old_price {MONEY}, currency string, discount_percentage int, availability string, coupon_code string, coupon_price {MONEY}, first_seen_at int, last_seen_at int"),
        table(f"store_id long, variant_id long, run_id long, recorded_at int, {ENTRY}"),
        table(f"perfume_id long, store_id long, product_url string, title string, candidate_brand string, candidate_name string, concentration string, volume_ml int, tester boolean, price {MONEY}, old_price {MONEY}, currency string, availability string, identifier string, match_score double, status string, first_seen_at int, last_seen_at int, resolved_at int"),
        table(f"alert_id long, variant_id long, target_price decimal(12,2), enabled boolean, last_triggered_at int, last_triggered_price {MONEY}"),
    )


def attempts(spark, *rows):
    return spark.createDataFrame([(1, s, e) for s, e in rows or [(1, None)]], "perfume_id long, store_id long, error_status string")


def run(spark, before, offers, at=10, *tries):
    after, outcomes = apply_run(before, offers, attempts(spark, *tries), at // 10, F.lit(at))
    return after, {r["store_id"]: (r["status"], r["offers_found"]) for r in outcomes.collect()}


def pin(spark, s):
    """The state as stored tables, with its history appended."""
    return replace(s, **{f: spark.createDataFrame(getattr(s, f).collect(), getattr(s, f).schema) for f in s.__dataclass_fields__})


def test_an_accepted_offer_is_stored_whole(spark):
    after, outcome = run(spark, state(spark), raw(spark, {"old_price": "1000.00", "coupon_code": "C", "coupon_price": "700.00"}))
    assert outcome == {1: ("in_stock", 1)}
    row = after.snapshot.first()
    assert (row["url"], row["identifier"], row["title"], row["price"], row["old_price"], row["discount_percentage"], row["currency"], row["coupon_code"], row["coupon_price"]) == ("u/1", "i1", BASE["raw_title"], D(799), D(1000), 20, "RON", "C", D(700))
    assert [(r["price"], r["discount_percentage"], r["run_id"]) for r in after.history.collect()] == [(D(799), 20, 1)]
    assert {r["perfume_id"]: r["last_checked_at"] for r in after.catalog.collect()} == {1: 10, 2: None}
    # the coupon is gone in the next run
    again, _ = run(spark, pin(spark, after), raw(spark, {}), 20)
    assert again.snapshot.first()["coupon_code"] is None and again.history.count() == 0


@pytest.mark.parametrize("change", [{"brand": "Dior"}, {"raw_title": "Xerjoff Erba Gold gift set 100 ml"}, {"price": None}, {"concentration": None, "raw_title": "Xerjoff Erba Gold 100 ml"}])
def test_nothing_is_saved(spark, change):
    after, outcome = run(spark, state(spark), raw(spark, change))
    assert outcome == {1: ("not_found", 0)} and after.snapshot.count() == 0 and after.queue.count() == 0


def test_a_missing_brand_is_the_perfumes(spark):
    after, outcome = run(spark, state(spark), raw(spark, {"brand": None}, {"brand": "", "product_url": "u/2", "volume_ml": 50}))
    assert outcome == {1: ("in_stock", 2)} and after.variants.count() == 2
    # without a brand and a perfume nothing can be said
    assert run(spark, state(spark), raw(spark, {"brand": None, "perfume_id": None}))[1] == {1: ("not_found", 0)}
    assert run(spark, state(spark), raw(spark, {"perfume_id": None}))[1] == {1: ("in_stock", 1)}


def test_statuses(spark):
    after, outcome = run(spark, state(spark), raw(spark, {"availability": "out_of_stock"}), 10, (1, None), (2, "scraping_error"), (3, "store_unavailable"), (4, None))
    assert outcome == {1: ("out_of_stock", 1), 2: ("scraping_error", 0), 3: ("store_unavailable", 0), 4: ("not_found", 0)}
    from offerlens.operators.offers import run_header

    rows = spark.createDataFrame([(1, s, *o) for s, o in outcome.items()], "perfume_id long, store_id long, status string, offers_found int")
    assert tuple(run_header(rows, 7, "single", F.lit(1), F.lit(2)).first()) == (7, "single", "completed_with_errors", 1, 2, 1, 4)


@pytest.mark.parametrize("rows,want", [(("363.00", "in_stock", "330.00", "in_stock"), "330.00"), (("330.00", "out_of_stock", "363.00", "in_stock"), "363.00")])
def test_one_variant_twice(spark, rows, want):
    p, a, q, b = rows
    after, outcome = run(spark, state(spark), raw(spark, {"price": p, "availability": a}, {"price": q, "availability": b, "product_url": "u/2"}))
    assert outcome[1][1] == 1 and [r["price"] for r in after.snapshot.collect()] == [D(want)] and after.history.count() == 1


def test_delisted_offers_and_failed_stores(spark):
    before = pin(spark, run(spark, state(spark), raw(spark, {}, {"volume_ml": 50, "product_url": "u/2"}, {"store_id": 2}))[0])
    after, _ = run(spark, before, raw(spark, {}), 20, (1, None), (2, "scraping_error"))
    assert sorted((r["store_id"], r["url"], r["availability"], r["last_seen_at"]) for r in after.snapshot.collect()) == [(1, "u/1", "in_stock", 20), (1, "u/2", "out_of_stock", 10), (2, "u/1", "in_stock", 10)]
    assert [(r["availability"], r["price"]) for r in after.history.collect()] == [("out_of_stock", D(799))]


DOUBTFUL = {"perfume_name": "Erba Gold Intense", "raw_title": "Xerjoff Erba Gold Intense Eau de Parfum 100 ml"}


def test_a_doubtful_name_is_queued_refreshed_and_confirmed(spark):
    first = pin(spark, run(spark, state(spark), raw(spark, DOUBTFUL))[0])
    assert first.snapshot.count() == 0
    row = first.queue.first()
    assert (row["candidate_name"], row["volume_ml"], row["price"], row["status"], row["identifier"]) == ("Erba Gold Intense", 100, D(799), "pending", "i1")
    second = pin(spark, run(spark, first, raw(spark, DOUBTFUL | {"price": "750.00"}), 20)[0])
    assert [(r["price"], r["first_seen_at"], r["last_seen_at"]) for r in second.queue.collect()] == [(D(750), 10, 20)]
    variant = spark.createDataFrame([(5, "EDP", 100, False)], "variant_id long, concentration string, volume_ml int, tester boolean").withColumn("perfume_id", F.lit(1).cast("long"))
    alert = spark.createDataFrame([(9, 5, D(760), True, None, None), (8, 6, D(760), True, None, None)], second.alerts.schema)
    second = replace(second, variants=variant.select(*second.variants.columns), alerts=alert)
    decided = apply_decisions(second, spark.createDataFrame([(1, 1, "u/1", "confirmed")], "perfume_id long, store_id long, product_url string, decision string"), F.lit(30))
    assert [(r["status"], r["resolved_at"]) for r in decided.queue.collect()] == [("confirmed", 30)]
    assert [tuple(r) for r in decided.aliases.select("perfume_id", "normalized_alias", "alias").collect()] == [(1, "erba gold intense", "Erba Gold Intense")]
    assert [(r["variant_id"], r["price"], r["url"], r["coupon_code"]) for r in decided.snapshot.collect()] == [(5, D(750), "u/1", None)]
    assert [(r["run_id"], r["price"]) for r in decided.history.collect()] == [(None, D(750))]
    assert {r["alert_id"]: (r["last_triggered_at"], r["last_triggered_price"]) for r in decided.alerts.collect()} == {9: (30, D(750)), 8: (None, None)}
    # from now on the name is known
    third, outcome = run(spark, pin(spark, decided), raw(spark, DOUBTFUL | {"price": "740.00"}), 40)
    assert outcome == {1: ("in_stock", 1)} and third.snapshot.first()["price"] == D(740)


def test_a_rejected_name_does_not_come_back(spark):
    first = pin(spark, run(spark, state(spark), raw(spark, DOUBTFUL))[0])
    decided = pin(spark, apply_decisions(first, spark.createDataFrame([(1, 1, "u/1", "rejected")], "perfume_id long, store_id long, product_url string, decision string"), F.lit(20)))
    assert decided.snapshot.count() == 0 and decided.aliases.count() == 0
    after, _ = run(spark, decided, raw(spark, DOUBTFUL), 30)
    assert [(r["status"], r["last_seen_at"]) for r in after.queue.collect()] == [("rejected", 10)]
