"""A run, and decisions on its doubtful matches, as plans: from tables to the next version of each."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.text import normalize
from offerlens.operators import alerts as alerting
from offerlens.operators import matching, offers, review
from offerlens.operators.history import changed_entries
from offerlens.sources.storage import written

VARIANT = ["perfume_id", "concentration", "volume_ml", "tester"]
#: Fields of a current offer that a new one replaces, null ones too, and those that its history keeps.
OFFER = ["perfume_id", "url", "identifier", "title", "price", "old_price", "currency", "discount_percentage", "availability", "coupon_code", "coupon_price"]
ENTRY = ["price", "old_price", "currency", "discount_percentage", "availability"]


@dataclass
class State:
    """Tables that a run reads and of which it makes the next version. `history` of a new state holds the rows to append only."""

    catalog: DataFrame  # perfume_id, brand, name, last_checked_at
    aliases: DataFrame  # perfume_id, normalized_alias, alias
    variants: DataFrame  # variant_id, perfume_id, concentration, volume_ml, tester
    snapshot: DataFrame  # store_id, variant_id, OFFER, first_seen_at, last_seen_at
    history: DataFrame  # store_id, variant_id, run_id, recorded_at, ENTRY
    queue: DataFrame  # review.QUEUE_KEY, title, candidate_brand, candidate_name, VARIANT, ENTRY, identifier, match_score, status, first_seen_at, last_seen_at, resolved_at
    alerts: DataFrame  # alert_id, variant_id, target_price, enabled, last_triggered_at, last_triggered_price


def judge(state: State, raw: DataFrame) -> DataFrame:
    """Each admitted raw offer (with store_id, ordinal and the perfume_id it was found for, or null) with the perfumes it may be, and the decision.

    One that was found for a perfume is compared with that one alone and has its brand where it tells none; the others with the perfumes of their brand
    that their name can match.
    """
    catalog = matching.with_aliases(state.catalog.select("perfume_id", "brand", "name"), state.aliases)
    found = offers.admit(raw).withColumnsRenamed({"brand": "candidate_brand", "perfume_name": "candidate_name"})
    aimed = matching.targeted_pairs(catalog, found.where("perfume_id IS NOT NULL"))
    free = matching.likely_pairs(catalog, found.where("perfume_id IS NULL").drop("perfume_id"))
    return matching.decide(aimed).unionByName(matching.decide(free, brand_checked=True))


def _offers(rows: DataFrame) -> DataFrame:
    """Rows of raw offers with their variant as current offers."""
    named = rows.withColumnsRenamed({"product_url": "url", "store_product_identifier": "identifier", "raw_title": "title"})
    return offers.with_discount(named).select(*offers.KEY, *OFFER, "ordinal")


def _entries(rows: DataFrame, run_id: int | None, now: Column) -> DataFrame:
    return rows.select(*offers.KEY, F.lit(run_id).cast("long").alias("run_id"), now.alias("recorded_at"), *ENTRY)


def apply_run(state: State, raw: DataFrame, attempts: DataFrame, run_id: int, now: Column) -> tuple[State, DataFrame]:
    """The next state, and the outcome of each attempted (perfume, store). `attempts`: perfume_id, store_id, error_status (null where the store answered).

    Offers are judged once: what the tables of the next state are made of (judged and best offers, delisted ones, the old rows of the best ones' keys) is
    written, each as large as the batch or the offers of the attempted perfumes. Every snapshot row's last change is the last entry of its history, so no history is read. Alerts of
    the attempted perfumes are evaluated, whether they got new offers or not.
    """
    judged = written(judge(state, raw))
    accepted = judged.where(matching.usable())
    variants = offers.resolve_variants(state.variants, accepted)
    placed = accepted.join(variants.select(*VARIANT, "variant_id"), VARIANT)
    best = written(offers.dedup_in_run(_offers(placed)).drop("ordinal").select(*offers.KEY, *OFFER))
    ok = attempts.where("error_status IS NULL")
    gone = written(offers.delisted(state.snapshot, best, ok, pair=["perfume_id", "store_id"]).select(*best.columns))
    known = written(state.snapshot.join(best.select(*offers.KEY), offers.KEY, "left_semi"))
    snapshot = offers.merge_batch(state.snapshot, best, known, now)
    out = gone.select(*offers.KEY, F.lit("out_of_stock").alias("__gone"))
    snapshot = snapshot.join(out, offers.KEY, "left").withColumn("availability", F.coalesce("__gone", "availability")).drop("__gone")
    history = _entries(changed_entries(best, known, offers.KEY).unionByName(gone), run_id, now)
    doubtful = judged.where("confidence = 'ambiguous' AND score IS NOT NULL").select(
        *review.QUEUE_KEY, F.col("raw_title").alias("title"), "candidate_brand", "candidate_name", "concentration", "volume_ml", "tester", "price", "old_price", "currency", "availability",
        F.col("store_product_identifier").alias("identifier"), F.col("score").cast("double").alias("match_score"), "ordinal",
    )
    outcomes = offers.run_outcomes(attempts, best.select("perfume_id", "store_id", "availability"), ["perfume_id", "store_id"])
    checked = snapshot.join(attempts.select("perfume_id").distinct(), "perfume_id", "left_semi")
    return replace(
        state, catalog=offers.mark_checked(state.catalog, attempts, now), variants=variants, snapshot=snapshot, history=history,
        queue=review.merge_queue(state.queue, doubtful, now), alerts=alerting.persist_triggers(state.alerts, checked, now),
    ), outcomes


def apply_decisions(state: State, decisions: DataFrame, now: Column) -> State:
    """The next state after decisions (review.QUEUE_KEY, decision) on pending rows.

    A confirmed row becomes an alias of its perfume, a variant if that is new, a current offer (without a coupon) as it was
    seen, a history entry without a run if price or availability differ, and its variant's alerts are evaluated. Of two confirmed
    rows of one store and variant, the one seen last counts, then the greater url. Rejected rows are only marked.
    """
    chosen = decisions.groupBy(*review.QUEUE_KEY).agg(F.max("decision").alias("decision")).where("decision = 'confirmed'")
    hits = state.queue.where("status = 'pending'").join(chosen.select(*review.QUEUE_KEY), review.QUEUE_KEY, "left_semi")
    named = hits.select("perfume_id", normalize(F.col("candidate_name")).alias("normalized_alias"), F.col("candidate_name").alias("alias"))
    variants = offers.resolve_variants(state.variants, hits)
    rows = hits.join(variants.select(*VARIANT, "variant_id"), VARIANT).withColumn("url", F.col("product_url"))
    rows = offers.with_discount(rows).withColumns({"coupon_code": F.lit(None).cast("string"), "coupon_price": F.lit(None).cast("decimal(10,2)")})
    rest = [c for c in OFFER]
    best = rows.groupBy(*offers.KEY).agg(F.max_by(F.struct(*rest), F.struct("last_seen_at", "url")).alias("x")).select(*offers.KEY, "x.*")
    best = written(best)
    known = written(state.snapshot.join(best.select(*offers.KEY), offers.KEY, "left_semi"))
    snapshot = offers.merge_batch(state.snapshot, best, known, now)
    touched = snapshot.join(best.select("variant_id").distinct(), "variant_id", "left_semi")
    return replace(
        state, aliases=review.merge_aliases(state.aliases, named), variants=variants, snapshot=snapshot, history=_entries(changed_entries(best, known, offers.KEY), None, now),
        queue=review.apply_decisions(state.queue, decisions, now), alerts=alerting.persist_triggers(state.alerts, touched, now),
    )
