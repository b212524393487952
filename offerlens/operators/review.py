"""The review queue of ambiguous matches, decisions on it, and confirmed aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUEUE_KEY = ["perfume_id", "store_id", "product_url"]


def merge_queue(queue: DataFrame, found: DataFrame, now: Column, keys: list[str] = QUEUE_KEY) -> DataFrame:
    """New rows enter as pending; pending ones get the new fields and keep first_seen_at; decided ones stay as they are.

    Of several rows of one key, the last by `ordinal` counts, or without that column the greatest by its fields in order.
    """
    state = ["status", "first_seen_at", "last_seen_at"]
    fields = [c for c in queue.columns if c not in (*keys, *state)]
    have = [c for c in fields if c in found.columns]
    order = F.struct(*(["ordinal"] if "ordinal" in found.columns else []), *have)
    b = found.groupBy(*keys).agg(F.max_by(F.struct(*have), order).alias("x")).select(*keys, *[F.col("x")[c].alias(f"__{c}") for c in have], F.lit(True).alias("__new"))
    both = queue.join(b, keys, "full")
    fresh = F.col("status").isNull()
    touch = F.col("__new").isNotNull() & (fresh | (F.col("status") == "pending"))
    return both.select(
        *keys,
        *[(F.when(touch, F.col(f"__{c}")).otherwise(F.col(c)) if c in have else F.col(c)).alias(c) for c in fields],
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.when(fresh, now).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(touch, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'").orderBy(*pending_keys())


def pending_listed(queue: DataFrame, catalog: DataFrame, stores: DataFrame) -> DataFrame:
    """Pending rows with their perfume's brand and name and their store's name, newest first; rows of deleted perfumes or stores go."""
    named = pending(queue).join(catalog.select("perfume_id", "brand", "name"), "perfume_id").join(stores.select("store_id", "store_name"), "store_id")
    return named.orderBy(*pending_keys())


def pending_keys() -> list:
    return [F.desc("first_seen_at"), *QUEUE_KEY]


def pending_count(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("status") == "pending").alias("pending"))


def apply_decisions(queue: DataFrame, decisions: DataFrame, now: Column, keys: list[str] = QUEUE_KEY) -> DataFrame:
    """Pending rows with a decision (confirmed or rejected) get it and resolved_at; others stay. A rejection stands against a confirmation of the same row."""
    d = decisions.groupBy(*keys).agg(F.max("decision").alias("__d"))
    hit = F.col("__d").isNotNull() & (F.col("status") == "pending")
    return queue.join(d, keys, "left").withColumns({"resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")), "status": F.when(hit, F.col("__d")).otherwise(F.col("status"))}).drop("__d")


def merge_aliases(aliases: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Aliases with the confirmed ones that are new, one for each perfume and normalised name."""
    key = ["perfume_id", "normalized_alias"]
    new = confirmed.groupBy(*key).agg(F.min("alias").alias("alias")).join(aliases.select(*key), key, "left_anti")
    return aliases.select(*key, "alias").unionByName(new.select(*key, "alias"))
