"""A run's offers: admission, variants, dedup, snapshot upsert, delisting, outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.functions.money import discount_percent

KEY = ["store_id", "variant_id"]


def admit(offers: DataFrame) -> DataFrame:
    """Offers with a price whose title is no excluded product; a missing concentration and volume come from the title, a missing name is the title."""
    kept = offers.where(T.exclusion(F.col("raw_title")).isNull() & F.col("price").isNotNull())
    return kept.withColumns(
        {
            "concentration": F.coalesce(F.nullif(F.col("concentration"), F.lit("")), T.concentration(F.col("raw_title"))),
            "volume_ml": T.volume_ml(F.col("raw_title"), F.col("volume_ml")),
            "perfume_name": F.coalesce(F.nullif(F.col("perfume_name"), F.lit("")), F.col("raw_title")),
        }
    )


def variant_id(perfume: Column, concentration: Column, volume: Column, tester: Column) -> Column:
    return F.xxhash64(perfume, concentration, volume.cast("int"), tester)


def resolve_variants(variants: DataFrame, wanted: DataFrame, key: tuple[str, ...] = ("perfume_id", "concentration", "volume_ml", "tester")) -> DataFrame:
    """`variants` with those of `wanted` that are new; ids are hashes of the key. Rows with a null in the key are left out."""
    whole = wanted
    for c in key:
        whole = whole.where(F.col(c).isNotNull())
    new = whole.select(*key).distinct().join(variants.select(*key), list(key), "left_anti").withColumn("variant_id", variant_id(*[F.col(c) for c in key]))
    return variants.unionByName(new, allowMissingColumns=True)


def dedup_in_run(offers: DataFrame, keys: list[str] = KEY, ordinal: list[str] | None = None) -> DataFrame:
    """One offer for each key: in stock before out of stock, then cheaper, then first seen."""
    rest = [c for c in offers.columns if c not in keys]
    order = F.struct((F.col("availability") != "in_stock").alias("out"), "price", *(ordinal or ["ordinal"]))
    return offers.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def upsert_snapshot(old: DataFrame, batch: DataFrame, now: Column, keys: list[str] = KEY, seen: tuple[str, str] = ("first_seen_at", "last_seen_at")) -> DataFrame:
    """The next snapshot: a row of the batch replaces the old row's fields, null ones too; first_seen stays, last_seen is now."""
    fields = [c for c in old.columns if c not in (*keys, *seen)]
    b = batch.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__new"))
    both = old.join(b, keys, "full")
    new = F.col("__new").isNotNull()
    return both.select(
        *keys,
        *[F.when(new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.coalesce(F.col(seen[0]), now).alias(seen[0]),
        F.when(new, now).otherwise(F.col(seen[1])).alias(seen[1]),
    )


def merge_batch(old: DataFrame, batch: DataFrame, known: DataFrame, now: Column, keys: list[str] = KEY, seen: tuple[str, str] = ("first_seen_at", "last_seen_at")) -> DataFrame:
    """`upsert_snapshot` for a batch that may be small against the old rows; `known`: the old rows of its keys.

    Each join has the batch or less on its right side, which Spark broadcasts where it is small enough; the old rows then stay where they are.
    """
    fields = [c for c in old.columns if c not in (*keys, *seen)]
    b = batch.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__new"))
    new = F.col("__new").isNotNull()
    kept = old.join(b, keys, "left").select(
        *keys, *[F.when(new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields], F.col(seen[0]), F.when(new, now).otherwise(F.col(seen[1])).alias(seen[1])
    )
    fresh = batch.join(known.select(*keys), keys, "left_anti").select(*keys, *fields, now.alias(seen[0]), now.alias(seen[1]))
    return kept.unionByName(fresh)


def delisted(known: DataFrame, touched: DataFrame, succeeded: DataFrame, keys: list[str] = KEY, pair: list[str] | None = None) -> DataFrame:
    """Known in-stock offers of successfully checked pairs that this run did not touch, as out-of-stock rows; prices stay."""
    ok = known.where(F.col("availability") == "in_stock").join(succeeded.select(*(pair or ["store_id"])).distinct(), pair or ["store_id"], "left_semi")
    return ok.join(touched.select(*keys).distinct(), keys, "left_anti").withColumn("availability", F.lit("out_of_stock"))


def run_outcomes(attempts: DataFrame, saved: DataFrame, pair: list[str]) -> DataFrame:
    """Status and offers_found of each attempted pair: its own error, else in stock, out of stock or not found by what was saved."""
    found = saved.groupBy(*pair).agg(F.count("*").alias("__n"), F.bool_or(F.col("availability") == "in_stock").alias("__in"))
    n = F.coalesce("__n", F.lit(0))
    status = F.when(F.col("error_status").isNotNull(), F.col("error_status")).when(F.col("__in"), "in_stock").when(n > 0, "out_of_stock").otherwise("not_found")
    return attempts.join(found, pair, "left").select(*attempts.columns, status.alias("status"), n.alias("offers_found"))


def run_status(results: DataFrame, run: str = "run_id", errors: tuple[str, ...] = ("scraping_error", "store_unavailable")) -> DataFrame:
    bad = F.bool_or(F.col("status").isin(*errors))
    return results.groupBy(run).agg(F.when(bad, "completed_with_errors").otherwise("completed").alias("run_status"), F.count("*").alias("checks"))


def with_discount(offers: DataFrame, price: str = "price", old: str = "old_price") -> DataFrame:
    return offers.withColumn("discount_percentage", discount_percent(F.col(price), F.col(old)))


def mark_checked(catalog: DataFrame, checked: DataFrame, now: Column, key: str = "perfume_id") -> DataFrame:
    hit = checked.select(key).distinct().withColumn("__hit", F.lit(True))
    return catalog.join(hit, key, "left").withColumn("last_checked_at", F.when(F.col("__hit"), now).otherwise(F.col("last_checked_at"))).drop("__hit")


def delete_cascade(tables: dict[str, DataFrame], deleted: DataFrame, chain: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the deleted keys and what hangs on them; chain: (table, own key, key in it of the row above), top first.

    The first entry's key is looked up in `deleted`; each further table loses the rows whose parent went.
    """
    gone, out = deleted, dict(tables)
    for name, own, above in chain:
        lost = tables[name].join(gone.select(F.col(gone.columns[0]).alias(above)).distinct(), above, "left_semi")
        out[name] = tables[name].join(gone.select(F.col(gone.columns[0]).alias(above)).distinct(), above, "left_anti")
        gone = lost.select(own)
    return out


def delete_graph(tables: dict[str, DataFrame], deleted: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the rows named in `deleted` (table: its keys) and all that hangs on them; links: (child, its column, parent, the parent's column).

    Tables are taken in an order in which parents come before their children; a child with several parents loses what any of them takes along. Rows whose
    column is null hang on nothing. Links that go in a circle are an error.
    """
    order, left = [], list(tables)
    while left:
        free = [t for t in left if not any(child == t and parent in left and parent != t for child, _, parent, _ in links)]
        if not free:
            raise ValueError(f"links in a circle among {left}")
        order += free
        left = [t for t in left if t not in free]
    out, gone = {}, {}
    for name in order:
        table, lost = tables[name], []
        if name in deleted:
            lost.append((deleted[name].distinct(), deleted[name].columns))
        for child, own, parent, key in links:
            if child == name and parent in gone:
                lost.append((gone[parent].select(F.col(key).alias(own)).where(F.col(own).isNotNull()).distinct(), [own]))
        if not lost:
            out[name] = table
            continue
        marks = [f"__gone{i}" for i in range(len(lost))]
        marked = table
        for mark, (keys, on) in zip(marks, lost, strict=True):
            marked = marked.join(keys.withColumn(mark, F.lit(True)), on, "left")
        hit = reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in marks])
        out[name] = marked.where(~hit).select(*table.columns)
        gone[name] = marked.where(hit).select(*table.columns)
    return out


def replace_children(children: DataFrame, new: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """Child rows of `parents`, by default those in `new`, are replaced by those in `new`; a parent whose new list is empty keeps none."""
    replaced = new.select(parent) if parents is None else parents.select(parent).unionByName(new.select(parent))
    return children.join(replaced.distinct(), parent, "left_anti").unionByName(new)


def for_pair(offers: DataFrame, variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """Current offers of each (perfume_id, store_id) among `pairs`."""
    known = offers if "perfume_id" in offers.columns else offers.join(variants.select("variant_id", "perfume_id"), "variant_id")
    return known.join(pairs.select("perfume_id", "store_id").distinct(), ["perfume_id", "store_id"], "left_semi")


def run_header(outcomes: DataFrame, run_id: int, run_type: str, started: Column, finished: Column) -> DataFrame:
    """One row for a run: its status by its outcomes, and how many perfumes and stores it checked."""
    bad = F.coalesce(F.bool_or(F.col("status").isin("scraping_error", "store_unavailable")), F.lit(False))
    return outcomes.agg(
        F.lit(run_id).cast("long").alias("run_id"), F.lit(run_type).alias("run_type"), F.when(bad, "completed_with_errors").otherwise("completed").alias("status"),
        F.first(started).alias("started_at"), F.first(finished).alias("finished_at"), F.count_distinct("perfume_id").cast("int").alias("perfume_count"), F.count_distinct("store_id").cast("int").alias("store_count"),
    )
