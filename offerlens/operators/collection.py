"""Profiles of a collection: family shares, rankings, counts, notes, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlens.sources.storage import written

# Family of each accord.
FAMILIES = {
    "Citrus": ["citrus"],
    "Green": ["green", "herbal"],
    "Aquatic": ["marine", "aquatic", "ozonic", "mineral", "salty", "metallic"],
    "Aromatic": ["aromatic", "fresh", "fresh spicy", "lavender", "aldehydic"],
    "White Floral": ["white floral", "tuberose"],
    "Floral": ["floral", "yellow floral", "rose", "iris", "violet"],
    "Woods": ["woody", "earthy", "patchouli"],
    "Mossy/Oud": ["mossy", "oud", "smoky"],
    "Amber": ["amber", "warm spicy", "animalic", "balsamic"],
    "Spicy": ["soft spicy", "cinnamon", "spice"],
    "Musk/Powdery": ["musky", "powdery"],
    "Tobacco/Leather": ["tobacco", "leather"],
    "Gourmand": ["sweet", "vanilla", "honey", "coconut", "fruity", "caramel", "tropical", "coffee", "nutty", "rum", "almond", "whiskey", "cherry", "beeswax", "lactonic", "chocolate"],
}
# Group of each family, and the groups' colours.
GROUPS = {
    "Fresh": ["Citrus", "Green", "Aquatic", "Aromatic"],
    "Floral": ["White Floral", "Floral"],
    "Woody": ["Woods", "Mossy/Oud"],
    "Oriental": ["Amber", "Spicy", "Musk/Powdery", "Tobacco/Leather"],
    "Gourmand": ["Gourmand"],
}
COLORS = {"Fresh": "#0ea5e9", "Floral": "#ec4899", "Woody": "#92400e", "Oriental": "#d97706", "Gourmand": "#a855f7", "Other": "#64748b"}


def family_table(families: dict[str, list[str]] = FAMILIES) -> Column:
    """An array of (accord, family, family_group, color): the lookup as one expression."""
    group = {f: g for g, fs in GROUPS.items() for f in fs}
    rows = [(a, f, group.get(f, "Other"), COLORS[group.get(f, "Other")]) for f, names in families.items() for a in names]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("accord", "family", "family_group", "color"), strict=True)]) for r in rows])


def with_family(accords: DataFrame, accord: str = "accord", families: dict[str, list[str]] = FAMILIES) -> DataFrame:
    """family, family_group and color of each accord, trimmed and lower-cased; unknown ones are Other."""
    lookup = accords.sparkSession.range(1).select(F.inline(family_table(families)))
    lookup = lookup.withColumnRenamed("accord", "__key")
    out = accords.withColumn("__key", F.lower(F.trim(accord))).join(F.broadcast(lookup), "__key", "left").drop("__key")
    return out.fillna({"family": "Other", "family_group": "Other", "color": COLORS["Other"]})


def family_shares(accords: DataFrame, strength: str = "strength") -> DataFrame:
    """(family, family_group, total, percentage of all to one place) from rows with `family`; none where all is 0."""
    sums = accords.groupBy("family", "family_group").agg(F.sum(strength).alias("total"))
    whole = F.sum("total").over(W.partitionBy(F.lit(1)))  # a row for each family
    share = F.bround((F.col("total").cast("decimal(28,0)") * 100 / whole.cast("decimal(28,0)")).cast("decimal(28,8)"), 1)
    return sums.withColumn("percentage", F.when(whole > 0, share).cast("decimal(5,1)")).where("percentage IS NOT NULL")


def family_contributors(accords: DataFrame, item: str = "item_id", strength: str = "strength", limit: int = 3) -> DataFrame:
    """(family, item, total, place): the items that give most to each family; the smaller item first of equals."""
    sums = accords.groupBy("family", item).agg(F.sum(strength).alias("total"))
    w = W.partitionBy("family").orderBy(F.desc("total"), item)
    return sums.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def offsets(shares: DataFrame) -> DataFrame:
    """Shares in order (largest first) with the sum of the rounded percentages before each; a row for each family."""
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("total"), "family")
    before = F.sum("percentage").over(w.rowsBetween(W.unboundedPreceding, -1))
    return shares.withColumn("offset", F.coalesce(before, F.lit(0)).cast("decimal(6,1)"))


def rank_attributes(rows: DataFrame, items: int | Column, name: str, item: str = "item_id", strength: str | None = None, order: list[str] | None = None, limit: int = 8) -> DataFrame:
    """The `limit` strongest attributes: score (sum of strength, or distinct items), items, percent of the collection, percent of the first.

    Names are told apart trimmed and lower-cased, and shown as first written in `order`; blank ones go. Ties: more items, then first seen.
    """
    seen = F.struct(*(order or [item]))
    keyed = rows.withColumn("__key", F.lower(F.trim(name))).where("__key <> ''")
    sums = keyed.groupBy("__key").agg(
        F.min_by(F.trim(name), seen).alias("label"), F.min(seen).alias("__first"), F.count_distinct(item).alias("item_count"), (F.sum(strength) if strength else F.count_distinct(item)).alias("score")
    )
    top = sums.orderBy(F.desc("score"), F.desc("item_count"), "__first", "__key").limit(limit)
    best = F.max("score").over(W.partitionBy(F.lit(1)))  # `limit` rows
    percent = lambda a, b, places: F.bround((a.cast("decimal(28,0)") * 100 / b.cast("decimal(28,0)")).cast("decimal(28,8)"), places)
    n = items if isinstance(items, Column) else F.lit(items)
    out = top.withColumns({"collection_percentage": percent(F.col("item_count"), n, 0).cast("int"), "bar_percentage": percent(F.col("score"), best, 1).cast("decimal(5,1)")})
    if strength:
        out = out.withColumn("avg_intensity", F.bround((F.col("score").cast("decimal(28,0)") / F.col("item_count").cast("decimal(28,0)")).cast("decimal(28,8)"), 0).cast("int"))
    return out.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.desc("item_count"), "__first", "__key"))).drop("__key", "__first")


def insight_counts(items: DataFrame, edges: DataFrame, brand: str = "brand") -> DataFrame:
    """One row: items, distinct brands, edges."""
    n = items.agg(F.count("*").alias("items"), F.count_distinct(F.lower(F.trim(brand))).alias("brands")).withColumn("__k", F.lit(1))
    return n.join(edges.agg(F.count("*").alias("edges")).withColumn("__k", F.lit(1)), "__k").drop("__k")


def note_lists(notes: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, tier, notes): names in order of position, joined by ", "."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("position", "name"))), lambda x: x["name"])
    return notes.groupBy(item, "tier").agg(F.array_join(names, ", ").alias("notes"))


def first_attributes(rows: DataFrame, item: str = "item_id", name: str = "accord", limit: int = 3) -> DataFrame:
    """(item, names): each item's first `limit` attributes by position, joined by ", "."""
    w = W.partitionBy(item).orderBy("position")
    few = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
    return few.groupBy(item).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", name))), lambda x: x[name]), ", ").alias("names"))


def insights(items: DataFrame, accords: DataFrame, notes: DataFrame, edges: DataFrame, item: str = "item_id", brand: str = "brand", name: str = "name", families: dict[str, list[str]] = FAMILIES) -> dict[str, DataFrame]:
    """All parts of the collection report: counts, dna (shares with offsets), contributors, accords and notes in order, clusters with their nodes, and the edges between those.

    `edges`: directed (src, dst) between items. They and `accords` are written once, several parts being made of each.
    """
    from offerlens.operators.graph import cluster_edges, cluster_report, visible_edges

    accords, edges = written(accords), written(edges)
    known = with_family(accords, families=families)
    n = items.agg(F.count_distinct(item)).scalar()
    plain = cluster_edges(edges)
    clusters = cluster_report(plain, items, item, name)
    return {
        "counts": insight_counts(items, edges, brand),
        "dna": offsets(family_shares(known)),
        "contributors": family_contributors(known),
        "accords": rank_attributes(accords, n, "accord", strength="strength", order=["item_id", "position"]),
        "notes": rank_attributes(notes, n, "name", order=["item_id", "name"]),
        "clusters": clusters,
        "cluster_edges": visible_edges(clusters, plain),
    }


def import_items(existing: DataFrame, found: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Items of an import that are new, and its counts. `found`: key, ordinal, parsed (null where parsing failed)."""
    first = found.groupBy(key).agg(F.min_by(F.struct(*[c for c in found.columns if c != key]), "ordinal").alias("x")).select(key, "x.*")
    known = existing.select(key).distinct().withColumn("__known", F.lit(True))
    marked = first.join(known, key, "left")
    outcome = F.when(F.col("__known"), "skipped").when(F.col("parsed").isNull(), "failed").otherwise("added")
    marked = marked.withColumn("outcome", outcome).drop("__known")
    counts = marked.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("outcome") == x).alias(x) for x in ("added", "skipped", "failed")])
    return marked.where("outcome = 'added'").drop("outcome"), counts
