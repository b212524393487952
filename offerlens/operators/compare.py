"""Comparisons of current offers: cheapest, best value, dashboard, catalog and detail reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.money import price_per_ml


def in_stock_priced(price: str = "price", availability: str = "availability") -> Column:
    return (F.col(availability) == "in_stock") & F.col(price).isNotNull()


def best_offer_per_variant(variants: DataFrame, offers: DataFrame, variant: str = "variant_id", price: str = "price", tie: str = "offer_id") -> DataFrame:
    """Every variant with its cheapest in-stock offer (the smallest `tie` of equals), null fields where there is none."""
    rest = [c for c in offers.columns if c != variant]
    best = offers.where(in_stock_priced(price)).groupBy(variant).agg(F.min_by(F.struct(*rest), F.struct(price, tie)).alias("x")).select(variant, "x.*")
    return variants.join(best, variant, "left")


def best_value_per_perfume(best: DataFrame, perfume: list[str], variant: str = "variant_id", price: str = "price", volume: str = "volume_ml") -> DataFrame:
    """Of each perfume's cheapest offers, that of the least price per volume; sums of money are compared exactly."""
    priced = best.where(F.col(price).isNotNull() & (F.col(volume) > 0))
    value = (F.col(price).cast("decimal(20,2)") / F.col(volume).cast("decimal(10,0)")).cast("decimal(38,18)")
    rest = [c for c in priced.columns if c not in perfume]
    return priced.groupBy(*perfume).agg(F.min_by(F.struct(*rest), F.struct(value, variant)).alias("x")).select(*perfume, "x.*")


def overall_best(best: DataFrame, perfume: list[str], price: str = "price", order: tuple[str, ...] = ("volume_ml", "concentration", "tester", "variant_id")) -> DataFrame:
    """Each perfume's cheapest offer by plain price; of equals that of the variant that stands first: larger volumes first."""
    first, *others = order
    rest = [c for c in best.columns if c not in perfume]
    return best.where(F.col(price).isNotNull()).groupBy(*perfume).agg(F.min_by(F.struct(*rest), F.struct(F.col(price), -F.col(first), *others)).alias("x")).select(*perfume, "x.*")


def enrich_offers(offers: DataFrame, variants: DataFrame, stores: DataFrame, variant: str = "variant_id", store: str = "store_id") -> DataFrame:
    """In-stock offers with their variant and store; offers of unknown ones go."""
    return offers.where(F.col("availability") == "in_stock").join(variants, variant).join(stores, store)


def semi_lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among `keys`; Spark broadcasts them where they are few."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def search(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """Rows with the trimmed, lower-cased term in any of the columns; all for an empty term."""
    term = (term or "").strip().lower()
    if not term:
        return df
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False))
    return df.where(found)


AVAILABILITY = {"in_stock": lambda p, t: F.col(p).isNotNull(), "not_found": lambda p, t: F.col(p).isNull(), "never_checked": lambda p, t: F.col(t).isNull()}


def by_availability(df: DataFrame, state: str, price: str = "price", checked: str = "last_checked_at") -> DataFrame:
    return df.where(AVAILABILITY[state](price, checked)) if state in AVAILABILITY else df


def dashboard_keys(sort: str = "name", direction: str = "asc", price: str = "price", checked: str = "last_checked_at") -> list:
    """By name, best_price (those without last either way) or last_checked (never is the least); others mean name."""
    down = direction == "desc"
    names = [F.lower("brand"), F.lower("name")]
    if sort == "best_price":
        keys = [F.desc_nulls_last(price) if down else F.asc_nulls_last(price)]
    elif sort == "last_checked":
        keys = [F.desc_nulls_last(checked) if down else F.asc_nulls_first(checked)]
    else:
        keys = [x.desc() if down else x for x in names]
    return [*keys, "brand", "name"]


def dashboard_order(df: DataFrame, sort: str = "name", direction: str = "asc", price: str = "price", checked: str = "last_checked_at") -> DataFrame:
    """Sorted by `dashboard_keys`."""
    return df.orderBy(*dashboard_keys(sort, direction, price, checked))


def store_catalog(stores: DataFrame, offers: DataFrame, store: str = "store_id", perfume: tuple[str, ...] = ("brand", "name")) -> DataFrame:
    """Every store with its perfumes in order of name, each with its offers by price, those without one last; empty stores stay."""
    o = F.struct(F.col("price").isNull().alias("unpriced"), "price", "variant_id", "availability")
    by_perfume = offers.groupBy(store, *perfume).agg(F.sort_array(F.collect_list(o)).alias("offers"))
    return stores.join(by_perfume, store, "left").orderBy(store, *[F.lower(c) for c in perfume], *perfume)


def offers_of_variants(variants: DataFrame, offers: DataFrame, variant: str = "variant_id") -> DataFrame:
    """Every variant with all its current offers as a list, cheapest first, those without a price last; an empty list for none."""
    o = F.struct(F.col("price").isNull().alias("unpriced"), "price", "offer_id", "availability")
    lists = offers.groupBy(variant).agg(F.sort_array(F.collect_list(o)).alias("offers"))
    return variants.join(lists, variant, "left").withColumn("offers", F.coalesce("offers", F.array()))


def variant_keys() -> list:
    """Order of a perfume's variants: larger ones first."""
    return [F.desc("volume_ml"), "concentration", "tester"]


def perfume_report(perfumes: DataFrame, best: DataFrame, latest: DataFrame, perfume: str = "perfume_id", store: str = "store_id") -> DataFrame:
    """Every perfume with the latest status of each store (a list by store, ties by time all in it), how many stores have it in stock, and its overall best offer.

    `best`: its variants' best offers; `latest`: results at each pair's latest time.
    """
    at = F.array_sort(F.collect_list(F.struct(store, "status")))
    there = F.count_distinct(F.when(F.col("status") == "in_stock", F.col(store)))
    statuses = latest.groupBy(perfume).agg(at.alias("statuses"), there.alias("in_stock_stores"))
    cheapest = overall_best(best, [perfume]).select(perfume, F.col("variant_id").alias("best_variant_id"), F.col("price").alias("best_price"))
    out = perfumes.join(statuses, perfume, "left").join(cheapest, perfume, "left")
    return out.withColumns({"statuses": F.coalesce("statuses", F.array()), "in_stock_stores": F.coalesce("in_stock_stores", F.lit(0))})


def detail(best: DataFrame, statuses: DataFrame, drops: DataFrame, stats: DataFrame, variant: str = "variant_id") -> DataFrame:
    """One row for each variant: its best offer and price per volume, drop, statistics, and stores in stock."""
    out = best.withColumn("price_per_ml", price_per_ml(F.col("price"), F.col("volume_ml")))
    return out.join(drops, variant, "left").join(stats, variant, "left").join(statuses, variant, "left")
