"""Check results of stores: latest statuses, health of the last checks, roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses that count as a failure.
UNHEALTHY = ("scraping_error", "store_unavailable")


def latest_statuses(results: DataFrame, keys: list[str], at: str = "created_at") -> DataFrame:
    """Each group's results at its latest time; ties stay."""
    w = W.partitionBy(*keys).orderBy(F.desc(at))
    return results.withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def in_stock_stores(latest: DataFrame, by: list[str], store: str = "store_id") -> DataFrame:
    return latest.groupBy(*by).agg(F.count_distinct(F.when(F.col("status") == "in_stock", F.col(store))).alias("in_stock_stores"))


def last_results(results: DataFrame, keys: list[str], limit: int, at: str = "created_at", id_col: str = "result_id") -> DataFrame:
    """The last `limit` results of each group with recency 1, 2, ... from the newest."""
    w = W.partitionBy(*keys).orderBy(F.desc(at), F.desc(id_col))
    return results.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= limit)


def store_health(results: DataFrame, store: str = "store_id", limit: int = 20, at: str = "created_at", id_col: str = "result_id") -> DataFrame:
    """(store, total, healthy, failing_in_a_row) over each store's last `limit` results."""
    last = last_results(results, [store], limit, at, id_col).withColumn("ok", ~F.col("status").isin(*UNHEALTHY))
    return last.groupBy(store).agg(
        F.count("*").alias("total"), F.count_if("ok").alias("healthy"), (F.coalesce(F.min(F.when(F.col("ok"), F.col("recency"))), F.count("*") + 1) - 1).cast("long").alias("failing_in_a_row")
    )


def health_report(stores: DataFrame, results: DataFrame, store: str = "store_id", limit: int = 20) -> DataFrame:
    """Every store with its health, zeros for one without results, and its last statuses as a strip, oldest first."""
    last = last_results(results, [store], limit)
    strip = last.groupBy(store).agg(F.transform(F.sort_array(F.collect_list(F.struct("recency", "status")), asc=False), lambda x: x["status"]).alias("strip"))
    out = stores.join(store_health(results, store, limit), store, "left").join(strip, store, "left")
    return out.fillna({"total": 0, "healthy": 0, "failing_in_a_row": 0}).withColumn("strip", F.coalesce("strip", F.array().cast("array<string>")))


def store_rollup(results: DataFrame, store: str = "store_id", at: str = "created_at", id_col: str = "result_id") -> DataFrame:
    """Last success, and the last error where no success came after it."""
    bad = F.col("status").isin(*UNHEALTHY)
    order = F.struct(at, id_col)
    out = results.groupBy(store).agg(F.max(F.when(~bad, F.col(at))).alias("last_successful_check"), F.max_by(F.struct("status", bad.alias("bad")), order).alias("x"))
    return out.select(store, "last_successful_check", F.when(F.col("x.bad"), F.col("x.status")).alias("last_error"))
