"""Price alerts: which fire, the overview, and their persisted state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.operators.compare import in_stock_priced


def firing(alerts: DataFrame, offers: DataFrame, variant: str = "variant_id") -> DataFrame:
    """Pairs of an enabled alert and an in-stock offer at or below its target."""
    a = alerts.where("enabled").alias("a")
    return a.join(offers.where(in_stock_priced()).alias("o"), (F.col(f"a.{variant}") == F.col(f"o.{variant}")) & (F.col("o.price") <= F.col("a.target_price"))).drop(F.col(f"o.{variant}"))


def triggered(alerts: DataFrame, offers: DataFrame) -> DataFrame:
    """(alert_id, best_price, n_offers) of alerts that fire."""
    return firing(alerts, offers).groupBy("alert_id").agg(F.min("price").alias("best_price"), F.count("*").alias("n_offers"))


def overview_keys() -> list:
    """Order of the overview: alerts that fire first, then by brand and name."""
    return [F.desc("fires"), F.lower("brand"), F.lower("name"), "alert_id"]


def overview(alerts: DataFrame, offers: DataFrame, variants: DataFrame) -> DataFrame:
    """Every enabled alert, those that fire first, then by brand and name."""
    out = alerts.where("enabled").join(triggered(alerts, offers), "alert_id", "left").join(variants, "variant_id")
    out = out.withColumn("fires", F.col("best_price").isNotNull())
    return out.orderBy(*overview_keys())


def live(alerts: DataFrame, offers: DataFrame) -> DataFrame:
    """Each firing alert with its offers, cheapest first."""
    return firing(alerts, offers).groupBy("alert_id").agg(F.sort_array(F.collect_list(F.struct("price", "offer_id"))).alias("offers"))


def persist_triggers(alerts: DataFrame, offers: DataFrame, now) -> DataFrame:
    """Alerts with last_triggered_at and last_triggered_price of this evaluation; those that do not fire keep theirs."""
    hit = triggered(alerts, offers).select("alert_id", "best_price")
    return alerts.join(hit, "alert_id", "left").withColumns(
        {"last_triggered_at": F.when(F.col("best_price").isNotNull(), now).otherwise(F.col("last_triggered_at")), "last_triggered_price": F.coalesce("best_price", "last_triggered_price")}
    ).drop("best_price")
