"""Price history: change-only series, latest entries, moves, drops, statistics, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def change_only(obs: DataFrame, series: list[str], order: list[str], watched: tuple[str, ...] = ("price", "availability")) -> DataFrame:
    """Observations that differ from the one before in a watched column, and each series' first."""
    w = W.partitionBy(*series).orderBy(*order)
    same = F.lag(F.lit(True)).over(w).isNotNull()
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return obs.withColumn("__same", same).where("NOT __same").drop("__same")


def latest(obs: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """The last observation of each series; one aggregation, no sort."""
    rest = [c for c in obs.columns if c not in series]
    return obs.groupBy(*series).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*series, "x.*")


def append_changes(history: DataFrame, batch: DataFrame, series: list[str], order: list[str], watched: tuple[str, ...] = ("price", "availability")) -> DataFrame:
    """Rows of one batch (a row for each series) that are to be appended to a change-only history."""
    return changed_entries(batch, latest(history, series, order), series, watched)


def changed_entries(batch: DataFrame, known: DataFrame, series: list[str], watched: tuple[str, ...] = ("price", "availability")) -> DataFrame:
    """Rows of a batch (a row for each series) that differ from what is known of their series, or that are its first.

    `known` has one row of a series at most: a snapshot that every change of the history went into tells as much as the history's last entries.
    """
    last = known.select(*series, *[F.col(c).alias(f"__{c}") for c in watched], F.lit(True).alias("__known"))
    same = F.col("__known").isNotNull()
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return batch.join(last, series, "left").where(~F.coalesce(same, F.lit(False))).select(*batch.columns)


def moves(obs: DataFrame, series: list[str], id_col: list[str], price: str = "price") -> DataFrame:
    """previous_price and delta where the price differs from the row before, by id; no row for a first one."""
    w = W.partitionBy(*series).orderBy(*id_col)
    out = obs.withColumn("previous_price", F.lag(price).over(w))
    return out.where(F.col("previous_price").isNotNull() & (F.col(price) != F.col("previous_price"))).withColumn("delta", F.col(price) - F.col("previous_price"))


def moves_of_run(obs: DataFrame, series: list[str], id_col: list[str], run_col: str, run: Column | None = None) -> DataFrame:
    """The moves of one run, by default the last; only the series that the run has rows of are looked at."""
    run = obs.agg(F.max(run_col)).scalar() if run is None else run
    touched = obs.where(F.col(run_col) == run).select(*series).distinct()
    return moves(obs.join(touched, series, "left_semi"), series, id_col).where(F.col(run_col) == run)


def count_moves_of_run(obs: DataFrame, series: list[str], id_col: list[str], run_col: str, run: Column | None = None) -> DataFrame:
    """(changes) of one run, by default the last: how many rows `moves_of_run` has, 0 where there is no run."""
    return moves_of_run(obs, series, id_col, run_col, run).agg(F.count("*").alias("changes"))


def series_history(history: DataFrame, wanted: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """All entries of the wanted series with recency 1, 2, ... from the newest."""
    w = W.partitionBy(*series).orderBy(*[F.desc(c) for c in order])
    return history.join(wanted.select(*series).distinct(), series, "left_semi").withColumn("recency", F.row_number().over(w))


def real_drop(obs: DataFrame, series: list[str], order: list[str], price: str = "price") -> DataFrame:
    """(series, drop) where the last price is below the one before, by time."""
    top2 = F.slice(F.sort_array(F.collect_list(F.struct(*order, price)), asc=False), 1, 2)
    w = W.partitionBy(*series).orderBy(*[F.desc(c) for c in order])
    ranked = obs.select(*series, *order, price).withColumn("__n", F.row_number().over(w)).where("__n <= 2")
    two = ranked.groupBy(*series).agg(top2.alias("x")).where(F.size("x") == 2)
    drop = F.col("x")[0][price] - F.col("x")[1][price]
    return two.select(*series, drop.alias("drop")).where("drop < 0")


def price_stats(obs: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """Least, greatest and mean price (halves to even, from an exact sum) and the number of entries."""
    mean = (F.sum(price).cast("decimal(38,6)") / F.count(price)).cast("decimal(38,10)")
    return obs.groupBy(*keys).agg(F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.bround(mean, 2).cast("decimal(10,2)").alias("avg_price"), F.count("*").alias("entries"))


def low_points(obs: DataFrame, series: list[str], price: str = "price") -> DataFrame:
    """Every entry with is_low: it has the series' least price."""
    return obs.withColumn("is_low", F.col(price) == F.min(price).over(W.partitionBy(*series)))


def scaled(obs: DataFrame, keys: list[str], at: str, price: str = "price") -> DataFrame:
    """x: share of the time span, y: share of the price span from above; spans of zero count as one."""
    w = W.partitionBy(*keys)
    p, first = F.col(price).cast("double"), F.min(at).over(w)
    span = F.max(p).over(w) - F.min(p).over(w)
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    seconds = lambda end: F.timestamp_diff("SECOND", first, end).cast("double")
    return obs.withColumns({"x": seconds(F.col(at)) / one(seconds(F.max(at).over(w))), "y": (F.max(p).over(w) - p) / one(span)})


def first_last_seen(obs: DataFrame, keys: list[str], at: str) -> DataFrame:
    return obs.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))
