"""Joins whose keys are uneven."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast, a fixed number; each other key has at most 1/HOT_KEYS of the rows.
HOT_KEYS = 256
#: Rows from which on a key can be one of them.
HOT_ROWS = 32


def join_once(rows: DataFrame, sums: DataFrame, keys: list[str], n: str = "n", how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """`rows` joined (inner, left or left_semi) with `sums`: one row for each key, with the number of its rows in column `n`.

    Rows of the most frequent keys stay where they are and meet a broadcast of `hot_keys` rows at most; the others are
    shuffled. Rows with a null key match nothing and, in a left join, stay where they are; `n` is dropped. `rows` and `sums` are read more than once.
    """
    if how == "left":
        whole, more = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), [f for f in sums.schema if f.name not in (*keys, n)]
        odd = rows.where(~whole).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more])
        rows = rows.where(whole)
    top = sums.where(F.col(n) >= HOT_ROWS).orderBy(F.desc(n), *keys).limit(hot_keys)
    rest = rows.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(sums.drop(n), keys, how)
    hot = rows.join(F.broadcast(top.drop(n)), keys, "inner" if how == "left" else how)
    both = hot.unionByName(rest)
    return both.unionByName(odd) if how == "left" else both
