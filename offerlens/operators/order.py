"""Numbers of rows in a total order, without bringing the rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlens.sources.storage import written

#: monotonically_increasing_id() holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "row_number") -> DataFrame:
    """`df` with the number, from 1, of each row in `order`, which should leave no ties.

    Rows are dealt to ranges of the order, sorted and numbered in each by one shuffle; only the ranges' sizes, a row for each, meet in one place.
    """
    place = F.monotonically_increasing_id()
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place)
    own = written(ranges).withColumn("__range", F.shiftright("__at", _PLACE_BITS))
    before = F.coalesce(F.sum("count").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = own.groupBy("__range").count().select("__range", before.alias("__before"))
    number = F.col("__at") - F.shiftleft("__range", _PLACE_BITS) + F.col("__before") + 1
    return own.join(F.broadcast(sizes), "__range").withColumn(name, number).drop("__range", "__at", "__before")
