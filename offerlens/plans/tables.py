"""The domain's tables as Spark derives them from the given star schema, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a stored table for each task that sorts them: with more rows there are more tasks, and none needs more memory.
TASK_ROWS = 250_000


def tasks(stored: DataFrame) -> int:
    """Tasks for as many rows as a stored table has; they are counted from the files' footers."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, stored.count() // TASK_ROWS + 1)


def dealt(stored: DataFrame, *keys: str) -> DataFrame:
    """Rows of a stored table dealt to tasks by `keys`."""
    return stored.repartition(tasks(stored), *keys)


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: a part is a variant, a supplier a store; seq numbers each variant's rows by all columns."""
    return distinct_lines(spark, sf_dir).select(
        F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("store_id"), F.col("l_extendedprice").cast("decimal(10,2)").alias("price"), F.col("l_shipdate").alias("recorded_at"),
        F.when(F.col("l_linestatus") == "O", "in_stock").otherwise("out_of_stock").alias("availability"), _run().alias("run_id"), "seq",
    )


def _run() -> Column:
    return F.year("l_shipdate") * 12 + F.month("l_shipdate")


def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without repeated rows; seq numbers each part's by all columns. Rows that are equal stand together in that order, so the sort that numbers them also tells the first of each: one shuffle, by part."""
    w = W.partitionBy("l_partkey").orderBy(*LINE)
    numbers = {"seq": F.dense_rank().over(w), "__rank": F.rank().over(w), "__row": F.row_number().over(w)}
    return dealt(read(spark, sf_dir, "lineitem").select("l_partkey", *LINE), "l_partkey").withColumns(numbers).where("__rank = __row").drop("__rank", "__row")


def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id) of all runs, the last one first; repeated rows make no difference to it."""
    return read(spark, sf_dir, "lineitem").select(_run().alias("run_id")).where("run_id IS NOT NULL").distinct().orderBy(F.desc("run_id"))


def perfumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (brand, name), with the least number of its parts as perfume_id."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("perfume_id"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("variant_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("concentration"),
        F.col("p_size").alias("volume_ml"), (F.col("p_partkey") % 10 == 0).alias("tester"),
    )


def named_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with their perfume_id: tables of parts alone meet here, so that observations need no shuffle by name."""
    return variants(spark, sf_dir).join(perfumes(spark, sf_dir), ["brand", "name"])


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"), (F.col("s_acctbal") >= 0).alias("enabled"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of each (variant, store); offer_id is the store, which is unique for a variant."""
    from offerlens.operators.history import latest

    return latest(obs(spark, sf_dir), ["variant_id", "store_id"], ["recorded_at", "seq"]).withColumn("offer_id", F.col("store_id"))


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, store_id) of the offers, in tasks that sort their rows, which takes less memory than a hash map of nearly as many pairs."""
    w = W.partitionBy("variant_id").orderBy("store_id")
    pairs = dealt(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("store_id")), "variant_id")
    return pairs.withColumns({"__rank": F.rank().over(w), "__row": F.row_number().over(w)}).where("__rank = __row").drop("__rank", "__row")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("alert_id"), F.col("p_partkey").alias("variant_id"), (F.col("p_retailprice").cast("decimal(10,2)") * 20).cast("decimal(12,2)").alias("target_price"), (F.col("p_partkey") % 15 != 0).alias("enabled"),
    )


STATUS = {"error": "scraping_error", "signup": "store_unavailable", "purchase": "in_stock", "click": "out_of_stock"}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.lit("not_found")
    for kind, value in STATUS.items():
        status = F.when(F.col("event_type") == kind, value).otherwise(status)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("result_id"), F.col("user_id").alias("store_id"), F.col("ts").alias("created_at"), status.alias("status"), (F.col("event_id") % 20).alias("perfume_id"))


def accords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is an item, the types of its parts its accords, the summed quantities their strengths."""
    lines = distinct_lines(spark, sf_dir).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sums = lines.groupBy(F.col("l_suppkey").alias("item_id"), F.col("p_type").alias("accord")).agg(F.sum("l_quantity").cast("long").alias("strength"))
    return sums.withColumn("position", F.row_number().over(W.partitionBy("item_id").orderBy("accord")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_suppkey").alias("item_id"), F.col("p_name").alias("name")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's similar ones: the three that stand most often on the line after its own in an order, of all lines.

    Lines of one number, part and supplier stand together, whatever else they hold, and what follows within them is the supplier itself, which does not count: neither repeated rows nor the other columns change anything.
    """
    rows = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    nxt = rows.withColumn("dst", F.lead("l_suppkey").over(w)).where("dst IS NOT NULL AND dst <> l_suppkey")
    times = nxt.groupBy(F.col("l_suppkey").alias("src"), "dst").agg(F.count("*").alias("n"))
    top = F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return times.withColumn("place", top).where("place <= 3").select("src", "dst")


#: The same relations for the oracle, each under the name above.
CTES = {
    "obs": """obs AS (SELECT l_partkey AS variant_id, l_suppkey AS store_id, CAST(l_extendedprice AS DECIMAL(10,2)) AS price, l_shipdate AS recorded_at,
      CASE l_linestatus WHEN 'O' THEN 'in_stock' ELSE 'out_of_stock' END AS availability, year(l_shipdate) * 12 + month(l_shipdate) AS run_id,
      row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq
      FROM (SELECT DISTINCT * FROM lineitem))""",
    "variants": "variants AS (SELECT p_partkey AS variant_id, p_brand AS brand, p_name AS name, p_type AS concentration, p_size AS volume_ml, p_partkey % 10 = 0 AS tester FROM part)",
    "perfumes": "perfumes AS (SELECT p_brand AS brand, p_name AS name, min(p_partkey) AS perfume_id FROM part GROUP BY 1, 2)",
    "stores": "stores AS (SELECT s_suppkey AS store_id, s_name AS store_name, s_acctbal >= 0 AS enabled FROM supplier)",
    "offers": """offers AS (SELECT *, store_id AS offer_id FROM (SELECT *, row_number() OVER (PARTITION BY variant_id, store_id ORDER BY recorded_at DESC, seq DESC) AS rn FROM obs) WHERE rn = 1)""",
    "alerts": "alerts AS (SELECT p_partkey AS alert_id, p_partkey AS variant_id, CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 20 AS DECIMAL(12,2)) AS target_price, p_partkey % 15 <> 0 AS enabled FROM part)",
    "results": """results AS (SELECT event_id AS result_id, user_id AS store_id, ts AS created_at, event_id % 20 AS perfume_id,
      CASE event_type WHEN 'error' THEN 'scraping_error' WHEN 'signup' THEN 'store_unavailable' WHEN 'purchase' THEN 'in_stock' WHEN 'click' THEN 'out_of_stock' ELSE 'not_found' END AS status FROM events)""",
    "best": """best AS (SELECT v.*, o.store_id, o.price, o.availability, o.recorded_at FROM variants v LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY price, offer_id) AS bn FROM offers WHERE availability = 'in_stock' AND price IS NOT NULL) o ON v.variant_id = o.variant_id AND bn = 1)""",
    "accords": """accords AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY accord) AS position FROM (
      SELECT l_suppkey AS item_id, p_type AS accord, CAST(sum(l_quantity) AS BIGINT) AS strength FROM (SELECT DISTINCT * FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))""",
    "notes": "notes AS (SELECT DISTINCT l_suppkey AS item_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "edges": """edges AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS place FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS dst
      FROM (SELECT DISTINCT * FROM lineitem)) WHERE dst IS NOT NULL AND dst <> src GROUP BY src, dst) WHERE place <= 3)""",
}


def sql(names: str, query: str, more: str = "") -> str:
    """A query over some of CTES, in the order given, and more of its own."""
    return f"WITH RECURSIVE {', '.join([*[CTES[n] for n in names.split()], *([more] if more else [])])} {query}"
