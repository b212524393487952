"""Schemas of the domain's tables; read with them, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MONEY = "decimal(10,2)"
TABLES = {
    "catalog": "perfume_id long, brand string, name string, normalized_brand string, normalized_name string, created_at timestamp_ntz, updated_at timestamp_ntz, last_checked_at timestamp_ntz",
    "variants": "variant_id long, perfume_id long, concentration string, volume_ml int, tester boolean",
    "stores": "store_id long, slug string, name string, base_url string, extractor string, enabled boolean, last_successful_check timestamp_ntz, last_error string",
    "current_offers": f"store_id long, variant_id long, url string, identifier string, title string, price {MONEY}, old_price {MONEY}, currency string, discount_percentage int, availability string, coupon_code string, coupon_price {MONEY}, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    "price_history": f"id long, store_id long, variant_id long, run_id long, recorded_at timestamp_ntz, price {MONEY}, old_price {MONEY}, currency string, discount_percentage int, availability string",
    "runs": "run_id long, run_type string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, perfume_count int, store_count int",
    "check_results": "result_id long, run_id long, perfume_id long, store_id long, status string, offers_found int, error_message string, created_at timestamp_ntz",
    "alerts": f"alert_id long, variant_id long, target_price {MONEY}, currency string, enabled boolean, last_triggered_at timestamp_ntz, last_triggered_price {MONEY}",
    "aliases": "perfume_id long, normalized_alias string, alias string",
    "review_queue": f"perfume_id long, store_id long, product_url string, title string, candidate_brand string, candidate_name string, concentration string, volume_ml int, tester boolean, price {MONEY}, old_price {MONEY}, currency string, availability string, identifier string, match_score double, status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, resolved_at timestamp_ntz",
    "items": f"item_id long, url string, brand string, name string, price {MONEY}, currency string, volume_ml int",
    "item_accords": "item_id long, accord string, strength int, position int",
    "item_notes": "item_id long, tier string, name string, position int",
    "item_similar": "item_id long, brand string, name string, url string, position int",
    "raw_pages": "store_slug string, page_kind string, url string, html string, fetched_at timestamp_ntz",
    "raw_offers": f"store_slug string, perfume_id long, raw_title string, product_url string, store_product_identifier string, brand string, perfume_name string, concentration string, volume_ml int, tester boolean, price {MONEY}, old_price {MONEY}, currency string, availability string, coupon_code string, coupon_price {MONEY}, scraped_at timestamp_ntz",
}
SORTS = {"name": ["name", "brand"], "brand": ["brand", "name"]}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table; columns that an older version lacks are null."""
    return spark.read.schema(schema(name)).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "raw_pages")


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same table as a stream of the files that arrive."""
    return spark.readStream.schema(schema("raw_pages")).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_sitemaps(spark: SparkSession, path: str, index: bool = False, stream: bool = False) -> DataFrame:
    """(loc, lastmod, file) of the locations in a folder of sitemap files, or of the sitemaps that index files name; read in parts by Spark's XML source."""
    reader = spark.readStream if stream else spark.read
    rows = reader.format("xml").option("rowTag", "sitemap" if index else "url").schema("loc string, lastmod string").load(path)
    return rows.where("loc IS NOT NULL").select(F.trim("loc").alias("loc"), "lastmod", F.col("_metadata.file_name").alias("file"))


def conform(df: DataFrame, name: str, *more: Column | str) -> DataFrame:
    """The table's columns in order, cast, and those in `more`; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)], *more)


def sort_keys(key: str) -> list[str]:
    """By name, or by brand and name; other keys mean name."""
    return SORTS.get(key, SORTS["name"])


def items_sorted(items: DataFrame, key: str) -> DataFrame:
    """The collection in the order of `sort_keys`."""
    return items.orderBy(*sort_keys(key))
