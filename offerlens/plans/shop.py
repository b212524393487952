"""Shops made of the star schema: pages in four forms, what was fetched for whom, and the catalog; the input of whole runs, and the same as SQL."""

from __future__ import annotations

from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.plans import ingest
from offerlens.plans import tables as T
from offerlens.sources import pages as P
from offerlens.sources.storage import shared_dir, written
from offerlens.sources.versions import Versions

BASE = "https://shop.test"
#: What stores' numbers modulo 4 have as pages, by the name of the extractor.
FORMS = ["linked_data", "product_data", "radios", "suggester"]


@lru_cache(maxsize=1)
def extractors() -> dict[str, P.Extractor]:
    return {"linked_data": P.json_ld, "product_data": P.product_data, "radios": P.radio_combinations, "suggester": partial(P.suggestions, base_url=F.lit(BASE))}


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores whose number ends in 7 have an extractor that nobody knows."""
    n = F.col("store_id")
    form = F.when(n % 10 == 7, "unknown").otherwise(F.get(F.array(*map(F.lit, FORMS)), (n % 4).cast("int")))
    none = F.lit(None)
    return T.stores(spark, sf_dir).select("store_id", _slug().alias("slug"), F.col("store_name").alias("name"), F.lit(BASE).alias("base_url"), form.alias("extractor"), "enabled", none.cast("timestamp_ntz").alias("last_successful_check"), none.cast("string").alias("last_error"))


def _slug() -> Column:
    return F.concat(F.lit("shop"), F.col("store_id"))


def listed(spark: SparkSession, sf_dir: str, runs: list[int] | None = None) -> DataFrame:
    """Each observation, by default of all runs, as a listing of its run: the volume is five times the size, the concentration goes by the variant's number; suggesters round prices down."""
    seen = T.obs(spark, sf_dir)
    rows = (seen if runs is None else seen.where(F.col("run_id").isin(runs))).join(T.named_variants(spark, sf_dir), "variant_id")
    wording = F.get(F.array(*map(F.lit, ["Eau de Parfum", "Eau de Toilette", "Extract de parfum"])), (F.col("variant_id") % 3).cast("int"))
    tester = F.when(F.col("tester"), " Tester").otherwise("")
    title = F.concat("name", F.lit(" "), wording, F.lit(" "), F.col("volume_ml") * 5, F.lit(" ml"), tester)
    number = F.concat_ws("_", F.lpad(F.col("variant_id").cast("string"), 12, "0"), F.lpad(F.col("seq").cast("string"), 6, "0"))
    return rows.select("run_id", "store_id", "perfume_id", "variant_id", "seq", "brand", title.alias("title"), (F.col("volume_ml") * 5).alias("volume_ml"), "price", (F.col("availability") == "in_stock").alias("there"), number.alias("number"))


def pages(rows: DataFrame, broken: Column) -> DataFrame:
    """(store_id, perfume_id, store_slug, url, html) of the listings of one run: linked data and radio lists have a page for each, the others one for each perfume. Where `broken` holds, the page has nothing."""
    lei = F.concat(F.replace(F.format_number(F.floor("price"), 0), F.lit(","), F.lit(".")), F.lit(" lei"))
    ld = F.to_json(F.struct(
        F.lit("Product").alias("@type"), F.col("title").alias("name"), F.struct(F.col("brand").alias("name")).alias("brand"),
        F.struct(F.col("price").cast("string").alias("price"), F.col("number").alias("sku"), F.when(F.col("there"), "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability"), F.lit("RON").alias("priceCurrency")).alias("offers"),
    ))
    radio = F.concat(
        F.lit("<h1>"), "title", F.lit('</h1><div class="product-variants"><ul><li><input class="input-radio" value="'), "number", F.lit('"><span class="variant-price">'), F.replace(F.col("price").cast("string"), F.lit("."), F.lit(",")),
        F.lit(' lei</span><span class="attr-name">'), "volume_ml", F.lit(' ml</span><span class="variant-availability '), F.when(F.col("there"), "yes").otherwise("no"), F.lit('">x</span></li></ul></div>'),
    )
    one = F.when(F.col("store_id") % 4 == 0, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))).otherwise(radio)
    single = rows.where("store_id % 2 = 0").select("store_id", "perfume_id", F.concat(F.lit(f"{BASE}/p_"), "number").alias("url"), one.alias("html"))
    data = F.struct(
        (F.col("variant_id") * 1_000_000 + F.col("seq")).alias("product_id"), F.col("brand").alias("item_brand"), F.concat("brand", F.lit(" "), "title").alias("item_name"), F.col("price").alias("price_with_tax"), F.lit(False).alias("has_discount"),
        F.when(F.col("there"), "În stoc").otherwise("Stoc epuizat").alias("availability"), F.concat(F.lit(f"{BASE}/x_"), "number").alias("url"),
    )
    hint = F.struct(F.struct(F.col("title").alias("name"), F.concat(F.lit("/s_"), "number").alias("url"), F.lit("product").alias("type"), lei.alias("price"), F.when(F.col("there"), "În stoc").otherwise("Stoc epuizat").alias("stock_string"), F.col("number").alias("code")).alias("data"))
    each = rows.where("store_id % 2 = 1").groupBy("store_id", "perfume_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("number", data.alias("d"))))).alias("d"), F.transform(F.array_sort(F.collect_list(F.struct("number", hint.alias("h")))), lambda x: x["h"]).alias("s"))
    script = F.concat(F.lit('<script data-controller="utils-gtm-productdataprinter">'), F.to_json("d"), F.lit("</script>"))
    both = F.when(F.col("store_id") % 4 == 1, script).otherwise(F.to_json(F.struct(F.col("s").alias("suggestions"))))
    several = each.select("store_id", "perfume_id", F.concat(F.lit(f"{BASE}/q_"), "perfume_id").alias("url"), both.alias("html"))
    return single.unionByName(several).select("store_id", "perfume_id", _slug().alias("store_slug"), "url", F.when(broken, "<p>gone</p>").otherwise(F.col("html")).alias("html"))


def two_runs(spark: SparkSession, sf_dir: str) -> Versions:
    """The state after runs over the pages of the last two months, as stored tables.

    In the second run stores whose number ends in 9 do not answer, and pages of those that end in 8 are broken; what only the first month has is asked for and not found.
    """
    last, before = (int(r[0]) for r in T.last_runs(spark, sf_dir).limit(2).collect())
    rows = written(listed(spark, sf_dir, [last, before]))
    tables = ingest.open_state(spark, f"{shared_dir(spark)}/offerlens-state-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}", buckets=16)
    catalog = T.perfumes(spark, sf_dir).withColumns({c: F.lit(None) for c in ("normalized_brand", "normalized_name", "created_at", "updated_at", "last_checked_at")})
    tables.commit(0, {"catalog": catalog, "stores": stores(spark, sf_dir)})
    ok = F.lit(None).cast("string")
    pairs = None
    for run, month in ((1, before), (2, last)):
        late, n = run == 2, F.col("store_id")
        found = pages(rows.where(F.col("run_id") == month), F.lit(late) & (n % 10 == 8))
        found = written(found.where(F.lit(not late) | (n % 10 != 9)))
        now = rows.where(F.col("run_id") == month).select("store_id", "perfume_id").distinct()
        pairs = now if pairs is None else pairs.unionByName(now).distinct()
        fetched = found.select("perfume_id", "store_id", "store_slug", "url")
        rest = pairs.join(fetched, ["perfume_id", "store_id"], "left_anti").select("perfume_id", "store_id", _slug().alias("store_slug"), ok.alias("url"))
        down = F.lit(late) & (n % 10 == 9)
        fetches = fetched.unionByName(rest).select("perfume_id", "store_slug", "url", F.when(down, "store_unavailable").alias("error_status"), F.when(down, "timed out").alias("error_message"))
        ingest.store_run(tables, found.drop("store_id", "perfume_id"), written(fetches), extractors(), run, F.lit(f"2024-01-0{run} 00:00:00").cast("timestamp_ntz"))
    return tables


#: The same for the oracle: o: listings of enabled stores, c1 and c2: a run's offers, p1 and p2: its pairs, bad: pairs that fail in the second run.
_KEYS = "store_id, perfume_id, concentration, volume_ml, tester"
_BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY availability <> 'in_stock', price, variant_id, seq) AS n FROM o, m WHERE run_id = {{}}) WHERE n = 1"
SHOP = (
    "m AS (SELECT max(run_id) AS last, (SELECT max(run_id) FROM obs WHERE run_id < (SELECT max(run_id) FROM obs)) AS prev FROM obs), "
    "o AS (SELECT obs.store_id, perfume_id, CASE variant_id % 3 WHEN 0 THEN 'EDP' WHEN 1 THEN 'EDT' ELSE 'Extrait' END AS concentration, volume_ml * 5 AS volume_ml, tester, CAST(CASE WHEN obs.store_id % 4 = 3 THEN floor(obs.price) ELSE obs.price END AS DECIMAL(10,2)) AS price, availability, seq, variant_id, run_id "
    "FROM obs JOIN variants USING (variant_id) JOIN perfumes USING (brand, name) JOIN stores ON stores.store_id = obs.store_id WHERE enabled), "
    f"c1 AS (SELECT * FROM ({_BEST.format('prev')}) WHERE store_id % 10 <> 7), c2 AS (SELECT * FROM ({_BEST.format('last')}) WHERE store_id % 10 NOT IN (7, 8, 9)), "
    "p1 AS (SELECT DISTINCT perfume_id, store_id FROM o, m WHERE run_id = prev), now2 AS (SELECT DISTINCT perfume_id, store_id FROM o, m WHERE run_id = last), p2 AS (SELECT * FROM p1 UNION SELECT * FROM now2), "
    "r2 AS (SELECT perfume_id, store_id, CASE WHEN store_id % 10 = 7 THEN 'no extractor for unknown' WHEN store_id % 10 = 9 THEN 'timed out' WHEN store_id % 10 = 8 AND (perfume_id, store_id) IN (SELECT (perfume_id, store_id) FROM now2) THEN 'structure not recognised' END AS message FROM p2), "
    f"both_ AS (SELECT {_KEYS}, c1.price AS p1, c2.price AS p2, c1.availability AS a1, c2.availability AS a2, c1.store_id IS NOT NULL AND c1.availability = 'in_stock' AND c2.store_id IS NULL AND (perfume_id, store_id) IN (SELECT (perfume_id, store_id) FROM r2 WHERE message IS NULL) AS gone FROM c1 FULL JOIN c2 USING ({_KEYS})), "
    "out2 AS (SELECT perfume_id, store_id, message, count(c2.store_id) AS n, coalesce(bool_or(c2.availability = 'in_stock'), false) AS there FROM r2 LEFT JOIN c2 USING (perfume_id, store_id) GROUP BY ALL), "
    "st2 AS (SELECT *, CASE WHEN message = 'timed out' THEN 'store_unavailable' WHEN message IS NOT NULL THEN 'scraping_error' WHEN there THEN 'in_stock' WHEN n > 0 THEN 'out_of_stock' ELSE 'not_found' END AS status FROM out2)"
)
KEYS = _KEYS
CTES = "obs variants perfumes stores"
