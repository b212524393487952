"""Queries over the star schema, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import money as M
from offerlens.functions import similarity as S
from offerlens.functions import sql as SQLF
from offerlens.functions import text as X
from offerlens.operators import alerts as A
from offerlens.operators import collection as C
from offerlens.operators import compare as P
from offerlens.operators import graph as G
from offerlens.operators import health as H
from offerlens.operators import history as Y
from offerlens.operators import matching as MA
from offerlens.operators import offers as O
from offerlens.operators.order import numbered
from offerlens.operators import overlap as V
from offerlens.operators import review as R
from offerlens.plans import run as RUN
from offerlens.plans import shop as SH
from offerlens.plans import tables as T
from offerlens.plans.tables import CTES, sql, stamp
from offerlens.sources import pages as SP
from offerlens.sources import schema as SC
from offerlens.sources.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None, ctes: str = "", more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = sql(ctes, oracle, more) if ctes else oracle
        return f

    return add


def best(s: SparkSession, d: str) -> DataFrame:
    return P.best_offer_per_variant(T.variants(s, d), T.offers(s, d))


BEST = "obs offers variants best"


@query("SELECT variant_id, store_id, price, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS recorded_at FROM best", BEST)
def best_offer_per_variant(s, d):
    return best(s, d).select("variant_id", "store_id", "price", stamp("recorded_at").alias("recorded_at"))


@query("SELECT brand, name, variant_id, store_id, price FROM (SELECT *, row_number() OVER (PARTITION BY brand, name ORDER BY CAST(price AS DECIMAL(38,18)) / volume_ml, variant_id) AS n FROM best WHERE price IS NOT NULL AND volume_ml > 0) WHERE n = 1", BEST)
def best_value_per_perfume(s, d):
    return P.best_value_per_perfume(best(s, d), ["brand", "name"]).select("brand", "name", "variant_id", "store_id", "price")


@query("SELECT brand, name, variant_id, price FROM (SELECT *, row_number() OVER (PARTITION BY brand, name ORDER BY price, volume_ml DESC, concentration, tester, variant_id) AS n FROM best WHERE price IS NOT NULL) WHERE n = 1", BEST)
def overall_best_by_perfume(s, d):
    return P.overall_best(best(s, d), ["brand", "name"]).select("brand", "name", "variant_id", "price")


@query("SELECT o.variant_id, o.store_id, o.price, o.availability, s.first_seen_at, s.last_seen_at FROM offers o JOIN (SELECT variant_id, store_id, strftime(min(recorded_at), '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM obs GROUP BY 1, 2) s USING (variant_id, store_id)", "obs offers")
def current_offers(s, d):
    seen = Y.first_last_seen(T.obs(s, d), ["variant_id", "store_id"], "recorded_at")
    return T.offers(s, d).join(seen, ["variant_id", "store_id"]).select("variant_id", "store_id", "price", "availability", stamp("first_seen_at").alias("first_seen_at"), stamp("last_seen_at").alias("last_seen_at"))


@query("SELECT o.variant_id, o.store_id, store_name, brand, name, price FROM offers o JOIN variants USING (variant_id) JOIN stores USING (store_id) WHERE availability = 'in_stock' AND enabled", "obs offers variants stores")
def in_stock_enriched(s, d):
    stores = T.stores(s, d).where("enabled")
    return P.enrich_offers(T.offers(s, d), T.variants(s, d), stores).select("variant_id", "store_id", "store_name", "brand", "name", "price")


@query("SELECT variant_id, seq, price, availability FROM (SELECT *, lag(price) OVER w AS p, lag(availability) OVER w AS a, row_number() OVER w AS n FROM obs WINDOW w AS (PARTITION BY variant_id ORDER BY recorded_at, seq)) WHERE n = 1 OR p <> price OR a <> availability", "obs")
def change_only_history(s, d):
    return Y.change_only(T.obs(s, d), ["variant_id"], ["recorded_at", "seq"]).select("variant_id", "seq", "price", "availability")


@query("SELECT variant_id, seq, price, previous_price, price - previous_price AS delta, row_number() OVER (ORDER BY abs(price - previous_price) DESC, variant_id, seq) AS row_number FROM (SELECT *, lag(price) OVER (PARTITION BY variant_id ORDER BY seq) AS previous_price FROM obs) WHERE previous_price <> price AND run_id = (SELECT max(run_id) FROM obs)", "obs")
def price_changes_last_run(s, d):
    moved = Y.moves_of_run(T.obs(s, d), ["variant_id"], ["seq"], "run_id").select("variant_id", "seq", "price", "previous_price", "delta")
    return numbered(moved, F.desc(F.abs("delta")), "variant_id", "seq")


@query('SELECT variant_id, a - b AS "drop" FROM (SELECT variant_id, price AS a, lead(price) OVER w AS b, row_number() OVER w AS n FROM obs WINDOW w AS (PARTITION BY variant_id ORDER BY recorded_at DESC, seq DESC)) WHERE n = 1 AND a < b', "obs")
def real_price_drop(s, d):
    return Y.real_drop(T.obs(s, d), ["variant_id"], ["recorded_at", "seq"])


@query("SELECT variant_id, min(price) AS min_price, max(price) AS max_price, CAST(CAST((CASE WHEN c % n * 2 > n THEN c // n + 1 WHEN c % n * 2 = n AND (c // n) % 2 = 1 THEN c // n + 1 ELSE c // n END) AS BIGINT) / 100.0 AS DECIMAL(10,2)) AS avg_price, any_value(n) AS entries FROM (SELECT variant_id, price, CAST(sum(price) OVER (PARTITION BY variant_id) * 100 AS BIGINT) AS c, count(*) OVER (PARTITION BY variant_id) AS n FROM obs) GROUP BY variant_id, c, n", "obs")
def price_stats(s, d):
    return Y.price_stats(T.obs(s, d), ["variant_id"])


@query("SELECT variant_id, store_id, seq, price FROM (SELECT *, min(price) OVER (PARTITION BY variant_id, store_id) AS m FROM obs) WHERE price = m", "obs")
def low_points(s, d):
    return Y.low_points(T.obs(s, d), ["variant_id", "store_id"]).where("is_low").select("variant_id", "store_id", "seq", "price")


@query("SELECT variant_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT variant_id, seq, CAST(date_diff('second', min(recorded_at) OVER w, recorded_at) AS DOUBLE) / CASE WHEN min(recorded_at) OVER w = max(recorded_at) OVER w THEN 1 ELSE date_diff('second', min(recorded_at) OVER w, max(recorded_at) OVER w) END AS x, (CAST(max(price) OVER w AS DOUBLE) - CAST(price AS DOUBLE)) / CASE WHEN max(price) OVER w = min(price) OVER w THEN 1 ELSE CAST(max(price) OVER w AS DOUBLE) - CAST(min(price) OVER w AS DOUBLE) END AS y FROM obs WINDOW w AS (PARTITION BY variant_id))", "obs")
def scaled_points(s, d):
    return Y.scaled(T.obs(s, d), ["variant_id"], "recorded_at").select("variant_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT store_id, strftime(min(recorded_at), '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM obs GROUP BY 1", "obs")
def first_last_seen(s, d):
    return Y.first_last_seen(T.obs(s, d), ["store_id"], "recorded_at").select("store_id", stamp("first_seen_at").alias("first_seen_at"), stamp("last_seen_at").alias("last_seen_at"))


@query("SELECT run_id, store_id, variant_id, price, availability FROM (SELECT *, row_number() OVER (PARTITION BY run_id, store_id, variant_id ORDER BY availability <> 'in_stock', price, seq) AS n FROM obs) WHERE n = 1", "obs")
def dedup_offers_in_run(s, d):
    return O.dedup_in_run(T.obs(s, d), ["run_id", "store_id", "variant_id"], ["seq"]).select("run_id", "store_id", "variant_id", "price", "availability")


TWO_RUNS = "two AS (SELECT max(run_id) AS last, max(run_id) - 6 AS mid FROM obs)"
_two = CTES["obs"] + ", " + TWO_RUNS + ", snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant_id, store_id ORDER BY recorded_at DESC, seq DESC) AS n FROM obs, two WHERE run_id <= mid) WHERE n = 1), runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, variant_id, store_id ORDER BY availability <> 'in_stock', price, seq) AS n FROM obs, two WHERE run_id > mid) WHERE n = 1), batch AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY variant_id, store_id ORDER BY run_id DESC) AS n FROM runs) WHERE n = 1)"


def _snapshot_and_batch(s, d):
    """The snapshot half a year before the last run, and the latest offers of the runs since, each run's duplicates settled within it."""
    obs = T.obs(s, d)
    mid = obs.agg(F.max("run_id") - 6).scalar()
    old = Y.latest(obs.where(F.col("run_id") <= mid), ["variant_id", "store_id"], ["recorded_at", "seq"])
    runs = O.dedup_in_run(obs.where(F.col("run_id") > mid), ["run_id", "variant_id", "store_id"], ["seq"])
    return old, Y.latest(runs, ["variant_id", "store_id"], ["run_id"])


@query(f"WITH {_two} SELECT s.variant_id, s.store_id, s.price, 'out_of_stock' AS availability FROM snap s WHERE availability = 'in_stock' AND store_id IN (SELECT store_id FROM batch) AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.variant_id = s.variant_id AND b.store_id = s.store_id)")
def delisted_offers(s, d):
    old, batch = _snapshot_and_batch(s, d)
    return O.delisted(old, batch, batch, ["variant_id", "store_id"]).select("variant_id", "store_id", "price", "availability")


@query(f"WITH {_two} SELECT coalesce(b.variant_id, s.variant_id) AS variant_id, coalesce(b.store_id, s.store_id) AS store_id, coalesce(b.price, s.price) AS price, coalesce(b.availability, s.availability) AS availability, coalesce(s.run_id, 0) AS first_seen_at, CASE WHEN b.variant_id IS NULL THEN s.run_id ELSE 0 END AS last_seen_at FROM snap s FULL JOIN batch b ON s.variant_id = b.variant_id AND s.store_id = b.store_id")
def upsert_snapshot(s, d):
    old, batch = _snapshot_and_batch(s, d)
    old = old.select("variant_id", "store_id", "price", "availability", F.col("run_id").alias("first_seen_at"), F.col("run_id").alias("last_seen_at"))
    return O.upsert_snapshot(old, batch, F.lit(0), ["variant_id", "store_id"])


@query(f"WITH {_two} SELECT b.variant_id, b.store_id, b.price, b.availability FROM batch b LEFT JOIN snap s ON s.variant_id = b.variant_id AND s.store_id = b.store_id WHERE s.variant_id IS NULL OR s.price <> b.price OR s.availability <> b.availability")
def incremental_changes(s, d):
    old, batch = _snapshot_and_batch(s, d)
    return Y.append_changes(old, batch, ["variant_id", "store_id"], ["recorded_at", "seq"]).select("variant_id", "store_id", "price", "availability")


@query("SELECT r.store_id, r.result_id, CASE WHEN r.status IN ('scraping_error', 'store_unavailable') THEN r.status WHEN n IS NULL THEN 'not_found' WHEN i THEN 'in_stock' ELSE 'out_of_stock' END AS status, coalesce(n, 0) AS offers_found FROM results r LEFT JOIN (SELECT store_id, count(*) AS n, bool_or(availability = 'in_stock') AS i FROM obs WHERE run_id = (SELECT max(run_id) FROM obs) GROUP BY 1) o USING (store_id)", "obs results")
def run_outcome(s, d):
    obs = T.obs(s, d)
    saved = obs.join(F.broadcast(obs.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")
    attempts = T.results(s, d).select("store_id", "result_id", F.when(F.col("status").isin(*H.UNHEALTHY), F.col("status")).alias("error_status"))
    return O.run_outcomes(attempts, saved, ["store_id"]).drop("error_status")


@query("SELECT perfume_id AS run_id, CASE WHEN bool_or(status IN ('scraping_error', 'store_unavailable')) THEN 'completed_with_errors' ELSE 'completed' END AS run_status, count(*) AS checks FROM results GROUP BY 1", "results")
def run_status(s, d):
    return O.run_status(T.results(s, d).withColumnRenamed("perfume_id", "run_id"))


@query("SELECT perfume_id, store_id, result_id, status FROM (SELECT *, rank() OVER (PARTITION BY perfume_id, store_id ORDER BY created_at DESC) AS n FROM results) WHERE n = 1", "results")
def latest_status_ties(s, d):
    return H.latest_statuses(T.results(s, d), ["perfume_id", "store_id"]).select("perfume_id", "store_id", "result_id", "status")


@query("SELECT perfume_id, count(DISTINCT CASE WHEN status = 'in_stock' THEN store_id END) AS in_stock_stores FROM (SELECT *, rank() OVER (PARTITION BY perfume_id, store_id ORDER BY created_at DESC) AS n FROM results) WHERE n = 1 GROUP BY 1", "results")
def in_stock_store_count(s, d):
    return H.in_stock_stores(H.latest_statuses(T.results(s, d), ["perfume_id", "store_id"]), ["perfume_id"])


@query("SELECT store_id, count(*) AS total, count(*) FILTER (WHERE ok) AS healthy, coalesce(min(CASE WHEN ok THEN n END), count(*) + 1) - 1 AS failing_in_a_row FROM (SELECT *, status NOT IN ('scraping_error', 'store_unavailable') AS ok, row_number() OVER (PARTITION BY store_id ORDER BY created_at DESC, result_id DESC) AS n FROM results) WHERE n <= 20 GROUP BY 1", "results")
def store_health(s, d):
    return H.store_health(T.results(s, d))


@query("SELECT store_id, strftime(max(CASE WHEN NOT bad THEN created_at END), '%Y-%m-%d %H:%M:%S') AS last_successful_check, arg_max(CASE WHEN bad THEN status ELSE '' END, (created_at, result_id)) AS last_error FROM (SELECT *, status IN ('scraping_error', 'store_unavailable') AS bad FROM results) GROUP BY 1", "results")
def store_rollup(s, d):
    return H.store_rollup(T.results(s, d)).select("store_id", stamp("last_successful_check").alias("last_successful_check"), F.coalesce("last_error", F.lit("")).alias("last_error"))


@query("SELECT perfume_id, store_id, result_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY perfume_id ORDER BY created_at DESC, result_id DESC) AS recency FROM results) WHERE recency <= 50", "results")
def last_results_per_perfume(s, d):
    return H.last_results(T.results(s, d), ["perfume_id"], 50).select("perfume_id", "store_id", "result_id", "recency")


ALERT = "obs offers variants alerts"


@query("SELECT alert_id, min(price) AS best_price, count(*) AS n_offers FROM alerts JOIN offers USING (variant_id) WHERE enabled AND availability = 'in_stock' AND price <= target_price GROUP BY 1", ALERT)
def triggered_alerts(s, d):
    return A.triggered(T.alerts(s, d), T.offers(s, d))


@query("SELECT a.alert_id, a.target_price, best_price, coalesce(n_offers, 0) AS n_offers, brand, name, best_price IS NOT NULL AS fires, row_number() OVER (ORDER BY best_price IS NULL, lower(brand), lower(name), a.alert_id) AS row_number FROM alerts a JOIN variants USING (variant_id) LEFT JOIN (SELECT alert_id, min(price) AS best_price, count(*) AS n_offers FROM alerts JOIN offers USING (variant_id) WHERE enabled AND availability = 'in_stock' AND price <= target_price GROUP BY 1) t USING (alert_id) WHERE enabled", ALERT)
def alert_overview(s, d):
    found = A.overview(T.alerts(s, d), T.offers(s, d), T.variants(s, d)).select("alert_id", "target_price", "best_price", F.coalesce("n_offers", F.lit(0)).alias("n_offers"), "brand", "name", "fires")
    return numbered(found, *A.overview_keys())


@query("SELECT alert_id, string_agg(offer_id || ':' || price, ',' ORDER BY price, offer_id) AS offers FROM alerts JOIN offers USING (variant_id) WHERE enabled AND availability = 'in_stock' AND price <= target_price GROUP BY 1", ALERT)
def live_alerts(s, d):
    live = A.live(T.alerts(s, d), T.offers(s, d))
    return live.select("alert_id", F.array_join(F.transform("offers", lambda x: F.concat_ws(":", x["offer_id"], x["price"])), ",").alias("offers"))


@query("SELECT alert_id, best_price AS last_triggered_price, CASE WHEN best_price IS NULL THEN 0 ELSE 1 END AS last_triggered_at FROM alerts LEFT JOIN (SELECT alert_id, min(price) AS best_price FROM alerts JOIN offers USING (variant_id) WHERE enabled AND availability = 'in_stock' AND price <= target_price GROUP BY 1) USING (alert_id)", ALERT)
def persisted_triggers(s, d):
    alerts = T.alerts(s, d).withColumns({"last_triggered_at": F.lit(0), "last_triggered_price": F.lit(None).cast("decimal(10,2)")})
    return A.persist_triggers(alerts, T.offers(s, d), F.lit(1)).select("alert_id", "last_triggered_price", "last_triggered_at")


DASH = "dash AS (SELECT p.brand, p.name, b.price AS best_price, b.variant_id, p.n_variants FROM (SELECT brand, name, count(*) AS n_variants FROM variants GROUP BY 1, 2) p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, name ORDER BY CAST(price AS DECIMAL(38,18)) / volume_ml, variant_id) AS n FROM best WHERE price IS NOT NULL AND volume_ml > 0) WHERE n = 1) b ON p.brand = b.brand AND p.name = b.name)"


def _dashboard(s, d):
    catalog = T.variants(s, d).groupBy("brand", "name").agg(F.count("*").alias("n_variants"))
    value = P.best_value_per_perfume(best(s, d), ["brand", "name"]).select("brand", "name", F.col("price").alias("best_price"), "variant_id")
    return catalog.join(value, ["brand", "name"], "left").withColumn("last_checked_at", F.lit(None).cast("timestamp"))


@query(f"WITH {CTES['obs']}, {CTES['offers']}, {CTES['variants']}, {CTES['best']}, {DASH} SELECT *, row_number() OVER (ORDER BY best_price DESC NULLS LAST, brand, name) AS row_number FROM dash")
def dashboard(s, d):
    return numbered(_dashboard(s, d).drop("last_checked_at"), *P.dashboard_keys("best_price", "desc", price="best_price"))


@query(f"WITH {CTES['obs']}, {CTES['offers']}, {CTES['variants']}, {CTES['best']}, {DASH} SELECT *, row_number() OVER (ORDER BY lower(brand), lower(name), brand, name) AS row_number FROM dash WHERE (contains(lower(brand), 'ring') OR contains(lower(name), 'ring')) AND best_price IS NOT NULL")
def dashboard_search(s, d):
    found = P.by_availability(P.search(_dashboard(s, d), "  RING ", "brand", "name"), "in_stock", price="best_price")
    return numbered(found.drop("last_checked_at"), *P.dashboard_keys("name"))


@query("SELECT s.store_id, s.store_name, o.brand, o.name, coalesce(o.offers, '') AS offers FROM stores s LEFT JOIN (SELECT store_id, brand, name, string_agg(variant_id || ':' || price, ',' ORDER BY price, variant_id, availability) AS offers FROM offers JOIN variants USING (variant_id) GROUP BY 1, 2, 3) o USING (store_id)", "obs offers variants stores")
def store_catalog(s, d):
    rows = T.offers(s, d).join(T.variants(s, d), "variant_id")
    listed = F.array_join(F.transform("offers", lambda x: F.concat_ws(":", x["variant_id"], x["price"])), ",")
    return P.store_catalog(T.stores(s, d), rows).select("store_id", "store_name", "brand", "name", F.coalesce(listed, F.lit("")).alias("offers"))


@query('SELECT b.variant_id, b.price, (((CAST(b.price * 100 AS BIGINT) * 20000000 + b.volume_ml) // (2 * b.volume_ml) + 500) // 1000) / 1000000.0 AS price_per_ml, "drop", min_price, entries, coalesce(in_stock_stores, 0) AS in_stock_stores FROM best b LEFT JOIN (SELECT perfume_id, count(DISTINCT CASE WHEN status = \'in_stock\' THEN store_id END) AS in_stock_stores FROM (SELECT *, rank() OVER (PARTITION BY perfume_id, store_id ORDER BY created_at DESC) AS n FROM results) WHERE n = 1 GROUP BY 1) z ON z.perfume_id = b.variant_id % 20 LEFT JOIN (SELECT variant_id, a - p AS "drop" FROM (SELECT variant_id, price AS a, lead(price) OVER w AS p, row_number() OVER w AS n FROM obs WINDOW w AS (PARTITION BY variant_id ORDER BY recorded_at DESC, seq DESC)) WHERE n = 1 AND a < p) x USING (variant_id) LEFT JOIN (SELECT variant_id, min(price) AS min_price, count(*) AS entries FROM obs GROUP BY 1) y USING (variant_id)', BEST + " results")
def perfume_detail(s, d):
    obs = T.obs(s, d)
    perfume = F.col("variant_id") % 20
    counts = H.in_stock_stores(H.latest_statuses(T.results(s, d), ["perfume_id", "store_id"]), ["perfume_id"])
    stores = T.variants(s, d).select("variant_id", perfume.alias("perfume_id")).join(counts, "perfume_id", "left").select("variant_id", F.coalesce("in_stock_stores", F.lit(0)).alias("in_stock_stores"))
    out = P.detail(best(s, d), stores, Y.real_drop(obs, ["variant_id"], ["recorded_at", "seq"]), Y.price_stats(obs, ["variant_id"]))
    return out.select("variant_id", "price", F.col("price_per_ml").cast("double").alias("price_per_ml"), "drop", "min_price", "entries", "in_stock_stores")


@query("SELECT l_orderkey, l_linenumber, price, old_price, CASE WHEN price < old_price THEN CAST(round(CAST((old_price - price) * 100 AS DOUBLE) / CAST(old_price AS DOUBLE)) AS INTEGER) END AS discount_percentage FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(10,2)) AS old_price, CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS price FROM lineitem)")
def discount_pct(s, d):
    old = F.col("l_extendedprice").cast("decimal(10,2)")
    rows = T.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", old.alias("old_price"), (old * (1 - F.col("l_discount")).cast("decimal(4,2)")).cast("decimal(10,2)").alias("price")).distinct()
    return O.with_discount(rows)


@query("SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[\\s\\xA0]+', ' ', 'g'))) AS normalized FROM documents")
def normalize_text(s, d):
    return T.read(s, d, "documents").select("doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("normalized"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(strip_accents(lower(regexp_extract(html, '<title>([^<]*)', 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '')) AS url_key, replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)/*$', 1), '-', ' ') AS last_segment FROM pages")
def page_slugs(s, d):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return T.read(s, d, "pages").select("page_id", X.slug(title).alias("slug"), X.url_key(F.col("url")).alias("url_key"), X.last_segment(F.regexp_replace("url", r"[?#].*$", "")).alias("last_segment"))


TITLES = "titles AS (SELECT p_partkey, p_brand || ' ' || p_name || CASE p_partkey % 12 WHEN 0 THEN ' Eau de Parfum' WHEN 1 THEN ' E.d.P.' WHEN 2 THEN ' Apă de toaletă' WHEN 3 THEN ' EDC' WHEN 4 THEN ' Extract de parfum' WHEN 5 THEN ' Parfum' WHEN 6 THEN ' parfumTester' WHEN 7 THEN ' gift set' WHEN 8 THEN ' refillable' WHEN 9 THEN ' esantion' WHEN 10 THEN ' parfém tester' ELSE ', unisex -' END || ' ' || p_size * 25 || ' ml' AS title, p_brand AS brand FROM part)"


def _titles(s, d):
    k = F.col("p_partkey") % 12
    words = [" Eau de Parfum", " E.d.P.", " Apă de toaletă", " EDC", " Extract de parfum", " Parfum", " parfumTester", " gift set", " refillable", " esantion", " parfém tester"]
    tail = F.lit(", unisex -")
    for i, w in enumerate(words):
        tail = F.when(k == i, w).otherwise(tail)
    return T.read(s, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" "), "p_name", tail, F.lit(" "), F.col("p_size") * 25, F.lit(" ml")).alias("title"), F.col("p_brand").alias("brand"))


def _case(patterns, column="t"):
    whens = " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(column, p, v) for p, v in patterns)
    return f"CASE {whens} END"


@query(f"WITH {TITLES}, n AS (SELECT *, strip_accents(lower(title)) AS t FROM titles) SELECT p_partkey, {_case(X.CONCENTRATIONS)} AS concentration, CASE WHEN CAST(regexp_extract(t, '\\b(\\d{{1,4}})\\s*ml\\b', 1) AS INTEGER) BETWEEN 1 AND 1000 THEN CAST(regexp_extract(t, '\\b(\\d{{1,4}})\\s*ml\\b', 1) AS INTEGER) END AS volume_ml, regexp_matches(t, '\\btester\\b') OR regexp_matches(title, '[a-z]Tester\\b') AS tester, {_case(X.EXCLUSIONS)} AS exclusion FROM n")
def title_fields(s, d):
    title = F.col("title")
    return _titles(s, d).select("p_partkey", X.concentration(title).alias("concentration"), X.volume_ml(title).alias("volume_ml"), X.is_tester(title).alias("tester"), X.exclusion(title).alias("exclusion"))


@query(SQL["title_fields"])
def sql_title_fields(s, d):
    """title_fields as SQL text."""
    SQLF.register(s)
    return s.sql("SELECT p_partkey, concentration_of(title) AS concentration, volume_of(title) AS volume_ml, is_tester(title) AS tester, exclusion_of(title) AS exclusion FROM {titles}", titles=_titles(s, d))


_stripped = "strip_accents(lower(title))"
for _p in [*[p for p, _ in X.CONCENTRATIONS], r"\b(\d{1,4})\s*ml\b", r"\btester\b", *X.NOISE[:3]]:
    _stripped = f"regexp_replace({_stripped}, '{_p}', ' ', 'g')"
_BRANDLESS = _stripped.replace("strip_accents(lower(title))", "regexp_replace(strip_accents(lower(title)), '\\b' || lower(brand) || '\\b(\\s+(?:perfumes?|parfums?|fragrances?|cosmetics?)\\b)?', ' ')")


@query(f"WITH {TITLES} SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({_BRANDLESS}, '[\"\''‘’“”,]', ' ', 'g'), '(^|\\s)-(\\s|$)', ' ', 'g'), '\\s+', ' ', 'g')) AS core_name FROM titles")
def core_name(s, d):
    return _titles(s, d).select("p_partkey", X.core_name(F.col("title"), F.col("brand")).alias("core_name"))


@query("SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(10,2)) AS comma, CAST(l_extendedprice AS DECIMAL(10,2)) AS dot, CAST(floor(l_extendedprice) AS DECIMAL(10,2)) AS lei FROM lineitem")
def parse_price(s, d):
    p = F.col("l_extendedprice").cast("decimal(10,2)")
    whole = F.format_number(F.floor("l_extendedprice"), 0)
    cents = F.lpad(((p * 100).cast("long") % 100).cast("string"), 2, "0")
    rows = T.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("RRP: "), F.replace(whole, F.lit(","), F.lit(" ")), F.lit(","), cents, F.lit(" lei")).alias("a"), p.cast("string").alias("b"), F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.lit(" lei")).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", M.comma_price(F.col("a")).alias("comma"), M.dot_price(F.col("b")).alias("dot"), M.lei_price(F.col("c")).alias("lei")).distinct()


NAMES = "names AS (SELECT DISTINCT p_name AS name FROM part)"


def _name_pairs(s, d):
    names = T.read(s, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("word", F.explode(F.split("name", " ")))
    return names.alias("x").join(names.alias("y"), "word").select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).where("a < b").distinct()


@query(rf"WITH RECURSIVE {NAMES}, pairs AS (SELECT DISTINCT x.name AS a, y.name AS b FROM names x JOIN names y ON x.name < y.name AND list_has_any(string_split(x.name, ' '), string_split(y.name, ' '))), w AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM pairs), dp(a, b, x, y, i, v) AS (SELECT a, b, x, y, 0, list_transform(range(length(y) + 1), lambda q: 0) FROM w UNION ALL SELECT a, b, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN v[j] + 1 ELSE greatest(v[j + 1], acc[j]) END), [0]) FROM dp WHERE i < length(x)) SELECT a, b, round(200.0 * v[length(y) + 1] / (length(x) + length(y)), 6) AS score FROM dp WHERE i = length(x)")
def name_similarity(s, d):
    return _name_pairs(s, d).select("a", "b", F.round(S.token_sort_ratio(F.col("a"), F.col("b")), 6).alias("score"))


@query(SQL["name_similarity"])
def sql_similarity(s, d):
    """name_similarity as SQL text."""
    SQLF.register(s)
    return s.sql("SELECT a, b, round(indel_ratio(a, b), 6) AS score FROM {pairs}", pairs=_name_pairs(s, d))


@query(f"WITH {NAMES} SELECT x.name AS a, y.name AS b, len(list_filter(string_split(x.name, ' '), lambda q: NOT list_contains(string_split(y.name || ' old', ' '), q))) = 0 AS within FROM names x JOIN names y ON x.name < y.name AND list_has_any(string_split(x.name, ' '), string_split(y.name, ' '))")
def word_containment(s, d):
    return _name_pairs(s, d).select("a", "b", S.words_within(F.col("a"), F.concat("b", F.lit(" old"))).alias("within"))


def _candidates(s, d):
    """Titles perturbed in seven ways, each a candidate for the catalog of its brand."""
    k = F.col("p_partkey") % 7
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" intense"))).when(k == 2, F.replace("p_name", F.lit(" "), F.lit(""))).when(k == 3, F.concat(F.lit("x"), "p_name")).when(k == 4, F.lit("zzz qqq")).otherwise(F.upper("p_name"))
    return T.read(s, d, "part").select(
        F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("candidate_brand"), name.alias("candidate_name"), F.when(k == 5, F.concat("p_name", F.lit(" gift set"))).otherwise(F.col("p_name")).alias("raw_title"),
        F.when(k != 6, F.col("p_type")).alias("concentration"), F.col("p_size").alias("volume_ml"),
    )


_cand = "c AS (SELECT p_partkey AS candidate_id, p_brand AS brand, p_name AS was, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' intense' WHEN 2 THEN replace(p_name, ' ', '') WHEN 3 THEN 'x' || p_name WHEN 4 THEN 'zzz qqq' ELSE p_name END AS cn, p_partkey % 7 = 5 AS gift, p_partkey % 7 = 6 AS bare FROM part), k AS (SELECT DISTINCT p_brand AS brand, p_name AS name FROM part)"

_scores = (
    "prs AS (SELECT DISTINCT cn, name FROM c JOIN k USING (brand)), w AS (SELECT cn, name, array_to_string(list_sort(string_split(cn, ' ')), ' ') AS x, array_to_string(list_sort(string_split(name, ' ')), ' ') AS y FROM prs), "
    "dp(cn, name, x, y, i, v) AS (SELECT cn, name, x, y, 0, list_transform(range(length(y) + 1), lambda q: 0) FROM w UNION ALL SELECT cn, name, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN v[j] + 1 ELSE greatest(v[j + 1], acc[j]) END), [0]) FROM dp WHERE i < length(x)), "
    "sc AS (SELECT cn, name, 200.0::DOUBLE * v[length(y) + 1] / (length(x) + length(y)) AS s, len(list_filter(string_split(name, ' '), lambda q: NOT list_contains(string_split(cn, ' '), q))) = 0 AS inside FROM dp WHERE i = length(x))"
)


@query(
    f"WITH RECURSIVE {_cand}, {_scores}, l AS (SELECT candidate_id, brand, name, gift, bare, cn, s, inside, CAST(round_even(s, 0) AS INTEGER) AS whole, CASE WHEN gift THEN 1 WHEN bare THEN 2 WHEN cn = name THEN 3 WHEN length(name) % 2 = 0 AND cn = 'x' || name THEN 4 WHEN s >= 90 THEN 5 WHEN s >= 70 THEN 6 WHEN inside THEN 7 ELSE 8 END AS step FROM c JOIN k USING (brand) JOIN sc USING (cn, name)) "
    "SELECT candidate_id, brand, name, CASE WHEN step IN (3, 4) THEN 'exact' WHEN step = 5 THEN 'high_confidence' WHEN step IN (2, 6, 7) THEN 'ambiguous' ELSE 'rejected' END AS confidence, "
    "CASE step WHEN 1 THEN 'excluded:gift_set' WHEN 2 THEN 'missing_variant_fields' WHEN 4 THEN 'confirmed_name_alias' WHEN 5 THEN 'name_fuzzy_score=' || whole WHEN 6 THEN 'name_fuzzy_score=' || whole WHEN 7 THEN 'name_containment_score=' || whole WHEN 8 THEN 'name_mismatch' END AS reason, "
    "CASE WHEN step BETWEEN 5 AND 7 THEN whole END AS score FROM l"
)
def match_ladder(s, d):
    """Every candidate with every product of its brand; names of even length have x and the name as a confirmed alias."""
    alias = F.when(F.length("name") % 2 == 0, F.array(F.concat(F.lit("x"), "name")))
    catalog = T.variants(s, d).select("brand", "name").distinct().withColumns({"perfume_id": F.xxhash64("brand", "name"), "aliases": alias})
    pairs = MA.candidate_pairs(catalog, _candidates(s, d).repartition("candidate_id"))  # the given table is one file
    out = MA.decide(pairs, brand_checked=True)
    return out.select("candidate_id", "brand", "name", "confidence", "reason", "score")


@query(f"WITH {_cand} SELECT candidate_id, name, CASE WHEN gift THEN 'excluded:gift_set' WHEN bare THEN 'missing_variant_fields' WHEN cn <> name THEN 'confirmed_name_alias' END AS reason FROM c JOIN k USING (brand) WHERE gift OR bare OR cn = name OR length(name) % 2 = 0 AND cn = 'x' || name")
def match_certain(s, d):
    """The decisions that need no score."""
    return match_ladder(s, d).where("reason IS NULL OR reason NOT LIKE 'name_%'").select("candidate_id", "name", "reason")


_ladder = SQL["match_ladder"]
_scored = "confidence IN ('exact', 'high_confidence') OR confidence = 'ambiguous' AND score IS NOT NULL"


def _found(s, d):
    alias = F.when(F.length("name") % 2 == 0, F.array(F.concat(F.lit("x"), "name")))
    catalog = T.variants(s, d).select("brand", "name").distinct().withColumns({"perfume_id": F.xxhash64("brand", "name"), "aliases": alias})
    candidates = _candidates(s, d)
    return catalog, candidates, MA.decide(MA.likely_pairs(catalog, candidates.repartition("candidate_id")), brand_checked=True)


@query(f"SELECT * FROM ({_ladder}) WHERE {_scored}")
def match_found(s, d):
    """What the ladder accepts or doubts, from likely pairs only."""
    found = _found(s, d)[2].where(_scored)
    return found.select("candidate_id", "brand", "name", "confidence", "reason", "score")


@query(f"SELECT candidate_id, count(*) AS compared, count(*) FILTER (WHERE confidence IN ('exact', 'high_confidence')) AS accepted, count(*) FILTER (WHERE confidence = 'ambiguous' AND score IS NOT NULL) AS doubtful, count(*) FILTER (WHERE NOT ({_scored})) AS mismatched FROM ({_ladder}) GROUP BY 1")
def match_counts(s, d):
    """How many names each candidate was compared with, by outcome; mismatches are numbers, not rows."""
    return MA.match_counts(*_found(s, d))


REVIEW = "q AS (SELECT p_partkey AS perfume_id, 1 AS store_id, p_name AS product_url, CAST(p_size AS DOUBLE) AS match_score, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status, 10 AS first_seen_at, 10 AS last_seen_at FROM part WHERE p_partkey % 2 = 0), f AS (SELECT p_partkey AS perfume_id, 1 AS store_id, p_name AS product_url, CAST(p_size + 1 AS DOUBLE) AS match_score FROM part WHERE p_partkey % 4 < 3)"


def _queue(s, d):
    part = T.read(s, d, "part")
    base = [F.col("p_partkey").alias("perfume_id"), F.lit(1).alias("store_id"), F.col("p_name").alias("product_url")]
    k = F.col("p_partkey") % 3
    status = F.when(k == 0, "pending").when(k == 1, "confirmed").otherwise("rejected")
    queue = part.where("p_partkey % 2 = 0").select(*base, F.col("p_size").cast("double").alias("match_score"), status.alias("status"), F.lit(10).alias("first_seen_at"), F.lit(10).alias("last_seen_at"))
    return queue, part.where("p_partkey % 4 < 3").select(*base, (F.col("p_size") + 1).cast("double").alias("match_score"))


@query(f"WITH {REVIEW} SELECT coalesce(q.perfume_id, f.perfume_id) AS perfume_id, coalesce(q.store_id, f.store_id) AS store_id, coalesce(q.product_url, f.product_url) AS product_url, CASE WHEN f.perfume_id IS NOT NULL AND coalesce(status, 'pending') = 'pending' THEN f.match_score ELSE q.match_score END AS match_score, coalesce(status, 'pending') AS status, coalesce(first_seen_at, 20) AS first_seen_at, CASE WHEN f.perfume_id IS NOT NULL AND coalesce(status, 'pending') = 'pending' THEN 20 ELSE last_seen_at END AS last_seen_at FROM q FULL JOIN f ON q.perfume_id = f.perfume_id AND q.product_url = f.product_url")
def review_merge(s, d):
    queue, found = _queue(s, d)
    return R.merge_queue(queue, found, F.lit(20))


@query(f"WITH {REVIEW} SELECT perfume_id, store_id, product_url, CASE WHEN status = 'pending' AND perfume_id % 4 = 0 THEN 'confirmed' WHEN status = 'pending' THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'pending' THEN 30 END AS resolved_at FROM q")
def review_decisions(s, d):
    queue = _queue(s, d)[0].withColumn("resolved_at", F.lit(None).cast("int"))
    decisions = queue.select("perfume_id", "store_id", "product_url", F.when(F.col("perfume_id") % 4 == 0, "confirmed").otherwise("rejected").alias("decision"))
    return R.apply_decisions(queue, decisions, F.lit(30)).select("perfume_id", "store_id", "product_url", "status", "resolved_at")


@query(f"WITH {REVIEW} SELECT count(*) FILTER (WHERE status = 'pending') AS pending FROM q")
def pending_count(s, d):
    return R.pending_count(_queue(s, d)[0])


@query("SELECT p_partkey AS perfume_id, p_name AS normalized_alias, p_name AS alias FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey, p_name, upper(p_name) FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0")
def alias_merge(s, d):
    part = T.read(s, d, "part").select(F.col("p_partkey").alias("perfume_id"), F.col("p_name").alias("alias"))
    have = part.where("perfume_id % 3 = 0").withColumn("normalized_alias", X.normalize(F.col("alias")))
    new = part.where("perfume_id % 2 = 0").withColumn("alias", F.upper("alias")).withColumn("normalized_alias", X.normalize(F.col("alias")))
    return R.merge_aliases(have, new)


@query("SELECT p_brand AS perfume_id, p_type AS concentration, p_size AS volume_ml, p_partkey % 10 = 0 AS tester FROM part GROUP BY ALL")
def variant_merge(s, d):
    rows = T.read(s, d, "part").select(F.col("p_brand").alias("perfume_id"), F.col("p_type").alias("concentration"), F.col("p_size").alias("volume_ml"), (F.col("p_partkey") % 10 == 0).alias("tester"), "p_partkey")
    key = ["perfume_id", "concentration", "volume_ml", "tester"]
    have = rows.where("p_partkey % 2 = 0").select(*key).distinct().withColumn("variant_id", O.variant_id(*[F.col(c) for c in key]))
    return O.resolve_variants(have, rows).select(*key)


FAMILY = {"Fresh": ["economy", "small"], "Floral": ["large"], "Woody": ["medium", "promo"]}
_fam = "fam AS (SELECT *, CASE lower(accord) " + " ".join(f"WHEN '{a}' THEN '{f}'" for f, xs in FAMILY.items() for a in xs) + " ELSE 'Other' END AS family FROM accords)"


def _families(s, d):
    return C.with_family(T.accords(s, d), families=FAMILY)


_share = f"{_fam}, sh AS (SELECT family, sum(strength) AS total FROM fam GROUP BY 1), pc AS (SELECT family, total, CAST(round_even(CAST(total AS DOUBLE) * 100 / sum(total) OVER (), 1) AS DECIMAL(5,1)) AS percentage FROM sh)"


@query(f"WITH {CTES['accords']}, {_share} SELECT family, CAST(total AS BIGINT) AS total, percentage FROM pc")
def family_share(s, d):
    return C.family_shares(_families(s, d)).select("family", "total", "percentage")


@query(f"WITH {CTES['accords']}, {_fam} SELECT * FROM (SELECT family, item_id, CAST(sum(strength) AS BIGINT) AS total, row_number() OVER (PARTITION BY family ORDER BY sum(strength) DESC, item_id) AS place FROM fam GROUP BY 1, 2) WHERE place <= 3")
def family_top3(s, d):
    return C.family_contributors(_families(s, d))


@query(f"WITH {CTES['accords']}, {_share} SELECT family, percentage, CAST(coalesce(sum(percentage) OVER (ORDER BY total DESC, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(6,1)) AS \"offset\" FROM pc")
def dna_offsets(s, d):
    return C.offsets(C.family_shares(_families(s, d))).select("family", "percentage", "offset")


@query("SELECT accord AS label, count(DISTINCT item_id) AS item_count, CAST(sum(strength) AS BIGINT) AS score, CAST(round_even(count(DISTINCT item_id) * 100.0 / (SELECT count(*) FROM supplier), 0) AS INTEGER) AS collection_percentage, CAST(round_even(CAST(sum(strength) AS DOUBLE) * 100 / max(sum(strength)) OVER (), 1) AS DECIMAL(5,1)) AS bar_percentage, CAST(round_even(CAST(sum(strength) AS DOUBLE) / count(DISTINCT item_id), 0) AS INTEGER) AS avg_intensity FROM accords GROUP BY 1 ORDER BY score DESC LIMIT 8", "accords")
def top_accords(s, d):
    n = T.read(s, d, "supplier").agg(F.count("*")).scalar()
    return C.rank_attributes(T.accords(s, d), n, "accord", strength="strength", order=["item_id", "position"]).drop("place")


@query("SELECT label, item_count, score, collection_percentage, CAST(round_even(CAST(score AS DOUBLE) * 100 / max(score) OVER (), 1) AS DECIMAL(5,1)) AS bar_percentage FROM (SELECT name AS label, count(*) AS item_count, count(*) AS score, CAST(round_even(count(*) * 100.0 / (SELECT count(*) FROM supplier), 0) AS INTEGER) AS collection_percentage, min(item_id) AS f FROM notes GROUP BY 1 ORDER BY score DESC, f, label LIMIT 8)", "notes")
def top_notes(s, d):
    n = T.read(s, d, "supplier").agg(F.count("*")).scalar()
    return C.rank_attributes(T.notes(s, d), n, "name", order=["item_id", "name"]).drop("place")


@query("SELECT (SELECT count(*) FROM supplier) AS items, (SELECT count(DISTINCT lower(trim(s_name))) FROM supplier) AS brands, (SELECT count(*) FROM edges) AS edges", "edges")
def insight_counts(s, d):
    return C.insight_counts(T.read(s, d, "supplier"), T.edges(s, d), "s_name")


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'middle' ELSE 'base' END AS tier, string_agg(name, ', ' ORDER BY position) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY name) AS position FROM notes) GROUP BY 1, 2", "notes")
def note_lists(s, d):
    from pyspark.sql import Window as W

    k = F.col("item_id") % 3
    rows = T.notes(s, d).withColumns({"position": F.row_number().over(W.partitionBy("item_id").orderBy("name")), "tier": F.when(k == 0, "top").when(k == 1, "middle").otherwise("base")})
    return C.note_lists(rows)


@query("SELECT a.item_id AS a, b.item_id AS b, round(sum(a.strength * b.strength) / (sqrt(max(na)) * sqrt(max(nb))), 6) AS cosine FROM (SELECT *, sum(CAST(strength AS DOUBLE) * strength) OVER (PARTITION BY item_id) AS na FROM accords) a JOIN (SELECT *, sum(CAST(strength AS DOUBLE) * strength) OVER (PARTITION BY item_id) AS nb FROM accords) b ON a.accord = b.accord AND a.item_id < b.item_id GROUP BY 1, 2 HAVING sum(CAST(a.strength AS DOUBLE) * b.strength) / (sqrt(max(na)) * sqrt(max(nb))) >= 0.99", "accords")
def overlap_pairs(s, d):
    return V.similar_pairs(V.vectors(T.accords(s, d)), 0.99, with_shared=False).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3")
def dense_overlap(s, d):
    return V.dense_pairs(T.read(s, d, "embeddings"), 0.3).select("a", "b", F.round("cosine", 6).alias("cosine"))


_GRAPH = "un AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, EXISTS (SELECT 1 FROM edges y WHERE y.src = x.dst AND y.dst = x.src) AS m FROM edges x), ce AS (SELECT DISTINCT a, b FROM un WHERE m = (SELECT bool_or(m) FROM un)), both_ AS (SELECT a, b FROM ce UNION SELECT b, a FROM ce), reach(x, y) AS (SELECT a, a FROM both_ UNION SELECT r.x, t.b FROM reach r JOIN both_ t ON r.y = t.a), comp AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY 1)"


@query(f"WITH RECURSIVE {CTES['edges']}, {_GRAPH} SELECT a, b FROM ce")
def mutual_edges(s, d):
    return G.cluster_edges(T.edges(s, d))


@query(f"WITH RECURSIVE {CTES['edges']}, {_GRAPH} SELECT node, component FROM comp")
def components(s, d):
    return G.connected_components(G.cluster_edges(T.edges(s, d)))


@query(f"WITH RECURSIVE {CTES['edges']}, {_GRAPH}, dg AS (SELECT a AS node, count(*) AS degree FROM both_ GROUP BY 1), sz AS (SELECT component, count(*) AS members, CAST(sum(degree) // 2 AS BIGINT) AS edge_count FROM comp JOIN dg USING (node) GROUP BY 1), tp AS (SELECT *, row_number() OVER (ORDER BY edge_count DESC, members DESC, component) AS cluster FROM sz) SELECT * FROM (SELECT cluster, component, members, edge_count, row_number() OVER (PARTITION BY component ORDER BY degree DESC, s_name DESC, node) AS number, node, degree FROM comp JOIN dg USING (node) JOIN tp USING (component) JOIN supplier ON s_suppkey = node WHERE cluster <= 6) WHERE number <= 8")
def cluster_report(s, d):
    items = T.read(s, d, "supplier")
    return G.cluster_report(G.cluster_edges(T.edges(s, d)), items, "s_suppkey", "s_name")


# -- pages ---------------------------------------------------------------------------------------------------------


def _pages(s, d):
    return T.read(s, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("store_slug"), F.lit("page").alias("page_kind"), "url", "html", "page_id")


@query(r"SELECT page_id, i AS position, href, trim(regexp_replace(label, '\s+', ' ', 'g')) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>([^<]*)</a>', 2)) AS label, unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1)))) AS i FROM pages)".replace('\\"', '"'))
def page_anchors(s, d):
    pages = _pages(s, d).withColumn("url", F.col("page_id").cast("string"))
    return SP.anchors(pages).select(F.col("url").cast("long").alias("page_id"), "position", "href", "label")


@query(r"SELECT host AS store_slug, brand, arg_max(href, (page_id, i)) AS target FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, page_id, strip_accents(lower(trim(regexp_replace(label, '\s+', ' ', 'g')))) AS brand, href, i FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>([^<]+)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>([^<]+)</a>', 2)) AS label, unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>([^<]+)</a>', 1)))) AS i FROM pages)) WHERE brand <> '' GROUP BY 1, 2".replace('\\"', '"'))
def page_directory(s, d):
    pages = _pages(s, d).withColumn("url", F.lpad(F.col("page_id").cast("string"), 12, "0"))
    return SP.brand_directory(pages)


@query(r"SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading, len(regexp_extract_all(html, '(?is)<p\b')) AS paragraphs FROM pages")
def page_headings(s, d):
    return T.read(s, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1).alias("heading"), F.size(F.regexp_extract_all("html", F.lit(r"(?is)<p\b"), 0)).cast("long").alias("paragraphs"))


@query("SELECT 'all' AS store_slug, url, 'structure not recognised' AS error FROM pages WHERE NOT regexp_matches(html, '\"@type\":\\s*\"Product\"')")
def page_error_rows(s, d):
    pages = _pages(s, d).withColumn("store_slug", F.lit("all"))
    return SP.extract_offers(pages, {"all": SP.json_ld})[1]


@query("SELECT regexp_extract(url, '://([^/]*)', 1) AS store_slug, regexp_replace(url, '[?&]page=\\d+.*$', '') AS listing, count(DISTINCT CASE WHEN regexp_extract(url, '[?&]page=(\\d+)', 1) = '' THEN 1 ELSE CAST(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INTEGER) END) AS pages_seen, max(len(regexp_extract_all(html, '<a '))) AS last_page, count(DISTINCT CASE WHEN regexp_extract(url, '[?&]page=(\\d+)', 1) = '' THEN 1 ELSE CAST(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INTEGER) END) >= max(len(regexp_extract_all(html, '<a '))) AS complete FROM pages GROUP BY 1, 2")
def listing_completeness(s, d):
    """The links of a page stand for the number of pages that a listing declares."""
    return SP.pages_complete(_pages(s, d), F.size(F.regexp_extract_all("html", F.lit("<a "), 0)), SP.url_page())


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def embedded_json_fields(s, d):
    return T.read(s, d, "events").select("event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+/(en|fr)/\d+') THEN 'https://www.example.com' || regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) END AS canonical FROM pages")
def canonical_url(s, d):
    """Pages' paths on one host; the pattern of item pages does not occur in these pages, so the path of a language and a number stands for it."""
    path = F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1)
    item = F.regexp_replace(path, r"^/(en|fr)/(\d+).*$", "/perfume/$1/x-$2.html")
    found = X.canonical_page(F.concat(F.lit("https://www.example.com"), item), ["www.example.com"], "www.example.com")
    return T.read(s, d, "pages").select("page_id", F.when(found.isNotNull(), F.concat(F.lit("https://www.example.com"), path)).alias("canonical"))


@query("SELECT count(DISTINCT p_name) AS discovered, count(DISTINCT p_name) FILTER (WHERE NOT known AND NOT failed) AS added, count(DISTINCT p_name) FILTER (WHERE known) AS skipped, count(DISTINCT p_name) FILTER (WHERE NOT known AND failed) AS failed FROM (SELECT p_name, p_name LIKE 'red%' AS known, p_name LIKE 'blue%' AS failed FROM part)")
def import_summary(s, d):
    part = T.read(s, d, "part")
    found = part.select(F.col("p_name").alias("url"), F.col("p_partkey").alias("ordinal"), F.when(~F.startswith("p_name", F.lit("blue")), F.col("p_name")).alias("parsed"))
    return C.import_items(part.where("p_name LIKE 'red%'").select(F.col("p_name").alias("url")), found)[1]


@query("SELECT l_orderkey, count(*) AS lines FROM (SELECT DISTINCT * FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0) GROUP BY 1")
def cascade_delete(s, d):
    orders, lines = T.read(s, d, "orders").select("o_orderkey", "o_custkey"), T.read(s, d, "lineitem").distinct()
    gone = T.read(s, d, "customer").where("c_custkey % 7 = 0").select("c_custkey")
    left = O.delete_cascade({"orders": orders, "lines": lines}, gone, [("orders", "o_orderkey", "o_custkey"), ("lines", "l_orderkey", "l_orderkey")])
    return left["lines"].groupBy("l_orderkey").agg(F.count("*").alias("lines"))


_known = [(a, f, {"Floral": "Floral"}.get(f, "Other")) for f, xs in FAMILY.items() for a in xs]


@query(
    "SELECT DISTINCT p_type AS accord, coalesce(family, 'Other') AS family, coalesce(grp, 'Other') AS family_group, CASE grp WHEN 'Floral' THEN '#ec4899' ELSE '#64748b' END AS color FROM part LEFT JOIN (VALUES "
    + ", ".join(f"('{a}', '{f}', '{g}')" for a, f, g in _known) + ") v(a, family, grp) ON lower(trim(p_type)) = a"
)
def accord_colors(s, d):
    return C.with_family(T.read(s, d, "part").select(F.col("p_type").alias("accord")).distinct(), families=FAMILY)


@query("SELECT a, b, percentage, shared FROM (SELECT a.item_id AS a, b.item_id AS b, round_even(CAST(sum(a.strength * b.strength) AS DOUBLE) / (sqrt(max(na)) * sqrt(max(nb))) * 100, 1) AS percentage, array_to_string(list_slice(list(lower(a.accord) ORDER BY a.strength + b.strength DESC, lower(a.accord)), 1, 4), ', ') AS shared FROM (SELECT *, sum(CAST(strength AS DOUBLE) * strength) OVER (PARTITION BY item_id) AS na FROM accords) a JOIN (SELECT *, sum(CAST(strength AS DOUBLE) * strength) OVER (PARTITION BY item_id) AS nb FROM accords) b ON a.accord = b.accord AND a.item_id < b.item_id GROUP BY 1, 2) WHERE percentage >= 72 ORDER BY percentage DESC, a, b LIMIT 15", "accords")
def overlap_report(s, d):
    return V.overlap_report(V.vectors(T.accords(s, d))).select("a", "b", "percentage", "shared")


@query("SELECT item_id, string_agg(accord, ', ' ORDER BY position) AS names FROM accords WHERE position <= 3 GROUP BY 1", "accords")
def first_accords(s, d):
    return C.first_attributes(T.accords(s, d))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_extendedprice - 30000 AS DECIMAL(10,2)) > 0 THEN CAST(l_extendedprice - 30000 AS DECIMAL(10,2)) END AS price FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice FROM lineitem)")
def entered_price(s, d):
    text = F.concat(F.lit(" "), F.replace((F.col("l_extendedprice") - 30000).cast("decimal(10,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" "))
    return T.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").distinct().select("l_orderkey", "l_linenumber", M.entered_price(text).alias("price"))


@query("SELECT v.brand, v.name, v.variant_id, v.volume_ml, v.concentration, v.tester, row_number() OVER (ORDER BY brand, name, volume_ml DESC, concentration, tester, variant_id) AS row_number FROM variants v", "variants")
def variants_ordered(s, d):
    return numbered(T.variants(s, d).select("brand", "name", "variant_id", "volume_ml", "concentration", "tester"), "brand", "name", *P.variant_keys(), "variant_id")


@query("SELECT variant_id, store_id FROM offers WHERE variant_id IN (SELECT variant_id FROM alerts WHERE enabled)", "obs offers alerts")
def offers_with_alerts(s, d):
    return P.semi_lookup(T.offered(s, d), T.alerts(s, d).where("enabled"), ["variant_id"]).select("variant_id", "store_id")


# -- catalog, runs, decisions --------------------------------------------------------------------------------------


@query("SELECT variant_id, store_id, seq, price, row_number() OVER (PARTITION BY variant_id, store_id ORDER BY recorded_at DESC, seq DESC) AS recency FROM obs WHERE (variant_id, store_id) IN (SELECT (variant_id, store_id) FROM offers WHERE availability = 'in_stock')", "obs offers")
def series_history(s, d):
    """All entries of the series that are in stock now, newest first."""
    now = T.offers(s, d).where("availability = 'in_stock'")
    return Y.series_history(T.obs(s, d), now, ["variant_id", "store_id"], ["recorded_at", "seq"]).select("variant_id", "store_id", "seq", "price", "recency")


@query("SELECT s.store_id, store_name, coalesce(total, 0) AS total, coalesce(healthy, 0) AS healthy, coalesce(strip, '') AS strip FROM stores s LEFT JOIN (SELECT store_id, count(*) AS total, count(*) FILTER (WHERE status NOT IN ('scraping_error', 'store_unavailable')) AS healthy, string_agg(status, ',' ORDER BY n DESC) AS strip FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY created_at DESC, result_id DESC) AS n FROM results) WHERE n <= 20 GROUP BY 1) h USING (store_id)", "stores results")
def store_health_report(s, d):
    return H.health_report(T.stores(s, d), T.results(s, d)).select("store_id", "store_name", "total", "healthy", F.array_join("strip", ",").alias("strip"))


@query("SELECT s_suppkey AS store_id, s_name AS store_name, row_number() OVER (ORDER BY s_name, s_suppkey) AS row_number FROM supplier WHERE s_acctbal >= 0")
def enabled_stores(s, d):
    return numbered(T.stores(s, d).where("enabled").select("store_id", "store_name"), "store_name", "store_id")


@query("SELECT perfume_id, trim(brand) AS brand, trim(name) AS name, lower(trim(brand)) AS normalized_brand, lower(trim(name)) AS normalized_name FROM perfumes", "perfumes")
def catalog_columns(s, d):
    padded = T.perfumes(s, d).select("perfume_id", F.concat(F.lit(" "), "brand").alias("brand"), F.concat("name", F.lit("  ")).alias("name"))
    return MA.normalised_catalog(padded)


@query("SELECT p.perfume_id, coalesce(string_agg(a, ',' ORDER BY a), '') AS aliases FROM perfumes p LEFT JOIN (SELECT DISTINCT perfume_id, p_type AS a FROM perfumes JOIN part ON brand = p_brand AND name = p_name) x USING (perfume_id) GROUP BY 1", "perfumes")
def catalog_aliases(s, d):
    part = T.read(s, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("normalized_alias"))
    named = T.perfumes(s, d).join(part, ["brand", "name"]).select("perfume_id", "normalized_alias")
    return MA.with_aliases(T.perfumes(s, d), named).select("perfume_id", F.coalesce(F.array_join("aliases", ","), F.lit("")).alias("aliases"))


@query(f"WITH {TITLES} SELECT p_partkey, contains(strip_accents(lower(title)), 'brand#1') AS named FROM titles")
def title_gate(s, d):
    """Whether a title holds the name of the brand Brand#1 (which every brand that begins so holds too)."""
    return _titles(s, d).select("p_partkey", MA.names_brand(F.col("title"), F.lit("Brand#1")).alias("named"))


@query("SELECT DISTINCT p_brand || ' ' || p_name AS label FROM part")
def labels(s, d):
    return T.perfumes(s, d).select(X.label(F.col("brand"), F.col("name")).alias("label")).distinct()


@query("SELECT perfume_id, CASE WHEN perfume_id IN (SELECT perfume_id FROM results) THEN 5 END AS last_checked_at FROM perfumes", "perfumes results")
def mark_checked(s, d):
    catalog = T.perfumes(s, d).select("perfume_id", F.lit(None).cast("int").alias("last_checked_at"))
    return O.mark_checked(catalog, T.results(s, d), F.lit(5))


@query("SELECT item_id, accord FROM (SELECT item_id, accord FROM accords WHERE item_id % 4 > 1 UNION ALL SELECT item_id, upper(accord) FROM accords WHERE item_id % 4 = 0)", "accords")
def replaced_accords(s, d):
    """Items divisible by four get new accords; those with a rest of one get an empty list."""
    old = T.accords(s, d).select("item_id", "accord")
    return O.replace_children(old, old.where("item_id % 4 = 0").withColumn("accord", F.upper("accord")), "item_id", old.where("item_id % 4 = 1").select("item_id").distinct())


@query("SELECT src, dst FROM edges", "edges")
def similar_edges(s, d):
    """Similar entries name the other item by a url that differs in case, query and slashes."""
    items = T.read(s, d, "supplier").select(F.col("s_suppkey").alias("item_id"), F.concat(F.lit("https://x.test/Item/"), "s_suppkey", F.lit("/")).alias("url"))
    similar = T.edges(s, d).select(F.col("src").alias("item_id"), F.concat(F.lit("http://www.x.test/item/"), "dst", F.lit("?a=1")).alias("url"))
    return G.owned_edges(similar, items)


@query("SELECT s_suppkey AS item_id, row_number() OVER (ORDER BY s_name, s_nationkey, s_suppkey) AS row_number FROM supplier")
def items_sorted(s, d):
    items = T.read(s, d, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("brand"))
    return numbered(items, *SC.sort_keys("unknown"), "item_id").select("item_id", "row_number")


@query("SELECT variant_id, store_id FROM offers WHERE (variant_id % 20, store_id) IN (SELECT (perfume_id, store_id) FROM results)", "obs offers results")
def offers_of_pairs(s, d):
    offers = T.offers(s, d).withColumn("perfume_id", F.col("variant_id") % 20)
    return O.for_pair(offers, offers, T.results(s, d)).select("variant_id", "store_id")


@query("SELECT a, b FROM (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON x.p_brand = y.p_brand) WHERE a = b OR len(list_filter(string_split(b, ' '), lambda q: NOT list_contains(string_split(a || ' old', ' '), q))) = 0")
def contained_names(s, d):
    """Names of one brand that hold all words of another, by the cheap test alone (threshold above any score)."""
    names = T.perfumes(s, d).select("brand", "name")
    pairs = names.select("brand", F.concat("name", F.lit(" old")).alias("x"), F.col("name").alias("a")).join(names.withColumnRenamed("name", "b"), "brand")
    return pairs.where(MA.plausible(F.col("x"), F.col("b"), 101)).select("a", "b").distinct()


_KEYS = "store_id, perfume_id, concentration, volume_ml, tester"
_RUN = (
    "m AS (SELECT max(run_id) AS last FROM obs), o AS (SELECT obs.store_id, perfume_id, concentration, volume_ml, tester, obs.price, availability, seq, variant_id, run_id FROM obs JOIN variants USING (variant_id) JOIN perfumes USING (brand, name)), "
    f"cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY availability <> 'in_stock', price, variant_id, seq) AS n FROM o, m WHERE run_id = last) WHERE n = 1), "
    f"old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY run_id DESC, availability <> 'in_stock', price, variant_id, seq) AS n FROM o, m WHERE run_id < last) WHERE n = 1)"
)


def _run_rows(s, d):
    """Observations with their perfume and variant; ordinal is by variant and sequence."""
    from pyspark.sql import Window as W

    rows = T.obs(s, d).join(T.named_variants(s, d), "variant_id")
    return rows.withColumn("ordinal", F.struct("variant_id", "seq"))


def _run_state(s, d, rows: DataFrame) -> tuple[RUN.State, DataFrame]:
    """The state before the last run of `rows`, and the raw offers of that run; every fourth tells no brand."""
    last = T.last_runs(s, d).agg(F.max("run_id")).scalar()
    key = RUN.VARIANT
    known = rows.select(*key).distinct().withColumn("variant_id", O.variant_id(*[F.col(c) for c in key]))
    text, money = F.lit(None).cast("string"), F.lit(None).cast("decimal(10,2)")
    earlier = rows.repartition(T.tasks(T.read(s, d, "lineitem")), "store_id", "perfume_id").where(F.col("run_id") < last).dropna(subset=key)
    before = O.dedup_in_run(earlier.select("store_id", *key, "run_id", "price", "availability", "ordinal"), ["store_id", *key, "run_id"])
    before = Y.latest(before, ["store_id", *key], ["run_id"]).withColumn("variant_id", O.variant_id(*[F.col(c) for c in key]))
    snapshot = before.select("store_id", "variant_id", "perfume_id", text.alias("url"), text.alias("identifier"), text.alias("title"), "price", money.alias("old_price"), F.lit("RON").alias("currency"), F.lit(None).cast("int").alias("discount_percentage"), "availability", F.lit("OLD").alias("coupon_code"), money.alias("coupon_price"), F.lit(1).alias("first_seen_at"), F.lit(1).alias("last_seen_at"))
    history = before.select("store_id", "variant_id", F.lit(1).cast("long").alias("run_id"), F.lit(1).alias("recorded_at"), "price", money.alias("old_price"), F.lit("RON").alias("currency"), F.lit(None).cast("int").alias("discount_percentage"), "availability")
    catalog = T.perfumes(s, d).withColumn("last_checked_at", F.lit(None).cast("int"))
    none = lambda kind: s.createDataFrame([], kind)
    aliases = none("perfume_id long, normalized_alias string, alias string")
    queue = none(SC.TABLES["review_queue"].replace("timestamp_ntz", "int"))
    alerts = none(SC.TABLES["alerts"].replace("timestamp_ntz", "int"))
    raw = rows.where(F.col("run_id") == last).select(
        F.concat_ws(" ", "brand", "name", F.concat("volume_ml", F.lit(" ml"))).alias("raw_title"), F.concat(F.lit("u/"), "variant_id").alias("product_url"), text.alias("store_product_identifier"), F.when(F.col("variant_id") % 4 > 0, F.col("brand")).alias("brand"),
        F.col("name").alias("perfume_name"), "concentration", "volume_ml", "tester", "price", (F.col("price") * 2).cast("decimal(10,2)").alias("old_price"), F.lit("RON").alias("currency"), "availability", text.alias("coupon_code"), money.alias("coupon_price"), "perfume_id", "store_id", "ordinal",
    )
    return RUN.State(catalog, aliases, known.select("variant_id", *key), snapshot, history, queue, alerts), raw


def _after_run(s, d) -> RUN.State:
    """The state after the last run, in which stores of odd numbers failed where they brought nothing."""
    state, raw = _run_state(s, d, written(_run_rows(s, d).select("brand", "name", "store_id", *RUN.VARIANT, "variant_id", "run_id", "price", "availability", "ordinal")))
    state = replace(state, variants=written(state.variants), snapshot=written(state.snapshot))
    pairs = state.snapshot.select("perfume_id", "store_id").unionByName(raw.select("perfume_id", "store_id")).distinct()
    attempts = written(pairs.withColumn("error_status", F.when(F.col("store_id") % 2 == 1, "scraping_error")))
    return RUN.apply_run(state, raw, attempts, 2, F.lit(2))[0]


@query(f"SELECT {_KEYS}, coalesce(c.price, p.price) AS price, CASE WHEN c.store_id IS NOT NULL THEN c.availability WHEN store_id % 2 = 0 THEN 'out_of_stock' ELSE p.availability END AS availability, CASE WHEN c.store_id IS NOT NULL THEN 'u/' || c.variant_id END AS url, CASE WHEN c.store_id IS NOT NULL THEN 50 END AS discount_percentage, CASE WHEN c.store_id IS NULL THEN 'OLD' END AS coupon_code, CASE WHEN p.store_id IS NULL THEN 2 ELSE 1 END AS first_seen_at, CASE WHEN c.store_id IS NULL THEN 1 ELSE 2 END AS last_seen_at FROM old p FULL JOIN cur c USING ({_KEYS})", "obs variants perfumes", _RUN)
def run_snapshot(s, d):
    after = _after_run(s, d)
    named = after.snapshot.drop("perfume_id").join(after.variants, "variant_id")
    return named.select("store_id", *RUN.VARIANT, "price", "availability", "url", "discount_percentage", "coupon_code", "first_seen_at", "last_seen_at")


@query(f"SELECT {_KEYS}, CASE WHEN c.store_id IS NULL THEN p.price ELSE c.price END AS price, CASE WHEN c.store_id IS NULL THEN 'out_of_stock' ELSE c.availability END AS availability FROM old p FULL JOIN cur c USING ({_KEYS}) WHERE CASE WHEN c.store_id IS NULL THEN store_id % 2 = 0 AND p.availability = 'in_stock' ELSE p.store_id IS NULL OR p.price <> c.price OR p.availability <> c.availability END", "obs variants perfumes", _RUN)
def run_history(s, d):
    after = _after_run(s, d)
    return after.history.join(after.variants, "variant_id").select("store_id", *RUN.VARIANT, "price", "availability")


@query("SELECT store_id, perfume_id, price, 'confirmed_name' AS alias, 'in_stock' AS availability FROM (SELECT DISTINCT 1 AS store_id, p_partkey AS perfume_id, CAST(p_retailprice AS DECIMAL(10,2)) AS price FROM part WHERE p_size % 2 = 0)")
def confirmed_offers(s, d):
    """Decisions on a queue of one doubtful row for each part: those of even sizes are confirmed, the others rejected."""
    state, _ = _run_state(s, d, _run_rows(s, d))
    part = T.read(s, d, "part")
    text = F.lit(None).cast("string")
    queue = part.select(
        F.col("p_partkey").alias("perfume_id"), F.lit(1).cast("long").alias("store_id"), F.concat(F.lit("u/"), "p_partkey").alias("product_url"), F.col("p_name").alias("title"), text.alias("candidate_brand"), F.lit("confirmed_name").alias("candidate_name"), F.col("p_type").alias("concentration"),
        F.col("p_size").alias("volume_ml"), F.lit(False).alias("tester"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"), F.lit(None).cast("decimal(10,2)").alias("old_price"), F.lit("RON").alias("currency"), F.lit("in_stock").alias("availability"), text.alias("identifier"),
        F.lit(80.0).alias("match_score"), F.lit("pending").alias("status"), F.lit(1).alias("first_seen_at"), F.lit(1).alias("last_seen_at"), F.lit(None).cast("int").alias("resolved_at"),
    )
    decisions = queue.select(*R.QUEUE_KEY, F.when(F.col("volume_ml") % 2 == 0, "confirmed").otherwise("rejected").alias("decision"))
    start = replace(state, queue=queue, snapshot=state.snapshot.limit(0), history=state.history.limit(0), variants=state.variants.limit(0))
    after = RUN.apply_decisions(start, decisions, F.lit(3))
    return after.snapshot.join(after.aliases, "perfume_id").select("store_id", "perfume_id", "price", F.col("normalized_alias").alias("alias"), "availability")


# -- whole runs from pages to stored tables ------------------------------------------------------------------------


@query(f"SELECT perfume_id, store_id, status, n::INTEGER AS offers_found, coalesce(message, '') AS error_message FROM st2", SH.CTES, SH.SHOP)
def pages_run_results(s, d):
    """Result rows of the second of two runs over pages."""
    rows = SH.two_runs(s, d).read("results").where("run_id = 2")
    return rows.select("perfume_id", "store_id", "status", "offers_found", F.coalesce("error_message", F.lit("")).alias("error_message"))


@query("SELECT 2 AS run_id, 'all' AS run_type, CASE WHEN bool_or(message IS NOT NULL) THEN 'completed_with_errors' ELSE 'completed' END AS status, count(DISTINCT perfume_id)::INTEGER AS perfume_count, count(DISTINCT store_id)::INTEGER AS store_count FROM st2", SH.CTES, SH.SHOP)
def pages_run_header(s, d):
    return SH.two_runs(s, d).read("runs").where("run_id = 2").select("run_id", "run_type", "status", "perfume_count", "store_count")


@query("SELECT s.store_id, CASE WHEN z.ok THEN '2024-01-02' WHEN y.store_id IS NOT NULL THEN '2024-01-01' END AS last_successful_check, z.e AS last_error FROM (SELECT store_id FROM stores WHERE enabled) s LEFT JOIN (SELECT store_id, bool_or(message IS NULL) AS ok, arg_max(coalesce(message, ''), perfume_id) AS e FROM r2 GROUP BY 1) z USING (store_id) LEFT JOIN (SELECT DISTINCT store_id FROM p1 WHERE store_id % 10 <> 7) y USING (store_id)", SH.CTES, SH.SHOP)
def pages_run_stores(s, d):
    """Enabled stores after both runs; '' stands for no error of a store that was tried."""
    stores, tried = (SH.two_runs(s, d).read(x) for x in ("stores", "results"))
    known = tried.select("store_id").distinct().withColumn("tried", F.lit(""))
    return stores.where("enabled").join(known, "store_id", "left").select("store_id", F.date_format("last_successful_check", "yyyy-MM-dd").alias("last_successful_check"), F.coalesce("last_error", "tried").alias("last_error"))


@query(f"SELECT {SH.KEYS}, coalesce(p2, p1) AS price, CASE WHEN gone THEN 'out_of_stock' ELSE coalesce(a2, a1) END AS availability, CASE WHEN a1 IS NULL THEN 2 ELSE 1 END AS first_day, CASE WHEN a2 IS NULL THEN 1 ELSE 2 END AS last_day FROM both_", SH.CTES, SH.SHOP)
def pages_run_snapshot(s, d):
    tables = SH.two_runs(s, d)
    named = tables.read("snapshot").drop("perfume_id").join(tables.read("variants"), "variant_id")
    return named.select("store_id", *RUN.VARIANT, "price", "availability", F.dayofmonth("first_seen_at").alias("first_day"), F.dayofmonth("last_seen_at").alias("last_day"))


@query(f"SELECT 1 AS run_id, {SH.KEYS}, p1 AS price, a1 AS availability FROM both_ WHERE a1 IS NOT NULL UNION ALL SELECT 2, {SH.KEYS}, coalesce(p2, p1), CASE WHEN gone THEN 'out_of_stock' ELSE a2 END FROM both_ WHERE gone OR a2 IS NOT NULL AND (a1 IS NULL OR a1 <> a2 OR p1 <> p2)", SH.CTES, SH.SHOP)
def pages_run_history(s, d):
    tables = SH.two_runs(s, d)
    return tables.read("history").join(tables.read("variants"), "variant_id").select("run_id", "store_id", *RUN.VARIANT, "price", "availability")


# -- reports, titles, deletions, components ------------------------------------------------------------------------


@query("SELECT count(*) AS changes FROM (SELECT *, lag(price) OVER (PARTITION BY variant_id ORDER BY seq) AS previous_price FROM obs) WHERE previous_price <> price AND run_id = (SELECT max(run_id) FROM obs)", "obs")
def price_change_count(s, d):
    return Y.count_moves_of_run(T.obs(s, d), ["variant_id"], ["seq"], "run_id")


@query("SELECT v.variant_id, coalesce(string_agg(offer_id || ':' || price || ':' || availability, ',' ORDER BY price, offer_id), '') AS offers FROM variants v LEFT JOIN offers USING (variant_id) GROUP BY 1", "obs variants offers")
def offers_by_variant(s, d):
    listed = P.offers_of_variants(T.variants(s, d).select("variant_id"), T.offers(s, d))
    return listed.select("variant_id", F.array_join(F.transform("offers", lambda x: F.concat_ws(":", x["offer_id"], x["price"], x["availability"])), ",").alias("offers"))


@query("SELECT perfume_id, coalesce(statuses, '') AS statuses, coalesce(x.n, 0) AS in_stock_stores, b.variant_id AS best_variant_id, b.price AS best_price FROM perfumes LEFT JOIN (SELECT perfume_id, string_agg(store_id || ':' || status, ',' ORDER BY store_id, status) AS statuses, count(DISTINCT CASE WHEN status = 'in_stock' THEN store_id END) AS n FROM (SELECT *, rank() OVER (PARTITION BY perfume_id, store_id ORDER BY created_at DESC) AS r FROM results) WHERE r = 1 GROUP BY 1) x USING (perfume_id) LEFT JOIN (SELECT * FROM (SELECT brand, name, variant_id, price, row_number() OVER (PARTITION BY brand, name ORDER BY price, volume_ml DESC, concentration, tester, variant_id) AS n FROM best WHERE price IS NOT NULL) WHERE n = 1) b USING (brand, name)", "obs offers variants best perfumes results")
def perfume_report(s, d):
    """Every perfume with its stores' latest statuses and its overall best offer."""
    perfumes = T.perfumes(s, d)
    latest = H.latest_statuses(T.results(s, d), ["perfume_id", "store_id"])
    out = P.perfume_report(perfumes, best(s, d).join(perfumes, ["brand", "name"]), latest)
    return out.select("perfume_id", F.array_join(F.transform("statuses", lambda x: F.concat_ws(":", x["store_id"], x["status"])), ",").alias("statuses"), "in_stock_stores", "best_variant_id", "best_price")


@query("SELECT p_partkey AS perfume_id, s_suppkey AS store_id, p_name AS product_url, p_brand AS brand, p_name AS name, s_name AS store_name, row_number() OVER (ORDER BY p_size DESC, p_partkey, s_suppkey, p_name) AS row_number FROM part JOIN supplier ON s_suppkey = p_partkey % 60 WHERE p_partkey % 3 = 0")
def pending_queue(s, d):
    """A doubtful row for each part, seen first by its size; those divisible by three wait."""
    part = T.read(s, d, "part")
    queue = part.select(F.col("p_partkey").alias("perfume_id"), (F.col("p_partkey") % 60).alias("store_id"), F.col("p_name").alias("product_url"), F.when(F.col("p_partkey") % 3 == 0, "pending").otherwise("rejected").alias("status"), F.col("p_size").alias("first_seen_at"))
    catalog = part.select(F.col("p_partkey").alias("perfume_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    return numbered(R.pending_listed(queue, catalog, T.stores(s, d)), *R.pending_keys()).select("perfume_id", "store_id", "product_url", "brand", "name", "store_name", "row_number")


@query(
    f"SELECT 'counts' AS part, 'items' AS key, items || ':' || brands || ':' || edges AS value FROM ({SQL['insight_counts']}) UNION ALL SELECT 'dna', family, percentage || ':' || \"offset\" FROM ({SQL['dna_offsets']}) "
    f"UNION ALL SELECT 'contributors', family || ':' || place, item_id || ':' || total FROM ({SQL['family_top3']}) UNION ALL SELECT 'accords', label, item_count || ':' || score FROM ({SQL['top_accords']}) "
    f"UNION ALL SELECT 'notes', label, item_count || ':' || score FROM ({SQL['top_notes']}) UNION ALL SELECT 'clusters', cluster || ':' || number, component || ':' || node || ':' || degree || ':' || members || ':' || edge_count FROM ({SQL['cluster_report']}) "
    f"UNION ALL SELECT 'cluster_edges', ce.a || '-' || ce.b, x.cluster || ':' || x.number || ':' || y.number FROM (WITH RECURSIVE {CTES['edges']}, {_GRAPH} SELECT a, b FROM ce) ce JOIN ({SQL['cluster_report']}) x ON x.node = ce.a JOIN ({SQL['cluster_report']}) y ON y.node = ce.b"
)
def insights_report(s, d):
    """All parts of the collection report in one table."""
    items = T.read(s, d, "supplier").withColumnsRenamed({"s_suppkey": "item_id", "s_name": "name"}).withColumn("brand", F.col("name"))
    parts = C.insights(items, T.accords(s, d), T.notes(s, d), T.edges(s, d), families=FAMILY)
    show = {
        "counts": (F.lit("items"), ["items", "brands", "edges"]), "dna": (F.col("family"), ["percentage", "offset"]), "contributors": (F.concat_ws(":", "family", "place"), ["item_id", "total"]), "accords": (F.col("label"), ["item_count", "score"]),
        "notes": (F.col("label"), ["item_count", "score"]), "clusters": (F.concat_ws(":", "cluster", "number"), ["component", "node", "degree", "members", "edge_count"]), "cluster_edges": (F.concat_ws("-", "a", "b"), ["cluster", "source_number", "target_number"]),
    }
    rows = [parts[name].select(F.lit(name).alias("part"), key.alias("key"), F.concat_ws(":", *values).alias("value")) for name, (key, values) in show.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(f"WITH {TITLES} SELECT p_partkey, b.brand FROM titles JOIN (SELECT DISTINCT p_brand AS brand FROM part UNION SELECT DISTINCT p_name FROM part) b ON contains(strip_accents(lower(title)), lower(b.brand))")
def title_brands(s, d):
    """Every title with every brand that it names; the products' names count as brands as well."""
    part = T.read(s, d, "part")
    brands = part.select(F.col("p_brand").alias("brand")).unionByName(part.select(F.col("p_name").alias("brand")))
    return MA.titles_with_brands(_titles(s, d).select("p_partkey", "title"), brands).select("p_partkey", "brand")


@query("WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0), parts AS (SELECT p_partkey FROM part WHERE p_size <= 5) SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT 'lines', count(*) FROM (SELECT DISTINCT * FROM lineitem) WHERE l_orderkey NOT IN (SELECT * FROM gone) AND l_partkey NOT IN (SELECT * FROM parts) UNION ALL SELECT 'parts', count(*) FROM part WHERE p_size > 5 UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def cascade_graph(s, d):
    """Lines hang on orders, these on customers, and on parts; some customers and parts are deleted in one call."""
    tables = {"lines": T.read(s, d, "lineitem").distinct(), "orders": T.read(s, d, "orders"), "customers": T.read(s, d, "customer"), "parts": T.read(s, d, "part"), "suppliers": T.read(s, d, "supplier")}
    deleted = {"customers": tables["customers"].where("c_custkey % 7 = 0").select("c_custkey"), "parts": tables["parts"].where("p_size <= 5").select("p_partkey")}
    links = [("orders", "o_custkey", "customers", "c_custkey"), ("lines", "l_orderkey", "orders", "o_orderkey"), ("lines", "l_partkey", "parts", "p_partkey"), ("lines", "l_suppkey", "suppliers", "s_suppkey")]
    left = O.delete_graph(tables, deleted, links)
    return reduce(lambda a, b: a.unionByName(b), [left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in ("orders", "lines", "parts", "suppliers")])


@query(f"WITH RECURSIVE {CTES['edges']}, {_GRAPH.replace('ce AS (SELECT DISTINCT a, b FROM un WHERE m = (SELECT bool_or(m) FROM un))', 'ce AS (SELECT DISTINCT a, b FROM un WHERE (a + b) % 7 <> 0)')} SELECT node, component FROM comp")
def components_updated(s, d):
    """Components after edges whose ends sum up to a multiple of five were added and those of a multiple of seven removed, from those before."""
    both = written(T.edges(s, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    late = (F.col("a") + F.col("b")) % 5 == 0
    before = both.where(~late)
    removed = both.where((F.col("a") + F.col("b")) % 7 == 0)
    return G.update_components(G.connected_components(before), before, both.where(late).join(removed, ["a", "b"], "left_anti"), removed)


# -- extraction from pages made of parts: what is extracted is what they were made of ---------------------------------

_PAGE = "p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_size * 5 AS volume, CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_size % 2 = 0 AS there, lpad(p_partkey::VARCHAR, 9, '0') AS code FROM part)"


def _parts(s, d):
    """Rows that pages are made of; dealt to all cores, as a small file is few splits and a page much more than its row."""
    return T.read(s, d, "part").repartition(4 * s.sparkContext.defaultParallelism).select(
        F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), (F.col("p_size") * 5).alias("volume"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"), (F.col("p_size") % 2 == 0).alias("there"),
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code"),
    )


def _made(rows: DataFrame, *html) -> DataFrame:
    """A page for each row: texts and columns (by name) one after the other; `{price}` stands for the price with a comma."""
    comma = F.replace(F.col("price").cast("string"), F.lit("."), F.lit(","))
    parts = [x if not isinstance(x, str) else comma if x == "{price}" else F.col(x[1:-1]) if x.startswith("{") and x.endswith("}") else F.lit(x) for x in html]
    return rows.select(F.lit("shop").alias("store_slug"), F.concat(F.lit("https://shop.test/p/"), "code").alias("url"), F.concat(*parts).alias("html"))


def _shown(raw: DataFrame) -> DataFrame:
    return SP.to_offers(raw).select("product_url", F.col("store_product_identifier").alias("code"), "perfume_name", "concentration", "volume_ml", "tester", "price", "old_price", "availability")


def _stock(then, other):
    return F.when(F.col("there"), then).otherwise(other)


_URL, _STOCK = "'https://shop.test/p/' || code AS product_url", "CASE WHEN there THEN 'in_stock' ELSE 'out_of_stock' END AS availability"


@query(f"WITH {_PAGE} SELECT {_URL}, code, name AS perfume_name, 'EDT' AS concentration, volume AS volume_ml, false AS tester, price, NULL::DECIMAL(10,2) AS old_price, {_STOCK} FROM p")
def extract_variant_list(s, d):
    html = ['<ul><li class="product-variants-list__item"><a data-variant-value="', "{code}", '" class="', _stock("x", "is-disabled"), '" title="Alege opțiunea produsului ', "{name}", " Apă de toaletă ", "{volume}", ' ml"></a><span class="product-variants-list__item-price">', "{price}", " lei</span></li></ul>"]
    return _shown(SP.variant_list(_made(_parts(s, d), *html)))


@query(f"WITH {_PAGE} SELECT {_URL}, code || x AS code, name AS perfume_name, 'Extrait' AS concentration, volume + v AS volume_ml, t AS tester, price + v AS price, NULL::DECIMAL(10,2) AS old_price, CASE WHEN x = 'a' AND there OR x = 'b' AND NOT there THEN 'in_stock' ELSE 'out_of_stock' END AS availability FROM p, (VALUES ('a', 0, false), ('b', 1, true)) z(x, v, t)")
def extract_attribute_groups(s, d):
    """Two sizes on each page; the second's price and button come from its own answer."""
    rows = _parts(s, d)
    html = [
        "<h1>", "{name}", '</h1><span class="current-price-value">', "{price}", ' lei</span><button class="add-to-cart"', _stock("", " disabled"), '>x</button><div class="product-variants"><div class="product-variants-item"><span class="form-control-label">Volum</span>',
        '<input class="input-radio" value="', "{code}", 'a" title="', "{volume}", ' ml" checked><input class="input-radio" value="', "{code}", 'b" title="', F.col("volume") + 1, ' ml Tester"></div><div class="product-variants-item"><select><option>a</option><option selected>extract de parfum</option></select></div></div>',
    ]
    pages = _made(rows, *html)
    other = F.concat(F.lit('<span class="current-price-value">'), F.replace((F.col("price") + 1).cast("string"), F.lit("."), F.lit(",")), F.lit("&nbsp;lei</span>"))
    more = rows.select(F.lit("shop").alias("store_slug"), F.concat(F.lit("https://shop.test/p/"), "code").alias("url"), F.concat("code", F.lit("b")).alias("value_id"), other.alias("price_html"), F.concat(F.lit('<button class="add-to-cart"'), _stock(" disabled", ""), F.lit(">x</button>")).alias("button_html"))
    return _shown(SP.attribute_groups(pages, more))


@query(f"WITH {_PAGE} SELECT {_URL}, 'CODE' || k AS code, price AS coupon FROM p WHERE there")
def extract_coupons(s, d):
    html = ['<div data-product-add-coupon-to-cart="CODE', "{k}", '"><b></b><p class="x h4">', _stock(F.replace(F.col("price").cast("string"), F.lit("."), F.lit(",")), "none"), " lei</p></div>"]
    return SP.coupons(_made(_parts(s, d), *html)).select(F.col("url").alias("product_url"), "code", M.comma_price(F.col("coupon")).alias("coupon"))


@query(f"WITH {_PAGE} SELECT k AS id, name, brand, '/a-' || k || '_z' || k || '/' AS product_url FROM p WHERE there")
def extract_tracked_search(s, d):
    """Results whose link the page does not have are left out."""
    row = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("k").alias("id"), "name", "brand")).alias("products")).alias("results")))
    link = _stock(F.concat(F.lit('<a href="/a-'), "k", F.lit("_z"), "k", F.lit('/">x</a>')), "")
    pages = _made(_parts(s, d), '<div data-tracking-search="', F.replace(row, F.lit('"'), F.lit("&quot;")), '"></div>', link, '<a href="/other_z999999999/">y</a>')
    return SP.tracked_search(pages).drop("store_slug")


@query(f"WITH {_PAGE} SELECT 'https://shop.test/v/' || code AS product_url, 'C' || code AS code, name AS perfume_name, 'EDP' AS concentration, volume AS volume_ml, false AS tester, price, CAST(price * 2 AS DECIMAL(10,2)) AS old_price, {_STOCK} FROM p")
def extract_pointer_map(s, d):
    ref = lambda key: F.struct(key.alias("__ref"))
    brand, variant = F.concat(F.lit("Brand:"), "k"), F.concat(F.lit("Variant:"), "k")
    product = F.struct(ref(brand).alias("brand"), F.array(ref(variant)).alias("variants"))
    detail = F.struct(
        "name", F.lit("Eau de Parfum").alias("variantName"), F.concat("volume", F.lit(" ml")).alias("additionalInfo"), F.concat(F.lit("/v/"), "code").alias("url"), F.concat(F.lit("C"), "code").alias("productCode"),
        F.struct(F.col("price").alias("value"), F.lit("RON").alias("currency")).alias("price"), F.struct((F.col("price") * 2).alias("value")).alias("originalPrice"), F.struct(_stock("CanBeBought", "Sold").alias("state")).alias("availability"),
    )
    pages = _made(_parts(s, d), '<script id="__APOLLO_STATE__">{"CatalogProduct:', "{k}", '":', F.to_json(product), ',"', variant, '":', F.to_json(detail), ',"', brand, '":', F.to_json(F.struct(F.col("brand").alias("name"))), "}</script>")
    return _shown(SP.pointer_map(pages, F.lit("https://shop.test")))


@query(f"WITH {_PAGE} SELECT 'https://shop.test/i/' || k || '?c=' || code || x AS product_url, code || x AS code, name AS perfume_name, 'EDP' AS concentration, volume + v AS volume_ml, false AS tester, CAST(price + v AS DECIMAL(10,2)) AS price, CASE WHEN v = 1 THEN CAST(price * 2 AS DECIMAL(10,2)) END AS old_price, CASE WHEN there = (v = 0) THEN 'in_stock' ELSE 'out_of_stock' END AS availability FROM p, (VALUES ('a', 0), ('b', 1)) z(x, v)")
def extract_escaped_state(s, d):
    """Two sizes of an item in a state that a script holds as a quoted string, quotes and backslashes escaped."""
    size = lambda x, v: F.struct(
        F.concat("code", F.lit(x)).alias("code"), F.concat(F.col("volume") + v, F.lit(" ml")).alias("value"), F.when(F.col("there") == F.lit(v == 0), 1).otherwise(0).alias("online"),
        F.struct(F.struct((F.col("price") + v).cast("string").alias("decimal")).alias("withVat"), F.struct((F.col("price") * 2).cast("decimal(10,2)").cast("string").alias("decimal")).alias("rrpWithVat")).alias("price"), F.struct(F.lit(v == 1).alias("sale")).alias("priceAction"),
    )
    item = F.to_json(F.struct(F.concat("name", F.lit(" Eau de Parfum")).alias("name"), F.concat(F.lit("/i/"), "k").alias("urlRelative"), F.array(F.struct(F.col("brand").alias("name"))).alias("brands"), F.array(size("a", 0), size("b", 1)).alias("pars")))
    quoted = F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    pages = _made(_parts(s, d), "<script>window.__INITIAL_STATE__state='{\"x\":1,\"productsStore\":{\"items\":[", quoted, "]}}';</script>")
    return _shown(SP.escaped_state(pages, F.lit("https://shop.test")))


@query(f"WITH {_PAGE} SELECT 'https://shop.test/c/' || code AS product_url, code, name AS perfume_name, 'EDP' AS concentration, NULL::INTEGER AS volume_ml, false AS tester, price, CAST(price * 2 AS DECIMAL(10,2)) AS old_price, {_STOCK} FROM p")
def extract_listing_cards(s, d):
    """Cards with prices: brand, name and type each in a place of its own."""
    html = [
        '<article class="product-miniature" data-id-product="', "{code}", '"><h3><a href="https://shop.test/c/', "{code}", '">link</a></h3><span class="product-name-manufacturer">', "{brand}", '</span><span class="product-name-middle">', "{name}",
        '</span><span class="product-name-type">Eau de Parfum</span><span class="regular-price">', F.replace((F.col("price") * 2).cast("decimal(10,2)").cast("string"), F.lit("."), F.lit(",")), ' lei</span><span class="price">', "{price}", " lei</span>", _stock("", '<b class="out-of-stock-product">x</b>'), "</article>",
    ]
    return _shown(SP.listing_cards(_made(_parts(s, d), *html)))


@query(f"WITH {_PAGE} SELECT 'https://shop.test/p/' || code AS url, position::INTEGER AS position, accord, strength::INTEGER AS strength FROM p, LATERAL (VALUES (0, brand, volume / 250 * 100), (1, name, 50)) z(position, accord, strength)".replace("volume / 250 * 100", "round_even(CAST(volume AS DOUBLE) * 100 / 250, 0)"))
def extract_accords(s, d):
    bar = ['<div style="opacity: 1; width: ', F.try_divide(F.col("volume") * 100, F.lit(250)).cast("decimal(10,2)"), '%;"> ', "{brand}", ' </div><div style="width:50%"> ', "{name}", " </div>"]
    return SP.accords(_made(_parts(s, d), "<h6>main accords</h6>", *bar, '<h2>x</h2><div style="width:9%">no</div>'))


@query(f"WITH {_PAGE} SELECT 'https://shop.test/p/' || code AS url, tier, position::INTEGER AS position, name FROM (SELECT code, 'top' AS tier, unnest(string_split(name, ' ')) AS name, unnest(range(len(string_split(name, ' ')))) AS position FROM p UNION ALL SELECT code, 'base', brand, 0 FROM p)")
def extract_notes(s, d):
    """The words of a name are its top notes, the brand the base."""
    label = lambda x: F.concat(F.lit('<span class="pyramid-note-label"> '), x, F.lit(" </span>"))
    top = F.array_join(F.transform(F.split("name", " "), label), "")
    return SP.notes(_made(_parts(s, d), '<pyramid-level-new notes="top">', top, '</pyramid-level-new><pyramid-level-new notes="base">', label(F.col("brand")), "</pyramid-level-new>"))


@query(f"WITH {_PAGE} SELECT 'https://shop.test/p/' || code AS url, 0 AS position, brand, name, 'https://www.items.test/perfume/b/n-' || k || '.html' AS similar_url FROM p WHERE there")
def extract_similar_items(s, d):
    """The object that a script assigns, decoded; entries on another host and repeated ones are left out."""
    entry = lambda host: F.struct(F.struct(F.col("brand").alias("dizajner"), F.col("name").alias("naslov"), F.concat(F.lit(host), F.lit("/perfume/b/n-"), "k", F.lit(".html")).alias("perfume_url")).alias("perfume"))
    body = F.to_json(F.struct(F.when(F.col("there"), F.array(entry(""), entry("https://www.items.test"))).otherwise(F.array(entry("https://other.test"))).alias("similar_perfumes")))
    payloads = SP.sealed_payload(_made(_parts(s, d), "<script>let similar_perfumes = ", body, ";</script>"))
    return SP.similar_items(payloads, ["www.items.test"], "www.items.test")


_OWNED = f"WITH {_PAGE} SELECT 'https://shop.test/p/' || code AS url, 0 AS position, 'https://www.items.test/perfume/b/n-' || k || '.html' AS item_url FROM p WHERE there"


@query(_OWNED)
def extract_owned_html(s, d):
    """The shelf under its label; pages without one are errors."""
    html = ["<div><div><h3>", _stock("I have (2)", "I want (2)"), '</h3></div><div><a href="/perfume/b/n-', "{k}", '.html?x=1">a</a><a href="/perfume/b/n-', "{k}", '.html">again</a></div></div>']
    return SP.owned_html(_made(_parts(s, d), *html), ["www.items.test"], "www.items.test")


@query(_OWNED)
def extract_owned_json(s, d):
    item = F.struct(F.concat(F.lit("/perfume/b/n-"), "k", F.lit(".html")).alias("url"))
    shelf = lambda value: F.struct(F.lit("wardrobe").alias("type"), F.lit("relation").alias("field"), value.alias("value"), F.array(item, item).alias("perfumes"))
    payloads = _made(_parts(s, d), F.to_json(F.array(shelf(F.lit("want")), shelf(_stock("have", "had"))))).select("url", F.col("html").alias("payload"))
    return SP.owned_json(payloads, ["www.items.test"], "www.items.test")


@query(f"WITH {_PAGE} SELECT 'https://shop.test/' || regexp_replace(lower(brand), '[^a-z0-9]+', '-', 'g') || '/' || replace(name, ' ', '-') || '/' AS loc, brand, replace(name, ' ', '-') AS slug FROM p GROUP BY ALL")
def extract_sitemap(s, d):
    """Locations of a sitemap that are of the catalog's brands; others are left out."""
    rows = _parts(s, d)
    entry = F.concat(F.lit("<url><loc> https://shop.test/"), X.slug(F.col("brand")), F.lit("/"), F.replace("name", F.lit(" "), F.lit("-")), F.lit("/ </loc></url><url><loc>https://shop.test/nobody/x/</loc></url>"))
    found = SP.sitemap_candidates(SP.sitemap_urls(_made(rows, "<urlset>", entry, "</urlset>")), T.perfumes(s, d))
    return found.select("loc", "brand", F.replace("name_text", F.lit(" "), F.lit("-")).alias("slug"))


@query(f"WITH {_PAGE} SELECT {_URL}, CASE WHEN there THEN 'EDP' END AS concentration FROM p WHERE k % 2 = 0 UNION ALL SELECT {_URL}, 'EDT' FROM p WHERE k % 2 = 1")
def extract_detail_concentration(s, d):
    """Offers without a concentration take it from their detail page, where that tells one."""
    rows = _parts(s, d)
    offers = rows.select(F.concat(F.lit("https://shop.test/p/"), "code").alias("product_url"), F.when(F.col("k") % 2 == 1, "EDT").alias("concentration"))
    data = F.replace(F.to_json(F.struct(F.lit("x").alias("description"), _stock("o apă de parfum", "y").alias("description_short"))), F.lit('"'), F.lit("&quot;"))
    return SP.detail_concentration(offers, _made(rows, '<div data-product="', data, '"></div>'))


@query(f"WITH {_PAGE} SELECT shape, name || ' ' || x AS brand, CASE shape WHEN 'grid_links' THEN 'b-' || k WHEN 'checkboxes' THEN k::VARCHAR ELSE '/brand/' || k END AS target FROM (SELECT name, max(k) AS k FROM p GROUP BY 1), (VALUES ('a')) y(x), (VALUES ('boxed_links'), ('brand_links'), ('data_spans'), ('grid_links'), ('checkboxes')) z(shape)")
def extract_directories(s, d):
    """Names as brands in directories of all five forms; of a name that stands on several pages the last counts."""
    rows = _parts(s, d).withColumn("name", F.concat("name", F.lit(" a")))
    link = ['<a href="/brand/', "{k}", '">', "{name}", "</a>"]
    forms = {
        "boxed_links": ['<div class="brand-infos">', *link, "</div>"], "brand_links": link, "data_spans": ['<span data-id="m-1" data-text="', "{name}", '" data-url="/brand/', "{k}", '"></span>'],
        "grid_links": ['<div class="grid"><a href="/b-', "{k}", '/">', "{name}", "</a></div>"],
        "checkboxes": ['<input class="filter-checkbox-list__checkbox" id="fs-prop-brand-val-', "{k}", '"><label for="fs-prop-brand-val-', "{k}", '"><span class="filter-checkbox-list__label-text">', "{name}", " <i>(3)</i></span></label>"],
    }
    found = [SP.read_directory(_made(rows, *html), shape)[0].select(F.lit(shape).alias("shape"), "brand", "target") for shape, html in forms.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


_listing = "regexp_replace(url, '[?&]page=\\d+.*$', '')"
_number = "CASE WHEN regexp_extract(url, '[?&]page=(\\d+)', 1) = '' THEN 1 ELSE CAST(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INTEGER) END"


@query(f"SELECT regexp_extract(url, '://([^/]*)', 1) AS store_slug, {_listing} AS listing, count(DISTINCT {_number}) AS pages_seen, max({_number}) AS last_page, count(DISTINCT {_number}) = max({_number}) AND NOT arg_max(length(html) % 2 = 0, {_number}) AS complete FROM pages GROUP BY 1, 2")
def listing_gaps(s, d):
    """Pages of even length get a link to a next one; of copies of a page the one of the least page_id counts."""
    rows = _pages(s, d)
    more = F.when(F.length("html") % 2 == 0, F.concat("html", F.lit('<a rel="next" href="/n">next</a>'))).otherwise(F.regexp_replace("html", '(?i)rel="next"', " "))
    return SP.listing_gaps(rows.withColumn("html", more), "rel_next", order=F.col("page_id"))
