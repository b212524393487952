"""A run from raw pages to the next version of every table: results with messages, header, stores' roll-up and all that the offers change."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from offerlens.operators import offers
from offerlens.operators.health import UNHEALTHY
from offerlens.plans.run import State, apply_decisions, apply_run
from offerlens.sources.pages import Extractor, extract_offers
from offerlens.sources.schema import TABLES, schema
from offerlens.sources.storage import written
from offerlens.sources.versions import BUCKETS, Layout, Versions

PAIR = ["perfume_id", "store_id"]


@dataclass
class Run:
    """What a run makes: the next state, and rows of its own."""

    state: State
    stores: DataFrame  # with last_successful_check and last_error of the run
    results: DataFrame  # a row for each attempted (perfume, store)
    header: DataFrame  # one row


def attempts_of(fetches: DataFrame, stores: DataFrame, page_errors: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """(perfume_id, store_id, store_slug, error_status, error_message) of each perfume and enabled store that `fetches` name.

    fetches: perfume_id, store_slug, url, error_status, error_message. A fetch that failed has its own status and message; a store whose extractor
    is not known and a page without offers are scraping errors. A pair with several errors has that of the least url; one error of a pair makes the pair fail.
    """
    named = _extractor()
    known = named.isin(list(extractors)) if extractors else F.lit(False)
    unknown = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("no extractor for "), F.coalesce(named, F.lit("null"))))
    enabled = stores.where("enabled").select("store_id", F.col("slug").alias("store_slug"), unknown.alias("__unknown"))
    bad = page_errors.groupBy("store_slug", "url").agg(F.min("error").alias("__page"))
    rows = fetches.join(enabled, "store_slug").join(bad, ["store_slug", "url"], "left")
    status = F.when(F.col("__unknown").isNotNull(), UNHEALTHY[0]).when(F.col("error_status").isNotNull(), F.col("error_status")).when(F.col("__page").isNotNull(), UNHEALTHY[0])
    rows = rows.select(*PAIR, "store_slug", F.struct("url", status.alias("status"), F.coalesce("__unknown", "error_message", "__page").alias("message")).alias("e"))
    out = rows.groupBy(*PAIR, "store_slug").agg(F.min(F.when(F.col("e.status").isNotNull(), F.col("e"))).alias("e"))
    return out.select(*PAIR, "store_slug", F.col("e.status").alias("error_status"), F.col("e.message").alias("error_message"))


def _extractor() -> Column:
    """The name of a store's extractor, by default its slug."""
    return F.coalesce("extractor", "slug")


def roll_up(stores: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Stores after a run: last_successful_check where any perfume's check succeeded; last_error is that of the run's last check by perfume, null after a success.

    Stores that the run did not try stay as they are.
    """
    bad = F.col("status").isin(*UNHEALTHY)
    of = results.groupBy("store_id").agg(F.bool_or(~bad).alias("__ok"), F.max_by(F.struct(F.when(bad, F.coalesce("error_message", "status")).alias("m")), "perfume_id").alias("__last"))
    out = stores.join(of, "store_id", "left")
    return out.withColumns({
        "last_successful_check": F.when(F.col("__ok"), now).otherwise(F.col("last_successful_check")), "last_error": F.when(F.col("__last").isNotNull(), F.col("__last.m")).otherwise(F.col("last_error")),
    }).select(*stores.columns)


def run_pages(
    state: State, stores: DataFrame, pages: DataFrame, fetches: DataFrame, extractors: dict[str, Extractor], run_id: int, now: Column, started: Column | None = None,
    run_type: str = "all", cards: DataFrame | None = None,
) -> Run:
    """A run over `pages` (store_slug, url, html), each fetched for the perfumes that `fetches` name with it (see `attempts_of`).

    Offers of a page are compared with its perfumes alone; a pair with an error keeps its old offers, and nothing of it is delisted. Of equal offers the
    first by page and position counts. Pages that no fetch of an enabled store names are not parsed.
    """
    enabled = stores.where("enabled").select(F.col("slug").alias("store_slug"), _extractor().alias("__by"))
    asked = fetches.where("url IS NOT NULL").select("store_slug", "url").distinct().join(enabled, "store_slug")
    own = written(pages.join(asked, ["store_slug", "url"]))
    found, errors = extract_offers(own, extractors, cards, place=True, by="__by") if extractors else (None, own.select("store_slug", "url", F.lit("").alias("error")).limit(0))
    attempts = written(attempts_of(fetches, stores, errors, extractors))
    good = attempts.where("error_status IS NULL").select(*PAIR, "store_slug")
    if found is None:
        raw = state.catalog.sparkSession.createDataFrame([], schema("raw_offers")).drop("store_slug").withColumns({"store_id": F.lit(0).cast("long"), "ordinal": F.lit(0)})
    else:
        aims = fetches.select("perfume_id", "store_slug", F.col("url").alias("page_url")).distinct().join(good, ["perfume_id", "store_slug"])
        raw = found.drop("perfume_id").join(aims, ["store_slug", "page_url"]).withColumn("ordinal", F.struct("page_url", "position")).drop("store_slug", "page_url", "position")
    after, outcomes = apply_run(state, raw, attempts, run_id, now)
    results = written(outcomes.select(
        F.xxhash64(F.lit(run_id), *PAIR).alias("result_id"), F.lit(run_id).cast("long").alias("run_id"), *PAIR, "status", F.col("offers_found").cast("int").alias("offers_found"), "error_message", now.alias("created_at")
    ))
    header = offers.run_header(results, run_id, run_type, started if started is not None else now, now)
    return Run(after, roll_up(stores, results, now), results, header)


# -- as versions of stored tables ----------------------------------------------------------------------------------


def _of(name: str, key: str | None = "perfume_id", facts: bool = False, more: str = "") -> Layout:
    return Layout(f"{TABLES[name]}{more}", key, facts)


def layouts() -> dict[str, Layout]:
    """Everything that hangs on a perfume lies in the perfume's bucket, so a run reads and rewrites the buckets of the perfumes that it checks."""
    return {
        "catalog": _of("catalog"), "aliases": _of("aliases"), "variants": _of("variants"), "snapshot": _of("current_offers", more=", perfume_id long"), "queue": _of("review_queue"),
        "alerts": _of("alerts", more=", perfume_id long"), "stores": _of("stores", None), "history": _of("price_history", None, True), "results": _of("check_results", None, True), "runs": _of("runs", None, True),
    }


def open_state(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Versions:
    return Versions(spark, root, layouts(), buckets)


def read_state(tables: Versions, version: int | None = None, only: list[int] | None = None) -> State:
    """The state as of a version; with `only`, of the perfumes in these buckets."""
    version = tables.current() if version is None else version
    return State(**{f.name: tables.read(f.name, version, None if f.name == "history" else only) for f in fields(State)})


#: Tables of a state that runs and decisions rewrite.
REWRITTEN = ("catalog", "aliases", "variants", "snapshot", "queue", "alerts")


def store_run(tables: Versions, pages: DataFrame, fetches: DataFrame, extractors: dict[str, Extractor], run_id: int, now: Column, **more) -> int:
    """Run over pages and commit all that it changes as one version, which is returned; a run that a version has already is not made again.

    Only the buckets of the perfumes in `fetches` are read and rewritten. `Conflict` means that another writer was faster: nothing has changed, and the run can be tried again.
    """
    base = tables.current()
    if tables.read("runs", base).where(F.col("run_id") == run_id).limit(1).count():
        return base
    only = tables.touched(fetches.select("perfume_id").where("perfume_id IS NOT NULL"))
    made = run_pages(read_state(tables, base, only), tables.read("stores", base), pages, fetches, extractors, run_id, now, **more)
    changed = {name: getattr(made.state, name) for name in REWRITTEN if name != "aliases"} | {"stores": made.stores}
    return tables.commit(base, changed, {"history": _numbered(made.state.history), "results": made.results, "runs": made.header}, only)


def run_stream(tables: Versions, fetched: DataFrame, extractors: dict[str, Extractor], now: Column | None = None, first_run: int = 1) -> DataStreamWriter:
    """A run for each micro-batch of a stream of fetches that carry their pages: perfume_id, store_slug, url, html, error_status, error_message.

    The number of a run is that of its micro-batch from `first_run` on, so a micro-batch that is played again after a failure is not stored again. A perfume's fetches of
    one check belong in one micro-batch (one file): what a later one brings counts as a later check.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = written(batch)
        pages = rows.where("html IS NOT NULL").select("store_slug", "url", "html").distinct()
        fetches = rows.select("perfume_id", "store_slug", "url", "error_status", "error_message")
        store_run(tables, pages, fetches, extractors, first_run + number, F.current_timestamp().cast("timestamp_ntz") if now is None else now, run_type="stream")

    return fetched.writeStream.foreachBatch(apply).outputMode("append")


def store_decisions(tables: Versions, decisions: DataFrame, now: Column) -> int:
    """Apply decisions on queued rows and commit all that they change as one version."""
    base = tables.current()
    only = tables.touched(decisions.select("perfume_id"))
    after = apply_decisions(read_state(tables, base, only), decisions, now)
    return tables.commit(base, {name: getattr(after, name) for name in REWRITTEN}, {"history": _numbered(after.history)}, only)


def _numbered(entries: DataFrame) -> DataFrame:
    """Entries with an id: a hash of what they are an entry of, so that a run made again gives the same."""
    return entries.withColumn("id", F.xxhash64("store_id", "variant_id", "run_id", "recorded_at"))
