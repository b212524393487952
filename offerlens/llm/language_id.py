"""Language ID: text likelihoods, declared language, address suffix and smoothed host priors fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import arrow_batch, join_once, keyed, slices, table, written

UNKNOWN = "und"
#: Labelled rows of each language that the text model is fitted on (as expected from a hash), and languages from which on `fit` raises an error.
TRAIN_ROWS, MAX_LANGUAGES = 3_000, 1_024
BUCKETS = 1 << 14
#: Added to each count; grams that a text's mean log likelihood counts for at most; prior weights of host levels and of declarations.
SMOOTHING, TEXT_WEIGHT, LEVEL_WEIGHT, DECLARED_WEIGHT, DECLARED_TRUST = 0.5, 200, 20.0, 20.0, 0.9
#: Address suffixes of countries with one main language, and how much more likely that language is.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
SUFFIX_ODDS = 4.0

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the three bytes from each place on (BUCKETS where they cross texts or hold no letter), and the texts' bounds."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LETTER[np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]] if raw is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    out = np.full(len(data), BUCKETS, np.int32)
    if len(data) >= 3:
        x = data.astype(np.uint32)
        x = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
        out[:-2] = np.where(x == 0x202020, BUCKETS, (x * np.uint32(2654435761)) >> np.uint32(18))
        for back in (1, 2):
            cross = bounds[1:] - back
            out[cross[cross >= bounds[:-1]]] = BUCKETS
    return out, bounds


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each gram bucket under each, the last being the unknown language's (all alike).

    Fitted on about `train_rows` labelled rows of each language, chosen by a hash of id and text; the size of the result is
    fixed for each language (64 KB). All languages are fitted; more than MAX_LANGUAGES raise a ValueError, none is left out.
    Rows without a label or text teach nothing.
    """
    lang, text = F.col(lang_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    labelled = docs.select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("h")).where("lang <> '' AND lang <> 'und' AND text <> ''")
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labelled languages in {lang_col}")
    languages = sorted(r["lang"] for r in sizes)
    share = F.lit(None)
    if sizes:
        shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], float(train_rows / r["count"]))])
        share = F.try_element_at(shares, F.col("lang"))
    sample = labelled.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buckets, bounds = _buckets(part["text"])
                names = np.array(part["lang"].to_pylist(), object)
                of = np.repeat(names, np.diff(bounds))
                for name in sorted(set(names)):
                    yield arrow_batch(schema, [name], [np.bincount(buckets[of == name], minlength=BUCKETS + 1)[:BUCKETS].astype(np.int64).tobytes()])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}  # one for each language
        for batch in batches:
            for name, counts in zip(batch["lang"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(counts, np.int64)
        yield arrow_batch(schema, list(sums), [x.tobytes() for x in sums.values()])

    kinds = "lang string, counts binary"
    sums = sample.mapInArrow(count, kinds).repartition("lang").mapInArrow(total, kinds).collect()  # one row for each language
    counts, place = np.full((len(languages), BUCKETS), SMOOTHING), {x: i for i, x in enumerate(languages)}
    for r in sums:
        counts[place[r["lang"]]] += np.frombuffer(r["counts"], np.int64)
    model = np.vstack([np.log(counts / counts.sum(axis=1, keepdims=True)), np.full(BUCKETS, -np.log(BUCKETS))])
    return languages, np.hstack([model, np.zeros((len(model), 1))]).astype(np.float32)


def _normal(logs: np.ndarray) -> np.ndarray:
    """Probabilities from rows of log likelihoods."""
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _levels(scored: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, float]:
    """(host, n, hosts, domains, suffixes), and sums and number over all rows: for each host the sums of the posteriors of its rows, of its
    domain's and of its suffix's, each with the number of rows as a last element; null where a host has no domain."""
    told = scored.where("n_grams > 0")
    sums = lambda c: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n + 1)])
    one = F.concat("posterior", F.array(F.lit(1.0)))
    hosts = written(told.groupBy("host", "domain", "suffix").agg(sums(one).alias("hosts"), F.count("*").alias("n")))
    domains = written(hosts.where("domain IS NOT NULL").groupBy("domain", "suffix").agg(sums(F.col("hosts")).alias("domains"), F.count("*").alias("n")))
    suffixes = written(domains.groupBy("suffix").agg(sums(F.col("domains")).alias("suffixes"), F.count("*").alias("n")))
    both = join_once(domains.withColumnRenamed("n", "m"), suffixes, ["suffix"]).select("domain", "domains", "suffixes", F.col("m").alias("n"))
    every = hosts.agg(sums(F.col("hosts")).alias("x")).first()["x"]
    every = np.array([x or 0.0 for x in every])
    named = hosts.where("host IS NOT NULL").select("host", "domain", "hosts", F.col("n").alias("m"))
    return written(join_once(named, both, ["domain"], how="left").select("host", "hosts", "domains", "suffixes", F.col("m").alias("n"))), every[:n], float(every[n])


def _declarations(scored: DataFrame, names: list[str]) -> np.ndarray:
    """(declared, language): sums of the posteriors of rows that declare each known language."""
    n, place = len(names), {x: i for i, x in enumerate(names)}
    sums = scored.where("n_grams > 0").where(F.col("declared").isin(names[:-1])).groupBy("declared").agg(F.array(*[F.sum(F.get("posterior", F.lit(i))) for i in range(n)]).alias("s"))
    out = np.zeros((n, n))
    for r in sums.collect():  # one row for each language
        out[place[r["declared"]]] = r["s"]
    return out


def _fuse(logs: np.ndarray, own: np.ndarray, told: np.ndarray, every: tuple[np.ndarray, float], levels: list[np.ndarray], declared: np.ndarray, declarations: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Probabilities of the languages of some rows. `levels`: sums from the suffix down to the host, with NaN for rows without one; declared: number, or -1.

    A row's own posterior is taken out of all sums before they count for it.
    """
    n = logs.shape[1]
    own, ones = np.where(told[:, None], own, 0.0), told.astype(float)[:, None]
    prior = (np.maximum(every[0] - own, 0) + LEVEL_WEIGHT / n) / (every[1] - ones + LEVEL_WEIGHT)
    for sums in levels:
        some = ~np.isnan(sums[:, -1:])
        next_ = (np.maximum(np.nan_to_num(sums[:, :n]) - own, 0) + LEVEL_WEIGHT * prior) / (np.nan_to_num(sums[:, n:]) - ones + LEVEL_WEIGHT)
        prior = np.where(some, next_, prior)
    fused = logs + np.log(prior) + odds
    said = np.flatnonzero(declared >= 0)
    if len(said):
        trust = np.full((n, n), (1 - DECLARED_TRUST) / max(1, n - 1))
        np.fill_diagonal(trust, DECLARED_TRUST)
        of = declared[said]
        hits = np.maximum(declarations[of] - own[said], 0) + DECLARED_WEIGHT * trust[of]
        fused[said] += np.log(hits / (np.maximum(declarations.sum(axis=0) - own[said], 0) + DECLARED_WEIGHT))
    return _normal(fused)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, declared: Column | None = None) -> DataFrame:
    """(doc_id, k, t, lang, confidence, text_lang, n_grams, rejected) for each row of `docs`.

    The text's likelihood is that of its byte triples; its mean counts for TEXT_WEIGHT of them at most, so that a long
    text does not drown the rest. The prior of a language is that of the row's host, smoothed towards its domain (the last two
    parts), this towards its suffix, and this towards all rows: counts that grouped aggregation takes over every row, by the text's
    posterior. Suffixes of countries multiply the odds of their language. A declared language counts by how often rows of each language
    declare it. A row's own posterior is taken out of the sums that it meets. Ties go to the first language by name.

    Rows without host or declaration do without; null and empty texts, and others without letters, are unknown and rejected, as is a text that
    the unknown language explains best. Repeated rows and ids are rows of their own, null ids are allowed, an empty table gives an
    empty one, and columns but those named are not read. Rows of a common host, or of none, are not brought together.
    """
    languages, logs = model
    names = [*languages, UNKNOWN]
    n = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    floats = pa.list_(pa.float64())
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("host", pa.string()), ("declared", pa.string()), ("n_grams", pa.int64()), ("likelihood", floats), ("posterior", floats)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for batch in batches:
            for part in slices(batch):
                buckets, bounds = _buckets(part["text"])
                count = np.concatenate([[0], np.cumsum(buckets < BUCKETS)])
                grams = count[bounds[1:]] - count[bounds[:-1]]
                out = np.empty((part.num_rows, n))
                for i in range(n):
                    sums = np.concatenate([[0.0], np.cumsum(table_[i][buckets], dtype=np.float64)])
                    out[:, i] = sums[bounds[1:]] - sums[bounds[:-1]]
                out *= (np.minimum(grams, TEXT_WEIGHT) / np.maximum(grams, 1))[:, None]
                yield arrow_batch(schema, part["doc_id"], part["k"], part["t"], part["host"], part["declared"], grams, list(out), list(_normal(out)))

    where = (host if host is not None else F.lit(None)).cast("string")
    said = F.lower(F.regexp_extract((declared if declared is not None else F.lit(None)).cast("string"), "^[A-Za-z]+", 0))
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), where.alias("host"), said.alias("declared")), more=("host", "declared"))
    scored = written(rows.mapInArrow(score, "doc_id long, k long, t long, host string, declared string, n_grams long, likelihood array<double>, posterior array<double>"))
    parts = F.split("host", r"\.")
    domain = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "."))
    suffix = F.when(F.size(parts) >= 2, F.element_at(parts, -1))
    scored = scored.withColumns({"domain": domain, "suffix": suffix})
    hosts, sums, number = _levels(scored, n)
    declarations = _declarations(scored, names)
    place = {x: i for i, x in enumerate(names)}
    of_suffix = {s: place[x] for s, x in SUFFIXES.items() if x in languages}
    result = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("text_lang", pa.string()), ("n_grams", pa.int64()), ("rejected", pa.bool_())])

    def matrix(column: pa.Array, width: int) -> np.ndarray:
        out = np.full((len(column), width), np.nan)
        some = column.is_valid().to_numpy(zero_copy_only=False)
        out[some] = column.drop_null().flatten().to_numpy().reshape(-1, width)
        return out

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, grams = matrix(batch["posterior"], n), batch["n_grams"].to_numpy()
            told = grams > 0
            odds = np.zeros((batch.num_rows, n))
            for i, s in enumerate(batch["suffix"].to_pylist()):
                if s in of_suffix:
                    odds[i, of_suffix[s]] = np.log(SUFFIX_ODDS)
            known = np.array([place.get(x, -1) if x != UNKNOWN else -1 for x in batch["declared"].to_pylist()])
            fused = _fuse(matrix(batch["likelihood"], n), own, told, (sums, number), [matrix(batch[c], n + 1) for c in ("suffixes", "domains", "hosts")], known, declarations, odds)
            lang = np.where(told, fused.argmax(axis=1), n - 1)
            by_text = np.where(told, own.argmax(axis=1), n - 1)
            called = np.array(names, object)
            yield arrow_batch(result, batch["doc_id"], batch["k"], batch["t"], called[lang], np.where(told, fused.max(axis=1), 0.0), called[by_text], grams, lang == n - 1)

    joined = join_once(scored.drop("domain"), hosts, ["host"], how="left")
    return joined.mapInArrow(fuse, "doc_id long, k long, t long, lang string, confidence double, text_lang string, n_grams long, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, confidence, text_lang, n_grams, rejected) of every document, the source as host; see `identify` for nulls, empty texts, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs), host=F.col("source"))
    return found.select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "n_grams", "rejected")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages: text without markup, `lang` of the html element, host of the url; the text model is fitted on documents."""
    html = F.col("html")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", text.alias("text"), F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1).alias("declared"), F.lower(F.regexp_extract("url", "(?s)^.*?://([^/?#]*)", 1)).alias("host")
    )
    found = identify(pages, fit(table(spark, sf_dir, "documents")), id_col="page_id", host=F.nullif(F.col("host"), F.lit("")), declared=F.col("declared"))
    return found.select(F.col("doc_id").alias("page_id"), "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "n_grams", "rejected")
