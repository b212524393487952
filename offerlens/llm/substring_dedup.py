"""Substring dedup: windows of words as edges of a De Bruijn graph, compacted to paths whose words are compared at both coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlens.llm.frames import arrow_batch, discard, join_once, keyed, slices, table, written
from offerlens.llm.words import SPACED, find_words, grams, minima

WINDOW = 20
#: Words of the small grams of which each window's least one stands for it.
GRAM = 6

_SCAN = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("n_words", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("grams", pa.list_(pa.int64())), ("twice", pa.list_(pa.int64()))])
_RUNS = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("place", pa.int32()), ("nodes", pa.list_(pa.int64()))])
_DIGESTS = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())])
_PATHS = "array<struct<start:int,end:int,source:long,source_t:long,source_start:int>>"


def _scan(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For each document of at least one window: a hash of all words, and the small grams that stand for its windows."""
    for batch in batches:
        for part in slices(batch):
            words = find_words(part["text"], SPACED, lower=False)
            counts = words.counts()
            hashes, at = grams(words.hash, words.row, GRAM)
            _, best = minima(hashes, words.row[at], window - GRAM + 1) if len(at) else (at, at)
            chosen = np.unique(best)
            first = np.searchsorted(words.row[at[chosen]], np.arange(part.num_rows + 1))
            k, t, texts = part["k"].to_pylist(), part["t"].to_pylist(), part["text"].to_pylist()
            out: list[list] = [[] for _ in _SCAN]
            for r in np.flatnonzero(counts >= window):
                whole = xxhash.xxh3_128_digest(b" ".join(texts[r].encode("utf-8", "replace").split()))
                own, times = np.unique(hashes[chosen[first[r] : first[r + 1]]].view(np.int64), return_counts=True)
                for column, value in zip(out, (k[r], t[r], counts[r], int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True), own, own[times > 1]), strict=True):
                    column.append(value)
            yield arrow_batch(_SCAN, *out)


def _runs(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The windows that may be repeated, those whose small gram is, as runs of them: the nodes from the first edge's first to the last one's last."""
    mask = np.uint64((1 << bits) - 1)
    for batch in batches:
        for part in slices(batch):
            words = find_words(part["text"], SPACED, lower=False)
            hashes, at = grams(words.hash, words.row, GRAM)
            node = np.zeros(len(words.hash), np.uint64)
            value, first = grams(words.hash, words.row, window - 1, seed=1)
            node[first] = value & mask
            starts = np.flatnonzero(words.row[: max(0, len(node) - window + 1)] == words.row[window - 1 :])
            if not len(starts):
                continue
            begin, best = minima(hashes, words.row[at], window - GRAM + 1)
            least = np.zeros(len(words.hash), np.int64)
            least[at[begin]] = hashes[best].view(np.int64)
            row, least = words.row[starts], least[starts]
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            repeated = part["grams"]
            maybe = np.zeros(len(starts), bool)
            for r in range(part.num_rows):
                maybe[bounds[r] : bounds[r + 1]] = np.isin(least[bounds[r] : bounds[r + 1]], repeated[r].values.to_numpy(zero_copy_only=False))
            row, starts, k, t = row[maybe], starts[maybe], part["k"].to_numpy(), part["t"].to_numpy()
            heads = np.flatnonzero(np.diff(starts, prepend=-2) != 1) if len(starts) else starts
            heads = np.union1d(heads, np.flatnonzero(np.diff(row, prepend=-1)))
            sizes = np.diff(np.append(heads, len(starts))) + 1  # nodes of each run: one more than it has edges
            ends = np.cumsum(sizes)
            index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[heads] - (ends - sizes), sizes)
            nodes = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(node[index].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(k[row[heads]]), pa.array(t[row[heads]]), pa.array((starts - words.first[row])[heads].astype(np.int32)), nodes], schema=_RUNS)


def _edges(runs: DataFrame) -> DataFrame:
    """(a, b, k, t, place) of each edge of the runs."""
    each = runs.select("k", "t", "place", "nodes", F.posexplode("nodes").alias("i", "a"))
    return each.select("a", F.get("nodes", F.col("i") + 1).alias("b"), "k", "t", (F.col("place") + F.col("i")).alias("place")).where("b IS NOT NULL")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit digest of the words of each span asked for."""
    for batch in batches:
        for part in slices(batch):
            out: list[list] = [[] for _ in _DIGESTS]
            for k, t, text, spans in zip(part["k"].to_pylist(), part["t"].to_pylist(), part["text"].to_pylist(), part["spans"], strict=True):
                words = text.encode("utf-8", "replace").split()
                for start, end in zip(*(spans.values.field(i).to_pylist() for i in (0, 1)), strict=True):
                    for column, value in zip(out, (k, t, start, end, xxhash.xxh3_128_digest(b" ".join(words[start:end]))), strict=True):
                        column.append(value)
            yield arrow_batch(_DIGESTS, *out)


def _digests(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(k, t, start, end, digest) of the words of each of `spans` (k, t, start, end)."""
    asked = spans.groupBy("k", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    texts = rows.select("k", "t", "text").join(asked.hint("shuffle_hash"), ["k", "t"]).dropDuplicates(["k", "t"])
    return texts.mapInArrow(_digest, "k long, t long, start int, end int, digest binary")


def _paths(edges: DataFrame) -> DataFrame:
    """(a, b, source, source_t, at, head, n) for each edge that stands n > 1 times: its first place, and where its path begins in that source.

    An edge goes on with the path of the one before it if their node has no other edge in or out, among the repeated ones, and their first
    places follow each other: each edge joins with its successor at the node, and paths are then the runs of the source's places.
    """
    first = edges.groupBy("a", "b").agg(F.min(F.struct("k", "place", "t")).alias("x"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("a", "b", F.col("x.k").alias("source"), F.col("x.t").alias("source_t"), F.col("x.place").alias("at"), "n"))
    place = F.struct("source", "source_t", "at")
    into = first.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n_in"), F.min(place).alias("x")).where("n_in = 1")
    out = first.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_out"), F.min("b").alias("b"), F.min(place).alias("y")).where("n_out = 1")
    next_ = into.join(out, "node").where("x.source = y.source AND x.source_t = y.source_t AND x.at + 1 = y.at").select(F.col("node").alias("a"), "b", F.lit(True).alias("goes_on"))
    run = W.partitionBy("source", "source_t").orderBy("at")
    head = F.last(F.when(F.col("goes_on").isNull(), F.col("at")), ignorenulls=True).over(run)
    paths = written(first.join(next_, ["a", "b"], "left").withColumn("head", head).drop("goes_on"))
    discard(first)
    return paths


def _spans(later: DataFrame, window: int) -> DataFrame:
    """Runs of edges of one path that follow each other in a document as in the source, as spans of words."""
    run = ["k", "t", "source", "source_t", "head", "diagonal"]
    edges = later.withColumn("diagonal", F.col("place") - F.col("at"))
    island = F.col("place") - F.row_number().over(W.partitionBy(*run).orderBy("place"))
    return edges.withColumn("island", island).groupBy(*run, "island").agg(F.min("place").alias("start"), (F.max("place") + window).alias("end"), F.min("at").alias("source_start")).select(
        "k", "t", "start", "end", "source", "source_t", "source_start"
    )


def _earlier() -> Column:
    return (F.col("k") > F.col("source")) | (F.col("k") == F.col("source")) & (F.col("place") > F.col("at"))


def _compared(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """`spans` with same: whether the words at the document's and at the source's coordinates are equal."""
    source = [F.col("source").alias("k"), F.col("source_t").alias("t"), F.col("source_start").alias("start"), (F.col("source_start") + F.col("end") - F.col("start")).alias("end")]
    own = spans.select("k", "t", "start", "end")
    digests = written(_digests(rows, own.unionAll(spans.select(*source).distinct())))
    asked = spans.select(*source).groupBy("k", "t", "start", "end").agg(F.count("*").alias("n")).join(digests, ["k", "t", "start", "end"])
    names = {"k": "source", "t": "source_t", "start": "source_start", "end": "source_end", "digest": "there"}
    found = spans.join(digests, ["k", "t", "start", "end"]).withColumn("source_end", F.col("source_start") + F.col("end") - F.col("start"))
    out = join_once(found, asked.withColumnsRenamed(names), ["source", "source_t", "source_start", "source_end"])
    compared = written(out.select(*own.columns, "source", "source_t", "source_start", (F.col("digest") == F.col("there")).alias("same")))
    discard(digests)
    return compared


def _by_words(rows: DataFrame, edges: DataFrame, wrong: DataFrame, window: int) -> DataFrame:
    """Spans, one for each window, for the windows of `wrong` spans: those windows met others of the same hash, and are now told apart by their words."""
    met = edges.join(wrong.select("k", "t", "start", "end"), ["k", "t"]).where(F.col("place").between(F.col("start"), F.col("end") - window)).select("a", "b").distinct()
    places = edges.join(met, ["a", "b"], "left_semi").select("k", "t", F.col("place").alias("start"), (F.col("place") + window).alias("end")).distinct()
    found = written(_digests(rows, places).withColumnRenamed("start", "place"))
    first = found.groupBy("digest").agg(F.min(F.struct("k", "place", "t")).alias("x"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", F.col("x.k").alias("source"), F.col("x.t").alias("source_t"), F.col("x.place").alias("at"), "n")
    later = join_once(found, first, ["digest"]).where(_earlier())
    return later.select("k", "t", F.col("place").alias("start"), "end", "source", "source_t", F.col("at").alias("source_start"))


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bits: int = 64) -> DataFrame:
    """(k, t, paths) for each document with words that stand earlier too, k and t as `keyed` makes them.

    A path is a run of words all of whose windows of `window` words start earlier in one source: the same words in a document
    of smaller id (null is the smallest) or at an earlier place of the same one. Whole copies, told by a 128-bit digest of all words, are one
    path at once. For the rest, windows are edges of a De Bruijn graph, from the node of their first `window` - 1 words to that of
    their last; only those whose least small gram occurs twice are looked at, which each repeated window has. Each edge joins with its
    successor where their node does not branch, and what follows each other in the source compacts to one path; runs of
    a path in a document are spans. Nodes are hashes of `bits` bits (fewer are for tests only), so each span's words are compared at both
    coordinates, by 128-bit digests; the windows of spans that differ are told apart by digests of their own. Rows of one id are not
    earlier than each other but by place; repeated rows get the same paths each, once here. Null, empty and short texts have no paths, an
    empty table gives none. A document's own grams and spans are held in one row, so they are bounded by its text.
    """
    rows = keyed(docs, id_col, text_col)
    scanned = written(rows.mapInArrow(lambda b: _scan(b, window), "k long, t long, n_words long, c1 long, c2 long, grams array<long>, twice array<long>"))
    heads = scanned.groupBy("c1", "c2").agg(F.min("k").alias("head"), F.count("*").alias("n"))
    own = F.col("k") == F.col("head")
    marked = written(join_once(scanned, heads, ["c1", "c2"]).select("k", "t", "n_words", "head", F.when(own, F.col("grams")).alias("grams"), F.when(own, F.col("twice")).alias("twice")))
    discard(scanned)
    one = F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"), F.col("head").alias("source"), F.lit(None).cast("long").alias("source_t"), F.lit(0).alias("source_start"))
    copies = written(marked.where("k > head").select("k", "t", F.array(one).cast(_PATHS).alias("paths")).distinct())
    mins = marked.select("k", "t", F.explode("grams").alias("gram"))
    often = written(mins.select("gram").unionAll(marked.select(F.explode("twice"))).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    maybe = written(join_once(mins, often, ["gram"], how="left_semi").groupBy("k", "t").agg(F.collect_set("gram").alias("grams")))
    discard(marked, often)
    texts = rows.select("k", "t", "text").join(maybe.hint("shuffle_hash"), ["k", "t"])
    scan = texts.mapInArrow(lambda b: _runs(b, window, bits), "k long, t long, place int, nodes array<long>")
    runs = written(scan)
    paths = _paths(_edges(runs))
    spans = written(_spans(join_once(_edges(runs), paths, ["a", "b"]).where(_earlier()), window))
    discard(runs, paths)
    compared = _compared(rows, spans)
    discard(spans)
    good, wrong = compared.where("same").drop("same"), compared.where("NOT same")
    if wrong.take(1):
        good = good.unionByName(written(_by_words(rows, _edges(written(scan)), wrong, window)))
    parts = good.groupBy("k", "t").agg(F.collect_set(F.struct("start", "end", "source", "source_t", "source_start")).alias("paths"))
    return parts.select("k", "t", F.col("paths").cast(_PATHS)).unionByName(copies)


def without_paths(text: str, paths: list | None) -> tuple[int, int, str]:
    """Number of words, of those in paths, and the other words joined by one space."""
    words = text.encode("utf-8", "replace").split()
    if not paths:
        return len(words), 0, b" ".join(words).decode()
    keep = np.ones(len(words), bool)
    for path in paths:
        keep[path["start"] : path["end"]] = False
    stay = [words[i] for i in np.flatnonzero(keep)]
    return len(words), len(words) - len(stay), b" ".join(stay).decode()


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; null texts have no words, see `repeated_paths` for the rest."""
    docs = table(spark, sf_dir, "documents")
    paths = written(repeated_paths(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                done = [without_paths(x, p) for x, p in zip(part["text"].to_pylist(), part["paths"].to_pylist(), strict=True)]
                yield arrow_batch(schema, part["doc_id"], [n for n, _, _ in done], [m for _, m, _ in done], [hashlib.sha256(x.encode()).hexdigest() for _, _, x in done])

    joined = keyed(docs).join(paths.hint("shuffle_hash"), ["k", "t"], "left").select("doc_id", "text", "paths")
    return joined.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT r, doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') AS win
  FROM (SELECT r, doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20)
), s AS (
  SELECT r, i FROM (SELECT r, i, rank() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, i) AS place FROM w) WHERE place > 1
), gone AS (SELECT DISTINCT r, i + j AS i FROM (SELECT r, i, unnest(range(20)) AS j FROM s)),
words AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
