"""Benchmark decontamination: winnowed word-gram fingerprints of both sides, joined and extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import arrow_batch, join_once, keyed, slices, table, written
from offerlens.llm.words import ALNUM, Words, find_words, grams, winnow

WINDOW = 10
#: Bits of the filter of benchmark fingerprints for each of them, and the most bits it has, whatever the benchmark's size (16 MB).
FILTER_BITS_EACH, FILTER_BITS = 32, 1 << 27

_HITS = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("starts", pa.list_(pa.int32())), ("windows", pa.list_(pa.string()))])


def gram_size(size: int) -> int:
    """Words of a gram such that the smallest of `size - gram_size + 1` neighbours is shared by every two equal windows of `size` words."""
    return (size + 2) // 2


def _prints(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    k = gram_size(size)
    hashes, at = grams(words.hash, words.row, k, seed=size)
    return winnow(hashes, at, words.row, size - k + 1)


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, size, n_words, text, fp): each window of each item, and its item's fingerprints in rows of their own."""
    schema = pa.schema([("item", pa.string()), ("size", pa.int32()), ("text", pa.string()), ("fp", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = find_words(part["text"], ALNUM)
                names, out = part["item"].to_pylist(), ([], [], [], [])
                counts = words.counts()
                for size in range(1, window + 1):
                    hashes, at = _prints(words, size)
                    mine = counts[words.row[at]] >= window if size == window else counts[words.row[at]] == size
                    for h, r in zip(hashes[mine].view(np.int64).tolist(), words.row[at[mine]].tolist(), strict=True):
                        for column, value in zip(out, (names[r], size, None, h), strict=True):
                            column.append(value)
                for r, n in enumerate(counts.tolist()):
                    size = min(window, n)
                    for i in range(words.first[r], words.first[r + 1] - size + 1) if n else ():
                        for column, value in zip(out, (names[r], size, words.text(i, i + size).decode("utf-8", "replace"), None), strict=True):
                            column.append(value)
                yield arrow_batch(schema, *out)

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, "item string, size int, text string, fp long").distinct()


def _bit(fp, bits: int, turn: int):
    return F.shiftrightunsigned(fp, turn).bitwiseAND(F.lit(bits - 1))


def _filter(prints: DataFrame) -> np.ndarray:
    """A bit field of the fingerprints, packed by the executors in parts of 8 KB: at most FILTER_BITS bits, whatever their number."""
    n = prints.count()
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (n * FILTER_BITS_EACH).bit_length()))
    fp = F.col("fp")
    at = prints.select(F.explode(F.array(_bit(fp, bits, 0), _bit(fp, bits, 33))).alias("bit")).select(F.shiftright("bit", 16).cast("int").alias("part"), "bit")
    schema = pa.schema([("part", pa.int32()), ("set", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}  # 2,048 of 8 KB at most
        for batch in batches:
            part, bit = batch["part"].to_numpy(), batch["bit"].to_numpy() & 0xFFFF
            for x in np.unique(part):
                field = parts.setdefault(int(x), np.zeros(8192, np.uint8))
                own = bit[part == x]
                np.bitwise_or.at(field, own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield arrow_batch(schema, list(parts), [x.tobytes() for x in parts.values()])

    field = np.zeros(bits // 8, np.uint8)
    for i, value in at.repartition("part").mapInArrow(pack, "part int, set binary").collect():
        field[i * 8192 : (i + 1) * 8192] = np.frombuffer(value, np.uint8)
    return field.view(np.uint64)


def _passes(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = np.uint64(len(field) * 64 - 1)
    ok = np.ones(len(hashes), bool)
    for turn in (0, 33):
        bit = (hashes >> np.uint64(turn)) & low
        ok &= (field[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def shared_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents' words, and the windows that each shares with the benchmark.

    First table: (doc_id, k, t, n_words) for each row of `docs`. Second: (k, t, start, size, items), with the items that hold the window. Words are runs of letters
    and digits, A-Z lower-cased. A window is `window` consecutive words of an item, or a shorter item as a whole. Both sides
    keep the smallest gram hash of each run of neighbours, which every shared window has in common. Documents' fingerprints
    first pass a filter of fixed size, then join with the benchmark's; each that joins is extended to the windows around it,
    which join by their text; items with the same window join as one. Null and empty texts have no words; null item ids are no items' ids, but hits all the same.
    """
    spark = docs.sparkSession
    bench = written(benchmark_windows(items, item_id, item_text, window))
    prints = bench.where("fp IS NOT NULL").select("fp").distinct()
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect() if r[0])  # at most `window` of them
    field = spark.sparkContext.broadcast(_filter(prints))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = find_words(part["text"], ALNUM)
                ids, k, t, n = (x.tolist() for x in (np.arange(part.num_rows), part["k"].to_numpy(), part["t"].to_numpy(), words.counts()))
                out: list[list] = [k[:], t[:], part["doc_id"].to_pylist(), n[:], [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids)]
                for size in sizes:
                    hashes, at = _prints(words, size)
                    ok = _passes(field.value, hashes)
                    for h, i in zip(hashes[ok].view(np.int64).tolist(), at[ok].tolist(), strict=True):
                        r = words.row[i]
                        begin, end = words.first[r], words.first[r + 1]
                        starts = range(max(begin, i + gram_size(size) - size), min(i, end - size) + 1)
                        if len(starts):
                            texts = [words.text(s, s + size).decode("utf-8", "replace") for s in starts]
                            for column, value in zip(out, (k[r], t[r], None, None, h, size, [int(s - begin) for s in starts], texts), strict=True):
                                column.append(value)
                yield arrow_batch(_HITS, *out)

    scanned = written(
        keyed(docs, doc_id, doc_text).mapInArrow(scan, "k long, t long, doc_id long, n_words long, fp long, size int, starts array<int>, windows array<string>")
    )
    hits = scanned.where("fp IS NOT NULL").join(prints, "fp", "left_semi")
    around = hits.select("k", "t", "size", F.explode(F.arrays_zip("starts", "windows")).alias("x")).select("k", "t", "size", F.col("x.starts").alias("start"), F.col("x.windows").alias("text"))
    around = written(around.distinct())
    windows = bench.where("text IS NOT NULL").groupBy("size", "text").agg(F.sort_array(F.collect_set("item")).alias("items"))
    often = around.groupBy("size", "text").agg(F.count("*").alias("n")).join(windows, ["size", "text"])
    return scanned.where("fp IS NULL").select("doc_id", "k", "t", "n_words"), join_once(around, written(often), ["size", "text"]).select("k", "t", "start", "size", "items")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, **names: str) -> DataFrame:
    """(doc_id, k, t, n_words, n_hit, items) for each row: hit words and the sorted ids, as strings, of the items found in it.

    See `shared_windows` for nulls and empty texts. Repeated rows get the same result each, ids may be null or repeated, an empty table on either side is
    allowed, and columns but the named ones are not read.
    """
    words, found = shared_windows(docs, items, window, **names)
    found = written(found)
    spans = found.select("k", "t", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size")).distinct()
    covered = spans.groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans")).select(
        "k",
        "t",
        F.expr(
            "aggregate(spans, named_struct('n', 0L, 'end', 0L), (a, x) -> named_struct("
            "'n', a.n + greatest(0L, x.start + x.size - greatest(a.end, x.start)), 'end', greatest(a.end, x.start + x.size)), a -> a.n)"
        ).alias("n_hit"),
    )
    ids = found.groupBy("k", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    none = F.array().cast("array<string>")
    return words.join(covered.join(ids, ["k", "t"]), ["k", "t"], "left").select("doc_id", "k", "t", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document; see `contamination` for nulls, repeated rows and empty tables."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bs AS (SELECT item_id, ws, least(10, len(ws)) AS size FROM b WHERE len(ws) > 0),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i + 1 : i + size], ' ') AS win
  FROM (SELECT item_id, ws, size, unnest(range(len(ws) - size + 1)) AS i FROM bs)
), dw AS (
  SELECT r, i, size, array_to_string(ws[i + 1 : i + size], ' ') AS win
  FROM (SELECT r, ws, size, unnest(range(len(ws) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM bs) WHERE len(ws) >= size)
), m AS (SELECT r, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, unnest(range(size)) AS j FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
