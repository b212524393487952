"""Line dedup: range-partitioned line hashes, sorted by document and place, streamed to keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import arrow_batch, free_names, join_once, keyed, row_keys, slices, table, written

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
#: Rows of one key that a task holds back before it hands the key on to the count over all partitions.
HELD_ROWS = 20_000

_LINES = "h1 long, h2 long, k long, t long, n_lines int, places array<int>"
_FOUND = "h1 long, h2 long, k long, t long, n_lines int, places array<int>, is_open boolean"
_LINES_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("n_lines", pa.int32()), ("places", pa.list_(pa.int32()))])


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document and line key of at least `min_chars` code points: 128-bit hash and places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[] for _ in range(6)]
                for text, k, t in zip(part["text"].to_pylist(), part["k"].to_pylist(), part["t"].to_pylist(), strict=True):
                    lines, at = text.split("\n"), {}
                    for place, line in enumerate(lines):
                        if len(line) >= min_chars and len(line := line.strip(SPACE)) >= min_chars:
                            at.setdefault(line.encode("utf-8", "replace").lower(), []).append(place)
                    for key, places in at.items():
                        digest = hashlib.blake2b(key, digest_size=16).digest()
                        for column, value in zip(out, (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), k, t, len(lines), places), strict=True):
                            column.append(value)
                yield arrow_batch(_LINES_ARROW, *out)

    return docs.select("text", "k", "t").mapInArrow(scan, _LINES)


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, then largest document first: those that lose their lines.

    A key at a partition's edge may go on in the next one; its rows go out as open, to be judged by counts over all partitions.
    """
    schema = pa.schema([*_LINES_ARROW, ("is_open", pa.bool_())])
    held: list[pa.RecordBatch] = []
    key, edge, flowing = None, True, False

    def rows(parts: list[pa.RecordBatch], is_open: bool) -> pa.RecordBatch:
        joined = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*joined.columns, pa.array(np.full(joined.num_rows, is_open))], schema=schema)

    def judged(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        """Whole runs of keys within this partition."""
        joined = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        h1, h2, k = (joined[c].to_numpy() for c in ("h1", "h2", "k"))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        other = new.copy()
        other[1:] |= k[1:] != k[:-1]
        run = np.cumsum(new) - 1
        docs = np.bincount(run, weights=other)
        lost = (docs[run] >= min_docs) & (k != k[new][run])
        return rows([joined.filter(pa.array(lost))], False) if lost.any() else None

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = batch["h1"].to_numpy(), batch["h2"].to_numpy()
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if key is not None:
            new[0] = (h1[0], h2[0]) != key
        heads = np.flatnonzero(new)
        if not len(heads):
            held.append(batch)
        else:
            if heads[0]:
                held.append(batch.slice(0, heads[0]))
            if held or flowing:
                if edge or flowing:
                    if held:
                        yield rows(held, True)
                elif (out := judged(held)) is not None:
                    yield out
                held, edge = [], False
            elif key is not None:
                edge = False
            if edge and len(heads) > 1:  # the partition's first key ends within this batch
                yield rows([batch.slice(0, heads[1])], True)
                edge = False
                if len(heads) > 2 and (out := judged([batch.slice(heads[1], heads[-1] - heads[1])])) is not None:
                    yield out
            elif not edge and heads[-1] > heads[0] and (out := judged([batch.slice(heads[0], heads[-1] - heads[0])])) is not None:
                yield out
            held, flowing = [batch.slice(heads[-1])], False
        key = (h1[-1], h2[-1])
        if edge or flowing or sum(x.num_rows for x in held) > HELD_ROWS:
            if held:
                yield rows(held, True)
            held, flowing = [], True
    if held:
        yield rows(held, True)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k, t, n_lines, n_dropped, keep) for each document that loses lines; the others keep all.

    keep is a zlib-compressed bitmap, one bit for each line in order, 1 to keep. A line's key is the line without
    white space at its ends, A-Z lower-cased. Keys of at least `min_chars` code points in at least `min_docs` documents
    keep their lines only in the document with the largest id (null is the smallest). Rows that share an id are one
    document for counting. Null and empty texts are one empty line and lose nothing.
    """
    lines = written(line_keys(keyed(docs, id_col, text_col), min_chars))
    order = [F.col("h1"), F.col("h2"), F.col("k").desc(), F.col("t")]
    found = written(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _stream(b, min_docs), _FOUND))
    loose = found.where("is_open")
    totals = loose.select("h1", "h2", "k").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("k").alias("last")).where(F.col("n") >= min_docs)
    lost = found.where("NOT is_open").select("k", "t", "n_lines", "places").unionAll(
        join_once(loose, written(totals), ["h1", "h2"]).where("k <> last").select("k", "t", "n_lines", "places")
    )
    marks = lost.groupBy("k", "t").agg(F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, places in zip(batch["n_lines"].to_pylist(), batch["places"].to_pylist(), strict=True):
                bits = np.ones(n, dtype=np.uint8)
                bits[places] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch["k"], batch["t"], batch["n_lines"], pc.list_value_length(batch["places"]), pa.array(keep, pa.binary())], names=["k", "t", "n_lines", "n_dropped", "keep"])

    return marks.mapInArrow(pack, "k long, t long, n_lines int, n_dropped int, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines, the number of lines before, and of those dropped."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    stay = [line for line, bit in zip(lines, bits, strict=True) if bit]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with the lines dropped from its text; other columns stay, whatever their names."""
    names = free_names(docs, "k", "t", "keep")
    maps = bitmaps.select(*[F.col(c).alias(n) for c, n in zip(("k", "t", "keep"), names, strict=True)]).hint("shuffle_hash")
    joined = docs.withColumns(dict(zip(names[:2], row_keys(id_col, text_col), strict=True))).join(maps, names[:2], "left")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if m is None else kept_lines(x or "", m)[0] for x, m in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.select(*docs.columns, names[2]).mapInArrow(cut, docs.schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document; see `keep_bitmaps` for nulls, empty texts and rows that share an id. Repeated rows stay, an empty table gives an empty one."""
    docs = keyed(table(spark, sf_dir, "documents"))
    joined = docs.join(keep_bitmaps(docs).select("k", "t", "keep").hint("shuffle_hash"), ["k", "t"], "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_lines(x, m) for x, m in zip(batch["text"].to_pylist(), batch["keep"].to_pylist(), strict=True)]
            yield arrow_batch(schema, batch["doc_id"], [n for _, n, _ in done], [d for _, _, d in done], [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x, _, _ in done])

    return joined.select("doc_id", "text", "keep").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP4_SQL = r"""
WITH lines AS (
  SELECT rowid_ AS r, doc_id, line, place,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT rowid_, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place
    FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
  )
), keys AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, coalesce(l.doc_id <> k.last, false) AS lost FROM lines l LEFT JOIN keys k ON l.key = k.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r
"""
