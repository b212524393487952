"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.skew import join_once  # noqa: F401
from offerlens.sources.storage import discard, written  # noqa: F401

#: Text that a Python task holds in numpy form at a time, in bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """What tells rows apart: the id (the smallest long for null), and a hash of the text (null counts as empty)."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names of columns that `df` does not have, in any case of letters."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """id, text, the columns in `more`, and the two columns that tell rows apart, k and t: see `row_keys`.

    Rows that share an id are told apart by their text; rows that share both get the same result each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k, t = row_keys(id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), k.alias("k"), t.alias("t"), *more)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does the same for texts of ASCII only and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for row, size in enumerate(sizes):
        if total + size > most and row > begin:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
