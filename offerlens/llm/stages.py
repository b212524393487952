"""Stages of the corpus pipeline over `documents`. Each takes and returns whole documents, the last one digests of them.

All of them keep the columns of their input, whatever else these are called. Texts may be null, empty or very long; rows that share an id
and a text are decided on together, and where ids decide (lines, windows) rows that share an id are one document. An empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlens.llm import decontaminate, language_id, line_dedup, sentencepiece_bpe, simhash
from offerlens.llm.frames import free_names, row_keys, table, written


def _where_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` whose id and text are (left_semi) or are not (left_anti) among k and t of `keys`."""
    names = free_names(docs, "k", "t")
    k, t = row_keys()
    found = keys.select(F.col("k").alias(names[0]), F.col("t").alias(names[1]))
    return docs.withColumns({names[0]: k, names[1]: t}).join(found.hint("shuffle_hash"), names, how).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Those without letters (null and empty texts among them) or that no language explains go; null ids, labels and sources are allowed."""
    found = written(language_id.identify(docs, language_id.fit(docs), host=F.col("source")))
    return _where_key(docs, found.where("rejected").select("k", "t").distinct(), "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that later documents repeat; n_chars follows. No document goes: one that loses all its lines has an empty text. Null texts stay null."""
    cut = line_dedup.apply_bitmaps(docs, written(line_dedup.keep_bitmaps(docs)))
    return cut.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    It is the one of the smallest id (a null id only where all are null), then of the least text hash; of rows equal in both, the first by their other
    columns as JSON. Null, empty and blank texts are copies of each other.
    """
    _, groups = simhash.near_duplicates(docs, shingle=5, similarity=0.8)
    first = groups.select(F.col("first_k").alias("k"), F.col("first_t").alias("t")).distinct()
    number, k, t = free_names(docs, "n", "k", "t")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = _where_key(docs, first, "left_semi").withColumns(dict(zip((k, t), row_keys(), strict=True)))
    order = W.partitionBy(k, t).orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0))
    return kept.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, and no shorter item, with the benchmark. Null and empty texts share none and stay."""
    found = written(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))
    return _where_key(docs, found.where("n_hit > 0").select("k", "t").distinct(), "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): number and digest of each document's ids, and of the text that they decode to. Null and empty texts have no ids."""
    return sentencepiece_bpe.encode_digests(docs, sentencepiece_bpe.default_model())
