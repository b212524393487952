"""Target-distribution importance resampling: hashed word n-grams of a corpus and of target texts give each document a weight, and noisy weights a sample."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import arrow_batch, free_names, keyed, row_keys, table, written
from offerlens.operators.order import numbered

#: Buckets that features are hashed to (the only table that the driver and each task hold), longest run of words that is a feature.
BUCKETS, NGRAM = 10_000, 2
#: Share of the documents drawn in percent, words that a document needs to be drawn, and what the noise is seeded with.
PERCENT, MIN_WORDS, SEED = 25, 20, 7
#: Bytes of a text that are taken apart at a time; a piece ends at a blank.
PIECE = 1 << 20

#: A-Z to a-z, other bytes of ASCII that are no digit or letter to a blank; bytes of longer characters stay.
BLANKS = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while len(text) - at > size:
        clean = text[at : at + size].translate(BLANKS)
        end = clean.rfind(b" ") + 1
        if not end:  # a word longer than a piece: on to its end
            size *= 2
            continue
        yield clean[:end].split()
        at += end
    yield text[at:].translate(BLANKS).split()


def buckets_of(text: bytes, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[Counter, int]:
    """How many features of a text are in each bucket, and its number of words.

    A feature is a run of 1 to `ngram` words joined by one space. The hash of a run goes on from the hash of the run without its last word.
    """
    found, n_words, tail = Counter(), 0, []
    for words in pieces(text):
        n_words += len(words)
        words, old = tail + words, len(tail)
        spaced = [b" " + w for w in words]
        ends = list(map(crc32, words))  # of the run that ends at word i + length - 1, by i
        found.update([x % buckets for x in ends[old:]])
        for length in range(2, ngram + 1):
            ends = list(map(crc32, spaced[length - 1 :], ends))
            found.update([x % buckets for x in ends[max(old - length + 1, 0) :]])
        tail = words[len(words) - ngram + 1 :] if ngram > 1 else []
    return found, n_words


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts. Each task counts its own texts, so a shuffle gets one row at most for a task and bucket. Null texts have no features."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text.is_valid:
                    total.update(buckets_of(text.as_py(), ngram, buckets)[0])
        yield arrow_batch(schema, list(total.keys()), list(total.values()))

    own = texts.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """For each bucket the logarithm, in thousandths and floored, of its smoothed share among the target's features over that among the corpus's."""
    s, t = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def _noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, by the id alone: from the first 32 bits of a digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, t, n_words, n_features, weight, score) of each document, written once; k and t are those of `frames.row_keys`.

    weight is the floored mean gain over the document's features, 0 without any; score is weight and noise. Both texts' bucket
    counts, `buckets` numbers each, are all that the driver gathers, whatever the size of the tables.
    """
    s, t = ({r["bucket"]: r["n"] for r in bucket_counts(x, text_col, ngram, buckets).collect()} for x in (docs, target))
    gain = gains(s, t, buckets)
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found, n_words = buckets_of(text.as_py(), ngram, buckets)
                n = found.total()
                rows.append((n_words, n, sum(gain[b] * c for b, c in found.items()) // n if n else 0))
            if rows:
                yield arrow_batch(schema, batch["doc_id"], batch["k"], batch["t"], *zip(*rows, strict=True))

    whole = keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    weighed = whole.mapInArrow(weigh, "doc_id long, k long, t long, n_words long, n_features long, weight long")
    return written(weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **parameters) -> DataFrame:
    """`importance` of each document and its rank in the sample, null where it was not drawn.

    Drawn are the `percent` hundredths, floored, of the documents of at least `min_words` words that have the highest scores; ties go to the
    smaller doc_id, null ids last, then by the text's hash. Drawing the highest of weight and Gumbel noise is sampling without replacement by exp(weight).
    Null and empty texts have no words and weigh 0; rows of one id have the same noise; repeated rows are drawn each; an empty table gives an empty one.
    """
    scored = importance(docs, target, **parameters)
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    places = numbered(scored, F.desc(able), F.desc("score"), F.asc_nulls_last("doc_id"), "t", name="rank")
    return places.withColumn("rank", F.when(able & (F.col("rank") <= n * percent // 100), F.col("rank")))


def drawn(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `resample` drew, with all their columns. Rows that share id and text are drawn together."""
    names = free_names(docs, "k", "t")
    keys = sample.where("rank IS NOT NULL").select(F.col("k").alias(names[0]), F.col("t").alias(names[1])).distinct()
    return docs.withColumns(dict(zip(names, row_keys(id_col, text_col), strict=True))).join(keys.hint("shuffle_hash"), names, "left_semi").select(*docs.columns)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`resample` of every document towards the texts of `benchmark`; see there for nulls, ties, repeated rows and empty tables."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The table of CRC-32 is made by its rule (the polynomial in its reflected form), then each distinct feature's bytes are folded over it.
OP13_SQL = r"""
WITH RECURSIVE step(i, n, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, n + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE n < 8),
crc AS (SELECT list(v ORDER BY i) AS x FROM step WHERE n = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, r, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS f FROM words),
known AS (SELECT side, r, f, count(*) AS n FROM runs GROUP BY ALL),
bucket AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, x[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM known), crc),
sums AS (SELECT b, sum(n) FILTER (WHERE side = 0) AS s, sum(n) FILTER (WHERE side = 1) AS t FROM known JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g FROM sums, (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums)),
weighed AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM known JOIN bucket USING (f) JOIN gain USING (b) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, r, len(w) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[:8])::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM words LEFT JOIN weighed USING (r) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id) AS n, (SELECT count(*) FROM scored WHERE able) AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND n <= most * 25 // 100 THEN n END AS rank FROM placed
"""
