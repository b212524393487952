"""Hard-negative mining: exact inner-product search in length buckets with sorted coordinate lists, and negatives in a band below each positive's score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import arrow_batch, join_once, table, written

#: Positives of an anchor, negatives of each positive, and the band of a negative's score in percent of its positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Components are scaled by this and floored, so that scores are whole numbers.
SCALE = 256
#: Anchors of a tile and rows of a slice; a tile meets each slice in a piece of work of its own. With more than PIECES pieces slices get longer instead of more: rows of a slice are not held.
TILE, SLICE, PIECES = 1024, 8192, 8192
#: Rows of the first length bucket and of the largest, and coordinates of an anchor that its candidates are sought by.
FIRST_BUCKET, BUCKET, FOCUS = 256, 2048, 4
#: Product of the ranges' shares of a bucket up to which candidate sets are intersected and verified one by one; beyond it the ranges exclude too little, and the bucket is verified as a whole.
SPARSE = 0.125
#: Sums of products of doubles are exact below this.
_EXACT = 2.0**53


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(r, id, label, size, length, v) of the rows that take part, written once: r numbers them, v is the scaled and floored vector as whole numbers of 64 bits.

    Rows with a null id, label or vector, with a null or non-finite component, or so long (squared length of 2^63 or more) that scores could leave 64 bits take no part.
    """
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("length", pa.float64()), ("v", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, lengths, out = [], [], [], []
            for i, value in enumerate(batch["v"]):
                if value.values.null_count:
                    continue
                x = np.floor(value.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    length = float(np.sqrt(x @ x))
                if length < 2.0**31.5:
                    keep.append(i)
                    sizes.append(len(x))
                    lengths.append(length)
                    out.append(x.astype(np.int64).tobytes())
            at = pa.array(keep, pa.int64())
            labels = batch["label"].take(at)
            yield pa.RecordBatch.from_arrays([batch["id"].take(at), labels, *[pa.array(c, f.type) for c, f in zip((sizes, lengths, out), list(schema)[1:], strict=True)]], names=["id", "label", "size", "length", "v"])

    kind = vectors.schema[label_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return written(rows.mapInArrow(scan, f"id long, label {kind}, size int, length double, v binary").withColumn("r", F.monotonically_increasing_id()))


def feasible(focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value that coordinate f of a unit vector can have, if its cosine with a unit vector whose coordinate f is `focus` is at least `cosine`.

    Angles obey the triangle inequality: the vector is no further from axis f than the anchor's angle to it plus the angle between both, and no nearer than their difference.
    """
    a, t = np.arccos(np.clip(focus, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(a + t, np.pi)), np.cos(np.maximum(a - t, 0))


class _Bucket:
    """Rows of about one length, with a sorted list of the values of each coordinate that is asked for."""

    def __init__(self, rows: np.ndarray, length: np.ndarray):
        self.rows, self.longest = rows, float(length.max())
        self.unit = rows / np.where(length > 0, length, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sorted_by(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of coordinate f in order, the rows that have them, and each row's place."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.lists[f] = self.unit[order, f], order, place
        return self.lists[f]


class _Anchors:
    """Anchors of one piece, for each of them some bands of scores, and the best rows of each band so far."""

    def __init__(self, v: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray, top: int, focus: int):
        self.v, self.length, self.low, self.high, self.top = v, length, low.copy(), high, top
        self.unit = v / np.where(length > 0, length, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :focus]
        self.best: list[tuple[np.ndarray, ...]] = []  # anchor, band, score, id, r of rows that may be among the best

    def candidates(self, bucket: _Bucket) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Anchors whose bucket is to be verified as a whole, and (anchor, candidates) of others; the rest cannot reach their least score."""
        least = np.where(self.low <= self.high, self.low, np.inf).min(axis=1)
        reach = self.length * bucket.longest
        live = np.flatnonzero(least <= reach * (1 + 1e-9) + 1e-6)
        n = len(bucket.rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((reach > 0) & (least > 0), least / reach, -1.0) - 1e-9  # a least score of 0 or less asks nothing of lengths
        searched = live[cosine[live] > 0]
        if not len(searched) or not self.focus.shape[1]:
            return live, []
        begin, end = np.zeros((len(self.v), self.focus.shape[1]), np.int64), np.full((len(self.v), self.focus.shape[1]), n)
        for j in range(self.focus.shape[1]):
            for f in np.unique(self.focus[searched, j]):
                own = searched[self.focus[searched, j] == f]
                values = bucket.sorted_by(f)[0]
                least_value, most_value = feasible(self.unit[own, f], cosine[own])
                begin[own, j] = np.searchsorted(values, least_value - 1e-9, side="left")
                end[own, j] = np.searchsorted(values, most_value + 1e-9, side="right")
        width = end - begin
        narrow = width.argmin(axis=1)
        few = searched[np.prod(width[searched] / n, axis=1) <= SPARSE]
        picked = []
        for i in few:
            found = bucket.sorted_by(self.focus[i, narrow[i]])[1][begin[i, narrow[i]] : end[i, narrow[i]]]
            for j, f in enumerate(self.focus[i]):
                if j != narrow[i] and width[i, j] < n:
                    place = bucket.sorted_by(f)[2][found]
                    found = found[(place >= begin[i, j]) & (place < end[i, j])]
            if len(found):
                picked.append((int(i), found))
        return np.setdiff1d(live, few), picked

    def meet(self, rows: np.ndarray, length: np.ndarray, ids: np.ndarray, r: np.ndarray, allowed) -> None:
        """Take in a bucket of rows; `allowed(anchors, rows)` tells which pairs count at all."""
        bucket = _Bucket(rows, length)
        whole, picked = self.candidates(bucket)
        kind = np.float64 if self.length.max() * bucket.longest < _EXACT else np.int64
        a, b, s = [], [], []
        if len(whole):
            scores = self.v[whole].astype(kind) @ rows.astype(kind).T
            x, y = np.nonzero(scores >= np.where(self.low <= self.high, self.low, np.iinfo(np.int64).max).min(axis=1)[whole, None])
            a, b, s = [whole[x]], [y], [scores[x, y].astype(np.int64)]
        for i, found in picked:
            a.append(np.full(len(found), i))
            b.append(found)
            s.append((rows[found].astype(kind) @ self.v[i].astype(kind)).astype(np.int64))
        if not a:
            return
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        ok = allowed(a, b)
        a, b, s = a[ok], b[ok], s[ok]
        for band in range(self.low.shape[1]):
            at = np.flatnonzero((s >= self.low[a, band]) & (s <= self.high[a, band]))
            if len(at):
                self._keep(band, a[at], s[at], ids[b[at]], r[b[at]])

    def _keep(self, band: int, a: np.ndarray, s: np.ndarray, ids: np.ndarray, r: np.ndarray) -> None:
        """The best of what there was and the new; a full band's last score is the least that still counts."""
        if len(self.best) <= band:
            self.best += [tuple(np.zeros(0, np.int64) for _ in range(4))] * (band + 1 - len(self.best))
        a, s, ids, r = (np.concatenate(x) for x in zip(self.best[band], (a, s, ids, r), strict=True))
        order = np.lexsort((r, ids, -s, a))
        a, s, ids, r = a[order], s[order], ids[order], r[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < self.top
        self.best[band] = a[keep], s[keep], ids[keep], r[keep]
        full = rank == self.top - 1
        self.low[a[full], band] = np.maximum(self.low[a[full], band], s[full])


def _search(work: DataFrame, keys: list[str], top: int, bands: int, same_label: bool) -> DataFrame:
    """(r, band, score, found_id, found_r): of each anchor's bands in each piece the `top` rows of highest scores, then least ids.

    `work` has the pieces' anchors (with low and high, the ends of their bands) and rows. A piece's anchors come first, then its rows from the longest down; they are taken in buckets.
    """
    out = pa.schema([("r", pa.int64()), ("band", pa.int32()), ("score", pa.int64()), ("found_id", pa.int64()), ("found_r", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, info, held, wanted, n, most = None, None, None, [], [], 0, FIRST_BUCKET

        def begin() -> None:
            nonlocal anchors, info, wanted
            rows = pa.Table.from_batches(wanted)
            low, high = (np.array(rows[c].to_pylist(), np.int64).reshape(len(rows), bands) for c in ("low", "high"))
            v = _matrix(rows["v"])
            anchors, info, wanted = _Anchors(v, rows["length"].to_numpy(), low, high, top, FOCUS), (rows["r"].to_numpy(), np.array(rows["label"].to_pylist(), object)), []

        def meet() -> None:
            nonlocal held, n
            rows = pa.Table.from_batches(held)
            r, label = rows["r"].to_numpy(), np.array(rows["label"].to_pylist(), object)
            allowed = (lambda a, b: info[0][a] != r[b]) if same_label else (lambda a, b: info[1][a] != label[b])
            anchors.meet(_matrix(rows["v"]), rows["length"].to_numpy(), rows["id"].to_numpy(), r, allowed)
            held, n = [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            if wanted or anchors is None:
                return
            if held:
                meet()
            for band, (a, s, ids, r) in enumerate(anchors.best):
                yield arrow_batch(out, info[0][a], np.full(len(a), band, np.int32), s, ids, r)

        for batch in batches:
            if not batch.num_rows:
                continue
            other = lambda c: pc.not_equal(batch[c].slice(1), batch[c].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([other(c) for c in (*keys, "is_row")])]))
            for at, end in zip(heads, [*heads[1:], batch.num_rows], strict=True):
                now = tuple(batch[k][at].as_py() for k in keys)
                if now != key:
                    yield from finish()
                    key, anchors, held, wanted, n, most = now, None, [], [], 0, FIRST_BUCKET
                if not batch["is_row"][at].as_py():
                    wanted.append(batch.slice(at, end - at))
                    continue
                if wanted:
                    begin()
                while anchors is not None and at < end:
                    run = min(end - at, most - n)
                    held.append(batch.slice(at, run))
                    at, n = at + run, n + run
                    if n == most:
                        meet()
                        most = min(2 * most, BUCKET)
        yield from finish()

    order = [*keys, "is_row", F.desc("length"), "r"]
    return work.repartition(*keys).sortWithinPartitions(*order).mapInArrow(scan, "r long, band int, score long, found_id long, found_r long")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.int64).reshape(len(values), -1) if values and values[0] else np.zeros((len(values), 0), np.int64)


def _pieces(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and anchors (with low and high) of each group dealt to tiles and slices: a row goes to each tile's piece of its slice, an anchor to each slice's piece of its tile."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(anchors.groupBy(*keys).agg(F.count("*").alias("anchors")), keys)
    tiles = F.ceil(F.col("anchors") / TILE)
    slices = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / SLICE), F.ceil(PIECES / tiles)))
    sizes = written(sizes.select(*keys, "n", tiles.cast("int").alias("tiles"), slices.cast("int").alias("slices")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("r"), F.col(n)).cast("int")
    same = ["r", "id", *(["label"] if "label" not in keys else []), "length", "v"]
    a = join_once(anchors, sizes, keys).select(*keys, own("tiles").alias("tile"), every("slices").alias("slice"), F.lit(False).alias("is_row"), *same, "low", "high")
    none = F.lit(None).cast("array<long>")
    b = join_once(rows, sizes, keys).select(*keys, every("tiles").alias("tile"), own("slices").alias("slice"), F.lit(True).alias("is_row"), *same, none.alias("low"), none.alias("high"))
    return a.unionByName(b)


def _best(found: DataFrame, top: int) -> DataFrame:
    """(r, band, rank, score, found_id, found_r): the first `top` of each band over all pieces."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "found_id", "found_r")))
    lists = found.groupBy("r", "band").agg(F.slice(ordered, 1, top).alias("x"))
    return lists.select("r", "band", F.posexplode("x").alias("at", "x")).select("r", "band", (F.col("at") + 1).alias("rank"), (-F.col("x.s")).alias("score"), "x.found_id", "x.found_r")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for whose id (column `id`) `is_anchor` holds.

    Scores are inner products of the scaled and floored vectors, whole numbers; higher ones come first, then smaller ids. An anchor's positives are the first other rows
    of its label; the negatives of a positive are the first rows of other labels whose score is within `low` to `high` percent of the positive's, exactly. A positive
    without any gives no row, as does a negative score of a positive. Which rows take part: `whole_vectors`. Vectors of different lengths do not meet. Repeated rows are rows
    of their own, so a row is no positive of itself but of its copy. Empty tables give empty ones; other columns are not read, whatever their names.
    """
    rows = whole_vectors(vectors, id_col, label_col, vector_col, scale)
    all_of = lambda x: F.array(F.lit(x).cast("long"))
    anchors = rows.where(is_anchor)
    least, most = -(2**63) + 1, 2**63 - 1
    aimed = anchors.withColumns({"low": all_of(least), "high": all_of(most)})
    own = written(_best(_search(_pieces(rows, aimed, ["size", "label"]), ["size", "label", "tile", "slice"], positives, 1, True), positives))
    band = lambda share, up: (F.ceil if up else F.floor)(F.col("score").cast("decimal(38,0)") * share / 100).cast("long")
    # a band without a positive, or whose ends have changed places, holds nothing
    ends = own.select("r", "rank", F.when(F.col("score") >= 0, band(low, True)).otherwise(most).alias("low"), F.when(F.col("score") >= 0, band(high, False)).otherwise(least).alias("high"))
    at = lambda c: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.transform(F.filter("x", lambda y: y["rank"] == i), lambda y: y[c]), F.lit(0)), F.lit(most if c == "low" else least)))
    bands = ends.groupBy("r").agg(F.collect_list(F.struct("rank", "low", "high")).alias("x")).select("r", at("low").alias("low"), at("high").alias("high"))
    banded = anchors.join(bands, "r")
    found = _best(_search(_pieces(rows, banded, ["size"]), ["size", "tile", "slice"], negatives, positives, False), negatives)
    named = own.select("r", (F.col("rank") - 1).alias("band"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(named, ["r", "band"]).join(anchors.select("r", F.col("id").alias("anchor_id")), "r")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`hard_negatives` of every row whose id is divisible by 100, ids divisible by 7 having the next label; see there for odd vectors, ties, repeated rows and empty tables."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score) WHERE rank <= 5
"""
