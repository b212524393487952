"""Embedding near-dedup: random projections decoded to E8 lattice points, neighbouring cells probed, cosine verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.graph import connected_components
from offerlens.llm.frames import arrow_batch, join_once, table, written

COSINE = 0.9
#: Lattice tables, cells of each that a vector enters (its own and the nearest others), and length of a projection at distance 1.
TABLES, CELLS, SCALE = 10, 4, 3.0
#: Rows of a block of a crowded cell; blocks are compared two by two, so many rows of one at a time.
BLOCK, BLOCK_STEP = 4096, 512

#: Rows of a cell up to which its pairs are taken together with those of other cells.
_FEW = 32
_VECTORS = pa.schema([("size", pa.int32()), ("node", pa.binary()), ("copies", pa.int64()), ("cells", pa.list_(pa.int64())), ("vector", pa.binary())])


def _half(x: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nearest point of D8 (or of its half-integer coset), and the rounding errors."""
    y = x - 0.5 if odd else x
    p = np.rint(y)
    e = y - p
    worst = np.abs(e).argmax(axis=1)
    rows = np.flatnonzero(p.sum(axis=1) % 2 != 0)
    step = np.where(e[rows, worst[rows]] >= 0, 1.0, -1.0)
    p[rows, worst[rows]] += step
    return p + 0.5 if odd else p, y - p


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight coordinates, doubled so that it is of integers."""
    whole, e = _half(x, False)
    half, f = _half(x, True)
    nearer = (f * f).sum(axis=1) < (e * e).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    pairs = [a * np.eye(8)[i] + b * np.eye(8)[j] for i in range(8) for j in range(i) for a in (2, -2) for b in (2, -2)]
    signs = np.array(np.meshgrid(*[[1, -1]] * 8)).reshape(8, -1).T
    return np.vstack([np.array(pairs), signs[signs.prod(axis=1) == 1]]).astype(np.int64)


ROOTS = _roots()


def lattice_cells(unit: np.ndarray, tables: int, cells: int, scale: float, seed: int = 7) -> np.ndarray:
    """(rows, tables * cells) hashes of the lattice points next to each row's projection, the table's number among them."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(unit), tables * cells), np.int64)
    odd = rng.integers(1 << 62, size=8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for i in range(tables):
        plane = rng.standard_normal((unit.shape[1], 8)) * (scale / np.sqrt(8))
        x = unit @ plane + rng.random(8)
        home = e8_nearest(x)
        away = x * 2 - home
        # the cells next to it in order of distance: |away - root|^2 grows as -2 away.root, all roots being of one length
        near = np.argsort(-(away @ ROOTS.T), axis=1, kind="stable")[:, : cells - 1]
        points = np.concatenate([home[:, None], home[:, None] + ROOTS[near]], axis=1)
        h = (points.astype(np.uint64) * odd).sum(axis=2, dtype=np.uint64) + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, i * cells : (i + 1) * cells] = (h ^ (h >> np.uint64(32))).view(np.int64)
    return out


def _units(column: pa.Array) -> tuple[np.ndarray, list]:
    """Which rows can link at all, and their vectors in double precision, of length 1."""
    ok, units = np.zeros(len(column), bool), []
    for i, value in enumerate(column):
        if not value.is_valid or value.values is None or value.values.null_count:
            continue
        x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(x).max() if len(x) else 0.0
            if top > 0 and np.isfinite(top):
                x = x / top  # no overflow in the norm
                ok[i] = True
                units.append(x / np.sqrt(x @ x))
    return ok, units


def _node(vector: str) -> Column:
    """128 bits that stand for a vector, equal ones having equal ones: two hashes with seeds of their own."""
    part = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.unhex(F.concat(part(F.col(vector)), part(F.lit(7), F.col(vector))))


def near_links(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, cells: int = CELLS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(node, n_links) and links (a, b) that connect all that are linked; node stands for the vector, so equal ones are one.

    A pair is found if both vectors enter one cell of a table, and linked if its cosine, in double precision, is at least `cosine`. A pair in
    several cells counts in the least of them. A crowded cell is cut into blocks, and each two blocks are a piece of work
    of their own; links come back as counts for each vector and a spanning forest, not as pairs.
    """
    wide = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                ok, units = _units(part["vector"])
                nodes, copies = np.array(part["node"].to_pylist(), object)[ok], part["copies"].to_numpy()[ok]
                raw = [x.values.to_numpy(zero_copy_only=False).astype(wide).tobytes() for x, good in zip(part["vector"], ok, strict=True) if good]
                for size in {len(x) for x in units}:
                    own = [i for i, x in enumerate(units) if len(x) == size]
                    cell = lattice_cells(np.array([units[i] for i in own]), tables, cells, scale)
                    yield arrow_batch(_VECTORS, np.full(len(own), size), nodes[own], copies[own], list(cell), [raw[i] for i in own])

    distinct = vectors.select(_node(vector_col).alias("node"), F.col(vector_col).alias("vector")).groupBy("node").agg(F.count("*").alias("copies"), F.first("vector").alias("vector"))
    units = written(distinct.mapInArrow(scan, "size int, node binary, copies long, cells array<long>, vector binary"))
    entries = units.select("size", "node", F.explode(F.array_distinct("cells")).alias("cell"))
    crowds = written(entries.groupBy("size", "cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    placed = join_once(entries, crowds, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # every block meets every other once: block x goes to (x, y) for y >= x and to (y, x) for y < x
    dealt = placed.select("size", "cell", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "size", "cell", "node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block"
    )
    work = dealt.join(units.drop("size"), "node").select("size", "cell", "low", "high", "block", "node", "copies", "cells", "vector")
    keys = ["size", "cell", "low", "high"]
    found = written(work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _compare(b, cosine, wide, tables), "node binary, n_links long, other binary"))
    return found.where("other IS NULL").groupBy("node").agg(F.sum("n_links").alias("n_links")), found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))


def _pairs(unit: np.ndarray, heads: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the linked pairs of each piece (rows from one head to the next)."""
    sizes = np.diff(heads)
    few = np.repeat((sizes <= _FEW) & (low[heads[:-1]] == high[heads[:-1]]), sizes)
    left = np.repeat(heads[1:], sizes) - np.arange(heads[-1])  # rows of the piece from here on
    for step in range(1, _FEW):
        x = np.flatnonzero(few & (left > step))
        if not len(x):
            break
        x = x[np.einsum("ij,ij->i", unit[x], unit[x + step]) >= cosine]
        yield x, x + step
    for p in np.flatnonzero(~few[heads[:-1]] & (sizes > 1)):
        rows = np.arange(heads[p], heads[p + 1])
        own, others = rows[block[rows] == low[rows[0]]], rows[block[rows] == high[rows[0]]]
        for i in range(0, len(own), BLOCK_STEP):
            x, y = np.nonzero(unit[own[i : i + BLOCK_STEP]] @ unit[others].T >= cosine)
            x, y = own[i + x], others[y]
            if low[rows[0]] == high[rows[0]]:
                x, y = x[x < y], y[x < y]
            yield x, y


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, wide: type, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and pair of blocks: counts of links, and the links that connect."""
    schema = pa.schema([("node", pa.binary()), ("n_links", pa.int64()), ("other", pa.binary())])

    def pieces(rows: pa.RecordBatch, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        if n < 2:
            return
        node = np.array(rows["node"].to_pylist(), object)
        block, low, high, cell, copies = (rows[c].to_numpy() for c in ("block", "low", "high", "cell", "copies"))
        unit = np.frombuffer(b"".join(rows["vector"].to_pylist()), wide).reshape(n, -1).astype(np.float64)
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        cells = rows["cells"].flatten().to_numpy().reshape(n, tables, -1)
        links, root, ex, ey = np.zeros(n, np.int64), np.arange(n), [], []
        for x, y in _pairs(unit, heads, block, low, high, cosine):
            for i in range(0, len(x), 16_384):  # a pair belongs to the least cell that both are in
                a, b = x[i : i + 16_384], y[i : i + 16_384]
                shared = (cells[a][:, :, :, None] == cells[b][:, :, None, :]).any(axis=3)
                keep = np.where(shared, cells[a], np.iinfo(np.int64).max).min(axis=(1, 2)) == cell[a]
                np.add.at(links, a[keep], copies[b[keep]])
                np.add.at(links, b[keep], copies[a[keep]])
            while len(x):
                rx, ry = root[x], root[y]
                apart = rx != ry
                x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
                if not len(x):
                    break
                top, at = np.unique(np.maximum(rx, ry), return_index=True)
                ex.append(node[x[at]])
                ey.append(node[y[at]])
                root[top] = np.minimum(rx, ry)[at]
                while not np.array_equal(up := root[root], root):
                    root = up
        at = np.flatnonzero(links)
        none = [None] * len(at)
        yield arrow_batch(schema, node[at], links[at], none)
        if ex:
            yield arrow_batch(schema, np.concatenate(ex), [None] * sum(map(len, ex)), np.concatenate(ey))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in ("size", "cell", "low", "high"):
            x = rows[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        heads = np.flatnonzero(new)
        # vectors of different lengths are not in one array
        sizes = rows["size"].to_numpy()
        cut = np.unique(np.concatenate([[0, heads[-1]], heads[np.flatnonzero(np.diff(sizes[heads])) + 1]]))
        for i, j in zip(cut, cut[1:], strict=False):
            yield from pieces(rows.slice(i, j - i), np.append(heads[(heads >= i) & (heads < j)], j) - i)
        held = [rows.slice(heads[-1])]
    if held:
        yield from pieces(held[0], np.array([0, held[0].num_rows]))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, **parameters) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of `vectors`.

    n_links counts the other vectors linked directly, copies included; component_id is the smallest id reachable by links, the own one included;
    kept rows are those whose id it is (null ids are kept where a component has no other). Null and zero vectors and those with null or non-finite components link with
    nothing, not even with their copies. Vectors of different lengths do not link. Rows of one id are rows of their own.
    Equal vectors are one node, told by 128 bits. An empty table gives an empty one; other columns are not read, whatever their names.
    """
    rows = vectors.select(F.col(id_col).alias("id"), _node(vector_col).alias("node"), F.col(vector_col).alias("vector"))
    bad = F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    rows = rows.select("id", "node", F.coalesce(bad, F.lit(True)).alias("bad"))
    good = rows.where("NOT bad")
    counts, links = near_links(vectors, cosine, id_col=id_col, vector_col=vector_col, **parameters)
    links = written(links)
    copies = good.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("low"))
    parts = connected_components(links)
    of = written(copies.join(parts, "node", "left").select("node", "copies", "low", F.coalesce("component", "node").alias("component")))
    lowest = of.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    info = join_once(of, lowest, ["component"]).join(counts, "node", "left")
    info = written(info.select("node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"))
    linked = join_once(good, info, ["node"], n="copies").select("id", "n_links", "component_id")
    alone = rows.where("bad").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embedding_groups` of every vector; see there for odd vectors, repeated rows, null ids and empty tables."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))
