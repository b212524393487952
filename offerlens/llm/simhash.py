"""SimHash near-dedup: exact comparison of fingerprints in tiles, by exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import arrow_batch, discard, join_once, keyed, slices, table, written
from offerlens.llm.words import SPACED, find_words, grams, mix
from offerlens.operators.graph import connected_components

#: Most rows of a strip, the unit that a task gets two of; rows of the tiles.
STRIP_ROWS = 32_768
TILE_ROWS = 512
#: Blocks that a set of shingles enters, smallest hashes that name one, and most rows and bytes of sets of a block's strip.
BLOCKS, BLOCK_HASHES, BLOCK_ROWS, BLOCK_BYTES = 8, 4, 8_192, 1 << 22
#: Texts of the sample that tells which shingles are common, and most shingles that it tells. Both only order the shingles; the links are the same with any.
SAMPLE_TEXTS, COMMON = 4_096, 1 << 16
#: Pairs that a task of `_meetings` collects before it returns them.
MEETING_ROWS = 1 << 16
#: Bits of a set's sketch: at least so many, and at least so many for each element.
SKETCH_BITS, ELEMENT_BITS = 512, 2
#: Bits that a sketch is folded to for `_meetings`, in 64-bit columns: what tells short sets apart before pairs become rows.
FOLDED = 2
_BLOCK = 1 << 12


def fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """SimHash of word shingles; see `fingerprints`."""
    words = text.encode("utf-8", "replace").lower().split()  # both act on ASCII only
    if not words:
        return 0
    joined, taken = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - taken + 1
    for i in range(0, n, _BLOCK):
        j = min(n, i + _BLOCK)
        spans = zip(starts[i:j].tolist(), ends[i + taken - 1 : j + taken - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)[:, None]
        votes += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, k, t, fp) for each row: the SimHash of all shingles of `shingle` words, repeats included.

    A-Z is lower-cased, words are runs without ASCII white space. A bit is 1 if it is set in over half of the
    shingles' XXH64. A text of fewer words is one shingle; null, empty and blank texts have all bits 0.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("fp", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield arrow_batch(schema, part["doc_id"], part["k"], part["t"], [fingerprint(x, shingle, seed) for x in part["text"].to_pylist()])

    return keyed(docs, id_col, text_col).mapInArrow(scan, "doc_id long, k long, t long, fp long")


def near_pairs(prints: DataFrame, radius: int = 4, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """Links (a, b) of the distinct fingerprints `fp` of `prints` such that those that differ by at most `radius` bits are connected, directly or by others.

    Every pair of strips whose population counts differ by at most `radius` is compared in full, tile by tile; a tile pair
    is skipped when the counts of its quarters alone differ by more. Each strip pair returns a spanning forest of its links, so
    a large group of near copies yields as many rows as it has members, not pairs. No link between components is lost.
    """
    spark = prints.sparkSession
    ones = written(prints.select(F.bit_count("fp").cast("int").alias("ones"), "fp").distinct())
    sizes = ones.groupBy("ones").agg(F.ceil(F.count("*") / strip_rows).cast("int").alias("parts"))  # 65 rows at most
    strips = written(
        ones.join(F.broadcast(sizes), "ones")
        .groupBy("ones", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("rows"))
    )
    names = strips.select("ones", "part")
    near = names.select(F.col("ones").alias("a_ones"), F.col("part").alias("a_part"), F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)).alias("b_ones"))
    cells = near.join(names.select(F.col("ones").alias("b_ones"), F.col("part").alias("b_part")), "b_ones").where("a_ones < b_ones OR a_part <= b_part")
    n_cells, rows = strips.groupBy("ones").agg(F.count("*").alias("parts"), F.sum(F.size("rows")).alias("n")).agg(F.coalesce(F.sum(F.col("parts") * F.col("parts")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, min(n_cells * (radius + 1), max(2 * spark.sparkContext.defaultParallelism, rows // 500), 8192))
    left = strips.select(F.col("ones").alias("a_ones"), F.col("part").alias("a_part"), F.col("rows").alias("a"))
    right = strips.select(F.col("ones").alias("b_ones"), F.col("part").alias("b_part"), F.col("rows").alias("b"))
    work = cells.join(left, ["a_ones", "a_part"]).join(right, ["b_ones", "b_part"]).repartition(tasks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = all(batch[f"a_{c}"][i] == batch[f"b_{c}"][i] for c in ("ones", "part"))
                bits = batch["a"][i].values.to_numpy()
                others = bits if same else batch["b"][i].values.to_numpy()
                x, y = linked(bits.view(np.uint64), None if same else others.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(bits[x]), pa.array(others[y])], names=["a", "b"])

    return work.select("a_ones", "a_part", "b_ones", "b_part", "a", "b").mapInArrow(compare, "a long, b long")


class _Tiled:
    """Fingerprints ordered by the population counts of their quarters; tiles with the least and greatest of each."""

    def __init__(self, bits: np.ndarray):
        quarters = np.bitwise_count(np.ascontiguousarray(bits).view(np.uint16).reshape(-1, 4)).astype(np.int16)
        self.order = np.lexsort(quarters.T)
        quarters, self.bits = quarters[self.order], bits[self.order]
        self.spans = [(i, min(len(bits), i + TILE_ROWS)) for i in range(0, len(bits), TILE_ROWS)]
        self.low = np.array([quarters[i:j].min(axis=0) for i, j in self.spans])
        self.high = np.array([quarters[i:j].max(axis=0) for i, j in self.spans])


def linked(bits: np.ndarray, others: np.ndarray | None, radius: int, test: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a spanning forest of the near pairs of two sets of fingerprints (uint64), or within one if `others` is None.

    With `test`, pairs within the radius are links only if it holds for their row numbers; it is asked only about pairs not connected yet.
    """
    if not len(bits) or (others is not None and not len(others)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = _Tiled(bits)
    b = a if others is None else _Tiled(others)
    shift = 0 if others is None else len(bits)
    root = np.arange(len(bits) + (0 if others is None else len(others)))
    out_x, out_y = [], []
    xors, counts = np.empty((TILE_ROWS, TILE_ROWS), np.uint64), np.empty((TILE_ROWS, TILE_ROWS), np.uint8)
    for m, (i, j) in enumerate(a.spans):
        gap = np.maximum(np.maximum(b.low - a.high[m], a.low[m] - b.high), 0).sum(axis=1)
        for n in np.flatnonzero(gap <= radius):
            if others is None and n < m:
                continue
            p, q = b.spans[n]
            xor, count = xors[: j - i, : q - p], counts[: j - i, : q - p]
            np.bitwise_xor(a.bits[i:j, None], b.bits[None, p:q], out=xor)
            np.bitwise_count(xor, out=count)
            hits = count <= radius
            if others is None and n == m:
                hits = np.triu(hits, 1)
            x, y = np.nonzero(hits) if hits.any() else ((), ())
            if not len(x):
                continue
            x, y = x + i, y + p
            while len(x):  # join roots, one edge for each that is hooked
                rx, ry = root[x], root[y + shift]
                apart = rx != ry
                x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
                if not len(x):
                    break
                _, at = np.unique(np.maximum(rx, ry), return_index=True)
                tried = at
                if test is not None:
                    at = at[[test(int(a.order[u]), int(b.order[v])) for u, v in zip(x[at], y[at], strict=True)]]
                out_x.append(x[at])
                out_y.append(y[at])
                root[np.maximum(rx, ry)[at]] = np.minimum(rx, ry)[at]
                while not np.array_equal(up := root[root], root):
                    root = up
                x, y = np.delete(x, tried), np.delete(y, tried)
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_x, out_y))
    return a.order[x], b.order[y]


def bits_at(similarity: float, bits: int = 64, errors: float = 3.0) -> int:
    """Different bits of SimHash that two sets of equal size and Jaccard `similarity` have, plus so many standard errors."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(round(bits * share + errors * np.sqrt(bits * share * (1 - share))))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """(doc_id, k, t, fp, component_id) for each row of `docs`: component_id is the smallest id reachable over links.

    Documents whose fingerprints differ by at most `radius` bits are linked; equal ones always are, those of empty texts (0)
    included. Null ids are allowed; a component of only null ids has a null component_id. Repeated rows stay, an empty table gives an
    empty one; other columns of `docs` are not read, whatever their names. Texts may be of any length.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle))
    parts = connected_components(near_pairs(prints, radius, strip_rows))
    first = prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    of = written(first.join(parts, "node", "left").select("node", "low", "n", F.coalesce("component", "node").alias("component")))
    lowest = of.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("m"))
    groups = join_once(of, lowest, ["component"], n="m").select(F.col("node").alias("fp"), "component_id", "n")
    return join_once(prints, groups, ["fp"]).select("doc_id", "k", "t", "fp", "component_id")


# -- similarity of shingle sets -------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word shingles, sorted, and the texts' bounds in them; a text of fewer words is one shingle."""
    words = find_words(texts, SPACED, strong=True)
    counts = words.counts()
    hashes, at = grams(words.hash, words.row, shingle)
    row = words.row[at]
    for size in np.unique(counts[(counts > 0) & (counts < shingle)]):
        few, first = grams(words.hash, words.row, int(size))
        own = counts[words.row[first]] == size
        hashes, row = np.concatenate([hashes, few[own]]), np.concatenate([row, words.row[first[own]]])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(texts) + 1))


def set_prints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash (int64) of each set, 0 for an empty one, and the names of the blocks it enters (rows, BLOCKS): hashes of its smallest hashes under several orders."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    votes, blocks = np.zeros((len(bounds) - 1, 64), np.int32), np.zeros((len(bounds) - 1, BLOCKS), np.uint64)
    starts = bounds[:-1][full]
    if not len(full):
        return np.zeros(len(bounds) - 1, np.int64), blocks.view(np.int64)
    for bit in range(64):
        votes[full, bit] = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int32), starts)
    fp = np.packbits(2 * votes > np.diff(bounds)[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
    turns = mix(np.arange(1, 2 * BLOCKS * BLOCK_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, BLOCKS, BLOCK_HASHES)
    for i in range(BLOCKS):
        name = np.full(len(full), np.uint64(i + 1))
        for j in range(BLOCK_HASHES):
            least = np.minimum.reduceat(hashes * (turns[0, i, j] | np.uint64(1)) + turns[1, i, j], starts)
            name = mix(name * np.uint64(0xD6E8FEB86659FD93) + least)
        blocks[full, i] = name
    return fp, blocks.view(np.int64)


def _prefix_sizes(sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """How many first elements of sets of these sizes, in one order of all elements, any similar set has one of: among its own first ones by the first number; by the second, smaller one, if it is at least as large."""
    least = lambda share: sizes - np.ceil(share * sizes - 1e-8).astype(np.int64) + 1
    return np.where(sizes > 0, least(similarity), 0), np.where(sizes > 0, least(2 * similarity / (1 + similarity)), 0)


def set_prefixes(hashes: np.ndarray, bounds: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First elements of each set in the order of all (those in the sorted `common` last, then by hash), their bounds, and how many of each set's are enough where the other set is not smaller."""
    sizes = np.diff(bounds)
    most, few = _prefix_sizes(sizes, similarity)
    row = np.repeat(np.arange(len(sizes)), sizes)
    late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    order = np.lexsort((hashes, late, row))
    taken = np.arange(len(hashes)) - bounds[:-1][row] < most[row]
    return hashes[order[taken]], np.concatenate([[0], np.cumsum(most)]), few


def set_sketches(hashes: np.ndarray, bounds: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(sets, bits / 8) bytes: each bit tells whether an odd number of a set's elements falls on it, so two sketches differ in no more bits than the sets in elements."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * bits + (mix(hashes) % np.uint64(bits)).astype(np.int64)
    odd = np.zeros(n * bits, np.uint8)
    np.add.at(odd, at, np.uint8(1))  # goes round at 256, which leaves odd numbers odd
    return np.packbits(odd & 1).reshape(n, bits // 8)


def sized_sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The sketch of each set, of a power of two of bits that grows with the set: one of few bits is half full for any long set and tells it from none."""
    sizes = np.diff(bounds)
    bits = np.array([max(SKETCH_BITS, 1 << (ELEMENT_BITS * n - 1).bit_length()) for n in sizes.tolist()], np.int64)
    out = [b""] * len(sizes)
    for width in np.unique(bits).tolist():
        own = np.flatnonzero(bits == width)
        drawn = set_sketches(hashes[np.repeat(bits == width, sizes)], np.concatenate([[0], np.cumsum(sizes[own])]), width)
        for i, x in zip(own.tolist(), drawn, strict=True):
            out[i] = x.tobytes()
    return out


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of `size` bytes (uint64) of the set that a longer one is of."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def apart(u: list[bytes], v: list[bytes]) -> np.ndarray:
    """Different bits of each two sketches; the longer one is folded to the size of the other, which gives the sketch of so many bits of its set."""
    lengths, out = np.array([(len(x), len(y)) for x, y in zip(u, v, strict=True)], np.int64).reshape(-1, 2), np.zeros(len(u), np.int64)
    for m, n in np.unique(lengths, axis=0).tolist():
        own = np.flatnonzero((lengths == (m, n)).all(axis=1)).tolist()
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([z[i] for i in own]), np.uint64).reshape(len(own), -1, min(m, n) // 8), axis=1) for z in (u, v))
        out[own] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _near_sketches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sketches u and v do not differ in more bits than sets of that similarity and of these sizes (together) in elements."""
    for batch in batches:
        near = pa.array(apart(batch["u"].to_pylist(), batch["v"].to_pylist()) <= (1 - similarity) / (1 + similarity) * batch["sizes"].to_numpy() + 1e-6)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(near), batch["b"].filter(near)], names=["a", "b"])


_SETS = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("node", pa.binary()), ("size", pa.int64()), ("fp", pa.int64()), ("blocks", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("few", pa.int64()), ("sketch", pa.binary()), ("folded", pa.list_(pa.int64()))])


def _set_scan(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            hashes, bounds = shingle_sets(part["text"], shingle)
            fp, blocks = set_prints(hashes, bounds)
            nodes = [xxhash.xxh3_128_digest(hashes[i:j].tobytes()) for i, j in zip(bounds, bounds[1:], strict=False)]
            sizes = np.diff(bounds)
            first, ends, few = set_prefixes(hashes, bounds, common, similarity)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first.view(np.int64)))
            sketches = sized_sketches(hashes, bounds)
            yield arrow_batch(_SETS, part["doc_id"], part["k"], part["t"], nodes, sizes, fp, [x if n else [] for x, n in zip(blocks.tolist(), sizes.tolist(), strict=True)], prefix, few, sketches, [folded(x, 8 * FOLDED).view(np.int64).tolist() for x in sketches])


def _common(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that at least two texts of a sample of about SAMPLE_TEXTS have, the COMMON most frequent ones, sorted."""
    sampled = rows.where(F.pmod("t", F.lit(max(1, rows.count() // SAMPLE_TEXTS))) == 0).dropDuplicates(["t"]).select("text")
    schema = pa.schema([("x", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield arrow_batch(schema, shingle_sets(part["text"], shingle)[0].view(np.int64))

    often = sampled.mapInArrow(scan, "x long").groupBy("x").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "x").limit(COMMON).select("x")
    return np.sort(often.toArrow()["x"].to_numpy().view(np.uint64))


def _meetings(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (x, c, i, size, early, f0...) sorted by x and c: pairs of i of one x and different c whose sizes and folded sketches allow the similarity, the smaller one being early."""
    folds = [f"f{n}" for n in range(FOLDED)]
    names = ("x", "c", "i", "size", "early", *folds)

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, c, i, size, early = (rows[n] for n in names[:5])
        bits = np.stack([rows[n] for n in folds]).view(np.uint64)  # bits of signed numbers would be those of their absolute values
        ends = lambda new: np.repeat(np.append(np.flatnonzero(new)[1:], len(x)), np.diff(np.append(np.flatnonzero(new), len(x))))
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        last = ends(new)
        new[1:] |= c[1:] != c[:-1]
        at, to, out, n = np.arange(len(x)), ends(new), [], 0
        while len(at):
            there = to < last[at]
            at, to = at[there], to[there]
            low, high = np.minimum(size[at], size[to]), np.maximum(size[at], size[to])
            first = np.where(size[at] == size[to], early[at] | early[to], np.where(size[at] < size[to], early[at], early[to]))
            good = np.flatnonzero(first & (low >= similarity * high - 1e-8))
            differ = np.bitwise_count(bits[:, at[good]] ^ bits[:, to[good]]).sum(axis=0, dtype=np.int64)
            good = good[differ <= (1 - similarity) / (1 + similarity) * (low + high)[good] + 1e-6]
            a, b = i[at[good]], i[to[good]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            n, to = n + len(a), to + 1
            if n > MEETING_ROWS or not len(at):
                met = np.unique(np.concatenate(out, axis=1), axis=1)
                out, n = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(met[0]), pa.array(met[1])], names=["a", "b"])

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = {n: batch[n].to_numpy(zero_copy_only=False) for n in names}
        rows = {n: np.concatenate([held[n], rows[n]]) for n in names} if held else rows
        if not len(rows["x"]):
            continue
        cut = int(np.searchsorted(rows["x"], rows["x"][-1]))  # rows of the last x go on in the next batch
        held = {n: rows[n][cut:] for n in names}
        if cut:
            yield from pairs({n: rows[n][:cut] for n in names})
    if held:
        yield from pairs(held)


def _exact_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(a, b) of components in `nodes` (node, component, size, prefix, few, sketch, folded, k, t) that hold similar sets, each such pair of sets found.

    Two similar sets have one of their first elements in common, in any order of all elements; those of different components that have, and whose sketches
    allow it, are compared whole.
    """
    folds = [F.col("folded")[n].alias(f"f{n}") for n in range(FOLDED)]
    placed = nodes.select(F.xxhash64("node").alias("i"), F.xxhash64("component").alias("c"), F.col("size").cast("int").alias("size"), "few", *folds, F.posexplode("prefix").alias("n", "x"))
    work = placed.select("x", "c", "i", "size", (F.col("n") < F.col("few")).alias("early"), *[f"f{n}" for n in range(FOLDED)]).repartition("x").sortWithinPartitions("x", "c")
    met = written(work.mapInArrow(lambda b: _meetings(b, similarity), "a long, b long").distinct())
    sketch = lambda i, c, n: nodes.select(F.xxhash64("node").alias(i), F.col("sketch").alias(c), F.col("size").alias(n))
    drawn = met.join(sketch("a", "u", "m"), "a").join(sketch("b", "v", "n"), "b").select("a", "b", "u", "v", (F.col("m") + F.col("n")).alias("sizes"))
    met = written(drawn.mapInArrow(lambda b: _near_sketches(b, similarity), "a long, b long"))
    ends = met.select(F.col("a").alias("i")).union(met.select(F.col("b").alias("i"))).distinct()
    found = written(sets(nodes.select(F.xxhash64("node").alias("i"), "node", F.lit(0).alias("fp"), "component", "k", "t").join(ends, "i")))
    side = lambda i, c, h: found.select(F.xxhash64("node").alias(i), F.col("component").alias(c), F.col("hashes").alias(h))
    pairs = met.join(side("a", "x", "u"), "a").join(side("b", "y", "v"), "b").select("x", "y", "u", "v")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64), similarity) for u, v in zip(batch["u"], batch["v"], strict=True)]
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["x"].filter(kept), batch["y"].filter(kept)], schema=schema)

    return pairs.mapInArrow(compare, "a binary, b binary").distinct()


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _block_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and pair of strips: a spanning forest of the similar pairs of each."""
    schema, radius = pa.schema([("a", pa.binary()), ("b", pa.binary())]), bits_at(similarity)

    def links(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        strip, low, high = rows["strip"].to_numpy(), rows["low"][0].as_py(), rows["high"][0].as_py()
        own = np.flatnonzero(strip == low)
        other = own if low == high else np.flatnonzero(strip == high)
        fp, sets = rows["fp"].to_numpy().view(np.uint64), [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]
        x, y = linked(fp[own], None if low == high else fp[other], radius, lambda u, v: similar(sets[own[u]], sets[other[v]], similarity))
        if len(x):
            nodes = rows["node"]
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(own[x])), nodes.take(pa.array(other[y]))], schema=schema)

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in ("block", "low", "high")), strict=True))
        begin = 0
        for i, key in enumerate([*keys, None]):
            if i == len(keys) or key != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if i < len(keys):
                    if sum(x.num_rows for x in held) > 1:
                        yield from links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, begin, last = [], i, key
    if sum(x.num_rows for x in held) > 1:
        yield from links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k, t, node) of `docs`, and for each node (node, component_id, first_k, first_t): the group of near copies it is in.

    Links are between texts whose sets of distinct shingles have a Jaccard similarity of at least `similarity`, as counted on the sets
    themselves; groups are what links connect, and (first_k, first_t) is the row of the smallest id (null is the largest), then of the
    least text hash. Equal sets, empty ones included, are one node, told by a 128-bit digest. Large groups are brought together first: sets meet in
    blocks, each named by the smallest shingle hashes under BLOCK_HASHES orders; in a block, strips are compared in tiles as in `near_pairs`,
    within the bits that the similarity stands for plus three standard errors, and what is within them by its sets. A block of many or long texts is cut
    into strips, and each two strips are a piece of work of their own. That leaves out some links; `_exact_links` finds all that are left between the groups.
    Null ids and texts, repeated rows, empty tables and other columns of any name are allowed.
    """
    rows = keyed(docs, id_col, text_col)
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))
    kind = "doc_id long, k long, t long, node binary, size long, fp long, blocks array<long>, prefix array<long>, few long, sketch binary, folded array<long>"
    prints = written(rows.mapInArrow(lambda b: _set_scan(b, shingle, similarity, common.value), kind))
    order, of_set = F.struct(F.col("doc_id").isNull().alias("none"), "k", "t"), ["node", "size", "fp", "blocks", "prefix", "few", "sketch", "folded"]
    nodes = written(prints.groupBy(*of_set).agg(F.min(order).alias("x")).select(*of_set, "x.none", "x.k", "x.t"))
    whole, prints = prints, written(prints.select("doc_id", "k", "t", "node"))
    discard(whole)
    entries = nodes.select("node", "size", F.explode("blocks").alias("block"))
    strips = F.greatest(F.ceil(F.sum("size") * 8 / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    crowds = written(entries.groupBy("block").agg(F.count("*").alias("n"), strips.alias("strips")).where("n > 1"))
    placed = written(join_once(entries, crowds, ["block"]).select("node", "block", "strips", F.pmod(F.xxhash64("node"), F.col("strips")).cast("int").alias("strip")))
    schema = pa.schema([("node", pa.binary()), ("fp", pa.int64()), ("component", pa.binary()), ("hashes", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, bounds = shingle_sets(part["text"], shingle)
                yield arrow_batch(schema, part["node"], part["fp"], part["component"], [hashes[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)])

    def sets(wanted: DataFrame) -> DataFrame:
        texts = rows.select("k", "t", "text").join(wanted.select("node", "fp", "component", "k", "t"), ["k", "t"]).select("node", "fp", "component", "text")
        return texts.mapInArrow(scan, "node binary, fp long, component binary, hashes binary").dropDuplicates(["node"])

    found = sets(nodes.withColumn("component", F.col("node")).join(placed.select("node").distinct(), "node")).drop("component")
    dealt = placed.select("node", "block", "strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("other")).select(
        "node", "block", "strip", F.least("strip", "other").alias("low"), F.greatest("strip", "other").alias("high")
    )
    keys = ["block", "low", "high"]
    work = dealt.join(found, "node").select(*keys, "strip", "node", "fp", "hashes").repartition(*keys).sortWithinPartitions(*keys)
    parts = connected_components(work.mapInArrow(lambda b: _block_links(b, similarity), "a binary, b binary"))
    parts = written(parts)
    of = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = connected_components(_exact_links(of, sets, similarity)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    of = written(of.join(more, "component", "left").select("node", F.coalesce("whole", "component").alias("component"), "none", "k", "t"))
    discard(nodes, crowds, placed)
    first = of.groupBy("component").agg(F.min(F.struct("none", "k", "t")).alias("x"), F.count("*").alias("n"))
    groups = join_once(of, first, ["component"]).select("node", F.when(~F.col("x.none"), F.col("x.k")).alias("component_id"), F.col("x.k").alias("first_k"), F.col("x.t").alias("first_t"))
    return prints, groups


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; see `simhash_groups` for nulls, empty texts, repeated rows and empty tables."""
    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
