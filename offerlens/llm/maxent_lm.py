"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, trained by distributed gradient updates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import SLICE_BYTES, arrow_batch, keyed, slices, table, written
from offerlens.llm.words import SPACED, find_words, mix

#: Classes, and places in each. The OWN most frequent tokens have a place of their own, in order, so that classes go by frequency; the others are hashed to the rest.
CLASSES = PLACES = 32
OWN = 768
#: Least rows of each of the two weight tables, to which contexts are hashed, and tokens of the corpus for each further row.
LEAST_ROWS, ROW_TOKENS = 1 << 15, 1 << 16
#: Parts of the corpus, each seen once, after each of which the shards' updates meet; step size; tokens of a step.
ROUNDS, RATE, STEP = 3, 0.4, 8192
#: Shards of a round: a fixed number, or one for so many tokens of the corpus.
LEAST_SHARDS, SHARD_TOKENS = 4, 8_000_000
#: Most tokens whose counts every task holds, and the longest of them in bytes; the counts of the others are joined.
HEAD_TOKENS, HEAD_BYTES = 1 << 17, 64
ADDED = 0.1
#: Different tokens that a task counts before it sends them on.
COUNTED = 1 << 17

_END = np.uint64(0x51ED270B4D2F1A33)  # hash of the end of a text; also stands before its first words
_SEEDS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose id, as text, has a crc32 divisible by ten; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _tail(hashes: np.ndarray) -> np.ndarray:
    return OWN + ((hashes >> np.uint64(40)) % np.uint64(CLASSES * PLACES - OWN)).astype(np.int64)


def slots_of(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Place of each token: its number among `own` (hashes of frequent tokens, most frequent first), or that of its hash."""
    out = _tail(hashes)
    if len(own):
        order = np.argsort(own)
        at = np.minimum(np.searchsorted(own, hashes, sorter=order), len(own) - 1)
        hit = own[order[at]] == hashes
        out[hit] = order[at[hit]]
    return out


@dataclass
class Tokens:
    """Tokens of some texts, each text's end included: hash, the two hashes before, and the text's row."""

    hash: np.ndarray
    before: np.ndarray
    skip: np.ndarray
    row: np.ndarray
    first: np.ndarray


def _tokens(texts: pa.Array):
    words = find_words(texts, SPACED)
    n = len(texts)
    first = words.first + np.arange(n + 1)
    hashes = np.full(len(words.hash) + n, _END, np.uint64)
    at = np.arange(len(words.hash)) + words.row
    hashes[at] = words.hash
    before, skip = np.full_like(hashes, _END), np.full_like(hashes, _END)
    before[1:], skip[2:] = hashes[:-1], hashes[:-2]
    row = np.repeat(np.arange(n), np.diff(first))
    skip[1:][row[1:] != row[:-1]] = _END
    second = first[:-1] + 1
    second = second[second < first[1:]]
    skip[second] = _END
    return words, at, Tokens(hashes, before, skip, row, first)


def _contexts(t: Tokens) -> np.ndarray:
    """Hashes of the three features of each token: the word before, the two before, and the one before that."""
    return np.stack([mix(t.before ^ _SEEDS[0]), mix(t.before * _SEEDS[1] + t.skip), mix(t.skip ^ _SEEDS[2])])


def table_rows(tokens: int) -> int:
    """Rows of a weight table for a corpus of `tokens`: a power of two that grows with the corpus."""
    return max(LEAST_ROWS, 1 << (max(tokens, 1) // ROW_TOKENS).bit_length())


class Model:
    """Weights of both levels, and log shares of classes and of places in them, from which training starts."""

    def __init__(self, mass: np.ndarray, weights: np.ndarray, own: np.ndarray):
        by_class = mass.reshape(CLASSES, PLACES)
        self.mass, self.own = mass, own
        self.bias = np.log(by_class.sum(axis=1) / mass.sum()).astype(np.float32), np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
        self.weights = weights  # (2, rows, 32)

    def step(self, contexts: np.ndarray, slots: np.ndarray, seen: np.ndarray | None) -> np.ndarray:
        """Log probability of each slot after its context; with `seen` (visits of each row) the weights are updated too."""
        total, size = np.zeros(len(slots)), self.weights.shape[1]
        classes, places = slots // PLACES, slots % PLACES
        n, ones, columns = np.arange(len(slots)), np.ones(PLACES, np.float32), np.arange(PLACES)
        for level, target in ((0, classes), (1, places)):
            keys = contexts if level == 0 else mix(contexts + (classes.astype(np.uint64) + np.uint64(1)) * _SEEDS[2])
            rows = (keys & np.uint64(size - 1)).astype(np.int64)
            table_ = self.weights[level]
            z = table_.take(rows[0], axis=0)
            z += table_.take(rows[1], axis=0)
            z += table_.take(rows[2], axis=0)
            z += self.bias[0] if level == 0 else self.bias[1].take(classes, axis=0)
            np.minimum(z, 80, out=z)  # no overflow
            right = z[n, target].astype(np.float64)
            np.exp(z, out=z)
            sums = z @ ones
            total += right - np.log(sums)
            if seen is not None:
                z /= -sums[:, None]
                z[n, target] += 1
                flat = table_.reshape(-1)
                for i in range(3):
                    times = np.bincount(rows[i], minlength=size)
                    seen[level] += times
                    rate = RATE / np.maximum(times + np.sqrt(seen[level]), 1)
                    change = z * rate.astype(np.float32).take(rows[i])[:, None]
                    np.add.at(flat, (rows[i][:, None] * PLACES + columns).reshape(-1), change.reshape(-1))
        return total

    def score(self, t: Tokens) -> np.ndarray:
        """log10 of each token's slot probability over the slot's mass: times (count + ADDED) it is the token's probability."""
        slots, contexts = slots_of(t.hash, self.own), _contexts(t)
        logs = np.concatenate([self.step(contexts[:, i : i + STEP], slots[i : i + STEP], None) for i in range(0, len(slots), STEP)])
        return logs / np.log(10) - np.log10(self.mass)[slots]


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, tail, n) over all texts of `docs` (keyed): words with A-Z lower-cased, and '' for each text's end; tail is the place by hash."""
    schema = pa.schema([("token", pa.string()), ("tail", pa.int32()), ("n", pa.int64())])

    def sent(sums: Counter) -> pa.RecordBatch:
        tokens = pa.array([x.decode() for x in sums], pa.string())
        return arrow_batch(schema, tokens, _tail(find_words(tokens, np.ones(256, bool)).hash), list(sums.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for part in slices(batch):
                for text in part["text"].to_pylist():
                    sums.update(text.encode("utf-8", "replace").lower().split())
                if len(sums) >= COUNTED:
                    yield sent(sums)
                    sums = Counter()
            yield sent(sums)
            yield arrow_batch(schema, [""], _tail(np.array([_END])), [batch.num_rows])

    return docs.select("text").mapInArrow(count, "token string, tail int, n long").groupBy("token", "tail").agg(F.sum("n").alias("n"))


def outputs(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the OWN most frequent tokens (of equals, the first by name), and the mass of each place: counts of its tokens, ADDED for each and for what is unknown there."""
    top = counts.orderBy(F.desc("n"), "token").limit(OWN).collect()
    mass = np.zeros(CLASSES * PLACES)
    for slot, value in counts.groupBy("tail").agg(F.sum(F.col("n") + ADDED)).collect():  # one row for each place
        mass[slot] = value
    for i, r in enumerate(top):
        mass[i] = r["n"] + ADDED
        mass[r["tail"]] -= r["n"] + ADDED
    mass[OWN:] = np.maximum(mass[OWN:], 0) + ADDED
    mass[len(top) : OWN] = 1e-9  # places that no token has
    own = np.array([_END if not r["token"] else find_words(pa.array([r["token"]]), np.ones(256, bool)).hash[0] for r in top], np.uint64)
    return own, mass


def _whole_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """Texts of rows sorted by shard, with their shard, in slices that do not depend on where batches end."""
    held: list[pa.Array] = []
    total, last = 0, None
    for batch in batches:
        texts, begin = batch["text"], 0
        for i, (shard, size) in enumerate(zip(batch["shard"].to_pylist(), pc.fill_null(pc.binary_length(texts), 0).to_pylist(), strict=True)):
            if shard != last or total + size > SLICE_BYTES:
                if total or i > begin or held:
                    yield last, pa.concat_arrays([*held, texts.slice(begin, i - begin)])
                held, total, begin, last = [], 0, i, shard
            total += size
        held.append(texts.slice(begin))
    if sum(map(len, held)):
        yield last, pa.concat_arrays(held)


def train(docs: DataFrame, mass: np.ndarray, tokens: int, rounds: int = ROUNDS, own: np.ndarray | None = None, rows: int | None = None) -> np.ndarray:
    """Weights after `rounds` rounds, each over another part of `docs` (keyed), so that every text is seen once; `rows` of each table, or as many as the corpus asks for.

    A round's texts are dealt to shards and ordered in them by hashes of id and text, and shards are as many as the `tokens` ask for, so the result
    does not depend on partitions or cores. For each shard, a task starts from the shared weights and takes gradient steps; the
    changes of each row are then averaged by the visits it had. A task sends at most the size of the weights.
    """
    spark = docs.sparkSession
    shards, own = max(LEAST_SHARDS, -(-tokens // SHARD_TOKENS)), np.zeros(0, np.uint64) if own is None else own
    weights = np.zeros((2, rows or table_rows(tokens), PLACES), np.float32)
    sent = pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("visits", pa.float64()), ("change", pa.binary())])
    met = pa.schema([("rows", pa.binary()), ("changes", pa.binary())])
    places = weights.shape[0] * weights.shape[1]
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, seen, last = None, None, None

            def changes() -> Iterator[pa.RecordBatch]:
                at = np.flatnonzero(seen.reshape(-1))
                change = (model.weights - shared.value).reshape(-1, PLACES)[at].astype(np.float16)
                for i in range(0, len(at), 4096):
                    yield arrow_batch(sent, at[i : i + 4096], np.full(len(at[i : i + 4096]), last), seen.reshape(-1)[at[i : i + 4096]], [x.tobytes() for x in change[i : i + 4096]])

            for shard, texts in _whole_slices(batches):
                if shard != last:
                    if model is not None:
                        yield from changes()
                    model, seen, last = Model(mass, shared.value.copy(), own), np.zeros(shared.value.shape[:2]), shard
                _, _, t = _tokens(texts)
                slots, contexts = slots_of(t.hash, own), _contexts(t)
                for i in range(0, len(slots), STEP):
                    model.step(contexts[:, i : i + STEP], slots[i : i + STEP], seen)
            if model is not None:
                yield from changes()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, visits = np.zeros((places, PLACES)), np.zeros(places)
            for batch in batches:
                if batch.num_rows:
                    row, times = batch["row"].to_numpy(), batch["visits"].to_numpy()
                    change = np.frombuffer(b"".join(batch["change"].to_pylist()), np.float16).reshape(-1, PLACES).astype(np.float64)
                    np.add.at(visits, row, times)
                    np.add.at(sums, row, change * times[:, None])
            at = np.flatnonzero(visits)
            yield arrow_batch(met, [at.astype(np.int32).tobytes()], [(sums[at] / visits[at, None]).astype(np.float32).tobytes()])

        order = F.xxhash64("t", "k")
        part = docs.where(F.pmod(F.xxhash64("k", "t"), F.lit(rounds)) == turn).select("text", F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("order"), "t")
        dealt = part.repartition(shards, "shard").sortWithinPartitions("shard", "order", "t").select("shard", "text")
        changes = dealt.mapInArrow(learn, "row int, shard int, visits double, change binary").repartition("row").sortWithinPartitions("row", "shard").mapInArrow(meet, "rows binary, changes binary")
        weights = weights.copy()
        flat = weights.reshape(-1, PLACES)
        for r in changes.toLocalIterator():  # the size of the weights at most
            flat[np.frombuffer(r["rows"], np.int32)] += np.frombuffer(r["changes"], np.float32).reshape(-1, PLACES)
    return weights


class _Head:
    """Counts of frequent tokens by hash, in a table of open addresses."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.bits = max(4, int(len(hashes) * 4).bit_length())
        self.keys, self.counts = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        self.probes, left = 0, np.arange(len(hashes))
        while len(left):  # each round, one of those that want a free place gets it
            at = self._at(hashes[left], self.probes)
            free = self.counts[at] == 0
            want, first = np.unique(at[free], return_index=True)
            got = left[free][first]
            self.keys[want], self.counts[want] = hashes[got], counts[got]
            left = np.setdiff1d(left, got)
            self.probes += 1

    def _at(self, hashes: np.ndarray, turn: int) -> np.ndarray:
        return (((hashes >> np.uint64(8)) + np.uint64(turn)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The count of each token, 0 for those that are not here."""
        out = np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        for turn in range(self.probes):
            at = self._at(hashes[left], turn)
            hit = (self.keys[at] == hashes[left]) & (self.counts[at] > 0)
            out[left[hit]] = self.counts[at[hit]]
            left = left[~hit & (self.counts[at] > 0)]
            if not len(left):
                break
        return out


def _head(counts: DataFrame) -> list:
    """Tokens with at least so many counts, a power of two, that there are HEAD_TOKENS of them at most."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = dict(tuple(r) for r in counts.groupBy(level.alias("level")).count().collect())  # 64 rows at most
    taken, least = 0, 64
    for x in sorted(sizes, reverse=True):
        taken += sizes[x]
        if taken > HEAD_TOKENS:
            break
        least = x
    return counts.where((F.col("n") >= F.lit(2.0) ** least) & (F.octet_length("token") <= HEAD_BYTES)).select("token", "n").collect()


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, table_size: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    Tokens are words without ASCII white space, A-Z lower-cased, and each text's end; null and empty texts have their end
    only. Counts and the model learn from all rows that are not held out. base_score is the log10 probability by
    smoothed counts. The model gives each token's class, then its place in the class, after the words before it (one, two, and the one before the
    last), times the token's share of the place by smoothed counts; frequent tokens have a place of their own. Over all known tokens, and one unknown one
    for each other place, the probabilities after any words sum to 1. Scores do not depend on how the rows are partitioned.

    Repeated rows count each time and get the same scores, null ids count as an empty text for the fold, texts may be of any length, other columns are not
    read. An empty table gives an empty one; without training rows, every token has the probability of an unknown one.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).withColumn("held_out", held_out(id_col="doc_id"))
    learnt = rows.where("NOT held_out")
    counts = written(token_counts(learnt))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own, mass = outputs(counts)
    frequent = _head(counts)
    head = spark.sparkContext.broadcast((pa.array([r["token"] for r in frequent], pa.string()), np.array([r["n"] for r in frequent], np.int64)))
    trained = spark.sparkContext.broadcast(train(learnt, mass, int(total), rounds, own, table_size))
    schema = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known", pa.float64()), ("model", pa.float64()), ("token", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(mass, trained.value, own)
        names, times = head.value
        word = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
        hashes, ends = find_words(names.filter(pa.array(word)), np.ones(256, bool)).hash, int(times[~word].sum())
        frequent = times[word]
        tokens = _Head(np.append(hashes, _END) if ends else hashes, np.append(frequent, ends) if ends else frequent)
        for batch in batches:
            for part in slices(batch):
                words, at, t = _tokens(part["text"])
                found = tokens.find(t.hash)
                logs = np.concatenate([[0.0], np.cumsum(np.where(found > 0, np.log10(found + ADDED), 0.0))])
                known = np.concatenate([[0], np.cumsum(found > 0)])
                models = np.concatenate([[0.0], np.cumsum(model.score(t))])
                begin, end = t.first[:-1], t.first[1:]
                k, ts, none = part["k"].to_numpy(), part["t"].to_numpy(), [None] * part.num_rows
                yield arrow_batch(schema, k, ts, part["doc_id"], part["held_out"], end - begin, known[end] - known[begin], logs[end] - logs[begin], models[end] - models[begin], none)
                missing = np.flatnonzero(found == 0)
                word = np.searchsorted(at, missing)
                is_word = (word < len(at)) & (at[np.minimum(word, len(at) - 1)] == missing) if len(at) else np.zeros(len(missing), bool)
                spans = zip(words.start[word[is_word]].tolist(), words.end[word[is_word]].tolist(), strict=True)
                raw = words.data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in spans] + [""] * int((~is_word).sum())
                of = np.concatenate([t.row[missing[is_word]], t.row[missing[~is_word]]])
                none = [None] * len(texts)
                yield arrow_batch(schema, k[of], ts[of], none, none, none, none, none, none, texts)

    scanned = written(rows.mapInArrow(scan, "k long, t long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, model double, token string"))
    rare = scanned.where("token IS NOT NULL").groupBy("k", "t", "token").agg(F.count("*").alias("times"))
    copies = scanned.where("token IS NULL").groupBy("k", "t").agg(F.count("*").alias("copies"))
    joined = rare.join(counts.select("token", "n"), "token", "left")
    n = F.coalesce("n", F.lit(0))
    tail = joined.groupBy("k", "t").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("tail_known"), F.sum(F.col("times") * F.log10(n + ADDED)).alias("tail"))
    tail = tail.join(copies, ["k", "t"]).select("k", "t", (F.col("tail_known") / F.col("copies")).cast("long").alias("tail_known"), (F.col("tail") / F.col("copies")).alias("tail"))
    zero = F.lit(0)
    own = F.col("known") + F.coalesce("tail", F.lit(0.0))
    return (
        scanned.where("token IS NULL").join(tail, ["k", "t"], "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
            (own - F.col("n_tokens") * float(np.log10(total + ADDED * (distinct + 1)))).alias("base_score"), (own + F.col("model")).alias("score"),
        )
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score_texts` of every document; see there for nulls, empty texts, repeated rows and empty tables."""
    return score_texts(table(spark, sf_dir, "documents"))
