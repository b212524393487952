"""Chat formatting: conversations as windows under a token budget, with the system turn kept, some history repeated, and a loss mask that has each target once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import NULL_ID, arrow_batch, table, written
from offerlens.llm.sentencepiece_bpe import codec, default_model

#: Tokens of a window, tokens and turns of history that a window repeats at most.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 1024, 256, 4
#: Bytes (texts, roles and ROW_BYTES for each turn) after which a conversation goes on in another segment, which any task may have.
SEGMENT_BYTES, ROW_BYTES = 4 << 20, 64


@dataclass(frozen=True)
class Template:
    """Control strings around turns of each role, and a reversible escape of them inside texts.

    A control string in a text gets `escape` after its first character; one that has some there already gets one more, so taking one away
    gives the text back. No control string may begin where another ends or stand within another; then none arises where a text meets a mark.
    """

    marks: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")  # before the name of a role without marks of its own, before the text, after it
    escape: str = "\\"
    control: re.Pattern = field(init=False, compare=False)
    quoted: re.Pattern = field(init=False, compare=False)
    escaped: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        strings = [x for _, *pair in self.marks for x in pair] + list(self.other)
        for a in strings:
            if len(a) < 2 or self.escape in a or len(self.escape) != 1:
                raise ValueError(f"not a control string: {a!r}")
            for b in strings:
                if a != b and a in b or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings meet: {a!r}, {b!r}")
        e = re.escape(self.escape)
        some = lambda between: re.compile("|".join(f"({re.escape(x[0])}{between})({re.escape(x[1:])})" for x in strings))
        object.__setattr__(self, "control", re.compile("|".join(map(re.escape, strings))))
        object.__setattr__(self, "quoted", some(f"{e}*"))
        object.__setattr__(self, "escaped", some(f"{e}+"))

    def quote(self, text: str) -> str:
        return self.quoted.sub(lambda m: m[m.lastindex - 1] + self.escape + m[m.lastindex], text)

    def unquote(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[m.lastindex - 1][:-1] + m[m.lastindex], text)

    def turn(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before the escaped text, the escaped text, what stands after it."""
        for own, before, after in self.marks:
            if role == own:
                return before, self.quote(text), after
        return self.other[0] + self.quote(role) + self.other[1], self.quote(text), self.other[2]

    def turns(self, window: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, begin and end of the escaped text) of each turn in a window; anything else in it is an error."""
        opens = {before: (role, after) for role, before, after in self.marks}
        at = 0
        while at < len(window):
            first = self.control.match(window, at)
            if first and first[0] in opens:
                role, after = opens[first[0]]
            elif first and first[0] == self.other[0]:
                named = self.control.search(window, first.end())
                if not named or named[0] != self.other[1]:
                    raise ValueError(f"no text after the role at {at}")
                role, after, first = self.unquote(window[first.end() : named.start()]), self.other[2], named
            else:
                raise ValueError(f"no turn at {at}")
            last = self.control.search(window, first.end())
            if not last or last[0] != after:
                raise ValueError(f"the turn at {at} has no end")
            yield role, self.unquote(window[first.end() : last.start()]), first.end(), last.start()
            at = last.end()


def spans(tokens: np.ndarray, system: int, budget: int, history_tokens: int, history_turns: int, known: int = 0) -> list[tuple[int, int, int]]:
    """(history, begin, end) of the windows of turns whose numbers of tokens are given; the first `known` turns are history only.

    Prefix sums choose each end: the last turn with which system turn, history and new turns stay within the budget, one new
    turn at least. History is the turns before the begin that fit into both its limits; it gives way where it would leave no room for a new turn.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    out, begin, room = [], known, budget - system
    while begin < len(tokens):
        least = max(sums[begin] - history_tokens, sums[begin + 1] - room)
        history = max(int(np.searchsorted(sums, least, side="left")), begin - history_turns, 0)
        history = min(history, begin)
        end = max(int(np.searchsorted(sums, sums[history] + room, side="right")) - 1, begin + 1)
        out.append((history, begin, end))
        begin = end
    return out


_ORDER = ["c", "turn", "role", "h", "tag"]


def segmented(rows: DataFrame, segment_bytes: int = SEGMENT_BYTES, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """(conv_id, c, segment, place, again, role, text): turns in order, long conversations cut into segments by prefix sums of their bytes.

    Rows are dealt to ranges of (conversation, turn) and summed up in each; what a conversation has in the ranges before comes from a table of the few
    conversations that several ranges share. A later segment also has the system turn (place -1) and the turns before it that may be repeated.
    """
    size = F.octet_length("text").cast("long") + F.octet_length("role") + ROW_BYTES
    c = F.coalesce("conv_id", F.lit(NULL_ID))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = plain.withColumns({"c": c, "h": F.xxhash64("text"), "size": size, "tag": F.monotonically_increasing_id()})
    names = ["conv_id", "c", "role", "text", "size"]
    schema = pa.schema([("conv_id", pa.int64()), ("c", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("size", pa.int64()), ("piece", pa.int64()), ("bytes", pa.int64()), ("place", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, total, n = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, sizes = batch["c"].to_numpy(), batch["size"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]]))
            sums = np.cumsum(sizes) - sizes
            first = np.zeros(len(key), np.int64)  # number of the first row of the row's conversation, 0 for one from the batch before
            first[begins] = begins
            first = np.maximum.accumulate(first)
            old = np.arange(len(key)) < (begins[0] if len(begins) else len(key))
            before = np.where(old, total + sums, sums - sums[first])
            places = np.where(old, n + np.arange(len(key)), np.arange(len(key)) - first)
            last, total, n = key[-1], int(before[-1] + sizes[-1]), int(places[-1] + 1)
            yield pa.RecordBatch.from_arrays([*[batch[x] for x in names], pa.array(np.full(len(key), own)), pa.array(before), pa.array(places)], schema=schema)

    ranged = keyed.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(*names)
    placed = written(ranged.mapInArrow(place, "conv_id long, c long, role string, text string, size long, piece long, bytes long, place long"))
    # a conversation that goes on in another range: a row for each range that it ends in, at most one more than there are ranges
    parts = placed.groupBy("c", "piece").agg(F.sum("size").alias("more"), F.count("*").alias("n"))
    shared = parts.join(parts.groupBy("c").agg(F.count("*").alias("pieces")).where("pieces > 1").select("c"), "c", "left_semi")
    earlier = shared.select("c", F.col("piece").alias("p"), "more", "n").join(shared.select("c", "piece"), "c").where("p < piece")
    offset = earlier.groupBy("c", "piece").agg(F.sum("more").alias("more"), F.sum("n").alias("n"))
    at = F.floor((F.col("bytes") + F.coalesce("more", F.lit(0))) / segment_bytes)
    turns = placed.join(F.broadcast(offset), ["c", "piece"], "left").select("conv_id", "c", at.alias("segment"), (F.col("place") + F.coalesce("n", F.lit(0))).alias("place"), "role", "text")
    edges = turns.groupBy("c", "segment").agg(F.min("place").alias("low")).where("segment > 0")
    before = edges.select("c", F.col("segment").alias("to"), F.explode(F.sequence(F.greatest(F.col("low") - history_turns, F.lit(0)), F.col("low") - 1)).alias("place"))
    last = turns.join(before, ["c", "place"]).where("place > 0 OR role <> 'system'").drop("segment").withColumnRenamed("to", "segment")
    head = turns.where("place = 0 AND role = 'system'").drop("segment", "place").join(edges.select("c", "segment"), "c").withColumn("place", F.lit(-1).cast("long"))
    return turns.withColumn("again", F.lit(False)).unionByName(last.unionByName(head).withColumn("again", F.lit(True)))


def format_windows(
    conversations: DataFrame, template: Template | None = None, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, targets: tuple[str, ...] = ("assistant",),
    model_path: str | None = None, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """(conv_id, segment, window, text, tokens, first_place, n_repeated, loss) for each window of each conversation (conv_id, turn, role, text).

    Turns are in the order of turn (null first), role, and a hash of the text; repeated rows are turns of their own, null texts and roles are empty ones, and rows
    without conv_id are one conversation. A window is the system turn, if the first turn is one, some history and new turns, `n_repeated` of its turns being repeated ones; first_place is the place of
    its first new turn. Tokens are those of the escaped texts under the model and one for each control string. Only a system turn with one new turn may go over the
    budget: no text is cut. loss has (begin, end) in code points of the escaped texts of new turns of the roles in `targets`. Windows do not run over
    segments of `segment_bytes`, but their history does. An empty table gives an empty one; other columns are not read.
    """
    template, path = template or Template(), model_path or default_model()
    schema = "conv_id long, segment long, window long, text string, tokens long, first_place long, n_repeated long, loss array<struct<begin:long,end:long>>"
    out = pa.schema([(x, pa.string() if x == "text" else pa.int64()) for x in ("conv_id", "segment", "window", "text", "tokens", "first_place", "n_repeated")] + [("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def windows(rows: list[tuple]) -> Iterator[tuple]:
        """Of the rows (conv_id, segment, place, again, role, text) of one segment, in order."""
        parts = [template.turn(*row[4:]) for row in rows]
        model = codec(path)
        known = model.parts.get
        counts = [sum((known(x) or model.part(x))[1] for x in model.split(body)) + len(template.control.findall(before)) + 1 for before, body, _ in parts]
        head = int(rows[0][2] <= 0 and rows[0][4] == "system")
        fresh = head and not rows[0][3]  # the system turn is new in the first window of the first segment
        cuts = spans(np.array(counts[head:], np.int64), counts[0] * head, budget, history_tokens, history_turns, sum(row[3] for row in rows[head:]))
        for number, (history, begin, end) in enumerate(cuts or [(0, 0, 0)]):
            picked = [*range(head), *range(head + history, head + end)]
            new = {*range(head + begin, head + end), *([0] if fresh and not number else [])}
            at, loss = 0, []
            for i in picked:
                before, body, after = parts[i]
                if i in new and rows[i][4] in targets:
                    loss.append({"begin": at + len(before), "end": at + len(before) + len(body)})
                at += len(before) + len(body) + len(after)
            yield *rows[0][:2], number, "".join(x for i in picked for x in parts[i]), sum(counts[i] for i in picked), rows[min(new)][2], len(picked) - len(new), loss

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["conv_id", "segment", "place", "again", "role", "text"], 2):
            made = list(windows(rows))
            yield arrow_batch(out, *zip(*made, strict=True))

    turns = segmented(conversations, segment_bytes, history_turns)
    return turns.repartition("c", "segment").sortWithinPartitions("c", "segment", "place").drop("c").mapInArrow(scan, schema)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[tuple]]:
    """Rows that follow each other and agree in their first `keys` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch[x].to_pylist() for x in names], strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def read_back(windows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its windows alone.

    Texts are parsed, repeated turns passed over and escapes taken away. A digest goes over a conversation in order, so its
    windows meet in one task, which holds one batch of them at a time.
    """
    template = template or Template()
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        close = lambda x: (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])
        for batch in batches:
            for conv, text, repeated, loss in zip(*[batch[x].to_pylist() for x in ("conv_id", "text", "n_repeated", "loss")], strict=True):
                if now is None or now[0] != conv:
                    done += [close(now)] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in list(template.turns(text))[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = template.unquote(text[span["begin"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
            if done:
                yield arrow_batch(out, *zip(*done, strict=True))
                done = []
        if now:
            yield arrow_batch(out, *zip(close(now), strict=True))

    order = ["conv_id", "segment", "window"]
    whole = windows.select(*order, "text", "n_repeated", "loss").repartition("conv_id").sortWithinPartitions(*order)
    return whole.mapInArrow(scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of control strings only, which the query adds.
QUOTED = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one (-7) that says control strings, formatted and read back; see `format_windows` for nulls, ties, repeated rows and empty tables."""
    more = spark.createDataFrame([(-7, 0, "user", QUOTED), (-7, 1, "assistant", QUOTED)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_windows(rows))


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `op12_chat_format` reads back of turns and targets: all of it that SQL can tell without the windows."""
    return op12_chat_format(spark, sf_dir).drop("formatted_chars")


CHAT_TURNS_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{QUOTED}'), (-7, 1, 'assistant', '{QUOTED}')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""
