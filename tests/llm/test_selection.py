"""Hard negatives, chat windows and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import chat_format, hard_negatives, resampling
from offerlens.llm.sentencepiece_bpe import codec, default_model

# -- hard negatives ------------------------------------------------------------------------------------------------


def plain_negatives(rows, is_anchor, top=5, low=80, high=100):
    """All scores by Python's whole numbers. Rows: (id, vector, label)."""
    whole = []
    for i, (id_, vector, label) in enumerate(rows):
        if id_ is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        x = [math.floor(float(np.float32(x)) * 256) for x in vector]
        if sum(y * y for y in x) < 2**63:
            whole.append((i, id_, x, label))
    out = []
    for i, anchor, x, label in whole:
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), id_, j, other) for j, id_, y, other in whole if j != i and len(y) == len(x))
        for p, positive, _, _ in [z for z in scored if z[3] == label][:top]:
            inside = [(n, id_) for n, id_, _, other in scored if other != label and low * -p <= 100 * -n <= high * -p][:top]
            out += [(anchor, positive, rank, id_, -p, -n) for rank, (n, id_) in enumerate(inside, 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    near = np.concatenate([centres[i % 12] + 0.1 * rng.normal(size=(1, 16)) for i in range(500)]) * rng.choice([0.3, 1.0, 4.0], size=(500, 1))
    rows = [(i, x.astype(np.float32).tolist(), int(rng.integers(4)) if i % 3 else i % 2) for i, x in enumerate(near)]
    rows += [(600 + i, [1.0 if j == i % 16 else 0.0 for j in range(16)], i % 2) for i in range(40)]  # ties
    rows += [rows[20], rows[20], rows[40], (700, None, 1), (720, [None] + [1.0] * 15, 1), (740, [math.nan] * 16, 1), (760, [math.inf] * 16, 1), (780, [1e30] * 16, 1), (800, [0.0] * 16, 1), (None, rows[1][1], 1), (820, rows[1][1], None)]
    rows += [(840, [], 1), (860, [], 2), (880, [1.0, 2.0], 1), (900, [2.0, 4.0], 1), (901, [1.0, 2.0], 2), (920, [-1.0, -2.0], 3), (921, [1.0, 2.0], 3), (940, [-0.7] * 16, 1)]
    return rows


def mined(spark, rows, every=20, schema="vec_id long, embedding array<float>, label int", **more):
    frame = spark.createDataFrame(rows, schema).withColumns({"r": F.lit("r"), "id": F.lit("id"), "v": F.lit(1)})
    return hard_negatives.hard_negatives(frame, F.col("id") % every == 0, **more)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many tiles, slices and buckets, candidates verified one by one
        for name, value in {"TILE": 5, "SLICE": 60, "FIRST_BUCKET": 4, "BUCKET": 16, "SPARSE": 1.0}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    got = sorted(map(tuple, mined(spark, rows).collect()))
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    assert got == want and len(want) > 300


def test_hard_negatives_labels_of_text_and_nothing(spark):
    rows = [(i, x, None if label is None else f"l{label}") for i, x, label in vectors()[:200]]
    got = mined(spark, rows, schema="vec_id long, embedding array<double>, label string", positives=2, negatives=3, low=50)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.where("rank > 3").count() == 0 and got.groupBy("anchor_id").agg(F.count_distinct("positive_id").alias("n")).where("n > 2").count() == 0 and got.count() > 0
    assert mined(spark, []).count() == 0 and mined(spark, [(1, [1.0], 1)]).count() == 0 and mined(spark, [(20, [1.0], 1), (1, [1.0], 1)]).count() == 0


def test_feasible_values_hold_and_prune():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(3000, 6))
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    anchor = unit[0]
    for t in (0.2, 0.6, 0.9):
        near = unit[unit @ anchor >= t]
        low, high = hard_negatives.feasible(anchor, np.full(6, t))
        assert (near >= low - 1e-12).all() and (near <= high + 1e-12).all()
    anchors = hard_negatives._Anchors(rows[:1], np.linalg.norm(rows[:1], axis=1), np.array([[0]]), np.array([[2**62]]), 5, 4)
    bucket = hard_negatives._Bucket(rows, np.linalg.norm(rows, axis=1))
    anchors.low = np.array([[0.95 * anchors.length[0] * bucket.longest]])
    whole, picked = anchors.candidates(bucket)
    assert not len(whole) and (not picked or len(picked[0][1]) < 300)


# -- chat windows --------------------------------------------------------------------------------------------------

PARTS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "\\", "\\\\", "<", ">", "[", "]", "s>", "/INST]", " ", "é", "😀", "x", "\n", "<\\s>"]


def test_template_is_reversible():
    rng, t = random.Random(6), chat_format.Template()
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        quoted = t.quote(text)
        assert not t.control.search(quoted) and t.unquote(quoted) == text
    for _ in range(1500):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "<s>"]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 5))]
        window = "".join(x for turn in turns for x in t.turn(*turn))
        assert [(r, x) for r, x, _, _ in t.turns(window)] == turns
        assert [t.unquote(window[a:b]) for _, _, a, b in t.turns(window)] == [x for _, x in turns]
    for marks in ((("user", "<a", "a>"),), (("user", "<<a>>", "<a>"),), (("user", "<\\a>", "</a>"),)):
        with pytest.raises(ValueError):
            chat_format.Template(marks=marks)
    with pytest.raises(ValueError):
        list(t.turns("[INST]never ends"))


def plain_windows(turns, budget, history_tokens, history_turns):
    """Windows of (role, text) turns, one turn after another: (picked turns, number of repeated ones, tokens)."""
    t, model = chat_format.Template(), codec(default_model())
    cost = [len(model.encode(t.turn(*x)[1])) + len(t.control.findall(t.turn(*x)[0])) + 1 for x in turns]
    head = [0] if turns and turns[0][0] == "system" else []
    out, at = [], len(head)
    if head and len(turns) == 1:
        return [([0], 0, cost[0])]
    while at < len(turns):
        room = budget - sum(cost[i] for i in head)
        back = []
        for i in range(at - 1, len(head) - 1, -1):
            kept = sum(cost[j] for j in [i, *back])
            if len(back) == history_turns or kept > history_tokens or kept + cost[at] > room:
                break
            back.insert(0, i)
        new = [at]
        while at + len(new) < len(turns) and sum(cost[i] for i in back + new) + cost[at + len(new)] <= room:
            new.append(at + len(new))
        first = not out and head
        picked = head + back + new
        out.append((picked, len(picked) - len(new) - (1 if first else 0), sum(cost[i] for i in picked)))
        at += len(new)
    return out


def conversations():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["a", "word", "longer", "[INST]", "<s>", "\\", "né", "😀"]) for _ in range(rng.randint(0, n)))
    rows = []
    for conv in range(25):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rng.randint(0 if conv % 3 == 0 else 1, 9) + (["tool"] if conv % 4 == 1 else [])
        rows += [(conv, i, role, say(60)) for i, role in enumerate(roles)]
    rows += [(50, i, ["user", "assistant"][i % 2], say(12)) for i in range(400)] + [(51, 0, "system", "be brief"), *[(51, i, ["assistant", "user"][i % 2], say(30)) for i in range(1, 300)]]
    rows += [(60, 0, "user", None), (60, 1, "assistant", ""), (60, 2, None, "no role"), (61, 0, "system", None), (62, 0, "assistant", "x " * 4000), (62, 1, "user", "ok"), (63, 5, "user", "same"), (63, 5, "user", "same"), (63, 7, "system", "late")]
    rows += [(64, None, "user", "first"), (64, 0, "assistant", "second"), (None, 0, "user", "nobody's"), (None, 1, "assistant", "answer"), (65, 0, "system", "s " * 500), (65, 1, "user", "q"), (65, 2, "assistant", "a"), (66, 0, "assistant", "long " * 400_000)]
    return rows


@pytest.mark.parametrize("segment", [chat_format.SEGMENT_BYTES, 900])
def test_chat_windows(spark, segment):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, segment int").repartition(5)
    found = chat_format.format_windows(frame, budget=120, history_tokens=40, history_turns=3, segment_bytes=segment)
    by = {}
    for r in sorted(found.collect(), key=lambda r: (r["segment"], r["window"])):
        by.setdefault(r["conv_id"], []).append(r)
    t, seen = chat_format.Template(), {}
    for conv, turn, role, text in rows:
        seen.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert by.keys() == seen.keys()
    for conv, turns in seen.items():
        turns = [x[2:] for x in sorted(turns, key=lambda x: x[:3])]
        windows = [([(r, x) for r, x, _, _ in t.turns(w["text"])], w["n_repeated"], w["tokens"]) for w in by[conv]]
        assert [x for w, n, _ in windows for x in w[n:]] == turns
        targets = [t.unquote(w["text"][s["begin"] : s["end"]]) for w in by[conv] for s in w["loss"]]
        assert targets == [x for role, x in turns if role == "assistant"]
        if segment == chat_format.SEGMENT_BYTES:
            assert windows == [([turns[i] for i in picked], n, tokens) for picked, n, tokens in plain_windows(turns, 120, 40, 3)]
        else:
            at = 0
            for w, n, tokens in windows:
                head = int(at > 0 and turns[0][0] == "system")
                assert w[:head] == turns[:head] and w[head:n] == turns[at - (n - head) : at] and n - head <= 3
                assert tokens <= 120 or len(w) - n == 1 or at == 0 and len(w) == 2
                at += len(w) - n
    assert segment > 900 or max(r["segment"] for r in by[50]) > 5
    back = {r["conv_id"]: r for r in chat_format.read_back(found).collect()}
    for conv, turns in seen.items():
        turns = [x[2:] for x in sorted(turns, key=lambda x: x[:3])]
        said = "".join(x for role, x in turns if role == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(back[conv])[1:] == (len(turns), digest("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), digest(said), sum(len(w["text"]) for w in by[conv]))


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.format_windows(none).count() == 0 and chat_format.read_back(chat_format.format_windows(none)).count() == 0


# -- importance resampling -----------------------------------------------------------------------------------------


def plain_features(text, ngram=2):
    words, now = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not c.isalnum():
            words, now = words + [now] if now else words, ""
        else:
            now += c
    words += [now] if now else []
    return words, [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("ngram,piece", [(2, 1 << 20), (3, 64)])
def test_resampling(spark, docs, rows, monkeypatch, ngram, piece):
    monkeypatch.setattr(resampling.pieces, "__defaults__", (piece,))
    goal = [rows[3][1], rows[40][1], "straße and the Haus", None]
    target = spark.createDataFrame([(i, x) for i, x in enumerate(goal)], "item_id long, text string")
    got = resampling.resample(docs, target, buckets=500, ngram=ngram).collect()
    bucket = lambda x: zlib.crc32(x.encode()) % 500
    s, t = [0] * 500, [0] * 500
    for table, texts in ((s, [x for _, x in rows]), (t, goal)):
        for x in texts:
            for f in plain_features(x, ngram)[1]:
                table[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 500) / ((a + 1) * (sum(t) + 500)))) for a, b in zip(s, t)]
    want = []
    for doc, text in rows:
        words, found = plain_features(text, ngram)
        weight = math.floor(sum(gain[bucket(f)] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        want.append((doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score"))) for r in got)
    able = sorted([w for w in want if w[1] >= 20], key=lambda w: (-w[4], w[0] is None, w[0] or 0))[: sum(w[1] >= 20 for w in want) * 25 // 100]
    ranked = sorted([r for r in got if r["rank"] is not None], key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(able) + 1)) and [(r["doc_id"], r["score"]) for r in ranked] == [(w[0], w[4]) for w in able]
    sample = resampling.resample(docs, target, buckets=500, ngram=ngram)
    kept = resampling.drawn(docs, sample)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {w[0] for w in able}


def test_resampling_nothing(spark, none, docs):
    assert resampling.resample(none, none).count() == 0
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(docs, empty).count() == docs.count()


def test_words_over_pieces():
    text = ("ab" * 3000 + " Cd,é " * 500 + "x" * 5000).encode()
    for size in (16, 1000, 1 << 20):
        assert [w for part in resampling.pieces(text, size) for w in part] == text.translate(resampling.BLANKS).split()
