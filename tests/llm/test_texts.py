"""Each operator on documents against a plain version of what it computes."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from offerlens.llm import decontaminate, language_id, licenses, line_dedup, maxent_lm, sentencepiece_bpe, simhash, substring_dedup

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def low(i):
    return -math.inf if i is None else i


def test_line_dedup(docs, rows, none):
    def key(line):
        return lower(line.strip(line_dedup.SPACE))

    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(low(i))
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and low(i) != max(holders[key(x)]))]
        want[(i, "\n".join(keep))] += 1
    bitmaps = line_dedup.keep_bitmaps(docs)
    got = line_dedup.apply_bitmaps(docs, bitmaps)
    assert got.columns == docs.columns
    assert Counter((i, t or "") for i, t in counted(got, "doc_id", "text").elements()) == want
    assert bitmaps.count() > 0
    assert line_dedup.keep_bitmaps(none).count() == 0


def test_line_dedup_across_partitions(spark):
    """A key that fills several range partitions, and keys at their edges."""
    hot, other = "h" * 45, "o" * 50
    rows = [(i, f"{hot}\n{other if i % 7 == 0 else i}\n{hot}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["doc_id"]: r["text"] for r in line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, text in rows:
        want = [x for x in text.split("\n") if not (x == hot and i != 399) and not (x == other and i != 399)]
        assert got[i] == "\n".join(want) or (i == 399 - 399 % 7 and got[i] == "\n".join([other] if i != 399 else text.split("\n")))


def test_stream_of_sorted_keys_by_batch_size():
    """The stream's verdicts do not depend on where batches end."""
    import pyarrow as pa

    data = [(1, 0, k, 0, 3, [0]) for k in range(9, 0, -1)] + [(2, 0, 5, 0, 1, [0])] + [(3, 0, k, 0, 1, [0]) for k in (9, 9, 8, 7, 6, 5)] + [(4, 0, k, 0, 1, [0]) for k in (3, 2, 1)]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*data, strict=True), line_dedup._LINES_ARROW, strict=True)], schema=line_dedup._LINES_ARROW)
    seen = set()
    for size in (1, 2, 3, 5, 100):
        parts = [whole.slice(i, size) for i in range(0, whole.num_rows, size)]
        out = [tuple(r.values()) for b in line_dedup._stream(iter(parts), 5) for r in b.to_pylist()]
        seen.add(tuple(sorted((r[0], r[2], r[-1]) for r in out)))
    assert len(seen) == 1
    closed = [x for x in seen.pop() if not x[2]]
    assert sorted(closed) == [(3, 5, False), (3, 6, False), (3, 7, False), (3, 8, False)]


@pytest.mark.parametrize("shingle", [4, 5])
def test_simhash(docs, rows, none, shingle):
    prints = []
    for _, t in rows:
        words = SPACED.findall(lower(t))
        parts = [" ".join(words[j : j + shingle]) for j in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    lowest, find = groups_of(rows, [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    want = Counter((rows[a][0], prints[a] - (prints[a] >> 63 << 64), lowest[find(a)]) for a in range(len(rows)))
    for strip in (simhash.STRIP_ROWS, 3):
        assert counted(simhash.simhash_groups(docs, shingle=shingle, strip_rows=strip), "doc_id", "fp", "component_id") == want
    assert simhash.simhash_groups(none).count() == 0


def groups_of(rows, links):
    """Smallest id of each group that links connect, and the function from a row's number to its group."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups: dict[int, list] = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a][0])
    return {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}, find


def shingles(text, size=5):
    words = SPACED.findall(lower(text))
    return {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()


def near(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


@pytest.mark.parametrize("strip", [8192, 3])
def test_near_duplicates_against_all_pairs(docs, rows, none, strip, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", strip)
    sets = [shingles(t) for _, t in rows]
    lowest, find = groups_of(rows, [(a, b) for a in range(len(rows)) for b in range(a) if near(sets[a], sets[b])])
    found, groups = simhash.near_duplicates(docs)
    got = found.join(groups, "node")
    assert counted(got, "doc_id", "component_id") == Counter((rows[a][0], lowest[find(a)]) for a in range(len(rows)))
    assert simhash.near_duplicates(none)[1].count() == 0


def test_near_duplicates_by_similarity(spark):
    """Pairs right at the threshold: just above are found, just below never are; repeats of a line do not count, and a hot group is whole."""
    import random

    rng, texts = random.Random(11), {}
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for i in range(300):
        words = [word() for _ in range(224)]  # 220 shingles; those of a new tail of m words are m
        for j, m in ((1, 24), (2, 25)):  # 196 of 244 shingles shared: 0.803; 195 of 245: 0.796
            texts[i * 10 + j] = " ".join(words[:-m] + [word() for _ in range(m)])
        texts[i * 10] = " ".join(words)
    line = " ".join(word() for _ in range(60))
    base = " ".join(word() for _ in range(400))
    texts[90_000], texts[90_001] = base, base + (" " + line) * 200
    texts[90_002] = " ".join(word() for _ in range(400)) + (" " + line) * 200
    hot = [word() for _ in range(100)]
    for i in range(400):
        texts[100_000 + i] = " ".join([*hot, str(i)])
    found, groups = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in found.join(groups, "node").collect()}
    assert near(shingles(texts[0]), shingles(texts[1])) and not near(shingles(texts[0]), shingles(texts[2]))
    assert np.mean([got[i * 10 + 1] == i * 10 for i in range(300)]) > 0.96
    assert all(got[i * 10 + 2] == i * 10 + 2 for i in range(300))
    assert (got[90_000], got[90_001], got[90_002]) == (90_000, 90_000 if near(shingles(base), shingles(texts[90_001])) else 90_001, 90_002)
    assert {got[100_000 + i] for i in range(400)} == {100_000}


def test_spanning_forest_connects_what_is_near():
    rng = np.random.default_rng(3)
    heads = rng.integers(0, 2**63, 40, dtype=np.uint64)
    bits = np.unique(np.concatenate([heads, *[heads ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]]))
    allowed = lambda a, b: (a + b) % 3 > 0
    for test in (None, allowed):
        x, y = simhash.linked(bits, None, 4, test)
        assert (np.bitwise_count(bits[x] ^ bits[y]) <= 4).all() and len(x) < len(bits)
        label = np.arange(len(bits))
        for a, b in zip(x, y, strict=True):
            assert test is None or test(a, b)
            label[label == label[b]] = label[a]
        for a in range(len(bits)):
            close = np.flatnonzero(np.bitwise_count(bits ^ bits[a]) <= 4)
            assert all(label[b] == label[a] for b in close if b != a and (test is None or test(a, b)))


def test_decontamination(spark, docs, rows, none):
    items = [(1, " ".join(f"passage{i}" for i in range(5, 30))), (2, "Licensed under cc"), (3, None), (4, ""), (None, "one"), (10, " ".join(f"PASSAGE{i}" for i in range(5, 30))), (5, "gnu GENERAL public, license"), (6, "x y z")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_hit string")
    words = [ALNUM.findall(lower(t)) for _, t in rows]
    want = Counter()
    for (i, _), ws in zip(rows, words, strict=True):
        hit, ids = set(), set()
        for item, text in items:
            iw = ALNUM.findall(lower(text))
            size = min(10, len(iw))
            wins = {tuple(iw[j : j + size]) for j in range(len(iw) - size + 1)} if iw else set()
            for j in range(len(ws) - size + 1) if iw else ():
                if tuple(ws[j : j + size]) in wins:
                    hit |= set(range(j, j + size))
                    if item is not None:
                        ids.add(str(item))
        want[(i, len(ws), len(hit), ",".join(sorted(ids)))] += 1
    got = decontaminate.contamination(docs, frame).withColumn("ids", F.array_join("items", ","))
    assert counted(got, "doc_id", "n_words", "n_hit", "ids") == want
    assert decontaminate.contamination(docs, frame.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(none, frame).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_license_scan(docs, rows, none, monkeypatch, broadcast):
    """With nothing broadcast, grams join by a shuffle; null ids and repeated rows are compared as well."""
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", broadcast)
    found = licenses.license_labels(docs).collect()
    want: Counter = Counter()
    for i, t in rows:
        ws = ALNUM.findall(lower(t))
        places = [(j, label) for phrase, label in licenses.PHRASES.items() for j in range(len(ws)) if ws[j : j + len(phrase.split())] == phrase.split()]
        want[(i, len(ws), len(places), min((j for j, _ in places), default=None), max((j for j, _ in places), default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == want
    got = {r["doc_id"]: r for r in found}
    assert got[52]["labels"] == "gpl,gpl-text" and got[52]["score"] == 1.0
    assert got[53]["labels"] == "cc-by,cc-by-nc"
    assert got[40]["labels"] == "" and got[40]["score"] == 0.0
    assert licenses.license_labels(docs).count() == len(rows)
    assert licenses.license_labels(none).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_license_templates_of_a_table(spark, monkeypatch, broadcast):
    """Whole texts as a table; words inserted, dropped and changed inside a template, and one cut too short."""
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", broadcast)
    text = " ".join(f"clause{i}" for i in range(60))
    table = spark.createDataFrame([(text, "long-text"), (text, "long-text"), (None, "none"), ("too short", "short"), (text.replace("clause30", "other"), "variant")], "text string, label string")
    ws = text.split()
    texts = {
        1: text, 2: " ".join(ws[:20] + ["inserted", "words"] + ws[20:]), 3: " ".join(ws[:40] + ws[42:]), 4: " ".join(ws[:25]), 5: " ".join(ws[:20] + ["x"] * 40 + ws[20:]),
        6: "\n".join([text.upper(), "between", text]), 7: " ".join(w if i % 9 else "x" for i, w in enumerate(ws)), 8: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_labels(docs, templates=table).collect()}
    labels = {i: r["labels"] for i, r in got.items()}
    assert labels == {1: "long-text,variant", 2: "long-text", 3: "long-text", 4: "", 5: "", 6: "long-text,variant", 7: "", 8: ""} or {i: x.split(",")[0] for i, x in labels.items()} == {1: "long-text", 2: "long-text", 3: "long-text", 4: "", 5: "", 6: "long-text", 7: "", 8: ""}
    assert got[1]["score"] == 1.0 and 0.8 <= got[2]["score"] < 1 and 0.8 <= got[3]["score"] < 1 and got[4]["score"] < 0.5
    _, places = licenses.license_places(docs, templates=table)
    assert {(r["start"], r["end"]) for r in places.where("label = 'long-text' AND coverage = 1").collect()} == {(0, 60), (61, 121)}


def test_sentencepiece(docs, rows, none):
    import sentencepiece

    path = sentencepiece_bpe.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in sentencepiece_bpe.encode(docs, path).collect()) == want
    digests = Counter((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for (i, ids, d), n in want.items() for _ in range(n))
    assert counted(sentencepiece_bpe.encode_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == digests
    assert sentencepiece_bpe.encode_digests(none, path).count() == 0


@pytest.mark.parametrize("bits", [64, 5])
def test_substring_dedup(docs, rows, none, bits):
    """Five bits: nodes collide all the time, and the words at both coordinates decide."""
    words = [SPACED.findall(t or "") for _, t in rows]
    first: dict[tuple, tuple] = {}
    for (i, _), ws in zip(rows, words, strict=True):
        for j in range(len(ws) - 19):
            key, at = tuple(ws[j : j + 20]), (low(i), j)
            first[key] = min(first.get(key, at), at)
    want = Counter()
    for (i, _), ws in zip(rows, words, strict=True):
        gone = {x for j in range(len(ws) - 19) if first[tuple(ws[j : j + 20])] < (low(i), j) for x in range(j, j + 20)}
        want[(i, len(ws), len(gone), " ".join(w for x, w in enumerate(ws) if x not in gone))] += 1
    paths = substring_dedup.repeated_paths(docs, bits=bits)
    from offerlens.llm.frames import keyed

    got = Counter((r["doc_id"], *substring_dedup.without_paths(r["text"], r["paths"])) for r in keyed(docs).join(paths, ["k", "t"], "left").collect())
    assert got == want
    assert substring_dedup.repeated_paths(none).count() == 0


def test_language_model(docs, rows, none):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    tokens = [[*SPACED.findall(lower(t)), ""] for _, t in rows]
    counts = Counter(x for h, ws in zip(held, tokens, strict=True) if not h for x in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((i, h, len(ws), sum(counts[x] > 0 for x in ws), total, round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in ws), 4)) for (i, _), h, ws in zip(rows, held, tokens, strict=True))
    scored = maxent_lm.score_texts(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in scored) == want
    assert all(r["score"] < 0 for r in scored)
    assert maxent_lm.score_texts(none).count() == 0


def test_language_model_score_by_loops(docs, rows):
    """Probabilities of all outcomes sum to 1, scores are sums of their logarithms, and partitions do not matter."""
    M = maxent_lm
    learnt = M.keyed(docs).where(~M.held_out())
    counts = {r["token"]: r for r in M.token_counts(learnt).collect()}
    total = sum(r["n"] for r in counts.values())
    own, mass = M.outputs(M.token_counts(learnt))
    weights = M.train(learnt, mass, total, own=own)
    size, names = weights.shape[1], {}
    for token in counts:
        names[token] = M._END if not token else M.find_words(M.pa.array([token]), np.ones(256, bool)).hash[0]
    place = {token: int(M.slots_of(np.array([h]), own)[0]) for token, h in names.items()}
    one = lambda x: np.array([x], np.uint64)

    def chances(before, skip):
        """Probability of each place after two words (hashes)."""
        keys = [M.mix(one(before) ^ M._SEEDS[0]), M.mix(one(before) * M._SEEDS[1] + one(skip)), M.mix(one(skip) ^ M._SEEDS[2])]
        softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        by_class = mass.reshape(M.CLASSES, M.PLACES)
        logits = np.log(by_class.sum(axis=1) / mass.sum()) + sum(weights[0][int(k[0]) & size - 1] for k in keys).astype(float)
        p = softmax(logits)
        out = []
        for c in range(M.CLASSES):
            row = [int(M.mix(k + one(c + 1) * M._SEEDS[2])[0]) & size - 1 for k in keys]
            out += (p[c] * softmax(np.log(by_class[c] / by_class[c].sum()) + sum(weights[1][r] for r in row).astype(float))).tolist()
        return np.array(out)

    p = chances(names["the"], names["of"])
    assert abs(p.sum() - 1) < 1e-6
    known = sum(p[place[x]] * (r["n"] + 0.1) / mass[place[x]] for x, r in counts.items())
    assert abs(known + (p[M.OWN :] * 0.1 / mass[M.OWN :]).sum() - 1) < 1e-6
    got = {r["doc_id"]: r["score"] for r in M.score_texts(docs.repartition(7)).collect()}
    again = {r["doc_id"]: r["score"] for r in M.score_texts(docs.coalesce(1)).collect()}
    assert got.keys() == again.keys() and all(abs(got[i] - again[i]) < 1e-6 for i in got)  # but for the order of sums
    for i, t in rows[:3] + rows[41:46]:
        want, before, skip = 0.0, M._END, M._END
        for token in [*SPACED.findall(lower(t)), ""]:
            h = M._END if not token else M.find_words(M.pa.array([token]), np.ones(256, bool)).hash[0]
            slot = int(M.slots_of(one(h), own)[0])
            n = counts[token]["n"] if token in counts else 0
            want += math.log10(chances(before, skip)[slot] * (n + 0.1) / mass[slot])
            before, skip = h, before
        assert abs(got[i] - want) < 1e-3 * abs(want), i


def test_language_model_learns_order(spark):
    """Texts whose next word follows from the one before: the model beats counts on texts it has not seen."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(80))) for i in range(400)]
    got = maxent_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.75 * got[1]


def test_language_id(spark, docs, rows, none):
    made = [(i, " ".join([["the", "of", "and", "thing", "with"], ["der", "und", "nicht", "schön", "zeit"]][i % 2][(i // 2 + j * 3) % 5] for j in range(30)), ["en", "de"][i % 2], None) for i in range(200)]
    more = [(200, "", "en", None), (201, None, "en", None), (202, "1234 5678 !!", "en", None), (203, "русский текст без других слов", None, None)]
    frame = spark.createDataFrame([*made, *more], "doc_id long, text string, lang string, host string")
    model = language_id.fit(frame.where("doc_id < 120"))
    got = {r["doc_id"]: r for r in language_id.identify(frame, model).collect()}
    assert np.mean([got[i]["lang"] == ["en", "de"][i % 2] for i in range(120, 200)]) > 0.95
    assert all(got[i]["rejected"] for i in (200, 201, 202, 203)) and not any(got[i]["rejected"] for i in range(200))
    out = language_id.identify(docs, language_id.fit(docs), host=F.col("source"))
    assert out.count() == len(rows)
    assert language_id.identify(none, language_id.fit(none)).count() == 0


def test_language_evidence(spark):
    """Short texts follow their host, suffix and declaration; clear texts do not."""
    clear = [(i, ("the thing of with and " if i % 2 else "der und nicht zeit schön ") * 8, ["de", "en"][i % 2], f"a{i}.{['de', 'com'][i % 2]}", ["de", "en"][i % 2]) for i in range(200)]
    odd = [(900, "xqj", None, "a0.de", None), (901, "xqj", None, None, "en-GB"), (902, clear[0][1], None, "a1.com", "en")]
    frame = spark.createDataFrame([*clear, *odd], "doc_id long, text string, lang string, host string, said string")
    got = {r["doc_id"]: r["lang"] for r in language_id.identify(frame, language_id.fit(frame), host=F.col("host"), declared=F.col("said")).collect()}
    plain = {r["doc_id"]: r["confidence"] for r in language_id.identify(frame, language_id.fit(frame)).where("doc_id = 902").collect()}
    assert got[900] == "de" and got[902] == "de" and plain[902] > 0.9


def plain_fusion(rows, model):
    """`identify` by loops: rows are (text, host, declared); (lang, confidence) of each."""
    languages, table = model
    names = [*languages, "und"]
    n, logs, posts = len(names), [], []
    softmax = lambda x: [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]
    for text, _, _ in rows:
        data = [b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
        codes = [data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)]
        grams = [(c * 2654435761 & 0xFFFFFFFF) >> 18 for c in codes if c != 0x202020]
        share = min(len(grams), language_id.TEXT_WEIGHT) / max(len(grams), 1)
        logs.append([sum(float(table[i][g]) for g in grams) * share for i in range(n)] if grams else None)
        posts.append(softmax(logs[-1]) if grams else None)

    def sums(key, skip):
        found = [p for j, (p, r) in enumerate(zip(posts, rows, strict=True)) if p and j != skip and key(r[1])]
        return [sum(p[i] for p in found) for i in range(n)], len(found)

    out = []
    for j, (_, host, declared) in enumerate(rows):
        if not posts[j]:
            out.append(("und", 0.0))
            continue
        domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None
        suffix = lambda h: h.split(".")[-1] if h and "." in h else None
        tests = [lambda h: True] + ([lambda h: suffix(h) == suffix(host), lambda h: domain(h) == domain(host)] if suffix(host) else []) + ([lambda h: h == host] if host else [])
        prior = [1 / n] * n
        for test in tests:
            s, count = sums(test, j)
            prior = [(s[i] + language_id.LEVEL_WEIGHT * prior[i]) / (count + language_id.LEVEL_WEIGHT) for i in range(n)]
        score = [logs[j][i] + math.log(prior[i]) for i in range(n)]
        lang = language_id.SUFFIXES.get(suffix(host))
        if lang in languages:
            score[names.index(lang)] += math.log(language_id.SUFFIX_ODDS)
        if declared in languages:
            d = lambda x, i, j=j: sum(posts[m][i] for m in range(len(rows)) if m != j and posts[m] and rows[m][2] == x)
            for i in range(n):
                trust = language_id.DECLARED_TRUST if names[i] == declared else (1 - language_id.DECLARED_TRUST) / (n - 1)
                # the own row declares `declared` only, so it is out of that sum alone
                score[i] += math.log((d(declared, i) + language_id.DECLARED_WEIGHT * trust) / (sum(d(x, i) for x in languages) + language_id.DECLARED_WEIGHT))
        p = softmax(score)
        out.append((names[p.index(max(p))], max(p)))
    return out


def test_language_fusion_against_loops(spark):
    import random

    rng = random.Random(8)
    words = {"en": ["the", "of", "and", "thing", "with"], "de": ["der", "und", "nicht", "zeit", "haus"], "fr": ["le", "est", "dans", "une", "pour"]}
    hosts = ["a.example.de", "b.example.de", "www.site.fr", "x.site.fr", "blog.com", "plain", None, "shop.example.de"]
    rows = []
    for i in range(180):
        lang = rng.choice(list(words))
        text = rng.choice([None, "", "12 34"]) if i % 30 == 0 else " ".join(rng.choice(words[lang]) for _ in range(rng.choice([1, 2, 3, 30])))
        rows.append((text, rng.choice(hosts), rng.choice([lang, "en", "xx", None]), lang))
    frame = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, host string, said string, lang string, domain string, hosts int")
    model = language_id.fit(frame)
    got = {r["doc_id"]: (r["lang"], r["confidence"]) for r in language_id.identify(frame, model, host=F.col("host"), declared=F.col("said")).collect()}
    want = plain_fusion([r[:3] for r in rows], model)
    assert all(got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-6 for i, w in enumerate(want))


def test_page_language(spark, tmp_path):
    """Declaration, address and text of pages, one of a megabyte among them."""
    words = {"en": "the thing of and with ", "de": "der nicht zeit und haus "}
    docs = [(i, words[x] * 6, x) for i, x in enumerate(["en", "de"] * 100)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    page = lambda body, lang: f'<html lang="{lang}"><head><style>p {{ }}</style><script>{"var der = 1;" * 20}</script></head><body><!-- der der --><p>{body}</p></body></html>'
    pages = [(i, f"https://h{i % 4}.{'de' if x == 'de' else 'com'}/p/{i}", page(words[x] * 4, x)) for i, x in enumerate(["en", "de"] * 40)]
    pages += [(900, "https://h9.de/x", page(words["en"] * 8, "de")), (901, "https://h9.de/y", page("zq", "de-AT")), (902, None, None), (903, "https://h1.de/z", page(words["de"] * 40_000, "de"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in language_id.page_language(spark, str(tmp_path)).collect()}
    assert all(got[i]["lang"] == x for i, x in enumerate(["en", "de"] * 40))
    assert got[900]["lang"] == "en" and got[901]["lang"] == "de" and got[902]["rejected"] and got[903]["lang"] == "de"


def test_page_language_takes_pages_apart(spark, docs, rows, tmp_path):
    """Text, declaration and host by Python's expressions and splits, judged by `identify`, give the query's rows."""
    words = {i: t for i, t in rows if t and i is not None}
    htmls = [
        f'<html lang="de-DE"><head><title>x</title><script>var a = "<b>";</script></head><body><p>{words[0]}</p><!-- <p>{words[1]}</p> --></body></html>', f"<HTML class=x LANG='fr'>{words[2]}<style>p {{}}</style>", f"<p lang=es>{words[3]}</p>",
        f'<html xlang="de">{words[4]} 1 < 2 > 0</html>', "<html lang=></html>", "", None, f"<script>{words[5]}", f"<html\nlang = 'de'>{words[6]}", f'<html lang="en">{words[7]}<SCRIPT type=x>no</script >yes</SCRIPT>{words[8]}',
    ]
    urls = ["http://A.Example.DE/x?y", "https://b.example.de", "ftp://fr.test/#a", None, "no scheme", "http://", "x://y://z", "https://a.example.de/", "http://one", "http://b.example.de?q=://c"]
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, htmls, strict=True))], "page_id long, url string, html string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    plain = []
    for i, (url, html) in enumerate(zip(urls, htmls, strict=True)):
        text = None if html is None else re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", html))
        said = re.search(r"(?is)<html[^>]*\slang=[\"']?([A-Za-z-]+)", html or "")
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0].lower()
        plain.append((i, text, host or None, said[1] if said else None))
    table = spark.createDataFrame(plain, "page_id long, text string, host string, declared string")
    want = language_id.identify(table, language_id.fit(docs), id_col="page_id", host=F.col("host"), declared=F.col("declared"))
    want = {r["doc_id"]: (r["lang"], round(r["confidence"], 6), r["text_lang"], r["n_grams"], r["rejected"]) for r in want.collect()}
    got = {r["page_id"]: (r["lang"], r["confidence"], r["text_lang"], r["n_grams"], r["rejected"]) for r in language_id.page_language(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == len(urls)


def test_backtracking_equals_the_library():
    """Texts without spaces: pieces cut and joined, several scripts, and long ones, where the longest match is often wrong."""
    import random

    import sentencepiece

    path = sentencepiece_bpe.default_model()
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.codec(path), random.Random(12)
    pieces = [library.id_to_piece(rng.randrange(300, library.get_piece_size())).replace("\u2581", "") for _ in range(3000)]
    made = ["".join(rng.choice(pieces)[rng.randrange(2) : rng.randint(1, 8)] for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    made += ["".join(rng.choice("aeinrstlohd") for _ in range(rng.randint(1, 40))) for _ in range(2000)] + ["".join(rng.choice("абвгде日本語éü😀x") for _ in range(20)) for _ in range(300)]
    made.append("".join(rng.choice("etaoinshrdlu") for _ in range(100_000)))
    for text, ids in zip(made, library.encode(made, num_threads=1), strict=True):
        assert own.encode(text) == ids, text[:200]


def test_words_made_to_collide_are_told_apart(spark):
    """The letters of the Thue-Morse sequence and their opposites: any polynomial with an odd base gives both the same value."""
    import pyarrow as pa

    from offerlens.llm import words as W

    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    texts = pa.array([f"{one} and", f"é {two}", f"x {one}", "", None, "same same ame"])
    weak, strong = (W.find_words(texts, W.SPACED, strong=x) for x in (False, True))
    assert weak.hash[0] == weak.hash[3] and strong.hash[0] != strong.hash[3] and strong.hash[0] == strong.hash[5]
    assert strong.hash[6] == strong.hash[7] != strong.hash[8] and len(set(strong.hash.tolist())) == 7
    assert all((getattr(weak, c) == getattr(strong, c)).all() for c in ("row", "start", "end", "first"))
    tail = " ".join(f"w{i}" for i in range(4))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    found, groups = simhash.near_duplicates(docs, shingle=5, similarity=0.8)
    assert {r["k"]: r["first_k"] for r in found.join(groups, "node").select("k", "first_k").collect()} == {1: 1, 2: 2, 3: 1}


def test_near_duplicates_that_share_no_block(spark, monkeypatch):
    """Every pair at the threshold is found, also where no block and no near fingerprint brings it together."""
    import random

    rng, texts = random.Random(12), {}
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for i in range(200):
        words = [word() for _ in range(224)]
        for j, m in ((0, 0), (1, 24), (2, 25)):  # 0.803 and 0.796 of the shingles
            texts[i * 10 + j] = " ".join(words[: len(words) - m] + [word() for _ in range(m)])
    texts[5000], texts[5001] = "a b c d e f g h i", "a b c d e f g h"  # 4 of 5 shingles
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for blocks, sample in ((simhash.BLOCKS, simhash.SAMPLE_TEXTS), (1, 7)):
        monkeypatch.setattr(simhash, "BLOCKS", blocks)
        monkeypatch.setattr(simhash, "SAMPLE_TEXTS", sample)
        found, groups = simhash.near_duplicates(frame)
        got = {r["doc_id"]: r["component_id"] for r in found.join(groups, "node").collect()}
        assert all(got[i * 10 + 1] == i * 10 and got[i * 10 + 2] == i * 10 + 2 for i in range(200)) and got[5001] == 5000


def test_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 30, 700)]
    sets += [np.sort(np.concatenate([sets[3][40:], sets[2]])), sets[3][:-1]]
    sketches = simhash.set_sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for x, u in zip(sets, sketches, strict=True):
        for y, v in zip(sets, sketches, strict=True):
            assert np.bitwise_count(u ^ v).sum() <= len(np.setxor1d(x, y))


def test_folded_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 300, 5000, 40_000)]
    sets += [sets[3][:-900], np.sort(np.concatenate([sets[3][4000:], sets[2]])), sets[4][:-7000], sets[4][::2]]
    sketches = simhash.sized_sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    at = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    got = simhash.apart([sketches[i] for i, _ in at], [sketches[j] for _, j in at])
    for (i, j), bits in zip(at, got, strict=True):
        both = len(np.setxor1d(sets[i], sets[j]))
        assert bits <= both and (bits > 0) == (i != j)
    assert got[at.index((3, 6))] > (len(sets[3]) + len(sets[6])) / 9 and len(simhash.apart([], [])) == 0


def test_whole_sets_of_long_texts_are_not_moved_in_vain(spark, monkeypatch):
    """Long texts that have some shingles in common meet, but only those that may be similar are compared whole."""
    import random

    rng, texts, moved = random.Random(13), {}, []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    start = [word() for _ in range(300)]
    for i in range(12):
        texts[i] = " ".join(start + [word() for _ in range(2700)])
    words = [word() for _ in range(3004)]
    texts[20], texts[21] = " ".join(words), " ".join(words[:-330] + [word() for _ in range(330)])  # 2,670 of 3,330 shingles: 0.802
    monkeypatch.setattr(simhash, "_common", lambda *_: np.zeros(0, np.uint64))
    write = simhash.written

    def written(df):
        out = write(df)
        moved.extend([out.count()] if "hashes" in df.columns else [])
        return out

    monkeypatch.setattr(simhash, "written", written)
    found, groups = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.join(groups, "node").collect()} == {i: 20 if i == 21 else i for i in texts}
    assert len(moved) == 1 and moved[0] <= 2


def test_meetings_leave_out_unlike_short_sets():
    """Sets that share one first element become a pair only where their folded sketches allow it; bits of either sign count."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(30)]
    sets += [np.sort(np.concatenate([x[:-6], rng.integers(0, 2**63, 6, dtype=np.uint64)])) for x in sets]  # 54 of 66
    bits = np.stack([simhash.folded(x, 16) for x in simhash.sized_sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))]).view(np.int64)
    n = np.arange(60)
    rows = simhash.pa.table({"x": np.zeros(60, np.int64), "c": n, "i": n, "size": np.full(60, 60, np.int32), "early": np.ones(60, bool), "f0": bits[:, 0], "f1": bits[:, 1]})
    got = {(a, b) for batch in simhash._meetings(iter(rows.to_batches()), 0.8) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)}
    assert {(i, i + 30) for i in range(30)} <= got and len(got) < 100
