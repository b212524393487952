"""Operators on vectors and urls, components, and the pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from offerlens.llm import embedding_dedup, url_filters


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) * 3
    near = embedding_dedup.e8_nearest(x) / 2
    others = near[:, None] + embedding_dedup.ROOTS[None] / 2
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-9).all()
    assert len(embedding_dedup.ROOTS) == 240 and set((embedding_dedup.ROOTS**2).sum(1)) == {8}


def test_embedding_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    near = np.concatenate([base[:5] + 0.15 * rng.normal(size=(5, 64)) for _ in range(40)])
    x = np.concatenate([base, near, base[7:9]]).astype(np.float32)
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    inf = [float("inf")] + [1.0] * 63
    rows += [(900, None, 1, "c"), (901, [0.0] * 64, 1, "c"), (902, [None] + [1.0] * 63, 1, "c"), (903, inf, 1, "c"), (904, inf, 1, "c"), (905, [], 1, "c"), (906, [1.0, 2.0], 1, "c"), (907, [2.0, 4.0], 1, "c"), (7, x[7].tolist(), 1, "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = embedding_dedup.embedding_groups(frame).collect()
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    u = np.concatenate([u, u[7:8]])
    want = (u @ u.T >= 0.9).sum(1) - 1
    have = {r["vec_id"]: r for r in got if r["vec_id"] < 900}
    links = np.array([have[i]["n_links"] for i in range(len(x))])
    assert (links <= want[: len(x)]).all() and links.sum() >= 0.98 * want[: len(x)].sum()
    odd = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] >= 900}
    assert all(odd[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905))
    assert odd[906] == (1, 906, True) and odd[907] == (1, 906, False)
    assert embedding_dedup.embedding_groups(frame.limit(0)).count() == 0


def test_crowded_cells_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=64) + 0.02 * rng.normal(size=(150, 64))).astype(np.float32)
    got = embedding_dedup.embedding_groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in got} == {149} and {r["component_id"] for r in got} == {0}


URLS = ["http://A.example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2#t", "http://x.com/fr/9", "http://x.com/de/9/", "http://x.com/fr", "http://net/fr/1", None, "", "no scheme/de/1", "ftp://notexample.org/es/1", "http://x.com/en/7.html", "http://x.com/en/8.html", "x://y://z/de/1", "http://org"]


def test_url_rules(spark):
    frame = spark.createDataFrame([(i, u, "v", "t") for i, u in enumerate(URLS)] + [(3, URLS[3], "v", "t")], "page_id long, url string, verdict string, template string")
    got = {r["page_id"]: r for r in url_filters.judge_urls(frame).collect()}
    for i, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(h + p, k) for k, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert url_filters.judge_urls(frame).count() == len(URLS) + 1
    assert url_filters.judge_urls(frame.limit(0)).count() == 0


def test_url_templates_follow_their_labels(spark):
    rules = [("block", "bad.test", "/a/"), ("allow", "good.test", "/a/")]
    urls = [f"http://{h}/{s}/{i}" for h in ("bad.test", "good.test", "mixed.test") for s in ("a", "b") for i in range(30)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judge_urls(frame, rules=rules).groupBy("host", "template").agg(F.collect_set("verdict").alias("v")).collect()
    seen = {(r["host"], r["template"]): r["v"] for r in got}
    assert set(seen) == {(h, f"/{s}/{{n}}") for h in ("bad.test", "good.test", "mixed.test") for s in "ab"}
    assert all(seen["bad.test", f"/{s}/{{n}}"] == ["block"] and seen["good.test", f"/{s}/{{n}}"] == ["allow"] for s in "ab")


def test_url_tree_at_every_level(spark):
    """Wildcards and merges at the second and third segments, a path deeper than the tree, and hosts whose branches differ."""
    rules = [("block", "x.test", "/shop/bad"), ("allow", "x.test", "/shop/good"), ("block", "y.test", "/a/p/"), ("block", "y.test", "/a/q/"), ("allow", "y.test", "/a/r/")]
    urls = [f"http://w.test/shop/word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/item" for i in range(600)]
    urls += [f"http://v.test/en/news/{chr(97 + i % 26)}{chr(97 + i // 26)}-story" for i in range(300)]
    urls += [f"http://y.test/a/{s}/{i}" for s in "pqrs" for i in range(40)] + ["http://z.test/" + "/".join("abcdefgh") * 6, "http://z.test/", "http://z.test"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filters.judge_urls(frame, rules=rules, levels=8).collect()
    of = lambda host: {r["template"] for r in rows if r["host"] == host}
    assert of("w.test") == {"/shop/{w}/item"} and of("v.test") == {"/en/news/{w}"}
    assert of("y.test") == {"/a/*/{n}", "/a/r/{n}", "/a/s/{n}"}  # p and q are both blocked wholly, s has no labels
    assert {r["verdict"] for r in rows if r["template"] == "/a/*/{n}"} == {"block"} and {r["verdict"] for r in rows if r["template"] == "/a/r/{n}"} == {"allow"}
    assert len(of("z.test")) == 2 and "/" in of("z.test")
    # branches of one share merge: half of each is blocked
    mixed = [("block", "m.test", f"/{s}/x") for s in "abc"] + [("allow", "m.test", f"/{s}/y") for s in "abc"]
    urls = [f"http://m.test/{s}/{c}/{i}" for s in "abc" for c in "xyz" for i in range(20)]
    got = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=mixed).collect()
    assert {r["template"] for r in got} == {"/*/x/{n}", "/*/y/{n}", "/*/z/{n}"}
    assert {(r["template"], r["verdict"]) for r in got if "z" not in r["template"]} == {("/*/x/{n}", "block"), ("/*/y/{n}", "allow")}


def test_url_groups_of_like_branches(spark):
    """Two groups of siblings merge, each on its own; one between them that is like neither stays alone; a line feed makes no number."""
    share = {"a": 0, "b": 0, "c": 20, "d": 20, "e": 10}
    rules = [("block" if i < n else "allow", "g.test", f"/{s}/v{chr(97 + i)}") for s, n in share.items() for i in range(20)]
    urls = [f"http://g.test/{s}/v{chr(97 + i)}/{j}" for s in share for i in range(20) for j in range(10)] + ["http://g.test/12\n", "http://g.test/12"]
    got = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules, max_children=1000, levels=2).collect()
    first = {}
    for r in got[: len(urls) - 2]:
        first.setdefault(r["path"].split("/")[1], set()).add(r["template"].split("/")[1])
    assert first == {"a": {"*"}, "b": {"*"}, "e": {"e"}, "c": {"*2"}, "d": {"*2"}}
    by_path = {r["path"]: r["template"] for r in got}
    assert by_path["/12"] == "/{n}" and by_path["/12\n"] == "/12\n"


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as P
    from offerlens.llm.frames import written

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, " ".join(f"passage{i}" for i in range(60)))], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, frames = docs, []
    for _, stage in P.STAGES[:-1]:
        kept = written(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns
        frames.append({r["doc_id"]: r["text"] for r in kept.collect()})
    language, lines, near, clean = frames
    assert not {40, 41, 42, 43} & set(language) and {24, 36, 44} <= set(language)
    assert len(lines[29]) < len(language[29])
    assert 24 in near and not {25, 26, 27, 28} & set(near)
    assert {36, 37, 38, 39} <= set(near) and not {36, 37, 38, 39} & set(clean)
    assert {i for i in range(24)} <= set(clean)
    result = P.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in result.collect()} == set(clean)
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]


def test_registry():
    from offerlens.llm import queries

    assert all(any(n.startswith(f"op{i}_") for n in queries.QUERIES) for i in range(1, 14)) and "pipeline" in queries.QUERIES
    assert set(queries.SQL) <= set(queries.QUERIES)
