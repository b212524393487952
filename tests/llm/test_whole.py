"""What earlier versions cut: each test fails on the version before its change."""

from __future__ import annotations

import numpy as np
import pytest

from offerlens.llm import language_id, maxent_lm, url_filters


def test_weight_tables_grow_with_the_corpus(docs):
    assert maxent_lm.table_rows(0) == 1 << 15 and maxent_lm.table_rows(6_000_000_000) == 1 << 17
    learnt = maxent_lm.keyed(docs)
    mass = np.ones(maxent_lm.CLASSES * maxent_lm.PLACES)
    assert maxent_lm.train(learnt, mass, 10_000, rounds=1).shape == (2, 1 << 15, 32)
    assert maxent_lm.train(learnt, mass, 3_000_000_000, rounds=1).shape == (2, 1 << 16, 32)


def test_wildcard_segments_meet_only_their_own_rests(spark, tmp_path):
    """300 rare first segments with a rest each: 300 paths, not 90,000 pairs."""
    frame = spark.createDataFrame([(i, f"http://hot.test/user{i}/post-{chr(97 + i % 26)}{i}") for i in range(300)], "page_id long, url string")
    got = url_filters.judge_urls(frame)
    assert got.count() == 300
    got.collect()
    made, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        while (name := plan.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            plan = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan()
        rows = plan.metrics().get("numOutputRows")
        made += [rows.get().value()] if rows.isDefined() else []
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    assert made and max(made) <= 300


def test_all_labelled_languages_are_fitted(spark):
    text = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}q" for x in "aeiouy" * 8)
    frame = spark.createDataFrame([(i, text(i // 2), f"l{i // 2:02}") for i in range(140)], "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    assert model[0] == [f"l{i:02}" for i in range(70)] and model[1].shape[0] == 71
    got = {r["doc_id"]: (r["lang"], r["rejected"]) for r in language_id.identify(frame, model).collect()}
    assert all(got[i] == (f"l{i // 2:02}", False) for i in range(140))


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language_id.fit(spark.createDataFrame([(i, "text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string"))


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns that operators use inside, null and repeated rows, and one row of each group of equals."""
    from offerlens.llm import stages

    line = "this line stands in many of the documents and is long enough to count"
    rows = [(i, f"{line}\n" + " ".join(f"w{(i * 31 + j * j) % 97}x{i}" for j in range(30)), "en", "s", 1, "a", "b", "c", "d", "e") for i in range(8)]
    rows += [rows[3], rows[3][:5] + ("z", "b", "c", "d", "e"), (None, "only null ids here", "en", None, 1, "a", "b", "c", "d", "e"), (None, "only null ids here", "en", None, 1, "a", "b", "c", "d", "e"), (99, None, None, None, 0, "a", "b", "c", "d", "e"), (98, "", "en", "s", 0, "a", "b", "c", "d", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, __k string, T string, keep string, n string")
    cut = stages.lines(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    kept = stages.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["k"]) for r in kept.collect()), key=str)
    assert got == sorted([*[(i, "a") for i in range(8)], (None, "a"), (98, "a")], key=str)
    assert stages.near_duplicates(spark, docs.limit(0), "").count() == 0 and stages.lines(spark, docs.limit(0), "").count() == 0


def test_recall_of_vectors_at_the_threshold(spark):
    """Pairs at a cosine just above 0.9, in 64 dimensions."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.901 * a + np.sqrt(1 - 0.901**2) * b
    from offerlens.llm import embedding_dedup

    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.stack([a, c], axis=1).reshape(-1, 64))], "vec_id long, embedding array<double>")
    got = embedding_dedup.embedding_groups(frame).where("n_links > 0").count()
    assert got / 3000 > 0.9
