"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlens.llm.frames import ascii_lower, keyed, table, written

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wording of public licences and notices, and the labels that the method adds.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "this source code form is subject to the terms of the mozilla public license": "mpl-text",
    "this is free and unencumbered software released into the public domain": "unlicense-text",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-text",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}
#: Words of a gram: of long templates, and of the phrases, of which some have two words only.
LONG_GRAM, SHORT_GRAM = 5, 2
#: Words of all templates up to which their grams are broadcast; more join by a shuffle.
BROADCAST_GRAMS = 200_000
#: Stands for a document itself among the hashes of its grams.
HEAD = -1
#: Share of a template's grams that a place must hold, distance of diagonals that are one place, longest place for its template.
COVERAGE, DRIFT, STRETCH = 0.8, 3, 1.5


def _template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str] | DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(gram, template, at), (template, label, exact, size, n_grams), and the number of words of all of them; their size is that of the parameters."""
    grams, about, total = [("", -1, 0)], [], 0
    for i, (text, label) in enumerate([*phrases.items(), *([] if isinstance(templates, DataFrame) else templates.items())]):
        words = [x for x in re.split(SPLIT, text.lower()) if x]
        size = SHORT_GRAM if i < len(phrases) else LONG_GRAM
        if len(words) < size:
            raise ValueError(f"{text!r} has fewer than {size} words")
        at = range(len(words) - size + 1)
        grams += [(" ".join(words[j : j + size]), i, j) for j in at]
        about.append((i, label, i < len(phrases), len(words), len({" ".join(words[j : j + size]) for j in at}) if i >= len(phrases) else len(at)))
        total += len(words)
    grams, about = spark.createDataFrame(grams, "gram string, template long, at int"), spark.createDataFrame(about, "template long, label string, exact boolean, size int, n_grams int")
    if not isinstance(templates, DataFrame):
        return grams, about, total
    words = F.filter(F.split(ascii_lower(F.col("text")), SPLIT), lambda x: x != "")
    number = F.pmod(F.xxhash64("text", "label"), F.lit(2**62)) + len(phrases)
    own = templates.where("text IS NOT NULL").select("text", "label").distinct().select(number.alias("template"), "label", words.alias("w")).where(F.size("w") >= LONG_GRAM)
    rolled = F.transform(F.sequence(F.lit(0), F.size("w") - LONG_GRAM), lambda i: F.array_join(F.slice("w", i + 1, LONG_GRAM), " "))
    own = written(own.select("template", "label", F.size("w").alias("size"), rolled.alias("grams")))
    total += own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    more = own.select("template", "label", F.lit(False).alias("exact"), "size", F.size(F.array_distinct("grams")).alias("n_grams"))
    return grams.unionByName(own.select("template", F.posexplode("grams").alias("at", "gram"))), about.unionByName(more), total


def license_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] | DataFrame = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, t, n_words) for each row, and (k, t, label, exact, start, end, coverage) for each place of a licence.

    Words are runs of letters and digits, A-Z lower-cased; null and empty texts have none. All rolling word grams join with
    the templates' grams by hash and text; votes are counted for each diagonal (the gram's place less its place in the template).
    A phrase needs all its grams on one diagonal. For a template, diagonals at most DRIFT apart are one place, which
    counts if it is no longer than STRETCH times the template; its coverage is the share of the template's grams it holds. Repeated rows share
    their places, null ids are allowed, an empty table gives none, and columns but the named ones are not read.

    `templates` may be a table (text, label) of whole licence texts; those null or of fewer than LONG_GRAM words are left out, and repeated ones count once. Grams of more than
    BROADCAST_GRAMS words of templates join by a shuffle of places and hashes alone; words then come from the documents with hits.
    """
    grams, about, n_words = _template_grams(docs.sparkSession, phrases, templates)
    few = n_words <= BROADCAST_GRAMS  # no fewer words than there are grams
    sent = F.broadcast if few else (lambda x: x)
    rows = keyed(docs, id_col, text_col).select("doc_id", "k", "t", F.filter(F.split(ascii_lower(F.col("text")), SPLIT), lambda x: x != "").alias("w"))
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    rows = rows.withColumns({"n": F.size("w"), "h": hashes})

    def rolling(size: int):
        of = lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(size)])
        return F.when(F.col("n") >= size, F.transform(F.sequence(F.lit(0), F.col("n") - size), of)).otherwise(F.array().cast("array<bigint>"))

    # the first entry of each document stands for itself and always joins; then come its short grams, then its long ones
    rows = rows.withColumn("grams", F.concat(F.array(F.lit(HEAD)), rolling(SHORT_GRAM), rolling(LONG_GRAM))).select("doc_id", "k", "t", "w", "n", "grams")
    short = F.greatest(F.col("n") - (SHORT_GRAM - 1), F.lit(0))
    place = F.when(F.col("pos") == 0, F.col("n")).otherwise(F.col("pos") - 1 - F.when(F.col("pos") > short, short).otherwise(0))
    words = F.split("gram", " ")
    hash_ = F.when(F.col("template") < 0, F.lit(HEAD))
    for size in (SHORT_GRAM, LONG_GRAM):
        hash_ = hash_.when(F.size(words) == size, F.xxhash64(*[F.xxhash64(F.get(words, F.lit(j))) for j in range(size)]))
    grams = sent(grams.select("gram", "template", "at", hash_.alias("hash"), F.size(words).alias("size")))
    agree = F.array_join(F.slice("w", F.col("place") + 1, F.col("size")), " ") == F.col("gram")
    if few:
        votes = (
            rows.select("doc_id", "k", "t", "w", "n", F.posexplode_outer("grams").alias("pos", "hash"))
            .join(grams, "hash")
            .where((F.col("pos") == 0) == (F.col("template") < 0))
            .withColumn("place", place)
            .where((F.col("template") < 0) | agree)
            .select("doc_id", "k", "t", "place", "template", "at")
        )
        votes = written(votes)
        heads = votes.where("template = -1").select("doc_id", "k", "t", F.col("place").cast("long").alias("n_words"))
    else:
        heads = rows.select("doc_id", "k", "t", F.col("n").cast("long").alias("n_words"))
        entries = rows.select("k", "t", "n", F.posexplode("grams").alias("pos", "hash")).where("pos > 0")
        hits = written(entries.join(grams.where("template >= 0"), "hash").select("k", "t", place.alias("place"), "template", "at", "gram", "size").distinct())
        held = rows.join(hits.select("k", "t").distinct(), ["k", "t"], "left_semi").groupBy("k", "t").agg(F.first("w").alias("w"))
        votes = written(hits.join(held, ["k", "t"]).where(agree).select("k", "t", "place", "template", "at"))
    placed = votes.where("template >= 0").select("k", "t", "template", "at", "place", (F.col("place") - F.col("at")).alias("diagonal")).distinct().join(sent(about), "template")
    whole = (
        placed.where("exact").groupBy("k", "t", "label", "diagonal", "size", "n_grams").agg(F.count("*").alias("votes")).where("votes = n_grams")
        .select("k", "t", "label", F.lit(True).alias("exact"), F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("coverage"))
    )
    lines = placed.where("NOT exact").groupBy("k", "t", "template", "label", "size", "n_grams", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("place").alias("start"), (F.max("place") + LONG_GRAM).alias("end")
    )
    order = W.partitionBy("k", "t", "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= DRIFT, 0).otherwise(1)
    merged = (
        lines.withColumn("new", new).withColumn("group", F.sum("new").over(order))
        .groupBy("k", "t", "template", "label", "size", "n_grams", "group")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"), F.min("start").alias("start"), F.max("end").alias("end"))
        .where(F.col("end") - F.col("start") <= F.col("size") * STRETCH)
        .select("k", "t", "label", F.lit(False).alias("exact"), "start", "end", F.least(F.lit(1.0), F.col("held") / F.col("n_grams")).alias("coverage"))
    )
    return heads, whole.unionByName(merged)


def license_labels(docs: DataFrame, coverage: float = COVERAGE, **parameters) -> DataFrame:
    """(doc_id, k, t, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of `docs`.

    score is the largest coverage of any place (1 for a phrase, 0 for none); a template's label needs `coverage` of it. Null and empty texts have no
    words, labels and score; repeated rows get the same result each, an empty table gives an empty one.
    """
    heads, places = license_places(docs, **parameters)
    exact = F.col("exact")
    found = places.groupBy("k", "t").agg(
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("coverage") >= coverage, F.col("label")))), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    return heads.join(found, ["k", "t"], "left").fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`license_labels` of every document; see there for nulls, empty texts, repeated rows and empty tables."""
    return license_labels(table(spark, sf_dir, "documents")).drop("k", "t")


def _sql() -> str:
    def values(texts: dict[str, str]) -> str:
        return ", ".join(f"('{text}', '{label}')" for text, label in texts.items())

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), pw AS (SELECT p, label, string_split(p, ' ') AS ws, len(string_split(p, ' ')) AS n FROM (VALUES {values(PHRASES)}) v(p, label)),
base AS (
  SELECT r, i, label FROM (
    SELECT r, i, label, p, array_to_string(ws[i + 1 : i + n], ' ') AS gram
    FROM (SELECT r, d.ws, p, label, n, unnest(range(len(d.ws) - n + 1)) AS i FROM d, pw WHERE len(d.ws) >= n)
  ) WHERE gram = p
), tw AS (SELECT label, string_split(p, ' ') AS ws, len(string_split(p, ' ')) AS n FROM (VALUES {values(TEMPLATES)}) v(p, label)),
tg AS (
  SELECT label, n, tpos, array_to_string(ws[tpos + 1 : tpos + {LONG_GRAM}], ' ') AS gram, n - {LONG_GRAM} + 1 AS n_grams
  FROM (SELECT label, ws, n, unnest(range(n - {LONG_GRAM} + 1)) AS tpos FROM tw)
), dg AS (
  SELECT r, i, array_to_string(ws[i + 1 : i + {LONG_GRAM}], ' ') AS gram
  FROM (SELECT r, ws, unnest(range(len(ws) - {LONG_GRAM} + 1)) AS i FROM d WHERE len(ws) >= {LONG_GRAM})
), v AS (SELECT r, label, n, n_grams, tpos, i, i - tpos AS diagonal FROM dg JOIN tg USING (gram)),
dl AS (SELECT DISTINCT r, label, diagonal FROM v),
gr AS (
  SELECT r, label, diagonal, sum(fresh) OVER (PARTITION BY r, label ORDER BY diagonal) AS g
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, label ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS fresh FROM dl)
), pl AS (
  SELECT r, label, count(DISTINCT tpos) / any_value(n_grams) AS coverage
  FROM v JOIN gr USING (r, label, diagonal) GROUP BY r, label, g HAVING max(i) + {LONG_GRAM} - min(i) <= any_value(n) * {STRETCH}
), al AS (SELECT r, label, coverage FROM pl UNION ALL SELECT r, label, 1.0 FROM base)
SELECT doc_id, len(ws) AS n_words,
  (SELECT count(*) FROM base b WHERE b.r = d.r) AS n_base,
  (SELECT min(i) FROM base b WHERE b.r = d.r) AS first_word,
  (SELECT max(i) FROM base b WHERE b.r = d.r) AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM base b WHERE b.r = d.r), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM al WHERE al.r = d.r AND coverage >= {COVERAGE}), '') AS labels,
  CAST(coalesce((SELECT max(coverage) FROM al WHERE al.r = d.r), 0) AS DOUBLE) AS score
FROM d
"""


OP2_SQL = _sql()
