"""Small tables with every odd case: nulls, empty and very long texts, repeated rows, ties, extra columns with clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, fp string, node string, n_words string"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LINE = "This very line is found in many documents, and it is longer than forty characters."


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = ["the", "of", "and", "Haus", "été", "niño", "straße", "x1", "code", "license", "Apache", "MIT", "gnu", "a\u00a0b", "日本"] + ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    out: list[tuple[int | None, str | None]] = []
    for i in range(24):
        out.append((i, make(rng.randint(1, 120)) + rng.choice([" ", "\n", "\t"]) + make(20)))
    base = make(150)
    out += [(24, base), (25, base), (26, base.upper()), (27, base + " end"), (28, base.replace("the", "thee", 1))]
    out += [(29 + i, f"{make(15)}\n{LINE if i % 2 else '  ' + LINE.upper() + chr(9)}\n{make(10)}\n{LINE}") for i in range(7)]
    out += [(36 + i, f"{make(12)} {PASSAGE} {make(12)}") for i in range(4)]
    out += [(40, None), (41, ""), (42, " \n\t "), (43, "\n"), (44, "one"), (45, "a b c"), (46, "word " * 3000), (47, "x" * 70_000), (48, "▁ mark ▁▁ and\u0000 nul 😀")]
    out += [(None, make(30)), (None, None), (50, out[3][1]), (50, out[3][1]), (50, make(40)), (51, f"{make(10)} GNU general  public license, CC-BY cc by cc by MIT License apache\nlicense")]
    out.append((52, "intro " + "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation" + " outro"))
    out.append((53, "licensed under CC BY-NC 4.0 and more words here"))
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, ["en", "de", None][n % 3], f"src{n % 2}" if n % 5 else None, len(t or ""), "k", "fp", "node", "n") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
