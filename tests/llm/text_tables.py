from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, fp string, spans string"


def frame(spark, rows, parts=3):
    """Documents from (doc_id, text, source), with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", "y", "z", "w") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def prose():
    """Texts with nulls, blanks, a very long text, repeated rows, exact and near copies, shared passages."""
    rng = random.Random(5)
    words = ["the", "river", "Stone", "über", "école", "light", "of", "and", "winter", "map", "seven", "cloud", "paper", "quiet"]
    words += ["w%d" % i for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(90)
    base = say(220)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t\x0b ", None),
        (4, "one", "b"),
        (5, base, "b"),
        (6, base, "b"),
        (6, base, "b"),
        (7, " ".join(near), "b"),
        (8, say(60) + "\n" + passage + "\n" + say(30), "c"),
        (9, passage + " " + say(80), None),
        (10, say(40) + " " + passage, "c"),
        (11, "ab " * 30_000, "d"),
        (12, "\n".join(["same line again here"] * 40), "d"),
        (None, say(120), "d"),
        (None, None, None),
        (13, base.upper(), "e"),
        (14, say(55), "e"),
    ]
    return rows + [(100 + i, say(rng.randint(1, 130)), "abcde"[i % 5]) for i in range(60)]


@pytest.fixture(scope="session")
def docs(spark, prose):
    return frame(spark, prose).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
