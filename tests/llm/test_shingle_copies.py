"""Near copies of the pipeline against brute force over all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpus_pipeline import near_copies as stage
from tallyloom.llm.shingle_copies import near_copies


def grams(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_texts():
    rng = random.Random(5)
    texts = [None, "", "one two", "One  two", "one two three"]
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 240))]
        texts.append(" ".join(words))
        for changed in range(1, 7):
            copy = list(words)
            for i in rng.sample(range(len(copy)), changed):
                copy[i] = f"x{rng.randint(0, 400)}"
            texts.append(" ".join(copy))
    return texts


def groups_of(texts):
    sets = [grams(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(len(sets)):
        groups[find(i)].add(i)
    return sorted(map(sorted, groups.values()))


def test_near_copies_equal_brute_force(spark):
    texts = near_texts()
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    got = defaultdict(list)
    for r in near_copies(frame).collect():
        got[r.root].append(r.doc_id)
    want = groups_of(texts)
    assert sorted(map(sorted, got.values())) == want
    assert sum(len(g) > 1 for g in want) > 8


def test_stage_keeps_one_of_each_group(spark):
    texts = near_texts()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in stage(spark, frame, "").collect()}
    assert kept == {g[0] for g in groups_of(texts)}


def test_rows_that_the_first_row_of_a_bucket_does_not_tie(spark):
    """A chain: neighbours are near copies, the ends are not."""
    words = [f"w{i}" for i in range(200)]
    chain = []
    for _ in range(6):
        chain.append(" ".join(words))
        words = [*words[12:], *[f"y{len(chain)}x{i}" for i in range(12)]]
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(chain)], "row long, doc_id long, text string")
    assert near_copies(frame).select("root").distinct().count() == 1
    assert near_copies(frame.limit(0)).agg(F.count("*")).first()[0] == 0
