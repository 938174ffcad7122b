"""The pipeline's near copies go through SimHash fingerprints as well as through shingle sets."""

from __future__ import annotations

import random

from corpus_pipeline import near_copies
from tallyloom.llm.simhash import fingerprint


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(40)]
    # The same run of words many times over: new words at the end change the set by more than 0.8 allows, the fingerprint by no bit.
    texts = [" ".join(base * 30), " ".join(base * 30 + [f"n{i}" for i in range(12)]), "quite another text", None, ""]
    assert bin(fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).count("1") <= 2
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in near_copies(spark, frame, "").collect()) == [0, 2, 3]
