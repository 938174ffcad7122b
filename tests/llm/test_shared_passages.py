"""The report of passages that stand in several texts, against a plain search over the same sampled positions."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from text_tables import frame, nothing  # noqa: F401  fixtures

from tallyloom.llm.suffix_dedup import Sampling, remove_repeats, sampled_positions


def plain_shared(texts, length, phrases):
    """Bytes of each text in runs of so many phrases that another, different text holds as well."""
    s = Sampling(length)
    places = {t: sampled_positions(np.frombuffer(t, np.uint8), np.array([0, len(t)]), s).tolist() for t in texts}
    holders = defaultdict(set)
    for t, at in places.items():
        for i in range(len(at) - phrases):
            holders[t[at[i] : at[i + phrases]]].add(t)
    out = {}
    for t, at in places.items():
        told = set()
        for i in range(len(at) - phrases):
            if len(holders[t[at[i] : at[i + phrases]]]) > 1:
                told |= set(range(at[i], at[i + phrases]))
        out[t] = len(told)
    return out


def test_shared_passages_equal_a_plain_search(spark):
    rng = random.Random(12)
    words = [f"w{i}x{i * i % 97}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, once = say(60), say(60)
    rows = [(1, f"{say(40)} {passage} {say(30)}", "a"), (2, f"{passage} {say(90)}", "a"), (3, say(200), "b"), (4, None, "b"), (5, "", "b")]
    rows += [(6, f"{once} {say(5)} {once}", "b"), (7, "kept twice " + say(80), "c")]
    rows += [(8, rows[-1][1], "c"), (9, "ab " * 900, "c"), (10, f"short {passage[:120]} end", "c")]
    texts = [(t or "").encode() for _, t, _ in rows]
    want = plain_shared(set(texts), 400, 6)
    got = {r.doc_id: r.n_shared for r in remove_repeats(frame(spark, rows), 400, report=6).collect()}
    copies = {t for t in texts if texts.count(t) > 1}
    assert got == {i: len(t) if t in copies else want[t] for (i, _, _), t in zip(rows, texts)}
    # A passage of sixty words is seen though it is under 400 bytes; one that repeats within its text alone is not.
    assert got[1] > 150 and got[2] > 150 and got[3] == got[6] == got[10] == 0 and got[7] == got[8] > 0


def test_no_texts(nothing):  # noqa: F811
    assert remove_repeats(nothing).count() == 0
