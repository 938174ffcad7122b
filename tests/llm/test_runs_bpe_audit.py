"""Operators 11 to 13 against plain versions of their contracts, on small texts and on empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from text_tables import docs, frame, nothing, prose  # noqa: F401  fixtures

from tallyloom.llm.byte_bpe import decoded, encoded, round_trip, vocabulary
from tallyloom.llm.filter_audit import audit, mask_cells
from tallyloom.llm.periodic_runs import digest_of_runs, numbered, periodic_runs, runs_of, with_planted_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
key = repr


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ------------------------------------------------------------------ periodic runs


def plain_runs(words, least=12):
    """(start, length, period): maximal stretches of equal words q apart, those that a smaller period has left out."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            y = x
            while y + q < n and words[y] == words[y + q]:
                y += 1
            if y - x >= q:
                found.setdefault((x, y + q), q)
            x = max(y, x + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, 2 * q))


def quick(words, least=12):
    found = runs_of(np.asarray(numbered([str(w).encode() for w in words])))
    return [(a, b - a, q) for a, b, q in zip(*(x.tolist() for x in found)) if b - a >= least]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 8)), max_size=14))
def test_runs_of_repeated_parts(parts):
    words = [w for part, times in parts for w in part * times]
    assert quick(words, 4) == plain_runs(words, 4)


def test_runs_of_awkward_words():
    rng = random.Random(3)
    fibonacci = "0"
    longer = "01"
    while len(longer) < 600:
        fibonacci, longer = longer, longer + fibonacci
    cases = [longer, "a" * 400, "ab" * 150 + "a" + "ba" * 150]
    # A period that is itself periodic, with and without a rest, at every scale.
    for root in ("a", "ab", "aab", "abcab"):
        for size in (7, 11, 13, 23, 29, 47, 95, 130):
            block = (root * size)[:size]
            cases += [block * 2, "x" + block * 3 + "y", block * 2 + block[: size // 2]]
    for _ in range(60):
        block = [rng.randrange(50) for _ in range(rng.randint(1, 200))]
        cases.append([rng.randrange(50) for _ in range(40)] + block * rng.randint(2, 3) + block[: rng.randrange(9)] + [99])
    for case in cases:
        assert quick(case) == plain_runs(list(case))


def plain_planted(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain_digest(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept))


def test_periodic_runs_equal_brute_force(spark, prose):
    rows = [r for r in prose if r[0] != 11]
    said = ("again and again the same thing is said " * 5).strip()
    rows += [(200, said, "a"), (201, f"before\x0b{said}\t after", "a"), (203, "é " * 11, "a"), (204, "é " * 12, "a")]
    rows += [(1000 + i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = digest_of_runs(periodic_runs(with_planted_runs(frame(spark, rows)))).collect()
    want = [plain_digest(i, plain_planted(i, t)) for i, t, _ in rows]
    assert sum(w[1] > 0 for w in want) > 12
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_periodic_runs_of_a_very_long_text(spark):
    words = ["w%d" % i for i in range(40_000)] + ["again", "and"] * 30_000 + ["end"]
    text = " ".join(words)
    row = periodic_runs(frame(spark, [(1, text, "a")]), carry=("source",)).collect()[0]
    assert (row.n_words, row.source, [tuple(r) for r in row.runs]) == (100_001, "a", [(40_000, 60_000, 2)])
    assert row.collapsed == " ".join([*words[:40_002], "end"])


def test_periodic_runs_of_nothing(nothing):
    out = digest_of_runs(periodic_runs(with_planted_runs(nothing)))
    assert out.count() == 0
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    with pytest.raises(ValueError):
        periodic_runs(nothing, min_length=2)


# ------------------------------------------------------------------ byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    with open(RANKS, "rb") as lines:
        return vocabulary(lines.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


ALPHABETS = ["ab", "aab=", "abcdefghijklmnopqrstuvwxyz", " \t\n", "äöüß", "日本語中文", "абвгд", "0123456789", "#$%!?.", "😀👍🏽‍"]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_tree_encoding_equals_direct_encoding(words, reference, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(a) for a in rng.choices(ALPHABETS, k=4) for _ in range(rng.choice([1, 3, 40, 300])))
    ids = words.encode(text).tolist()
    assert ids == reference.encode_ordinary(text)
    assert words.decode(ids) == text.encode()


def test_join_is_associative(words):
    rng = random.Random(8)
    for _ in range(200):
        parts = ["".join(rng.choice("abten ") for _ in range(rng.randint(1, 40))).encode() for _ in range(3)]
        a, b, c = (words.merged(p) for p in parts)
        whole = words.merged(b"".join(parts))
        assert words.joined(words.joined(a, b), c) == words.joined(a, words.joined(b, c)) == whole
        assert words.merged_long(b"".join(parts)) == whole
    assert words.joined([], words.merged(b"xyz")) == words.merged(b"xyz")


@pytest.mark.parametrize("piece", ["a" * 5000, "=" * 3000, "ab" * 3000 + "a", " " * 3000, "The" * 1000])
def test_pieces_without_end(words, reference, piece):
    assert words.encode(piece).tolist() == reference.encode_ordinary(piece)


def test_round_trip_of_documents(spark, prose, reference):
    rows = prose + [(300, "<|endoftext|> is text", "a"), (301, "it's 12 o'clock,\r\n\r\n  we'll   go on ", "a"), (302, "\x00\x7f", "a")]
    got = round_trip(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_bpe_of_nothing_and_of_bad_ids(spark, nothing):
    assert round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    tokens = spark.createDataFrame([(1, None), (2, []), (3, [50_255, 0])], "doc_id long, ids array<int>")
    got = dict(decoded(tokens, RANKS, public_tokenizers.PATTERN).select("doc_id", "bytes").collect())
    assert got[1] == got[2] == b"" and len(got[3]) > 1
    back = encoded(nothing, RANKS, public_tokenizers.PATTERN, carry=("size", "row"))
    assert back.columns == ["ids", "size", "row"]
    bad = spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="KeyError"):
        decoded(bad, RANKS, public_tokenizers.PATTERN).collect()


# ------------------------------------------------------------------ audit of filters


def plain_audit(rows, labels, min_words):
    """Every order applied to every document by itself."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < min_words,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows),
        }
        parts.setdefault(lang or "", []).append((i, {f for f, bad in fails.items() if bad}))
    out, shapley = [], Counter()
    for part, documents in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                kept = [i for i, fails in documents if not fails & (before | {f})]
                removed = [i for i, fails in documents if f in fails and not fails & before]
                shapley[part, f] += len(removed)
                redundant = sum(f in fails and bool(fails & before) for _, fails in documents)
                alone = sum(fails == {f} for _, fails in documents)
                lost = [len([i for i in removed if i in kind]) for kind in (good, toxic)]
                out.append((part, order, step, len(kept), len(removed), redundant, alone, *lost))
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def as_documents(spark, rows):
    full = [(i, t, g, "s", 0, 7, "x", "y") for i, t, g in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, mask int, n int, same string, part string").repartition(3)


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    langs = ["en", "de", None, ""]
    texts = [None, "", " \t\n", "#", "ABC abc", "say it " * 9, "one two three four five six seven", "wörter über $ alles hinaus gehen weiter"]
    texts += [" ".join(rng.choice(["a", "b", "Cd", "e%", "ff", "gg", "hh"]) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(langs)) for i in range(150)]
    rows += [(5, "told twice", "en"), (5, "told twice", "en"), (5, "told twice", "de"), (9, "told twice", "en"), (None, "told twice", "en")]
    rows += [(None, "", None), (7, None, "en"), (7, None, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(as_documents(spark, rows), marks, min_words=5).collect()
    known = [(i, q, t) for i, q, t in labels if i is not None]
    assert sorted(map(tuple, got)) == sorted(plain_audit(rows, known, 5))
    assert len(got) == 3 * math.factorial(5) * 5


def test_audit_of_empty_tables(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = as_documents(spark, [])
    assert audit(empty, marks).count() == 0
    got = audit(as_documents(spark, [(1, None, None)]), marks)
    assert got.count() == 600 and {r.part for r in got.select("part").collect()} == {""}
    assert [tuple(r) for r in mask_cells(as_documents(spark, [(1, "x", "en")]), marks).collect()] == [("en", 1, 1, 0, 0)]
