"""Each operator against a plain version of its contract on small texts, and on empty tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from text_tables import docs, nothing, prose  # noqa: F401  fixtures

from tallyloom.llm import license_join, pii_disclosure, quality_rules, simhash, suffix_dedup, winnowing
from tallyloom.llm.common import bloom_of, components
from tallyloom.llm.mixing import copies, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
key = repr


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def as_rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text, shingle):
    words = WORD.findall(ascii_lower(text))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_equals_brute_force(docs, prose):
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    prints = [(i, plain_fingerprint(t, 3)) for i, t, _ in prose]
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[find(f)].append(i)
    want = [(i, f, min(least[find(f)], default=None)) for i, f in prints]
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert any(i == 13 and c == 5 for i, _, c in want)  # capitals do not count


def test_links_of_chains_and_one_bit(spark):
    values = [0, 0b11, 0b1111, 1 << 63, (1 << 63) | 1, 0b111 << 40]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    groups = defaultdict(set)
    for r in components(simhash.links(frame)).collect():
        groups[r.root] |= {r.node, r.root}
    assert sorted(map(len, groups.values())) == [5]
    near = {tuple(sorted((r.a, r.b))) for r in simhash.links(frame, 1).collect()}
    assert near == {tuple(sorted((signed[3], signed[4]))), tuple(sorted((signed[0], signed[3])))}


def test_long_chain_is_one_component(spark):
    edges = spark.range(400).selectExpr("id as a", "id + 1 as b")
    assert components(edges).select("root").distinct().count() == 1


def test_one_row_of_each_component(docs):
    numbered = docs.drop("row").withColumn("row", F.monotonically_increasing_id()).cache()
    linked = simhash.near_duplicates(numbered, row="row")
    kept = numbered.join(simhash.surplus_rows(linked), "row", "left_anti")
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 13 not in ids and 14 in ids


# ------------------------------------------------------------------ repeated strings


def plain_repeats(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length", [400, 64, 24])
def test_repeats_equal_brute_force(spark, docs, prose, length):
    rows = [(i, t) for i, t, _ in prose if i != 11]
    texts = [(t or "").encode() for _, t in rows]
    want = sorted(((i, *x) for (i, _), x in zip(rows, plain_repeats(texts, length))), key=key)
    got = suffix_dedup.remove_repeats(docs.where("doc_id is null or doc_id <> 11"), length)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert any(x[2] for x in want)


def test_periodic_text_goes_whole(spark):
    frame = spark.createDataFrame([(1, "a" * 1000), (2, "abc" * 500), (3, "x" * 399)], "doc_id long, text string")
    assert as_rows(suffix_dedup.remove_repeats(frame), "doc_id", "n_removed") == [(1, 1000), (2, 1500), (3, 0)]


# ------------------------------------------------------------------ quality rules


def plain_measures(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(docs, prose):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(((i, *plain_measures(t)) for i, t, _ in prose), key=key)
    assert as_rows(quality_rules.judge(docs), *names) == want


def test_hosts_are_shrunk_and_rejected(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, bad if i % 10 else good, "bad.example") for i in range(200)]
    rows += [(1000 + i, good if i % 20 else bad, f"host{i % 10}") for i in range(400)]
    rows += [(5000, bad, "tiny"), (5001, good, "tiny2"), (5002, good, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(frame).collect()}
    assert not got[10].base_failed and got[10].host_rejected and not got[10].kept
    assert all(got[1000 + i].kept == bool(i % 20) for i in range(400))
    assert got[5001].kept and got[5002].kept


# ------------------------------------------------------------------ licenses


def test_licenses_equal_plain_search(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0.\nsome text\nAll  rights -- reserved."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "cc by cc by"),
        (4, "all rights\nreserved by nobody"),
        (5, "licensed the apache license version 2 0 under nothing else"),
        (6, "apache version"),
        (7, None),
        (8, "K cc ſ by"),
        (9, ""),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_join.find_licenses(frame).collect()}
    for i, t in rows:
        words = LETTERS.findall(ascii_lower(t))
        places = defaultdict(list)
        for label, phrase in license_join.PHRASES.items():
            p = phrase.split()
            places[label] = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        every = sorted(sum(places.values(), []))
        labels = {k for k, v in places.items() if v}
        best = 1.0 if labels else 0.0
        base = ",".join(sorted(labels))
        for line in (t or "").split("\n"):
            held = set(LETTERS.findall(ascii_lower(line)))
            for label, text in license_join.TEMPLATES.items():
                share = len(held & set(text.split())) / len(set(text.split()))
                if share >= 0.8:
                    labels.add(label)
                    best = max(best, share)
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(words), len(every), base, ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.score == pytest.approx(best)


# ------------------------------------------------------------------ benchmark passages


def test_winnowing_equals_brute_force(spark, docs, prose):
    passage = prose[9][1].split()[:90]
    items = [
        (1, " ".join(passage[20:45]).upper()),
        (2, " ".join(passage[60:70])),
        (3, "the river"),
        (4, "Same line, again"),
        (5, None),
        (6, " - "),
        (1, " ".join(passage[20:45])),
        (7, " ".join(["ab"] * 25)),
        (8, " ".join(passage[:9]) + " nowhere " + " ".join(passage[80:88])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        words = LETTERS.findall(ascii_lower(t))
        n = min(10, len(words))
        for s in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[s : s + n])].add(i)
    want = []
    for i, t, _ in prose:
        words = LETTERS.findall(ascii_lower(t))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                own = windows.get(tuple(words[s : s + n]))
                if own:
                    found |= own
                    hit |= set(range(s, s + n))
        ids = sorted(map(str, found))
        want.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    got = winnowing.contamination(docs, bench)
    assert as_rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=key)
    assert sum(w[5] for w in want) >= 4


# ------------------------------------------------------------------ personal data


def plain_entities(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    out += [("ip", *m.span()) for m in re.finditer(ip, t) if all(int(p) <= 255 for p in m[0].split("."))]
    card = r"[0-9]([\x20-]?[0-9])+"
    out += [("card", *m.span()) for m in re.finditer(card, t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    return out + [("phone", *m.span()) for m in re.finditer(phone, t) if 8 <= len(digits(m)) <= 15]


def test_entities_equal_the_patterns():
    import random

    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("ab@@..-+%1234567890 ()é") for _ in range(rng.randint(0, 60)))
        assert pii_disclosure.entities(t) == plain_entities(t)


def test_terms_that_disclose(spark):
    filler = [(100 + i, f"plain words number {i} about nothing much at all", "s") for i in range(60)]
    mail = "zora.quill@mail.example.com"
    rows = [
        (1, f"Please ask Quillfeather at {mail} about the plain words", "s"),
        (2, f"the house of Quillfeather wrote from {mail} again about nothing", "s"),
        (3, "plain words about nothing, 10.1.2.3 and all", "s"),
        (4, None, "s"),
        (5, "", None),
    ]
    frame = spark.createDataFrame(rows + filler, "doc_id long, text string, source string")
    found = pii_disclosure.disclosures(frame, carry=("text",))
    listed = {r.doc_id: r for r in pii_disclosure.listed(found).collect()}
    at = rows[0][1].index("Quillfeather")
    assert f"term:{at}:{at + 12}" in listed[1].spans.split(",")
    assert listed[3].spans == "ip:27:35" and listed[3].n_ip == 1
    assert listed[4].base_sha256 == hashlib.sha256(b"").hexdigest() == listed[5].base_sha256
    clean = {r.doc_id: r.text for r in pii_disclosure.sanitised(found).collect()}
    assert "Quillfeather" not in clean[1] + clean[2] and "<EMAIL>" in clean[1]
    assert clean[100] == filler[0][1] and clean[4] is None and "<IP>" in clean[3] and "plain words" in clean[1]


def test_pii_counts(docs, prose):
    got = pii_disclosure.listed(pii_disclosure.disclosures(docs))
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in plain_entities(t)).encode()).hexdigest()
    assert as_rows(got, "doc_id", "base_sha256") == sorted(((i, digest(t)) for i, t, _ in prose), key=key)


# ------------------------------------------------------------------ mixing


def test_mix_meets_targets(docs, prose):
    rows = mix(docs).collect()
    sizes = sorted((i, len(WORD.findall(t or ""))) for i, t, _ in prose if i is not None)
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sizes
    totals = Counter()
    for _, t, s in prose:
        totals[s] += len(WORD.findall(t or ""))
    order = sorted(s for s in totals if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(totals.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == totals[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(key, (tuple(r) for r in rows))) == sorted(map(key, (tuple(r) for r in again)))


def test_copies_hold_the_words_taken(docs):
    mixed = mix(docs, carry=("text",))
    taken = mixed.agg(F.sum("taken")).first()[0]
    assert copies(mixed).agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0] == taken


# ------------------------------------------------------------------ empty tables, helpers


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    for made in (
        simhash.near_duplicates(nothing),
        suffix_dedup.remove_repeats(nothing),
        quality_rules.judge(nothing),
        license_join.find_licenses(nothing),
        winnowing.contamination(nothing, bench),
        pii_disclosure.listed(pii_disclosure.disclosures(nothing)),
        mix(nothing),
    ):
        assert made.count() == 0


def test_bloom_never_misses(spark):
    keys = spark.range(5000).selectExpr("id * 7919 as k")
    small = bloom_of(keys, "k", max_bytes=512)
    assert small.hits(np.arange(5000, dtype=np.uint64) * np.uint64(7919)).all()
    wide = bloom_of(keys, "k")
    assert wide.hits(np.arange(5000, dtype=np.uint64) * np.uint64(104729) + np.uint64(3)).mean() < 0.1
