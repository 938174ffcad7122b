"""License statements are found whatever the line breaks, and not in words scattered over a long line."""

from __future__ import annotations

import random
from itertools import pairwise

import duckdb
import pyarrow as pa
import pytest

from tallyloom.llm import license_join, oracles


def test_wrapped_statements_and_a_long_line(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    scattered = " ".join(f"{w} " + "filler " * 30 for w in license_join.TEMPLATES["apache-2.0"].split())
    rows = [
        (1, bsd),
        (2, "this work is licensed under the gnu general\npublic license, version 3"),
        (3, scattered),
        (4, "filler " * 5000 + "Released under the\r\nMIT\r\nlicense" + " filler" * 5000),
        (5, "sublicensed under ccc byte 4 0"),
        (6, "released under the mit"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_join.find_licenses(frame).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4, 5, 6)] == ["bsd", "gpl,gpl-3.0", "", "mit", "", "mit"]
    assert got[4].matches[0].share == 1.0 and got[6].score == pytest.approx(0.8)


def test_windows_equal_brute_force(spark):
    rng = random.Random(9)
    words = [w for t in license_join.TEMPLATES.values() for w in t.split()]
    texts = []
    for _ in range(60):
        own = []
        while len(own) < 60:
            label = rng.choice(list(license_join.TEMPLATES))
            own += [w for w in license_join.TEMPLATES[label].split() for w in ([w] if rng.random() < 0.8 else ["x", w] if rng.random() < 0.5 else [])]
            own += [rng.choice(words + ["y"]) for _ in range(rng.randint(0, 8))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", ", "]) for w in own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {m.label: m.share for m in r.matches} for r in license_join.find_licenses(frame).collect()}
    found = 0
    for i, text in enumerate(texts):
        held = text.replace(",", " ").split()
        want = {}
        for label, statement in license_join.TEMPLATES.items():
            own, width = set(statement.split()), int(len(statement.split()) / 0.8 + 1e-9)
            best = max(len(own & set(held[s : s + width])) / len(own) for s in range(len(held)))
            if best >= 0.8:
                want[label] = best
        assert got[i] == pytest.approx(want)
        found += len(want)
    assert found > 60 and any(a != b for a, b in pairwise(map(str, got.values())))


def test_sql_equals_the_operator(spark):
    """Wrapped, scattered, cut and repeated statements, nulls and empty texts."""
    rng = random.Random(4)
    texts = [None, "", "Licensed under\nthe Apache\r\nLicense, Version 2.0", "released under the mit " + "x " * 9 + "license"]
    texts += [" ".join(w + " filler" * 12 for w in license_join.TEMPLATES["gpl-3.0"].split()), "All Rights\nReserved. cc by, CC-BY 4.0"]
    for statement in license_join.TEMPLATES.values():
        words = [w if rng.random() < 0.9 else "other" for w in statement.split()]
        texts += ["\n".join(words) + "\n" + statement.upper(), "see " * 40 + " ".join(words[1:] + words[:1])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_join.find_licenses(frame).drop("matches")
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    want = db.execute(oracles.LICENSES).to_arrow_table().to_pylist()
    rows = sorted((r.asDict() for r in got.collect()), key=lambda r: r["doc_id"])
    assert rows == sorted(({k: w[k] for k in got.columns} for w in want), key=lambda r: r["doc_id"])
    assert sum("," in r["labels"] for r in rows) > 1 and len({r["labels"] for r in rows}) > 8
