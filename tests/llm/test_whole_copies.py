"""The training mix of the pipeline holds whole texts."""

from __future__ import annotations

from collections import Counter

from corpus_pipeline import source_mix
from tallyloom.llm.mixing import mix


def test_the_mix_holds_whole_texts(spark):
    rows = [(i, "\n".join(f"line {i} word{k}" for k in range(3 + i % 17)), "en", f"s{i % 3}") for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame = frame.selectExpr("*", "cast(length(text) as long) n_chars")
    text = {r[0]: r[1] for r in rows}
    got = source_mix(spark, frame, "").collect()
    assert got and all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in got)
    mixed = mix(frame, cycle=(3, 1, 2), share=1.5, max_epochs=2.0).collect()
    assert any(0 < r.extra < r.size for r in mixed)  # a document at the boundary
    target = {r.source: r.target for r in mixed}
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - target[s]) <= max(len(t.split()) for t in text.values()) for s in target)
