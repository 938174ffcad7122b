"""Terms disclose an entity wherever in the text they stand."""

from __future__ import annotations

from tallyloom.llm import pii_disclosure


def test_terms_far_from_the_entity(spark):
    filler = [(100 + i, f"plain words number {i} about nothing much at all") for i in range(80)]
    far = " plain words about nothing much at all" * 20
    rows = [
        (1, f"Quillfeather signs{far} contact zora@mail.example.com{far} Quillfeather"),
        (2, f"number 3{far} zora@mail.example.com{far} yours Quillfeather"),
        (3, f"Loner{far} only@once.example.com"),
        (4, "zora alone is a word"),
    ]
    frame = spark.createDataFrame(rows + filler, "doc_id long, text string")
    found = pii_disclosure.disclosures(frame, carry=("text",)).cache()
    places = {r.doc_id: [(x.start, x.stop) for x in r.terms] for r in found.collect()}
    last = rows[0][1].rindex("Quillfeather")
    assert places[1] == [(0, 12), (last, last + 12)]
    at = rows[1][1].index("Quillfeather")
    assert places[2] == [(at, at + 12)]
    assert not any(places[i] for i in places if i > 2)
    clean = {r.doc_id: r.text for r in pii_disclosure.sanitised(found).collect()}
    assert "Quillfeather" not in clean[1] + clean[2] and clean[3].startswith("Loner") and clean[4] == rows[3][1]
