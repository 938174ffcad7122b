"""Strict batches are refused on their numbers alone."""

from __future__ import annotations

import pytest

from tallyloom.operators.dedup import DuplicateInvoice, bulk_outcome
from tallyloom.sources.ledger import _fixed


@pytest.mark.parametrize("numbers", [["A", "B", " A "], ["A", "S"], ["A", "A"]])
def test_a_strict_batch_is_refused_before_its_rows_are_joined(spark, numbers):
    batch = spark.createDataFrame([(n, i, "wide") for i, n in enumerate(numbers)], "invoice_number string, pos int, other string")
    stored = spark.createDataFrame([("S",)], "invoice_number string")
    kept = []

    def fix(df, label):
        kept.append(df.columns)
        return _fixed(df, label)

    with pytest.raises(DuplicateInvoice):
        bulk_outcome(batch, stored, ["pos"], strict=True, fix=fix)
    assert kept and all("other" not in columns for columns in kept)


def test_a_strict_batch_without_repeats_is_judged_like_any(spark):
    batch = spark.createDataFrame([("A", 1), (" ", 2), (None, 3), ("B", 4), ("C", None)], "invoice_number string, pos int")
    stored = spark.createDataFrame([("S",)], "invoice_number string")
    strict, plain = (sorted(map(str, bulk_outcome(batch, stored, ["pos"], strict=s, fix=_fixed).collect())) for s in (True, False))
    assert strict == plain == sorted(map(str, bulk_outcome(batch, stored, ["pos"]).collect()))
