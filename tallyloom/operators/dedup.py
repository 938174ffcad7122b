"""Which invoices of a batch are new: number-keyed, first wins, every skip with its reason."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import blank_to_empty

# The reasons a batch row is skipped, in the order they are tested.
EMPTY_NUMBER = "The invoice number is empty."
ALREADY_STORED = "An invoice with this number already exists."
REPEATED = "This number appears twice in the batch."

# Copies of one number are spread over this many shares, so no task meets them all.
SHARES = 1024


class DuplicateInvoice(ValueError):
    """A strict save met a number that is already taken."""


def bulk_outcome(
    batch: DataFrame,
    stored_numbers: DataFrame,
    order: Sequence[str],
    strict: bool = False,
    fix: Callable[[DataFrame, str], DataFrame] = lambda df, _label: df,
) -> DataFrame:
    """Add `outcome` (created / skipped) and `reason` to every row; numbers come back trimmed.

    `order` names the columns that place a row in the batch, unique together. A number is looked up
    and its first row found on one small row per (number, share); batch rows then join those on
    (number, share), so a number that fills a third of the batch is spread over all shares.
    `strict` refuses a batch with a stored or repeated number before its rows are joined. `fix` stores what is read
    several times: one small row per (number, share), never the batch.
    """
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    placed = batch.withColumns(
        {
            "invoice_number": blank_to_empty(F.col("invoice_number")),
            "_share": F.pmod(F.xxhash64(*order), F.lit(SHARES)),
            "_place": place,
        }
    )
    shares = fix(
        placed.where(F.col("invoice_number") != "")
        .groupBy("invoice_number", "_share")
        .agg(F.min("_place").alias("_first"), F.max("_place").alias("_last")),
        "batch-numbers",
    )
    firsts = shares.withColumn("_winner", F.min("_first").over(Window.partitionBy("invoice_number")))
    # Only the numbers of this batch leave the ledger scan; a small batch is broadcast to it.
    known = (
        stored_numbers.select(blank_to_empty(F.col("invoice_number")).alias("invoice_number"))
        .join(shares.select("invoice_number").distinct(), "invoice_number", "left_semi")
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    verdicts = firsts.join(known, "invoice_number", "left").select(
        "invoice_number", "_share", "_winner", "_known", (F.col("_last") != F.col("_winner")).alias("_repeated")
    )
    if strict:
        verdicts = fix(verdicts, "batch-verdicts")
        # A share whose last row is not the number's first one holds a repeat.
        clash = verdicts.where(F.col("_known") | F.col("_repeated")).select("invoice_number").first()
        if clash is not None:
            raise DuplicateInvoice(f"Invoice number {clash[0]!r} already exists.")
    reason = (
        F.when(F.col("invoice_number") == "", F.lit(EMPTY_NUMBER))
        .when(F.col("_known"), F.lit(ALREADY_STORED))
        .when(F.col("_place") != F.col("_winner"), F.lit(REPEATED))
    )
    return (
        placed.join(verdicts.drop("_repeated"), ["invoice_number", "_share"], "left")
        .withColumn("reason", reason)
        .withColumn("outcome", F.when(F.col("reason").isNull(), F.lit("created")).otherwise(F.lit("skipped")))
        .drop("_share", "_place", "_winner", "_known")
    )


def choose_drafts(drafts: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("file", "first_row")) -> DataFrame:
    """Only the drafts that were picked."""
    return drafts.join(chosen.select(*keys), list(keys), "left_semi")


def source_of(kind: str) -> str:
    """How a saved draft is labelled: documents are uploaded, exports imported."""
    return {"document": "uploaded", "export": "imported"}[kind]
