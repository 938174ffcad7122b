"""Deterministic invoice checks. A note per failed rule, in rule order; any note means review.

The rules read the invoice's own columns plus `line_count` and `line_sum`, so they run the same on
nested invoices and on header rows whose lines live in a separate table.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.lines import round_line, sum_amounts
from tallyloom.functions.text import blank_to_empty, money_text, quantity_text, quoted
from tallyloom.schema import MONEY, SUM_MONEY

# Fixed value: one cent of rounding on printed documents is tolerated.
TOLERANCE = "0.011"


def _note(broken: Column, *parts: Column | str) -> Column:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.when(broken, text)


def opening_notes(require_lines: Column) -> list[Column]:
    """Rules on the invoice as a whole that come before the per-line rules."""
    line_count, line_sum = F.col("line_count"), F.col("line_sum")
    subtotal, tax, total = F.col("subtotal"), F.col("tax"), F.col("total")
    issued, due, currency = F.col("invoice_date"), F.col("due_date"), F.col("currency")
    tolerance = F.lit(TOLERANCE).cast("decimal(4,3)")
    return [
        _note(blank_to_empty(F.col("invoice_number")) == "", "Invoice number is missing."),
        _note(blank_to_empty(F.col("vendor_name")) == "", "Vendor name is missing."),
        _note((line_count == 0) & require_lines, "No line items were extracted."),
        _note(
            (line_count > 0) & (F.abs(line_sum - subtotal) > tolerance),
            "Line items sum to ", money_text(line_sum), " but the subtotal reads ", money_text(subtotal), ".",
        ),
        _note(
            F.abs(subtotal + tax - total) > tolerance,
            "Subtotal + tax = ", money_text(subtotal + tax), " but the total reads ", money_text(total), ".",
        ),
        _note(
            due < issued,
            "Due date ", due.cast("string"), " precedes invoice date ", issued.cast("string"), ".",
        ),
        _note(
            ~F.coalesce(currency, F.lit("")).rlike("^[A-Z]{3}$"),
            "Currency ", F.coalesce(quoted(currency), F.lit("None")), " is not a 3-letter ISO 4217 code.",
        ),
    ]


def closing_notes() -> list[Column]:
    total = F.col("total")
    return [_note(total <= 0, "Total is ", money_text(total), ", which is not a payable amount.")]


def bad_quantity(line: Column) -> Column:
    return line["quantity"] <= 0


def negative_money(line: Column) -> Column:
    return (line["amount"] < 0) | (line["unit_price"] < 0)


def line_notes(number: Column, line: Column) -> list[Column]:
    """The two per-line rules, in order, for one line."""
    label = F.concat(
        F.lit("Line "), number.cast("string"), F.lit(" ("), F.substring(line["description"], 1, 40), F.lit(")")
    )
    return [
        _note(bad_quantity(line), label, " has quantity ", quantity_text(line["quantity"]), "."),
        _note(negative_money(line), label, " has a negative amount or unit price."),
    ]


def line_note_count(line: Column) -> Column:
    """How many notes one line earns; needs no line number, so it aggregates freely."""
    return F.when(bad_quantity(line), 1).otherwise(0) + F.when(negative_money(line), 1).otherwise(0)


def array_line_notes(lines: Column) -> Column:
    """Per-line notes of a nested invoice, interleaved line by line."""
    none = F.array().cast("array<string>")
    noted = F.flatten(F.transform(lines, lambda line, i: F.array_compact(F.array(*line_notes(i + 1, line)))))
    # Notes are worded only where a line breaks a rule.
    broken = F.exists(lines, lambda line: bad_quantity(line) | negative_money(line))
    return F.when(broken, F.coalesce(noted, none)).otherwise(none)


def _noted(notes: list[Column]) -> Column:
    """The notes there are. Rules are tested in compiled code; only rows that break one go through the array function, which is not."""
    some = reduce(lambda a, b: a | b, [note.isNotNull() for note in notes])
    return F.when(some, F.array_compact(F.array(*notes))).otherwise(F.array().cast("array<string>"))


def with_line_totals(df: DataFrame) -> DataFrame:
    """Add `line_count` and `line_sum`; where the array is null, counts already present are kept."""
    count = F.size("line_items").cast("long")
    total = sum_amounts(F.col("line_items"), SUM_MONEY)
    if "line_count" in df.columns:
        held = F.col("line_items").isNotNull()
        count = F.when(held, count).otherwise(F.col("line_count"))
        total = F.when(held, total).otherwise(F.col("line_sum"))
    else:
        count = F.coalesce(F.when(F.col("line_items").isNotNull(), count), F.lit(0).cast("long"))
        total = F.coalesce(total, F.lit(0).cast(SUM_MONEY))
    return df.withColumns({"line_count": count, "line_sum": total})


def stored_line_note(df: DataFrame) -> Column:
    """For an invoice whose lines are kept in the line table: one note on how many of them have notes."""
    none = F.array().cast("array<string>")
    if "line_note_count" not in df.columns:
        return none
    noted = F.col("line_items").isNull() & (F.col("line_note_count") > 0)
    text = F.concat(F.lit("The line table has "), F.col("line_note_count").cast("string"), F.lit(" note(s) on lines of this invoice."))
    return F.when(noted, F.array(text)).otherwise(none)


def with_review(df: DataFrame, require_lines: Column | bool = True) -> DataFrame:
    """Add `review_notes` and `needs_review` to invoices that carry `line_items`."""
    require = F.lit(require_lines) if isinstance(require_lines, bool) else require_lines
    totals = with_line_totals(df)
    notes = F.concat(
        _noted(opening_notes(require)),
        F.coalesce(array_line_notes(F.col("line_items")), F.array().cast("array<string>")),
        stored_line_note(df),
        _noted(closing_notes()),
    )
    return totals.withColumn("review_notes", notes).withColumn("needs_review", F.size("review_notes") > 0)


def with_header_review(df: DataFrame, require_lines: Column | bool = True) -> DataFrame:
    """The same verdict for header rows with `line_count`, `line_sum` and `line_note_count`.

    `review_notes` holds the notes on the invoice as a whole; those of single lines come from
    `line_review_notes` on the line table.
    """
    require = F.lit(require_lines) if isinstance(require_lines, bool) else require_lines
    notes = F.array_compact(F.array(*opening_notes(require), *closing_notes()))
    return df.withColumn("review_notes", notes).withColumn(
        "needs_review", (F.size("review_notes") > 0) | (F.col("line_note_count") > 0)
    )


def line_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per-invoice line aggregates, all map-side combined: a huge invoice is never gathered."""
    line = F.struct("description", "quantity", "unit_price", "amount")
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum("amount").cast(SUM_MONEY).alias("line_sum"),
        F.sum(line_note_count(line)).cast("long").alias("line_note_count"),
    )


def line_review_notes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per line note: keys, `line_no`, `note_no`, `note`. Clean lines are filtered first."""
    line = F.struct("description", "quantity", "unit_price", "amount")
    broken = lines.where(bad_quantity(line) | negative_money(line))
    notes = F.array_compact(F.array(*line_notes(F.col("line_no"), line)))
    return broken.select(*keys, "line_no", F.posexplode(notes).alias("note_no", "note"))


def derive_status(as_of: date | Column) -> Column:
    """An unpaid invoice past its due date is overdue, whatever the document says."""
    day = F.lit(as_of) if isinstance(as_of, date) else as_of
    return F.when(
        (F.col("status") != "paid") & F.col("due_date").isNotNull() & (F.col("due_date") < day), F.lit("overdue")
    ).otherwise(F.col("status"))


def round_money(df: DataFrame) -> DataFrame:
    """Every money field to two decimals; quantities are left alone."""
    money = {name: F.round(F.col(name), 2).cast(MONEY) for name in ("subtotal", "tax", "total")}
    if "line_items" in df.columns:
        money["line_items"] = F.transform("line_items", round_line)
    return df.withColumns(money)
