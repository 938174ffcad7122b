"""Staged rows plus a mapping to invoice drafts, each assumption recorded as a note.

Work is split by granularity. Rows of one-row-per-invoice files become drafts where they stand, with
no shuffle. Rows of line-item files are grouped by invoice number with map-side combined aggregates
(first values, counts, sums), so an invoice holding a third of all rows is never gathered; its lines
stay rows in the line table, and `nest` packs arrays only for invoices up to a stated size.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.cells import is_code, parse_currency, parse_status, with_dates, with_money
from tallyloom.functions.lines import SYNTHESIZED_DESCRIPTION, build_line, parse_line_cell, round_line, sum_amounts
from tallyloom.functions.text import file_stem, money_text, norm_key, quoted, strip
from tallyloom.operators.numbering import MOST_BUCKETS, SLICE_BITS, bucket_of, measured, number_groups
from tallyloom.operators.validate import (
    array_line_notes,
    closing_notes,
    derive_status,
    line_note_count,
    line_review_notes,
    opening_notes,
    stored_line_note,
)
from tallyloom.schema import LINE_FIELDS, MAPPED_FIELDS, MONEY, RAW_LINE_DDL, RAW_MONEY, SUM_MONEY

# Values read once per invoice, from the first row of the group that has one.
_FIRST_OF = tuple(name for name in MAPPED_FIELDS if name not in LINE_FIELDS[1:])
NEST_LIMIT = 10_000


@dataclass(frozen=True)
class Drafts:
    """Invoice drafts in relational form, keyed by (file, draft_key).

    headers   one row per draft: invoice fields, notes on the invoice as a whole, line totals
    rows      one row per source row: its draft, its own line if it has one, and whether the draft
              was grouped from several rows
    """

    headers: DataFrame
    rows: DataFrame

    @property
    def source_rows(self) -> DataFrame:
        return self.rows.select("file", "draft_key", "row_no")

    @property
    def lines(self) -> DataFrame:
        """One row per line, ordered by `row_no`, `item_no` within its draft."""
        return self._column_lines().unionByName(self._cell_lines(self.headers))

    def _column_lines(self) -> DataFrame:
        lines = self.rows.where(F.col("line").isNotNull()).select(
            "file", "draft_key", "row_no", F.lit(0).alias("item_no"), round_line(F.col("line")).alias("line")
        )
        return lines.select("file", "draft_key", "row_no", "item_no", "line.*")

    def _cell_lines(self, headers: DataFrame) -> DataFrame:
        return headers.select(
            "file", "draft_key", F.col("first_row").alias("row_no"),
            F.posexplode("other_lines").alias("item_no", "line"),
        ).select("file", "draft_key", "row_no", "item_no", "line.*")

    def numbered_lines(self) -> DataFrame:
        """Lines with `line_no`, counted from 1 within each draft.

        Drafts are dealt into buckets, and the rows of each are counted first. A draft has other lines than those of its
        columns only where some row of it has no line, so no other draft is grouped for them. Rows of a bucket that no
        slice could exceed meet the rows of their draft; the others are numbered slice by slice.
        """
        bucket = bucket_of("file", "draft_key")
        # Named once, so that lines need not be made to see that they are there.
        dealt = self.rows.select(bucket.alias("bucket"), F.col("line").isNotNull().alias("lined"))
        counts = dealt.groupBy("bucket").agg(F.count_if("lined").alias("lines"), F.count_if(~F.col("lined")).alias("lineless"))
        found = counts.where((F.col("lines") > 1 << SLICE_BITS) | (F.col("lineless") > 0)).collect()
        large, lineless = ([r.bucket for r in found if r.lines > 1 << SLICE_BITS], [r.bucket for r in found if r.lineless])
        lines = self._column_lines()
        if lineless:
            headers = self.headers if len(lineless) > MOST_BUCKETS else self.headers.where(bucket.isin(*lineless))
            lines = lines.unionByName(self._cell_lines(headers))
        large = None if len(large) > MOST_BUCKETS else large
        return number_groups(lines, ["file", "draft_key"], "row_no", ["row_no", "item_no"], "line_no", large)

    def line_notes(self) -> DataFrame:
        """Review notes on single lines."""
        return line_review_notes(self.numbered_lines(), ["file", "draft_key"])

    def nested(self, limit: int = NEST_LIMIT) -> DataFrame:
        return nest(self, limit)


# ------------------------------------------------------------------ rows with named values



@dataclass(frozen=True)
class Rows:
    """Source rows with one text column per invoice field, and the mapping struct `m` of each file.

    `used` names the fields that some file maps, all others are empty in every row; `kinds` says whether
    some file's rows are drafts by themselves (False) or grouped (True).
    """

    frame: DataFrame
    mapping: DataFrame
    used: frozenset[str] = frozenset(MAPPED_FIELDS)
    kinds: frozenset[bool] = frozenset((False, True))


def rows_from_cells(cells: DataFrame, mapping: DataFrame) -> Rows:
    """Look every mapped column up in the cell map: file, row_no, m, one text column per field."""
    structs = measured(
        mapping.select("file", F.struct(*[c for c in mapping.columns if c != "file"]).alias("m"))
    )
    m = F.col("m")
    # One row of booleans: a field that no file maps is a constant, and a kind of file that is not there costs nothing.
    seen = structs.agg(
        *[F.bool_or(m[name].isNotNull()).alias(name) for name in MAPPED_FIELDS],
        F.bool_or(_is_grouped(m)).alias("grouped"), F.bool_and(_is_grouped(m)).alias("only_grouped"),
    ).first()
    used = frozenset(name for name in MAPPED_FIELDS if seen[name])
    kinds = frozenset(k for k, there in ((True, seen["grouped"]), (False, not seen["only_grouped"])) if there)
    values = [(F.coalesce(F.col("cells")[m[name]], F.lit("")) if name in used else F.lit("")).alias(name) for name in MAPPED_FIELDS]
    return Rows(cells.join(structs, "file").select("file", "row_no", "m", *values), structs, used, kinds)


def rows_from_frame(df: DataFrame, file: str, row_no: str, mapping: Mapping[str, object]) -> Rows:
    """The same shape straight from one wide text table and its one mapping.

    Only mapped columns are read, so pruning reaches the scan; nothing is packed into maps.
    """
    names = {name: mapping.get(name) for name in MAPPED_FIELDS}
    vocabulary = mapping.get("status_values") or {}
    pairs = [F.lit(x) for item in dict(vocabulary).items() for x in item]
    m = F.struct(
        F.lit(mapping.get("granularity") or "invoice").alias("granularity"),
        *[F.lit(v).cast("string").alias(k) for k, v in names.items()],
        F.lit(mapping.get("currency_default")).cast("string").alias("currency_default"),
        F.lit(mapping.get("date_format") or "unknown").alias("date_format"),
        F.create_map(*pairs).cast("map<string,string>").alias("status_values"),
    )
    values = [
        (strip(F.coalesce(F.col(f"`{v}`").cast("string"), F.lit(""))) if v else F.lit("")).alias(k)
        for k, v in names.items()
    ]
    frame = df.select(F.lit(file).alias("file"), F.col(row_no).cast("long").alias("row_no"), m.alias("m"), *values)
    return Rows(frame, df.sparkSession.range(1).select(F.lit(file).alias("file"), m.alias("m")))


def _is_grouped(m: Column) -> Column:
    return F.coalesce((m["granularity"] == "line_item") & m["invoice_number"].isNotNull(), F.lit(False))


def _mapped_line_columns(m: Column) -> Column:
    return sum((F.when(m[name].isNotNull(), 1).otherwise(0) for name in LINE_FIELDS), F.lit(0))


def _with_row_line(rows: DataFrame) -> DataFrame:
    """Type the line cells of every row once, before any shuffle."""
    filled = reduce(or_, [F.col(name) != "" for name in LINE_FIELDS])
    has_line = (_mapped_line_columns(F.col("m")) >= 2) & filled
    typed = with_money(
        rows.withColumn("_has_line", has_line),
        {"_q": "line_item_quantity", "_p": "line_item_unit_price", "_a": "line_item_amount"},
    )
    line = build_line(F.col("line_item_description"), F.col("_q"), F.col("_p"), F.col("_a"))
    return typed.withColumn("line", F.when(F.col("_has_line"), line)).drop("_q", "_p", "_a", "_has_line")


def is_skipped() -> Column:
    """True for rows of a line-item file whose invoice number is empty."""
    return _is_grouped(F.col("m")) & (norm_key(F.col("invoice_number")) == "")


def _keyed(rows: Rows) -> tuple[DataFrame, DataFrame]:
    """(rows that are drafts by themselves, rows to be grouped by invoice number)."""
    lined = _with_row_line(rows.frame)
    grouped = _is_grouped(F.col("m"))
    single, many = (lined.where(kind if found in rows.kinds else F.lit(False)) for kind, found in ((~grouped, False), (grouped, True)))
    # The filter says that the key is not empty, without making the key a second time.
    many = many.where(F.lower("invoice_number").rlike("[a-z0-9]")).withColumn("draft_key", norm_key(F.col("invoice_number")))
    return single.withColumn("draft_key", F.col("row_no").cast("string")), many


def _line_measures(rows: DataFrame) -> DataFrame:
    """Per-row contributions to the line totals of a draft."""
    rounded = round_line(F.col("line"))
    has = F.col("line").isNotNull()
    return rows.withColumns(
        {
            "column_lines": F.when(has, 1).otherwise(0).cast("long"),
            "column_sum": F.when(has, F.col("line.amount")).otherwise(0).cast("decimal(28,6)"),
            "column_rounded": F.when(has, rounded["amount"]).otherwise(0).cast(SUM_MONEY),
            "column_notes": F.when(has, line_note_count(rounded)).otherwise(0).cast("long"),
        }
    )


_MEASURES = {
    "column_lines": "long",
    "column_sum": "decimal(28,6)",
    "column_rounded": SUM_MONEY,
    "column_notes": "long",
}


def _groups(single: DataFrame, many: DataFrame, rows: Rows) -> DataFrame:
    """One row per draft with the first non-empty texts, the row range and line measures."""
    first = [F.expr(f"coalesce(min_by({c}, row_no) FILTER (WHERE {c} <> ''), '')").alias(c) for c in _FIRST_OF if c in rows.used]
    unmapped = [F.lit("").alias(c) for c in _FIRST_OF if c not in rows.used]
    keep = ["file", "draft_key", "m", *_FIRST_OF, *_MEASURES]
    alone = _line_measures(single).select(
        *keep,
        F.col("row_no").alias("first_row"),
        F.lit(1).cast("long").alias("row_count"),
        F.lit(False).alias("grouped"),
        F.col("line").alias("own_line"),
    )
    # The mapping is joined again afterwards rather than carried through the aggregation.
    gathered = (
        _line_measures(many)
        .groupBy("file", "draft_key")
        .agg(
            F.min("row_no").alias("first_row"),
            F.count(F.lit(1)).alias("row_count"),
            *first,
            *[F.sum(c).cast(t).alias(c) for c, t in _MEASURES.items()],
        )
        .select("*", *unmapped)
        .join(rows.mapping, "file")
        .select(
            *keep, "first_row", "row_count", F.lit(True).alias("grouped"),
            F.lit(None).cast(RAW_LINE_DDL).alias("own_line"),
        )
    )
    return alone.unionByName(gathered)


def group_rows(rows: Rows) -> DataFrame:
    """Drafts of each file as row groups: file, draft_key, first_row, row_count, first values."""
    return _groups(*_keyed(rows), rows).select("file", "draft_key", "first_row", "row_count", *_FIRST_OF)


# ------------------------------------------------------------------ groups to drafts


def _other_lines(groups: DataFrame) -> DataFrame:
    """Lines that do not come from line columns: a packed cell, or one made from the subtotal."""
    m = F.col("m")
    none = F.array().cast(f"array<{RAW_LINE_DDL}>")
    packed = F.when(
        (F.col("column_lines") == 0) & (F.col("line_items_json") != ""), parse_line_cell(F.col("line_items_json"))
    ).otherwise(none)
    parsed = with_money(groups, {name: name for name in ("subtotal", "tax", "total")}).withColumn(
        "_packed", packed
    )
    amount = F.coalesce(F.round("subtotal", 2), F.lit(0)).cast(RAW_MONEY)
    made = F.struct(
        F.when(F.col("line_item_description") == "", F.lit(SYNTHESIZED_DESCRIPTION))
        .otherwise(F.col("line_item_description"))
        .alias("description"),
        F.lit(1).cast(RAW_MONEY).alias("quantity"),
        amount.alias("unit_price"),
        amount.alias("amount"),
    ).cast(RAW_LINE_DDL)
    origin = (
        F.when(F.col("column_lines") > 0, "columns")
        .when(F.size("_packed") > 0, "packed")
        .when(m["line_item_description"].isNotNull(), "synthesized")
        .otherwise("none")
    )
    return (
        parsed.withColumn("line_origin", origin)
        .withColumn(
            "other_lines",
            F.when(F.col("line_origin") == "packed", F.col("_packed"))
            .when(F.col("line_origin") == "synthesized", F.array(made))
            .otherwise(none),
        )
        .drop("_packed")
    )


def _with_amounts(groups: DataFrame) -> DataFrame:
    """Missing tax, subtotal and total, strictly in that order, each with its note."""
    m = F.col("m")
    counted = groups.withColumns(
        {
            "line_count": F.col("column_lines") + F.size("other_lines"),
            "_raw_sum": F.round(F.col("column_sum") + sum_amounts(F.col("other_lines")), 2).cast(SUM_MONEY),
        }
    )
    tax_note = F.when(
        F.col("tax").isNull(),
        F.when(m["tax"].isNotNull(), F.lit("The tax column was empty; tax recorded as 0."))
        .otherwise(F.lit("No tax column in the file; tax recorded as 0.")),
    )
    taxed = counted.withColumns(
        {"tax_note": tax_note, "tax": F.coalesce("tax", F.lit(0)).cast(RAW_MONEY), "_given": F.col("subtotal")}
    )
    has_lines = F.col("line_count") > 0
    subtotal_note = F.when(
        F.col("_given").isNull(),
        F.when(
            has_lines,
            F.concat(
                F.lit("Subtotal was not in the file; summed "), F.col("line_count").cast("string"),
                F.lit(" line amount(s) to "), money_text(F.col("_raw_sum")), F.lit("."),
            ),
        )
        .when(F.col("total").isNotNull(), F.lit("Subtotal was not in the file; derived it as total minus tax."))
        .otherwise(F.lit("Neither a subtotal nor a total was found; subtotal recorded as 0.")),
    )
    derived = F.when(has_lines, F.col("_raw_sum")).otherwise(
        F.coalesce(F.round(F.col("total") - F.col("tax"), 2), F.lit(0))
    )
    subtotalled = taxed.withColumns(
        {
            "subtotal_note": subtotal_note,
            "_wide_subtotal": F.coalesce(F.col("_given").cast("decimal(28,6)"), derived.cast("decimal(28,6)")),
        }
    )
    used = F.round(F.col("_wide_subtotal") + F.col("tax"), 2).cast(SUM_MONEY)
    totalled = subtotalled.withColumns(
        {
            "total_note": F.when(
                F.col("total").isNull(),
                F.concat(F.lit("Total was not in the file; used subtotal + tax = "), money_text(used), F.lit(".")),
            ),
            "_wide_total": F.coalesce(F.col("total").cast("decimal(28,6)"), used.cast("decimal(28,6)")),
        }
    )
    # Parsed amounts always fit; a derived sum might not, and then says so.
    subtotal = F.round("_wide_subtotal", 2).try_cast(MONEY)
    total = F.round("_wide_total", 2).try_cast(MONEY)
    return totalled.withColumns(
        {
            "overflow_note": F.when(
                subtotal.isNull() | total.isNull(), F.lit("A derived amount is too large to store; recorded as 0.")
            ),
            "subtotal": F.coalesce(subtotal, F.lit(0)).cast(MONEY),
            "tax": F.round("tax", 2).cast(MONEY),
            "total": F.coalesce(total, F.lit(0)).cast(MONEY),
        }
    ).drop("_raw_sum", "_given", "_wide_subtotal", "_wide_total")


def _finish(groups: DataFrame, as_of: date) -> DataFrame:
    m = F.col("m")
    amounts = _with_amounts(_other_lines(groups))
    number = F.col("invoice_number")
    made_number = F.concat(
        F.lit("IMPORT-"), file_stem(F.col("file")), F.lit("-"), F.col("first_row").cast("string")
    )
    default = F.upper(strip(F.coalesce(m["currency_default"], F.lit(""))))
    with_days = with_dates(
        amounts, {"_issued": "invoice_date", "_due": "due_date"}, m["date_format"], as_of
    )
    read = with_days.withColumns(
        {
            "_currency": F.coalesce(parse_currency(F.col("currency")), default),
            "_number": F.when(number == "", made_number).otherwise(number),
            "_number_note": F.when(
                number == "",
                F.concat(F.lit("No invoice number in the file; generated "), made_number, F.lit(".")),
            ),
            "status": parse_status(F.col("status"), m["status_values"]),
        }
    )
    date_notes = [
        F.when(
            F.col("_issued").isNull(),
            F.lit("No readable invoice date in the source row; today's date was used."),
        ),
        F.when(
            F.col("_due").isNull() & (F.col("due_date") != ""),
            F.concat(F.lit("Due date "), quoted(F.col("due_date")), F.lit(" could not be read.")),
        ),
    ]
    has_sources = F.coalesce(
        *[F.when(m[name].isNotNull(), F.lit(True)) for name in (*LINE_FIELDS, "line_items_json")], F.lit(False)
    )
    line_note = F.when(
        F.col("line_origin") == "packed",
        F.concat(F.lit("Line items were unpacked from the "), quoted(m["line_items_json"]), F.lit(" column.")),
    ).when(
        F.col("line_origin") == "synthesized",
        F.lit("The file has a description but no line detail; one line was synthesized from the subtotal."),
    )
    usable = is_code(F.col("_currency"))
    rounded = F.transform("other_lines", round_line)
    dated = read.withColumns(
        {
            "date_notes": F.array_compact(F.array(*date_notes)),
            "require_lines": has_sources,
            "import_notes": F.array_compact(
                F.array(
                    line_note,
                    "tax_note",
                    "subtotal_note",
                    "total_note",
                    "_number_note",
                    F.when(~usable, F.lit("No usable currency for this row; assumed USD.")),
                    F.when(
                        ~has_sources & (F.col("line_count") == 0),
                        F.lit("No line items in the source file (summary-level export)."),
                    ),
                )
            ),
            "invoice_number": F.col("_number"),
            "invoice_date": F.coalesce("_issued", F.lit(as_of)),
            "due_date": F.col("_due"),
            "currency": F.when(usable, F.col("_currency")).otherwise(F.lit("USD")),
            "vendor_email": F.when(F.col("vendor_email") != "", F.col("vendor_email")),
            "po_number": F.when(F.col("po_number") != "", F.col("po_number")),
            "other_lines": rounded,
        }
    )
    totals = dated.withColumns(
        {
            "status": derive_status(as_of),
            "line_sum": (F.col("column_rounded") + sum_amounts(F.col("other_lines"), SUM_MONEY)).cast(SUM_MONEY),
            "line_note_count": F.col("column_notes")
            + F.aggregate("other_lines", F.lit(0).cast("long"), lambda n, line: n + line_note_count(line)),
        }
    )
    checked = totals.withColumns(
        {
            "opening_notes": F.array_compact(F.array(*opening_notes(F.col("require_lines")))),
            "closing_notes": F.concat(
                F.array_compact(F.array(*closing_notes(), "overflow_note")), F.col("date_notes")
            ),
        }
    )
    return checked.withColumn(
        "needs_review",
        (F.size("opening_notes") + F.size("closing_notes") > 0) | (F.col("line_note_count") > 0),
    ).select(
        "file", "draft_key", "first_row", "row_count",
        "invoice_number", "vendor_name", "vendor_email", "invoice_date", "due_date", "currency",
        "subtotal", "tax", "total", "po_number", "status",
        "line_origin", "line_count", "line_sum", "line_note_count",
        "opening_notes", "closing_notes", "needs_review", "import_notes",
        "grouped", F.when(F.col("own_line").isNotNull(), round_line(F.col("own_line"))).alias("own_line"), "other_lines",
    )


def convert(rows: Rows, as_of: date | None = None) -> Drafts:
    """All drafts of all files. `as_of` stands in for today wherever a date is missing or compared."""
    as_of = as_of or date.today()
    single, many = _keyed(rows)
    headers = _finish(_groups(single, many, rows), as_of)
    keyed = [
        part.select("file", "draft_key", "row_no", "line", F.lit(grouped).alias("grouped"))
        for part, grouped in ((single, False), (many, True))
    ]
    return Drafts(headers, keyed[0].unionByName(keyed[1]))


def convert_cells(cells: DataFrame, mapping: DataFrame, as_of: date | None = None) -> Drafts:
    return convert(rows_from_cells(cells, mapping), as_of)


def nest(drafts: Drafts, limit: int = NEST_LIMIT) -> DataFrame:
    """Drafts with arrays: `line_items`, `source_rows` and the full `review_notes`.

    A draft grouped from more than `limit` rows keeps null arrays; its rows stay whole in the long
    tables. They are taken out before anything is collected, so no task gathers more than `limit`.
    """
    grouped = drafts.rows.where("grouped")
    large = (
        grouped.groupBy("file", "draft_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limit)
        .select("file", "draft_key")
    )
    gathered = (
        grouped.join(large, ["file", "draft_key"], "left_anti")
        .groupBy("file", "draft_key")
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("_entries"))
    )
    own, entries, other = F.col("own_line"), F.col("_entries"), F.col("other_lines")
    column_lines = F.transform(F.filter(entries, lambda e: e["line"].isNotNull()), lambda e: round_line(e["line"]))
    items = (
        F.when(~F.col("grouped"), F.when(own.isNotNull(), F.array(own)).otherwise(other))
        .when(entries.isNull(), F.lit(None))
        .when(F.col("line_origin") == "columns", column_lines)
        .otherwise(other)
    )

    def packed(headers: DataFrame) -> DataFrame:
        filled = headers.withColumns(
            {
                "line_items": items,
                "source_rows": F.when(F.col("grouped"), F.transform(entries, lambda e: e["row_no"])).otherwise(
                    F.array("first_row")
                ),
            }
        )
        return filled.withColumn(
            "review_notes",
            F.concat("opening_notes", array_line_notes(F.col("line_items")), stored_line_note(filled), "closing_notes"),
        ).drop("_entries", "own_line", "other_lines", "opening_notes", "closing_notes", "grouped")

    no_entries = F.lit(None).cast(gathered.schema["_entries"].dataType)
    alone = drafts.headers.where("not grouped").withColumn("_entries", no_entries)
    several = drafts.headers.where("grouped").join(gathered, ["file", "draft_key"], "left")
    return packed(alone).unionByName(packed(several))


# ------------------------------------------------------------------ per-file reports


def file_warnings(rows: Rows, as_of: date | None = None) -> DataFrame:
    """Whole-file problems: file, warnings. One pass of partial aggregates over the rows."""
    m = F.col("m")
    dated = with_dates(rows.frame, {"_issued": "invoice_date", "_due": "due_date"}, m["date_format"], as_of)
    unread = [
        F.when((F.col(text) != "") & F.col(parsed).isNull(), 1).otherwise(0)
        for text, parsed in (("invoice_date", "_issued"), ("due_date", "_due"))
    ]
    read = dated.select(
        "file",
        is_skipped().cast("int").alias("_skipped"),
        (unread[0] + unread[1]).alias("_unreadable"),
        (m["total"].isNull() & m["subtotal"].isNull()).alias("_no_total"),
        m["vendor_name"].isNull().alias("_no_vendor"),
    )
    per_file = read.groupBy("file").agg(
        F.sum("_skipped").alias("skipped"),
        F.sum("_unreadable").alias("unreadable"),
        F.bool_or("_no_total").alias("no_total"),
        F.bool_or("_no_vendor").alias("no_vendor"),
    )
    warnings = [
        F.when(
            F.col("skipped") > 0,
            F.concat(F.col("skipped").cast("string"), F.lit(" row(s) were skipped: the invoice-number column was empty.")),
        ),
        F.when(
            F.col("unreadable") > 0,
            F.concat(F.col("unreadable").cast("string"), F.lit(" date value(s) could not be read and were left blank or defaulted.")),
        ),
        F.when(F.col("no_total"), F.lit("No total or subtotal column was found; amounts were derived from the line items.")),
        F.when(F.col("no_vendor"), F.lit("No vendor column was found; vendor names are blank and need review.")),
    ]
    return per_file.select("file", "skipped", "unreadable", F.array_compact(F.array(*warnings)).alias("warnings"))


def preview_summary(rows: Rows, headers: DataFrame) -> DataFrame:
    """Per file: source rows, drafts found, drafts that need review."""
    counted = rows.frame.groupBy("file").agg(F.count(F.lit(1)).alias("row_count"))
    found = headers.groupBy("file").agg(
        F.count(F.lit(1)).alias("drafts"), F.count_if("needs_review").alias("flagged")
    )
    return counted.join(found, "file", "left").select(
        "file",
        "row_count",
        F.coalesce("drafts", F.lit(0)).alias("drafts"),
        F.coalesce("flagged", F.lit(0)).alias("flagged"),
    )
