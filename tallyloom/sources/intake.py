"""What arrived and where it goes: routing by suffix and size, the text gate, structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import blank_to_empty
from tallyloom.operators.validate import round_money, with_review
from tallyloom.schema import INVOICE_DRAFT, STATUSES

# Limits and suffixes of the intake.
MAX_FILE_BYTES = 2 * 1024 * 1024
EXPORT_SUFFIXES = ("csv", "json", "xlsx")
DOCUMENT_SUFFIXES = ("txt", "md", "pdf")
MIN_TEXT_CHARS = 20
MAX_PASTED_CHARS = 20_000


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def classify(listing: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add `kind` (export, document or null) and `reject_reason` to rows of `path, length`.

    Without `max_bytes` no size is refused; MAX_FILE_BYTES is the limit of an upload.
    """
    suffix = suffix_of(F.col("path"))
    kind = F.when(suffix.isin(*EXPORT_SUFFIXES), F.lit("export")).when(
        suffix.isin(*DOCUMENT_SUFFIXES), F.lit("document")
    )
    name = base_name(F.col("path"))
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    reason = F.when(
        large, F.concat(name, F.lit(" is "), F.col("length").cast("string"), F.lit(f" bytes; the limit is {max_bytes} bytes."))
    ).when(
        kind.isNull(),
        F.concat(F.lit("Unsupported file type '"), name, F.lit("'. Upload a .pdf, .txt, .md, .csv, .json or .xlsx file.")),
    )
    return listing.withColumns({"kind": kind, "reject_reason": reason})


def list_files(spark: SparkSession, paths: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """Route a landing folder without reading any content: only path and length leave the scan."""
    return classify(spark.read.format("binaryFile").load(paths).select("path", "length"), max_bytes)


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text documents, undecodable ones flagged: path, text, decodable."""
    files = spark.read.format("binaryFile").load(paths).where(suffix_of(F.col("path")).isin("txt", "md"))
    return files.select(
        "path",
        F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("decodable"),
    )


def text_gate(text: Column, pasted: bool = True) -> Column:
    """`ok`, `undecodable`, `too_short` (trimmed below 20) or, for pasted text, `too_long`."""
    gate = F.when(text.isNull(), F.lit("undecodable"))
    if pasted:
        gate = gate.when(F.length(text) > MAX_PASTED_CHARS, F.lit("too_long"))
    return gate.when(F.length(blank_to_empty(text)) < MIN_TEXT_CHARS, F.lit("too_short")).otherwise(F.lit("ok"))


REQUIRED = ("invoice_number", "vendor_name", "invoice_date", "currency", "line_items", "subtotal", "tax", "total")


def parse_records(df: DataFrame, json_column: str) -> DataFrame:
    """Invoices extracted upstream, one JSON text per row, checked against the invoice schema.

    Adds the invoice columns, `error` (null when the record fits), `review_notes` and `needs_review`.
    A record that does not fit keeps its row with the reason.
    """
    schema = T.StructType([*INVOICE_DRAFT.fields, T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn(
        "_record",
        F.from_json(F.col(json_column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    )
    record = F.col("_record")
    missing = F.array_compact(
        F.array(*[F.when(record[name].isNull(), F.lit(name)) for name in REQUIRED])
    )
    # A line must be whole; an entry that is not an object parses to null.
    broken_line = F.exists(
        record["line_items"],
        lambda line: line.isNull() | line["description"].isNull() | line["quantity"].isNull()
        | line["unit_price"].isNull() | line["amount"].isNull(),
    )
    error = (
        F.when(record.isNull() | record["_corrupt"].isNotNull(), F.lit("The record does not match the invoice schema."))
        .when(F.size(missing) > 0, F.concat(F.lit("Missing or unreadable: "), F.array_join(missing, ", "), F.lit(".")))
        .when(broken_line, F.lit("A line item does not match the invoice schema."))
        .when(
            record["status"].isNotNull() & ~record["status"].isin(*STATUSES),
            F.lit("The status is not one of paid, pending or overdue."),
        )
    )
    columns = {name: record[name] for name in INVOICE_DRAFT.fieldNames()}
    columns["status"] = F.coalesce(record["status"], F.lit("pending"))
    flat = parsed.withColumn("error", error).withColumns(columns).drop("_record")
    reviewed = with_review(round_money(flat))
    fits = F.col("error").isNull()
    return reviewed.withColumns(
        {
            "review_notes": F.when(fits, F.col("review_notes")),
            "needs_review": F.when(fits, F.col("needs_review")),
        }
    )
