"""Column types shared by every stage. Money is decimal from the first parse to the last sum."""

from __future__ import annotations

from pyspark.sql import types as T

# Parsed cells keep six decimals; stored money keeps two. Eighteen digits hold every value the
# money parser can return, so storing a parsed amount never overflows.
RAW_MONEY = "decimal(18,6)"
MONEY = "decimal(18,2)"
SUM_MONEY = "decimal(28,2)"

LINE_DDL = f"struct<description:string,quantity:{RAW_MONEY},unit_price:{MONEY},amount:{MONEY}>"
RAW_LINE_DDL = f"struct<description:string,quantity:{RAW_MONEY},unit_price:{RAW_MONEY},amount:{RAW_MONEY}>"

STATUSES = ("paid", "pending", "overdue")
SOURCES = ("seed", "extracted", "seed-fallback", "uploaded", "imported")

LINE = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.DecimalType(18, 6)),
        T.StructField("unit_price", T.DecimalType(18, 2)),
        T.StructField("amount", T.DecimalType(18, 2)),
    ]
)

# What a document or an export yields before it is saved.
INVOICE_FIELDS = [
    T.StructField("invoice_number", T.StringType()),
    T.StructField("vendor_name", T.StringType()),
    T.StructField("vendor_email", T.StringType()),
    T.StructField("invoice_date", T.DateType()),
    T.StructField("due_date", T.DateType()),
    T.StructField("currency", T.StringType()),
    T.StructField("line_items", T.ArrayType(LINE)),
    T.StructField("subtotal", T.DecimalType(18, 2)),
    T.StructField("tax", T.DecimalType(18, 2)),
    T.StructField("total", T.DecimalType(18, 2)),
    T.StructField("po_number", T.StringType()),
    T.StructField("status", T.StringType()),
]
INVOICE_DRAFT = T.StructType(INVOICE_FIELDS)

# The stored ledger. `line_count` and `line_sum` stand beside the array so that checks and reports
# never have to read it; `line_items` is null for an invoice whose lines live in the line table.
INVOICE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("vendor_name", T.StringType()),
        T.StructField("vendor_email", T.StringType()),
        T.StructField("invoice_date", T.DateType()),
        T.StructField("due_date", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("line_items", T.ArrayType(LINE)),
        T.StructField("line_count", T.LongType()),
        T.StructField("line_sum", T.DecimalType(28, 2)),
        T.StructField("subtotal", T.DecimalType(18, 2)),
        T.StructField("tax", T.DecimalType(18, 2)),
        T.StructField("total", T.DecimalType(18, 2)),
        T.StructField("currency", T.StringType()),
        T.StructField("po_number", T.StringType()),
        T.StructField("needs_review", T.BooleanType()),
        T.StructField("review_notes", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

LEDGER_LINE = T.StructType(
    [
        T.StructField("invoice_number", T.StringType()),
        T.StructField("line_no", T.LongType()),
        *LINE.fields,
    ]
)

REJECT = T.StructType([T.StructField("file", T.StringType()), T.StructField("reason", T.StringType())])

# The invoice fields a source column can feed, in report and tie-break order.
MAPPED_FIELDS = (
    "invoice_number",
    "vendor_name",
    "vendor_email",
    "invoice_date",
    "due_date",
    "currency",
    "status",
    "subtotal",
    "tax",
    "total",
    "po_number",
    "line_item_description",
    "line_item_quantity",
    "line_item_unit_price",
    "line_item_amount",
    "line_items_json",
)
LINE_FIELDS = (
    "line_item_description",
    "line_item_quantity",
    "line_item_unit_price",
    "line_item_amount",
)
MONEY_FIELDS = ("total", "subtotal", "tax", "line_item_amount", "line_item_unit_price")

MAPPING = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("granularity", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in MAPPED_FIELDS],
        T.StructField("currency_default", T.StringType()),
        T.StructField("date_format", T.StringType()),
        T.StructField("status_values", T.MapType(T.StringType(), T.StringType())),
        T.StructField("notes", T.ArrayType(T.StringType())),
        T.StructField("mapping_source", T.StringType()),
    ]
)
