"""Invoice-shaped views over the order tables, and the same orders rendered as foreign exports.

These feed the registered queries: the engine sees messy text, the checks see the typed columns the
text was made from.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.cells import parse_status
from tallyloom.operators.numbering import earlier_sum, number_rows, written
from tallyloom.operators.validate import derive_status
from tallyloom.schema import MONEY, SUM_MONEY
from tallyloom.sources.staging import Staged

AS_OF = date(1999, 1, 1)
CENTS = "decimal(12,2)"
ORDERS_PER_FILE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_case(value: Column, cases: dict, default: Column | None = None) -> Column:
    """CASE value WHEN ... over constants or columns."""
    items = [(k, v if isinstance(v, Column) else F.lit(v)) for k, v in cases.items()]
    out = F.when(value == items[0][0], items[0][1])
    for key, result in items[1:]:
        out = out.when(value == key, result)
    return out if default is None else out.otherwise(default)


def invoice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per order: header columns, `line_count`, `line_sum`, `line_note_count`."""
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.col("l_extendedprice").cast(CENTS)).alias("line_sum"),
        F.count_if((F.col("l_quantity") <= 0) | (F.col("l_extendedprice") < 0)).alias("line_note_count"),
    )
    customers = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "c_mktsegment", "r_name")
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    terms = by_case(F.col("o_orderpriority"), {"1-URGENT": 15, "2-HIGH": 30, "3-MEDIUM": 45, "5-LOW": -5})
    line_sum = F.coalesce("line_sum", F.lit(0)).cast(SUM_MONEY)
    subtotal = (line_sum + F.when(key % 10 == 3, F.lit("5.00")).otherwise(F.lit("0.00")).cast(CENTS)).cast(MONEY)
    shaped = joined.select(
        key.alias("id"),
        F.concat(F.lit("INV-"), key.cast("string")).alias("invoice_number"),
        F.col("c_name").alias("vendor_name"),
        F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lower("c_mktsegment"), F.lit("@example.com"))).alias("vendor_email"),
        day.alias("invoice_date"),
        F.date_add(day, terms).alias("due_date"),
        by_case(F.col("o_orderstatus"), {"F": "Settled", "O": "open", "P": "Past due"}).alias("raw_status"),
        by_case(F.col("r_name"), {"EUROPE": "EUR", "ASIA": "JPY", "MIDDLE EAST": "us"}, F.lit("USD")).alias("currency"),
        F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count"),
        line_sum.alias("line_sum"),
        F.coalesce("line_note_count", F.lit(0)).cast("long").alias("line_note_count"),
        subtotal.alias("subtotal"),
        F.when(key % 2 == 0, F.concat(F.lit("PO-"), key.cast("string"))).alias("po_number"),
        by_case(key % 4, {0: "seed", 1: "extracted", 2: "uploaded", 3: "imported"}).alias("source"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").cast(CENTS).alias("_printed"),
    )
    taxed = shaped.withColumn("tax", F.round(F.col("subtotal") * F.lit("0.08").cast("decimal(4,2)"), 2).cast(MONEY))
    return (
        taxed.withColumn(
            "total",
            F.when(F.col("id") % 10 == 7, F.col("_printed")).otherwise(F.col("subtotal") + F.col("tax")).cast(MONEY),
        )
        .withColumn("status", parse_status(F.col("raw_status")))
        .withColumn("status", derive_status(AS_OF))
        .drop("_printed")
    )


# ------------------------------------------------------------------ orders as export files

_STATES = {"F": "Settled", "O": "Open", "P": "Past due"}


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed order rows with the file and layout they are exported in.

    A file holds one nation's orders of one key range, so no file has more than a thousand rows.
    """
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    nation, key = F.col("c_nationkey"), F.col("o_orderkey")
    layout = nation % 4
    day = F.col("o_orderdate").cast("date")
    net = F.col("o_totalprice").cast(CENTS)
    tax = F.round(net * F.lit("0.10").cast("decimal(4,2)"), 2).cast(CENTS)
    return orders.select(
        layout.alias("layout"),
        F.concat(
            F.lit("orders-"), nation.cast("string"), F.lit("-"), F.expr(f"o_orderkey div {ORDERS_PER_FILE}").cast("string"),
            F.when(layout == 2, F.lit(".json")).otherwise(F.lit(".csv")),
        ).alias("file"),
        "o_orderkey",
        F.concat(F.lit("ORD-"), key.cast("string")).alias("number"),
        F.col("c_name").alias("vendor"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("email"),
        F.when(layout == 3, F.last_day(day)).otherwise(day).alias("day"),
        F.when(layout == 0, F.last_day(day)).otherwise(F.date_add(day, 30)).alias("due"),
        net.alias("net"),
        tax.alias("tax"),
        (net + tax).cast(CENTS).alias("total"),
        by_case(F.col("o_orderstatus"), _STATES).alias("state"),
        F.when(key % 3 == 0, F.lit("EUR")).otherwise(F.lit("usd")).alias("code"),
    )


LAYOUT_HEADERS = {
    0: ("Supplier", "Inv No", "Bill Date", "Pay By", "Net", "VAT", "Amount Due", "Ccy", "State", "PO Ref"),
    1: ("Company", "Reference", "Date", "Net Amount", "Total Due", "Comment"),
    2: (
        "document_no", "vendor.name", "vendor.email", "issued_on", "due_on", "currency", "lines", "net_amount",
        "tax_amount", "grand_total", "state",
    ),
    3: ("Payee", "Document No", "Issued", "Total Incl. Tax"),
}


def _quoted_cell(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def rendered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: every order exported once, in four layouts."""
    rows = order_rows(spark, sf_dir)
    net, total = F.col("net"), F.col("total")
    dmy = "dd/MM/yyyy"
    european = F.translate(F.format_number(net, 2), ",.", ".,")
    first = F.round(net * F.lit("0.60").cast("decimal(4,2)"), 2).cast(CENTS)

    def line(description: str, amount: Column) -> Column:
        return F.struct(
            F.lit(description).alias("description"), F.lit(1).alias("quantity"),
            amount.alias("unit_price"), amount.alias("amount"),
        )

    record = F.to_json(
        F.struct(
            F.col("number").alias("document_no"),
            F.struct(F.col("vendor").alias("name"), F.col("email").alias("email")).alias("vendor"),
            F.col("day").alias("issued_on"),
            F.col("due").alias("due_on"),
            F.lit("GBP").alias("currency"),
            F.array(line("Goods", first), line("Freight", (net - first).cast(CENTS))).alias("lines"),
            net.alias("net_amount"),
            F.col("tax").alias("tax_amount"),
            total.alias("grand_total"),
            F.col("state").alias("state"),
        )
    )
    text = by_case(
        F.col("layout"),
        {
            0: F.concat_ws(
                ",", "vendor", "number", F.date_format("day", dmy), F.date_format("due", dmy), net.cast("string"),
                F.col("tax").cast("string"), _quoted_cell(F.concat(F.lit("$"), F.format_number(total, 2))), "code",
                "state", F.concat(F.lit("PO-"), F.col("o_orderkey").cast("string")),
            ),
            1: F.concat_ws(
                ";", "vendor", "number", F.date_format("day", "yyyy-MM-dd"), european,
                F.concat(F.lit("€ "), european), F.lit("none"),
            ),
            2: record,
            3: F.concat_ws(
                ",", "vendor", "number", F.date_format("day", "MM/dd/yyyy"),
                _quoted_cell(F.concat(F.lit("$"), F.format_number(total, 2))),
            ),
        },
    )
    files = (
        rows.select("layout", "file", "o_orderkey", text.alias("text"))
        .groupBy("layout", "file")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "text"))), lambda r: r["text"]).alias("rows"))
    )
    head = by_case(
        F.col("layout"), {0: ",".join(LAYOUT_HEADERS[0]), 1: ";".join(LAYOUT_HEADERS[1]), 3: ",".join(LAYOUT_HEADERS[3])}
    )
    body = F.when(
        F.col("layout") == 2, F.concat(F.lit("["), F.array_join("rows", ",\n"), F.lit("]"))
    ).otherwise(F.concat(head, F.lit("\n"), F.array_join("rows", "\n"), F.lit("\n")))
    return files.select(F.col("file").alias("path"), F.encode(body, "UTF-8").alias("content"))


# ------------------------------------------------------------------ order lines as one-line-per-row exports

LINE_HEADERS = ("Invoice", "Vendor", "Date", "Item", "Qty", "Unit Price", "Line Total")
_LINE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def line_rows(spark: SparkSession, sf_dir: str) -> Staged:
    """Every order line as a staged row of its nation's line-item export.

    Numbers are spelt two ways, missing on seventh lines; vendors stand on even lines only; some
    dates are unreadable.
    """
    lines = table(spark, sf_dir, "lineitem")
    file = F.concat(F.lit("lines-"), F.col("c_nationkey").cast("string"), F.lit(".csv"))
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(file.alias("file"), "o_orderkey", "o_orderdate", "c_name")
        .where(F.col("file").isNotNull())
    )
    # Lines are counted by order, and orders placed by the lines before them; lines only meet those of their order.
    # Slices are ranges of order keys, so sizes are summed over few rows.
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("_lines"))
    sliced = orders.join(per_order, "o_orderkey").withColumn("_slice", F.shiftright("o_orderkey", 16))
    placed = earlier_sum(sliced, ["file"], ["_slice"], "o_orderkey", "_lines", "_earlier")
    within = F.row_number().over(Window.partitionBy("l_orderkey", "file").orderBy("l_linenumber", *_LINE_ORDER))
    numbered = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("row_no", F.col("_earlier") + within + 1)
    n, key = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    values = [
        F.when(n == 7, F.lit("")).when(n % 2 == 0, F.concat(F.lit("LI-"), key)).otherwise(F.concat(F.lit("li "), key)),
        F.when(n % 2 == 0, F.concat(F.col("c_name"), F.lit("/"), n.cast("string"))).otherwise(F.lit("")),
        F.when(F.col("l_partkey") % 50 == 0, F.lit("some day")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")),
        F.col("l_quantity").cast("int").cast("string"),
        F.concat((F.col("l_partkey") % 1000).cast("string"), F.lit(".25")),
        F.format_number(F.col("l_extendedprice").cast(CENTS), 2),
    ]
    names = F.array(*[F.lit(h) for h in LINE_HEADERS])
    # Numbered once: what reads the rows reads them several times. Most values are distinct, so a dictionary of them is work for nothing.
    cells = written(
        numbered.select("file", F.col("row_no").cast("long").alias("row_no"), F.map_from_arrays(names, F.array(*values)).alias("cells")),
        "line-rows", {"parquet.enable.dictionary#cells.key_value.value": "false"},
    )
    return Staged(cells, cells.select("file").distinct().select("file", names.alias("headers")))


# ------------------------------------------------------------------ exports whose layout only late rows give away

#: Rows before those that decide.
LATE = 250
LATE_HEADERS = {
    0: ("Invoice", "Total", "Amount", "Item", "Qty", "Date"),
    1: ("Ref", "Vendor", "Amount", "Issued"),
    2: ("Ref", "Vendor", "Total", "Date"),
    3: ("Ref", "Vendor", "Total", "Date", "Ccy"),
    4: ("Ref", "Vendor", "Total", "Misc"),
}


def late_rows(spark: SparkSession, sf_dir: str) -> Staged:
    """Every order as a staged row of its nation's export, in five layouts.

    Past row `LATE` numbers repeat (0), days exceed twelve (2), another code is the most common (3), and lists and symbols
    turn up (4); dates are year first in (1) and spelt out in (3).
    """
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind, key = F.col("c_nationkey") % 5, F.col("o_orderkey")
    named = orders.withColumn("file", F.concat(F.lit("late-"), F.col("c_nationkey").cast("string"), F.lit(".csv")))
    sliced = named.withColumn("_slice", F.shiftright("o_orderkey", 16))
    rows = number_rows(sliced, ["file"], ["_slice"], ["o_orderkey"], "row_no", start=2)
    late = F.col("row_no") > LATE + 1
    day, text = F.col("o_orderdate").cast("date"), key.cast("string")
    price = F.col("o_totalprice").cast(CENTS).cast("string")
    early_day = F.make_date(F.year(day), F.month(day), F.day(day) % 12 + 1)
    again = F.concat(F.lit("n "), (F.col("row_no") % 7).cast("string"))
    values = {
        0: (F.when(late, again).otherwise(F.concat(F.lit("K-"), text)), price, price, F.lit("Goods"), F.lit("1"), day.cast("string")),
        1: (text, F.col("c_name"), price, F.date_format(day, "yyyy/MM/dd")),
        2: (text, F.col("c_name"), price, F.date_format(F.when(late, day).otherwise(early_day), "dd/MM/yyyy")),
        3: (text, F.col("c_name"), price, F.date_format(day, "d MMMM yyyy"), F.when(F.col("row_no") > 151, "eur").otherwise("USD")),
        4: (
            text,
            F.col("c_name"),
            F.concat(F.when(late, "€ ").otherwise(""), price),
            F.when(late, F.concat(F.lit('[{"description": "Part '), text, F.lit('", "amount": 2}]'))).otherwise(F.lit("none")),
        ),
    }
    names = {k: F.array(*[F.lit(h) for h in heads]) for k, heads in LATE_HEADERS.items()}
    packed = {k: F.map_from_arrays(names[k], F.array(*values[k])) for k in values}
    cells = rows.select("file", F.col("row_no").cast("long").alias("row_no"), by_case(kind, packed).alias("cells"))
    files = named.select("file", by_case(kind, names).alias("headers")).distinct()
    return Staged(cells, files)
