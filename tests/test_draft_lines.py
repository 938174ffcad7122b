"""Lines of drafts are read, typed and numbered without grouping drafts that have lines, in methods short enough to be compiled."""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.cells import with_money
from tallyloom.operators import convert as C
from tallyloom.operators import mapping as M
from tallyloom.operators import numbering
from tallyloom.plans.views import line_rows

HEADERS = ["Invoice", "Item", "Qty", "Unit Price", "Line Total", "Details"]


def _staged(spark, files):
    rows = [(f, i + 2, dict(zip(HEADERS, r))) for f, part in files.items() for i, r in enumerate(part)]
    cells = spark.createDataFrame(rows, "file string, row_no long, cells map<string,string>")
    return cells, spark.createDataFrame([(f, HEADERS) for f in files], "file string, headers array<string>")


def _drafts(spark, files):
    cells, headers = _staged(spark, files)
    return C.convert_cells(cells, M.heuristic_mapping(cells, headers))


def _longest_method(df):
    """Bytes of the longest method that Spark generates for a stage of the plan."""
    jvm = df.sparkSession._jvm
    package = getattr(jvm.org.apache.spark.sql.execution.debug, "package$")
    text = getattr(package, "MODULE$").codegenString(df._jdf.queryExecution().sparkPlan())
    plain = df._jdf.queryExecution().executedPlan()
    text += getattr(package, "MODULE$").codegenString(plain)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


PLAIN = ("A 1", "Good", "2", "5.25", "1,010.50", "")


def _got(lines):
    return sorted((r.file, r.draft_key, r.row_no, r.item_no, r.line_no, r.description, r.amount) for r in lines.collect())


def test_lines_of_columns_group_no_drafts(spark):
    lines = _drafts(spark, {"a.csv": [PLAIN, PLAIN, ("b", "Fee", "1", "", "$ 3", "")]}).numbered_lines()
    assert "Aggregate" not in lines._jdf.queryExecution().executedPlan().toString()
    want = [("a1", 2, 1, "Good", "1010.50"), ("a1", 3, 2, "Good", "1010.50"), ("b", 4, 1, "Fee", "3.00")]
    assert _got(lines) == [("a.csv", k, r, 0, n, d, Decimal(a)) for k, r, n, d, a in want]


def test_line_methods_can_be_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = _drafts(spark, {"a.csv": [PLAIN, PLAIN]}).numbered_lines()
        assert 0 < _longest_method(lines) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_drafts_without_lines_keep_their_cells_and_made_lines(spark):
    packed = '[{"description": "P", "amount": 4}, {"description": "Q", "amount": 5}]'
    none = ("", "", "", "")
    files = {
        # c: a packed cell; d: one row with a line, one without; e: neither, so one line is made.
        "a.csv": [PLAIN, ("c", *none, packed), ("c", *none, ""), ("d", *none, packed), ("D", *PLAIN[1:]), ("e", *none, ""), ("-", *PLAIN[1:])],
        # Every row a draft of its own.
        "b.csv": [("x", *none, packed), ("y", *PLAIN[1:])],
    }
    drafts = _drafts(spark, files)
    want = [
        ("a.csv", "a1", 2, 0, 1, "Good", "1010.50"), ("a.csv", "c", 3, 0, 1, "P", "4.00"), ("a.csv", "c", 3, 1, 2, "Q", "5.00"),
        ("a.csv", "d", 6, 0, 1, "Good", "1010.50"), ("a.csv", "e", 7, 0, 1, "Imported invoice", "0.00"),
        ("b.csv", "2", 2, 0, 1, "P", "4.00"), ("b.csv", "2", 2, 1, 2, "Q", "5.00"), ("b.csv", "3", 3, 0, 1, "Good", "1010.50"),
    ]
    assert _got(drafts.numbered_lines()) == [(*r[:-1], Decimal(r[-1])) for r in want]
    assert drafts.lines.count() == len(want)


def test_groups_are_numbered_alike_in_all_buckets(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("g"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("string")).alias("g"), (F.col("id") * 7 % 3001).alias("p"), F.lit(0).alias("i")
    )
    odd = df.union(spark.createDataFrame([(None, 1, 0), ("g1", None, 0)], df.schema))
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("p")).cast("long"))
    one = df.where("g = 'g1'").select(numbering.bucket_of("g")).first()[0]
    for large in ([], [one], None):
        got = numbering.number_groups(odd, ["g"], "p", ["p", "i"], "n", large)
        assert got.columns == ["g", "p", "i", "n"] and got.schema["n"].dataType.simpleString() == "bigint"
        assert got.count() == 3000 and got.select(want.columns).exceptAll(want).count() == 0


def test_large_drafts_are_numbered_by_slices(spark, monkeypatch):
    rows = [(f"k{i % 2}" if i % 3 else "big", "x", "1", "2", "2", "") for i in range(60)]
    drafts = _drafts(spark, {"a.csv": rows})
    whole = drafts.numbered_lines()
    plain = whole._jdf.queryExecution().toString()
    monkeypatch.setattr(C, "SLICE_BITS", 4)
    monkeypatch.setattr(numbering, "SLICE_BITS", 4)
    sliced = drafts.numbered_lines()
    assert "_slice" in sliced._jdf.queryExecution().toString() and "_slice" not in plain
    assert _got(sliced) == _got(whole) and len(_got(whole)) == 60


def test_several_amounts_read_like_one(spark):
    texts = [
        "1,234.50", "1,23", "1,234", "-5", "-1,2.5", "12.", ".5", ".", "", None, "  ", "$1,234.50", "€ 1.234,50", "(200.00)", "$(200)", "- 5", "£\xa01 000.5",
        "5-", "EUR 99,90", "12\n", "12 ", "99999999999999.5", "1.2.3", "--5", "5,", ",5", "1,,2.5", "¥-7", "free", "0x10", "١٢",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    alone = [r.a for r in with_money(df, {"a": "v"}).orderBy("i").collect()]
    both = with_money(df, {"a": "v", "b": "v"}).orderBy("i").collect()
    assert [r.a for r in both] == alone == [r.b for r in both] and both[0].a == Decimal("1234.5")


def test_line_rows_are_numbered_by_order(spark, tmp_path):
    day = datetime(1998, 5, 1)
    # An order without a customer, one that comes twice, one in two files, one without lines; lines that come twice.
    customers = [(1, "C1", 3), (2, "C2", 4), (3, "C3", None)]
    orders = [(70000, 1, day), (5, 1, day), (5, 1, day), (9, 1, day), (9, 2, day), (8, 3, day), (7, 9, day), (6, 1, day)]
    lines = [(k, n, 1) for k in (5, 70000, 9, 8, 7) for n in (2, 1, 1, 7)] + [(9, None, 1)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    rest = ", ".join(f"{c} double" for c in ("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    names = "l_orderkey long, l_linenumber int, l_partkey long"
    kept = spark.createDataFrame(lines, names).selectExpr("*", *[f"cast(2 as double) {c.split()[0]}" for c in rest.split(", ")])
    kept.selectExpr("*", "'R' l_returnflag", "'O' l_linestatus", "timestamp'1998-05-02' l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    staged = line_rows(spark, str(tmp_path))
    got = {}
    for r in staged.cells.orderBy("file", "row_no").collect():
        got.setdefault(r.file, []).append((r.row_no, r.cells["Invoice"]))
    # Of each order: number 1 twice, then 2, then 7; null first.
    a = ["li 5"] * 4 + ["LI-5"] * 2 + [""] * 2 + ["li 9"] * 3 + ["LI-9", ""] + ["li 70000"] * 2 + ["LI-70000", ""]
    assert got == {"lines-3.csv": list(enumerate(a, 2)), "lines-4.csv": list(enumerate(a[8:13], 2))}
    assert sorted(r.file for r in staged.headers.collect()) == ["lines-3.csv", "lines-4.csv"]
