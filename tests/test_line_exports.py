"""Facts of a file are hashed on the map side, and what no file maps costs nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import convert as C
from tallyloom.operators import mapping as M

HEADERS = ["Ref", "Date", "Net", "Total"]


def _cells(spark, rows):
    full = [(f, i + 2, dict(zip(HEADERS, r))) for f, part in rows.items() for i, r in enumerate(part)]
    cells = spark.createDataFrame(full, "file string, row_no long, cells map<string,string>")
    return cells, spark.createDataFrame([(f, HEADERS) for f in rows], "file string, headers array<string>")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_symbols_and_date_parts(spark):
    rows = {
        # The symbol is the first by column, whatever the row; parts keep their zeros.
        "a.csv": [("1", "01/02/2020", "5", "£ 5"), ("2", "0013/2/2020", "$ 5", "5"), ("3", "14/2/2020", "€ 5", "5")],
        "b.csv": [("1", "1/13/20", "5", "5"), ("2", "", "5", "¥5"), ("3", "1/31/20", "5", "$5")],
        "c.csv": [("1", "2020/01/02", "5", "5")],
    }
    cells, headers = _cells(spark, rows)
    got = {r.file: r for r in M.heuristic_mapping(cells, headers).collect()}
    assert [got[f].currency_default for f in sorted(got)] == ["GBP", "JPY", "USD"]
    assert [got[f].date_format for f in sorted(got)] == ["DMY", "MDY", "YMD"]
    assert "symbol in 'Total'" in " ".join(got["a.csv"].notes) and "a day part of 0013 rules" in " ".join(got["a.csv"].notes)
    assert "symbol in 'Total'" in " ".join(got["b.csv"].notes) and "a part of 13 rules" in " ".join(got["b.csv"].notes)


def test_facts_are_hashed(spark):
    cells, headers = _cells(spark, {"a.csv": [("1", "1/2/2020", "5", "5")]})
    wanted = headers.select("file", F.col("headers").alias("money"), F.lit("Ref").alias("number"), F.lit("Net").alias("currency"), F.lit("Date").alias("invoice_date"), F.lit("Date").alias("due_date"))
    facts = M._with_seen(cells.join(wanted, "file")).groupBy("file").agg(*M._facts_of_rows())
    assert "SortAggregate" not in _plan(facts)


def test_line_files_alone_read_their_rows_once(spark):
    names = ["Invoice", "Item", "Qty", "Line Total"]
    rows = [("a.csv", i + 2, dict(zip(names, (f"N{i // 2}", "x", "1", "2.50")))) for i in range(6)]
    cells = spark.createDataFrame(rows, "file string, row_no long, cells map<string,string>")
    headers = spark.createDataFrame([("a.csv", names)], "file string, headers array<string>")
    headers_of = C.convert_cells(cells, M.heuristic_mapping(cells, headers)).headers
    assert "Union" not in _plan(headers_of)
    got = sorted((r.invoice_number, r.row_count, str(r.total), r.vendor_name) for r in headers_of.collect())
    assert got == [(f"N{i}", 2, "5.00", "") for i in range(3)]
