"""Files to drafts, end to end, against known results."""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal

import pytest
from conftest import AS_OF
from fixtures import FILES
from pyspark.sql import functions as F

from tallyloom.operators import convert as C
from tallyloom.operators import mapping as M
from tallyloom.sources.staging import Staged, from_dataframe, from_files, json_leaves, stage_files


def staged_files(spark, files) -> Staged:
    rows = [(name, bytearray(text if isinstance(text, bytes) else text.encode())) for name, text in files.items()]
    return stage_files(spark.createDataFrame(rows, "path string, content binary"))


@pytest.fixture(scope="module")
def imported(spark):
    staged = staged_files(spark, FILES)
    cells, headers = staged.cells.cache(), staged.headers.cache()
    mapping = M.heuristic_mapping(cells, headers).cache()
    rows = C.rows_from_cells(cells, mapping)
    drafts = C.convert(rows, AS_OF)
    return {
        "cells": cells,
        "headers": headers,
        "mapping": mapping,
        "maps": {r.file: r for r in mapping.collect()},
        "rows": rows,
        "drafts": drafts,
        "nested": {
            name: [r for r in sorted(all_rows, key=lambda r: r.first_row)]
            for name, all_rows in _by_file(drafts.nested().collect()).items()
        },
        "warnings": {r.file: r for r in C.file_warnings(rows, AS_OF).collect()},
    }


def _by_file(rows, after=None):
    """Rows by file, or by what follows the last `after` in it."""
    out = {}
    for row in rows:
        out.setdefault(row.file.rsplit(after, 1)[-1] if after else row.file, []).append(row)
    return out


def test_summary_mapping(imported):
    m = imported["maps"]["kelp.csv"]
    assert (m.granularity, m.invoice_number, m.vendor_name, m.invoice_date, m.due_date) == (
        "invoice", "Invoice Number", "Merchant", "Issue Date", "Due On",
    )
    assert (m.subtotal, m.tax, m.total, m.currency, m.status, m.po_number) == (
        "Sub Total", "Sales Tax", "Grand Total", "Currency", "Payment Status", "Purchase Order",
    )
    assert (m.date_format, m.currency_default) == ("DMY", "EUR")
    assert "Currency defaults to EUR, the most common value in 'Currency'." in m.notes
    assert "Dates read as day-month-year (a day part of 25 rules out month-first)." in m.notes


def test_line_item_mapping(imported):
    m = imported["maps"]["stall.csv"]
    assert (m.granularity, m.invoice_number, m.line_item_description, m.line_item_quantity) == (
        "line_item", "Ref", "Product", "Units",
    )
    assert (m.line_item_unit_price, m.line_item_amount, m.total, m.date_format) == ("Rate", "Extended", None, "ISO")
    assert "'Ref' repeats across rows, so rows are grouped into one invoice per number." in m.notes
    assert "No column matched total; it will be derived or left blank." in m.notes


def test_nested_json_mapping(imported):
    m = imported["maps"]["bridge.json"]
    assert (m.vendor_name, m.vendor_email, m.invoice_number) == ("company.title", "company.email", "reference")
    assert (m.invoice_date, m.due_date) == ("billing_date", "pay_by")
    assert (m.subtotal, m.tax, m.total, m.line_items_json) == ("net", "vat", "total_due", "items")
    assert m.currency_default == "NOK"


def test_few_headers_mapping(imported):
    m = imported["maps"]["tolls.csv"]
    assert (m.vendor_name, m.invoice_number, m.invoice_date, m.total, m.tax) == (
        "Biller", "Reference", "Bill Date", "Balance Due", None,
    )
    assert m.currency_default == "USD" and any("assuming USD" in n for n in m.notes)


def test_bare_amount_symbols_and_date_orders(imported):
    maps = imported["maps"]
    assert (maps["bare_total.csv"].total, maps["bare_total.csv"].line_item_amount) == ("Amount", None)
    assert any("read as the invoice total" in n for n in maps["bare_total.csv"].notes)
    line = maps["bare_line.csv"]
    assert (line.total, line.line_item_amount, line.granularity) == ("Grand Total", "Amount", "line_item")
    assert maps["pounds.csv"].currency_default == "GBP"
    assert "Currency inferred as GBP from the £ symbol in 'Amount Due'." in maps["pounds.csv"].notes
    assert maps["unclear_dates.csv"].date_format == "unknown"
    assert maps["month_first.csv"].date_format == "MDY"


def test_summary_drafts(imported):
    a, b, c = imported["nested"]["kelp.csv"]
    assert [r.invoice_number for r in (a, b, c)] == ["QZ-17", "QZ-18", "QZ-19"]
    assert (a.total, a.invoice_date, a.due_date, a.currency, a.po_number) == (
        Decimal("310.40"), date(2025, 2, 25), date(2025, 3, 27), "EUR", "PX 7714",
    )
    assert (b.status, b.due_date, b.po_number) == ("paid", None, None)
    assert (c.status, c.currency, c.total) == ("overdue", "SEK", Decimal("1452.00"))
    assert all(r.line_items == [] and not r.needs_review for r in (a, b, c))
    assert all("No line items in the source file (summary-level export)." in r.import_notes for r in (a, b, c))
    assert a.source_rows == [2] and c.source_rows == [4]


def test_line_items_are_grouped(imported):
    one, two = imported["nested"]["stall.csv"]
    assert [len(r.line_items) for r in (one, two)] == [2, 3]
    assert [r.source_rows for r in (one, two)] == [[2, 3], [4, 5, 6]]
    assert one.invoice_number == "ST-1" and one.line_items[0].description == "Rye loaf"
    assert (one.subtotal, one.tax, one.total, two.subtotal) == (61, 0, 61, Decimal("51.55"))
    assert one.import_notes == [
        "No tax column in the file; tax recorded as 0.",
        "Subtotal was not in the file; summed 2 line amount(s) to 61.00.",
        "Total was not in the file; used subtotal + tax = 61.00.",
    ]
    assert one.review_notes == [] and not one.needs_review


def test_packed_lines_are_unpacked(imported):
    one, two = imported["nested"]["bridge.json"]
    assert [len(r.line_items) for r in (one, two)] == [2, 1]
    assert (one.subtotal, one.tax, one.total, one.currency, two.total) == (789, Decimal("197.25"), Decimal("986.25"), "NOK", 820)
    assert (one.vendor_email, one.status, two.status) == ("toll@heron.example", "paid", "pending")
    assert [line.amount for line in one.line_items] == [735, 54]
    assert "Line items were unpacked from the 'items' column." in one.import_notes
    assert not one.needs_review and not two.needs_review


def test_derived_amounts_numbers_and_dates(imported):
    nested = imported["nested"]
    toll = nested["tolls.csv"][0]
    assert (toll.subtotal, toll.tax, toll.total) == (64, 0, 64)
    assert "Subtotal was not in the file; derived it as total minus tax." in toll.import_notes
    made = nested["ops export.csv"][0]
    assert made.invoice_number == "IMPORT-ops-export-2"
    assert "No invoice number in the file; generated IMPORT-ops-export-2." in made.import_notes
    desc = nested["desc.csv"][0]
    assert [line.amount for line in desc.line_items] == [500] and not desc.needs_review
    assert any("one line was synthesized" in n for n in desc.import_notes)
    bad = nested["bad-dates.csv"][0]
    assert bad.invoice_date == AS_OF and bad.needs_review
    assert "No readable invoice date in the source row; today's date was used." in bad.review_notes


def test_warnings_and_summary(imported):
    orphans = imported["warnings"]["orphans.csv"]
    assert "1 row(s) were skipped: the invoice-number column was empty." in orphans.warnings
    assert imported["nested"]["orphans.csv"][0].subtotal == 200
    assert "1 date value(s) could not be read and were left blank or defaulted." in imported["warnings"]["bad-dates.csv"].warnings
    assert "No vendor column was found; vendor names are blank and need review." in imported["warnings"]["unclear_dates.csv"].warnings
    assert imported["warnings"]["kelp.csv"].warnings == []
    summary = {r.file: r for r in C.preview_summary(imported["rows"], imported["drafts"].headers).collect()}
    s = summary["orphans.csv"]
    assert (s.row_count, s.drafts, s.flagged) == (3, 1, 1)  # no date column: today's date was used
    assert (summary["kelp.csv"].row_count, summary["kelp.csv"].flagged) == (3, 0)


def test_unmapped_columns_and_report(imported):
    left = M.unmapped_columns(imported["mapping"], imported["headers"]).orderBy("file", "header_no").collect()
    assert [r.header for r in left if r.file == "extra.csv"] == ["Internal Notes", "Cost Centre"]
    assert not [r for r in left if r.file == "kelp.csv"]
    report = M.mapping_report(imported["mapping"]).where("file = 'pounds.csv'").orderBy("position").collect()
    assert [(r.field, r.value) for r in report] == [
        ("granularity", "One row per invoice"), ("invoice_number", "Invoice"), ("vendor_name", "Vendor"),
        ("invoice_date", "Date"), ("total", "Amount Due"),
        ("currency_default", "GBP, assumed because there is no currency column"),
        ("date_format", "ISO, as in 2026-08-04"),
    ]


def test_lines_stay_rows_beyond_the_nesting_limit(imported):
    small = {(r.file, r.invoice_number): r for r in imported["drafts"].nested(limit=2).collect()}
    big = small["stall.csv", "ST-2"]
    assert big.line_items is None and big.source_rows is None and (big.line_count, big.line_sum) == (3, Decimal("51.55"))
    assert len(small["stall.csv", "ST-1"].line_items) == 2
    lines = imported["drafts"].numbered_lines().where("file = 'stall.csv'").orderBy("row_no").collect()
    assert [(r.draft_key, r.line_no) for r in lines] == [("st1", 1), ("st1", 2), ("st2", 1), ("st2", 2), ("st2", 3)]


SUPPLIED = {
    "granularity": "invoice", "invoice_number": "Invoice Number", "vendor_name": "Merchant", "invoice_date": "Issue Date",
    "due_date": "Due On", "currency": "Currency", "currency_default": "eur", "status": "Payment Status", "subtotal": "Sub Total",
    "tax": "Sales Tax", "total": "Sum", "po_number": "purchase order", "date_format": "DMY", "notes": ["Checked by hand."],
}


def test_supplied_mappings(spark, imported):
    rows = [
        ("kelp.csv", json.dumps(SUPPLIED)),
        ("pounds.csv", "{not json"),
        ("extra.csv", json.dumps({**SUPPLIED, "currency_default": "dollars", "status_values": {"bezahlt": "paid"}})),
    ]
    supplied = M.parse_supplied(spark.createDataFrame(rows, "file string, text string"), "text")
    chosen = {r.file: r for r in M.choose_mapping(imported["cells"], imported["headers"], supplied).collect()}
    assert len(chosen) == len(FILES)
    m = chosen["kelp.csv"]
    assert (m.mapping_source, m.total, m.po_number, m.currency_default) == ("supplied", None, "Purchase Order", "EUR")
    assert m.notes == [
        "Checked by hand.",
        "Dropped total: 'Sum' is not a column in this file.",
        "Matched po_number to the column 'Purchase Order' (the model wrote 'purchase order').",
    ]
    assert (chosen["pounds.csv"].mapping_source, chosen["pounds.csv"].total) == ("heuristic", "Amount Due")
    assert "could not be parsed" in chosen["pounds.csv"].notes[0]
    assert chosen["extra.csv"].currency_default is None and chosen["extra.csv"].status_values == {"bezahlt": "paid"}
    assert "Ignored currency_default 'dollars': not a 3-letter ISO code." in chosen["extra.csv"].notes
    assert chosen["month_first.csv"].mapping_source == "heuristic"


def test_file_reading_rules(spark):
    files = {
        "bom.csv": "﻿a,b\r\n1,2\r\n\r\n,\r\n3,4\r\n",
        "euro.csv": "vendor;total\nAcme;1.234,50\nBeta;99,90\n",
        "dupes.csv": "total,,total,total\n1,2,3,4\n",
        "clash.csv": "total (2),total,total\n1,2,3\n",
        "ragged.csv": "a,b\n1\n1,2,3\n",
        "tabs.tsv": "a\tb\n1\t2\n",
        "wrapped.json": '{"generated": "2026-08-20", "invoices": [{"no": "A1"}, {"no": "A2", "x": {"y": 1.0}}]}',
        "one.json": '{"no": "A1", "total": 10, "ok": true, "none": null}',
        "scalars.json": "[1, 2, 3]",
        "broken.json": "{oops}",
        "headers.csv": "a,b,c\n",
        "nothing.csv": "",
        "many.csv": "a,b\n" + "\n".join(f"{i},b" for i in range(2100)) + "\n",
        "quoted.csv": 'a,b\n"x, ""y""\nz",5" pipe\n',
        "deep.json": "[" * 100_000,
        "latin.csv": b"a,b\n\xff\xfe,2\n",
        "prog.exe": "MZ",
    }
    staged = staged_files(spark, files)
    cells = {k: [r.cells for r in v] for k, v in _by_file(staged.cells.orderBy("file", "row_no").collect()).items()}
    heads = {r.file: r.headers for r in staged.headers.collect()}
    rejects = {r.file: r.reason for r in staged.rejects.collect()}
    assert cells["bom.csv"] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    assert cells["euro.csv"][0] == {"vendor": "Acme", "total": "1.234,50"}
    assert heads["dupes.csv"] == ["total", "column_2", "total (2)", "total (3)"]
    assert heads["clash.csv"] == ["total (2)", "total", "total (3)"]
    assert cells["ragged.csv"] == [{"a": "1", "b": ""}, {"a": "1", "b": "2"}]
    assert cells["tabs.tsv"] == [{"a": "1", "b": "2"}]
    assert heads["wrapped.json"] == ["no", "x.y"] and cells["wrapped.json"][1] == {"no": "A2", "x.y": "1"}
    assert cells["one.json"] == [{"no": "A1", "total": "10", "ok": "true", "none": ""}]
    assert "JSON objects" in rejects["scalars.json"] and "not valid JSON" in rejects["broken.json"]
    assert "no data rows" in rejects["headers.csv"] and "no rows" in rejects["nothing.csv"]
    assert len(cells["many.csv"]) == 2100 and "not valid UTF-8" in rejects["latin.csv"]
    assert cells["quoted.csv"] == [{"a": 'x, "y"\nz', "b": '5" pipe'}]
    assert "not valid JSON" in rejects["deep.json"]
    assert "Unsupported file type" in rejects["prog.exe"]
    assert not set(rejects) & set(heads) and set(rejects) | set(heads) == set(files)
    frame = spark.createDataFrame([("many.csv", bytearray(files["many.csv"].encode()))], "path string, content binary")
    assert "more than 2000 rows" in stage_files(frame, max_rows=2000).rejects.first().reason
    assert "the limit is 100 bytes" in stage_files(frame, max_bytes=100).rejects.first().reason


def test_folders_of_files_of_any_size(spark, tmp_path):
    body = "Invoice,Vendor,Total\n,Acme,{0}\n,Acme,{0}\n"
    for month in ("01", "02"):
        (tmp_path / month).mkdir()
        (tmp_path / month / "export 1.csv").write_text(body.format(month))
    (tmp_path / "01" / "large.csv").write_text("total;note.a\n" + "".join(f'{i};"n;{i}"\n' for i in range(5000)))
    (tmp_path / "02" / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "02" / "none.csv").write_bytes(b"")
    (tmp_path / "02" / "large.json").write_text("[" + ",".join('{"a": 1}' for _ in range(5000)) + "]")
    staged = from_files(spark, f"{tmp_path}/*")
    counts = {r.file.rsplit("/", 2)[-2] + "/" + r.file.rsplit("/", 1)[-1]: r["count"] for r in staged.cells.groupBy("file").count().collect()}
    assert counts == {"01/export%201.csv": 2, "02/export%201.csv": 2, "01/large.csv": 5000, "02/large.json": 5000}
    last = staged.cells.where("row_no = 5001 and file like '%csv'").first().cells
    assert last == {"total": "4999", "note.a": "n;4999"}
    reasons = {r.file.rsplit("/", 1)[-1]: r.reason for r in staged.rejects.collect()}
    assert set(reasons) == {"scan.pdf", "none.csv"} and "Unsupported" in reasons["scan.pdf"] and "no rows" in reasons["none.csv"]
    drafts = C.convert_cells(staged.cells, M.heuristic_mapping(staged.cells, staged.headers), AS_OF).nested()
    numbers = [r.invoice_number for r in drafts.where("file like '%export%'").collect()]
    assert len(set(numbers)) == len(numbers) == 4


def test_split_files_stage_like_whole_ones(spark, tmp_path):
    """Cells with line breaks, quoted delimiters and stray quotes, read in pieces of four kilobytes and as one row."""
    head = 'no,"note, or\nnot",size\n'
    rows = [f'{i},"line one, {i}\n\nsays ""{i}"", twice\r\n",{"5" + chr(34) if i % 7 else ""}\n' for i in range(900)]
    texts = {"broken.csv": head + "".join(rows), "plain.csv": "a;b\n" + "".join(f"{i};x,y,z\n" for i in range(3000))}
    texts["open.csv"] = "a,b\n1,2\n3,\"never closed\n4,5\n"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.csv").write_bytes(b"a,b\n" + b"1,2\n" * 3000 + b"\xff\xfe,2\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "4096")
        assert spark.read.text(f"{tmp_path}/broken.csv").rdd.getNumPartitions() > 5
        split = from_files(spark, str(tmp_path))
        read = {k: [(r.row_no, r.cells) for r in v] for k, v in _by_file(split.cells.orderBy("file", "row_no").collect(), "/").items()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    whole = staged_files(spark, texts)
    assert read == {k: [(r.row_no, r.cells) for r in v] for k, v in _by_file(whole.cells.orderBy("file", "row_no").collect()).items()}
    assert len(read["broken.csv"]) == 900 and len(read["plain.csv"]) == 3000
    assert read["broken.csv"][8] == (10, {"no": "8", "note, or\nnot": 'line one, 8\n\nsays "8", twice', "size": '5"'})
    assert [r.reason for r in split.rejects.collect()] == ["latin.csv is not valid UTF-8 text."]


def test_json_leaves_keep_names_in_order(spark):
    text = '{"z": {"y": {"b": 1.50, "a": [1, {"k": "v"}]}, "x": null}, "c": " t ", "e": {}, "d": 1e3, "n": 12345678901234567890, "t": true, "z.w": "{no}"}'
    found = spark.createDataFrame([(text,)], "t string").select(json_leaves(F.col("t")).alias("l")).first().l
    assert [(x.name, x.cell) for x in found] == [
        ("z.y.b", "1.5"), ("z.y.a", '[1,{"k":"v"}]'), ("z.x", ""), ("c", "t"), ("d", "1000"), ("n", "12345678901234567890"), ("t", "true"), ("z.w", "{no}"),
    ]
    deep = '{"a":' * 40 + "1" + "}" * 40
    found = spark.createDataFrame([(deep,)], "t string").select(json_leaves(F.col("t")).alias("l")).first().l
    assert [(x.name, x.cell) for x in found] == [(".".join("a" * 40), "1")]


def test_large_frames_stage_the_same_shape(spark):
    df = spark.createDataFrame(
        [(5, "A-1", 10.0, date(2026, 1, 5), ("x", 2.5), None), (9, " ", None, None, (None, None), None), (7, "A-2", 0.25, None, ("y", 1e16), [1])],
        "pos long, no string, total double, day date, v struct<name:string,rate:double>, tags array<int>",
    )
    staged = from_dataframe(df, "big.parquet", "pos")
    got = [(r.row_no, r.cells) for r in staged.cells.orderBy("row_no").collect()]
    assert got == [
        (2, {"no": "A-1", "total": "10", "day": "2026-01-05", "v.name": "x", "v.rate": "2.5", "tags": ""}),
        (3, {"no": "A-2", "total": "0.25", "day": "", "v.name": "y", "v.rate": "10000000000000000", "tags": "[1]"}),
    ]
    assert staged.headers.collect()[0].headers == ["no", "total", "day", "v.name", "v.rate", "tags"]


def test_wide_frames_convert_without_cell_maps(spark, imported):
    lines = [line.split(",") for line in FILES["stall.csv"].strip().split("\n")]
    df = spark.createDataFrame([(i + 2, *r) for i, r in enumerate(lines[1:])], ["pos", *lines[0]])
    m = imported["maps"]["stall.csv"].asDict(recursive=True)
    direct = C.convert(C.rows_from_frame(df, "stall.csv", "pos", m), AS_OF).nested().drop("file")
    via_cells = imported["drafts"].nested().where("file = 'stall.csv'").drop("file")
    assert sorted(map(str, direct.collect())) == sorted(map(str, via_cells.collect()))


def test_line_notes_are_numbered(spark):
    text = (
        "Invoice,Vendor,Date,Item,Qty,Unit Price,Line Total\nN-1,Acme,2026-01-05,Good,1,5.00,5.00\n"
        "N-1,Acme,2026-01-05,Free,0,5.00,0\nN-1,Acme,2026-01-05,Back,-1,5.00,-5.00\n"
    )
    staged = staged_files(spark, {"neg.csv": text})
    mapping = M.heuristic_mapping(staged.cells, staged.headers)
    drafts = C.convert_cells(staged.cells, mapping, AS_OF)
    [row] = drafts.nested().collect()
    want = [
        "Line 2 (Free) has quantity 0.0.",
        "Line 3 (Back) has quantity -1.0.",
        "Line 3 (Back) has a negative amount or unit price.",
    ]
    assert row.review_notes == [*want, "Total is 0.00, which is not a payable amount."]
    assert [r.note for r in drafts.line_notes().orderBy("line_no", "note_no").collect()] == want
    assert row.line_note_count == 3
