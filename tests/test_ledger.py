"""Validation rules, saving with dedup, the read side, guarded SQL, synthetic data, streaming."""

from __future__ import annotations

import json
import os
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from conftest import AS_OF
from fixtures import FILES
from pyspark.sql import functions as F

from tallyloom.operators.dedup import ALREADY_STORED, EMPTY_NUMBER, REPEATED, bulk_outcome, choose_drafts
from tallyloom.operators.numbering import number_rows, ordered_positions
from tallyloom.operators.synth import synthetic_invoices
from tallyloom.operators.validate import round_money, with_header_review, with_review
from tallyloom.plans import adhoc
from tallyloom.plans import query as Q
from tallyloom.schema import INVOICE, INVOICE_DRAFT
from tallyloom.sources.intake import classify, parse_records, text_gate
from tallyloom.sources.ledger import ConcurrentSave, DuplicateInvoice, Ledger, to_ledger_rows
from tallyloom.sources.samples import sample_documents
from tallyloom.streaming.landing import ingest_landing

D = Decimal
NOW = datetime(2026, 8, 21, tzinfo=timezone.utc)


def draft(**over):
    base = dict(
        invoice_number="INV-1", vendor_name="Acme Ltd", vendor_email=None, invoice_date=date(2026, 1, 10),
        due_date=date(2026, 2, 9), currency="USD", line_items=[("Widget", D(2), D(50), D(100))],
        subtotal=D(100), tax=D(10), total=D(110), po_number=None, status="pending",
    )
    base.update(over)
    return tuple(base[f.name] for f in INVOICE_DRAFT.fields if f.name in base)


def frame(spark, *rows):
    schema = INVOICE_DRAFT
    return spark.createDataFrame(list(rows), schema)


RULES = [
    ({}, []),
    ({"subtotal": D("100.01"), "total": D("110.01")}, []),
    ({"invoice_number": "  ", "vendor_name": ""}, ["Invoice number is missing.", "Vendor name is missing."]),
    ({"subtotal": D(90), "total": D(100)}, ["Line items sum to 100.00 but the subtotal reads 90.00."]),
    ({"total": D(999)}, ["Subtotal + tax = 110.00 but the total reads 999.00."]),
    ({"due_date": date(2026, 1, 1)}, ["Due date 2026-01-01 precedes invoice date 2026-01-10."]),
    ({"currency": "dollars"}, ["Currency 'dollars' is not a 3-letter ISO 4217 code."]),
    (
        {"line_items": [], "subtotal": D(0), "tax": D(0), "total": D(0)},
        ["No line items were extracted.", "Total is 0.00, which is not a payable amount."],
    ),
    ({"line_items": [("Widget", D(0), D(50), D(100))]}, ["Line 1 (Widget) has quantity 0.0."]),
    (
        {"line_items": [("A" * 50, D(-1), D(-100), D(-100))], "subtotal": D(-100), "tax": D(0), "total": D(-100)},
        [
            f"Line 1 ({'A' * 40}) has quantity -1.0.",
            f"Line 1 ({'A' * 40}) has a negative amount or unit price.",
            "Total is -100.00, which is not a payable amount.",
        ],
    ),
]


def test_validation_rules(spark):
    df = frame(spark, *[draft(**{"po_number": str(i), **over}) for i, (over, _) in enumerate(RULES)])
    got = {int(r.po_number): r for r in with_review(df).collect()}
    assert [got[i].review_notes for i in range(len(RULES))] == [want for _, want in RULES]
    assert [got[i].needs_review for i in range(len(RULES))] == [bool(want) for _, want in RULES]
    lenient = with_review(frame(spark, draft(line_items=[])), require_lines=False).first()
    assert lenient.review_notes == []


def test_header_rules_agree_with_nested_rules(spark):
    df = frame(spark, *[draft(**{"po_number": str(i), **over}) for i, (over, _) in enumerate(RULES)])
    nested = with_review(df)
    notes = F.size(F.filter("review_notes", lambda n: F.startswith(n, F.lit("Line ")) & ~F.startswith(n, F.lit("Line items"))))
    flat = with_header_review(
        nested.withColumn("line_note_count", notes).withColumnRenamed("needs_review", "want").drop("review_notes")
    )
    assert flat.where("want <> needs_review").count() == 0


def test_rounding_is_half_up_and_keeps_quantities(spark):
    line = "named_struct('description','Hours','quantity',3.333333BD,'unit_price',33.333BD,'amount',99.999BD)"
    df = spark.sql(f"SELECT array({line}) line_items, 99.995BD subtotal, 9.9999BD tax, 110.0BD total")
    row = round_money(df).first()
    assert (row.line_items[0].unit_price, row.line_items[0].amount, row.line_items[0].quantity) == (D("33.33"), D("100.00"), D("3.333333"))
    assert (row.subtotal, row.tax, row.total) == (D("100.00"), D("10.00"), D("110.00"))


def test_numbering_matches_a_plain_window(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(3)).alias("g"), (F.col("id") * 7 % 5003).alias("p"))
    got = number_rows(df.withColumn("s", F.shiftright("p", 6)), ["g"], ["s"], ["p"], "n", start=2)
    df.createOrReplaceTempView("t_numbers")
    want = spark.sql("SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY p) + 1 AS n FROM t_numbers")
    assert got.select("g", "p", "n").exceptAll(want).count() == 0 and got.count() == 5000
    placed = ordered_positions(df, [F.col("p").desc()], "n", start=10)
    want = spark.sql("SELECT g, p, row_number() OVER (ORDER BY p DESC) + 9 AS n FROM t_numbers")
    assert placed.select("g", "p", "n").exceptAll(want).count() == 0


def test_outcomes_in_batch_order(spark):
    batch = spark.createDataFrame(
        [(1, " A "), (2, "B"), (3, "A"), (4, ""), (5, "C"), (6, "C"), (7, "B"), (8, None)], "pos long, invoice_number string"
    )
    stored = spark.createDataFrame([("B",), ("Z",)], "invoice_number string")
    got = bulk_outcome(batch, stored, ["pos"]).orderBy("pos").collect()
    assert [(r.invoice_number, r.reason) for r in got] == [
        ("A", None), ("B", ALREADY_STORED), ("A", REPEATED), ("", EMPTY_NUMBER), ("C", None), ("C", REPEATED),
        ("B", ALREADY_STORED), ("", EMPTY_NUMBER),
    ]


def test_saving_skips_and_keeps_order(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = frame(spark, draft(invoice_number=" N-2 "), draft(invoice_number="N-1"), draft(invoice_number="N-2"))
    batch = rows.selectExpr(
        "*", "case when invoice_number = ' N-2 ' then 1 when invoice_number = 'N-1' then 2 else 3 end as pos"
    )
    report = ledger.save(batch, ["pos"], as_of=AS_OF, created_at=NOW)
    assert [r.invoice_number for r in report.created.orderBy("pos").collect()] == ["N-2", "N-1"]
    assert [tuple(r) for r in report.skipped.collect()] == [("N-2", REPEATED)]
    stored = ledger.invoices().orderBy("id").collect()
    assert [(r.id, r.invoice_number, r.source, r.status, r.needs_review) for r in stored] == [
        (1, "N-2", "imported", "overdue", False), (2, "N-1", "imported", "overdue", False),
    ]
    again = ledger.save(batch, ["pos"], as_of=AS_OF, created_at=NOW)
    assert again.created.count() == 0 and {r.reason for r in again.skipped.collect()} == {ALREADY_STORED}
    with pytest.raises(DuplicateInvoice, match="N-"):
        ledger.create(batch, ["pos"], as_of=AS_OF, created_at=NOW)
    fresh = frame(spark, draft(invoice_number="N-9", line_items=[])).withColumn("pos", F.lit(1))
    ledger.create(fresh, ["pos"], as_of=AS_OF, created_at=NOW)
    row = ledger.invoices().where("invoice_number = 'N-9'").first()
    # A document should have lines; a summary export need not.
    assert (row.id, row.source, row.review_notes) == (3, "uploaded", ["No line items were extracted."])
    picked = choose_drafts(batch.withColumn("file", F.lit("f")), spark.createDataFrame([("f", 2)], "file string, pos int"), ["file", "pos"])
    assert [r.invoice_number for r in picked.collect()] == ["N-1"]


def test_loading_only_when_empty(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = to_ledger_rows(frame(spark, draft(), draft(invoice_number="INV-2")), "seed", AS_OF, NOW)
    first = ledger.load_if_empty(rows, ["invoice_number"])
    second = ledger.load_if_empty(rows, ["invoice_number"])
    forced = ledger.load_if_empty(rows.where("invoice_number = 'INV-2'"), ["invoice_number"], force=True)
    assert (first.inserted, second.skipped, second.existing, forced.inserted, forced.existing) == (2, True, 2, 1, 2)
    assert ledger.count() == 1


@pytest.fixture(scope="module")
def book(spark):
    rows = [
        (1, "A-1", "Acme", "pay@acme.example", date(2026, 1, 5), date(2026, 2, 5), "paid", D(10), "USD", "PO-1", False, "seed"),
        (2, "A-2", "Acme", None, date(2026, 1, 6), None, "pending", D(30), "USD", None, True, "imported"),
        (3, "B-1", "Beta 50%", None, date(2026, 1, 7), date(2026, 1, 8), "overdue", D(30), "EUR", None, False, "imported"),
        (4, "C_9", "Gamma", None, date(2026, 1, 8), date(2026, 3, 8), "pending", D(2000), "USD", "po-77", False, "uploaded"),
    ]
    return spark.createDataFrame(
        rows,
        "id long, invoice_number string, vendor_name string, vendor_email string, invoice_date date, due_date date, "
        "status string, total decimal(18,2), currency string, po_number string, needs_review boolean, source string",
    ).withColumn("created_at", F.col("invoice_date").cast("timestamp"))


def ids(df):
    return [r.id for r in df.collect()]


def test_search_and_filters(book):
    found = lambda **f: sorted(ids(Q.filter_invoices(book, **f)))
    assert found(q=" ACME ") == [1, 2] and found(q="po-") == [1, 4] and found(q="pay@") == [1]
    # Literal by default; as LIKE wildcards on request.
    assert found(q="50%") == [3] and found(q="_") == [4] and found(q="a_1") == []
    assert found(q="a_1", wildcards=True) == [1]
    assert found(q="  ") == [1, 2, 3, 4]
    assert found(status="pending", needs_review=True) == [2] and found(source="imported") == [2, 3]
    with pytest.raises(ValueError):
        Q.filter_invoices(book, status="bogus")


def test_sorting_and_paging(book, monkeypatch):
    assert ids(Q.sort_invoices(book)) == [4, 3, 2, 1]
    assert ids(Q.sort_invoices(book, "total", "asc")) == [1, 3, 2, 4]
    assert ids(Q.sort_invoices(book, "due_date", "asc")) == [2, 3, 1, 4]
    assert ids(Q.sort_invoices(book, "due_date", "desc")) == [4, 1, 3, 2]
    assert ids(book.orderBy(*Q.preset_keys("vendor"))) == [2, 1, 3, 4]
    assert ids(Q.page_of(book, 2, 3)) == [1]
    with pytest.raises(ValueError):
        Q.page_of(book, 0)
    with pytest.raises(ValueError):
        Q.page_of(book, 1, 201)
    monkeypatch.setattr(Q, "DEEP_OFFSET", 0)
    assert ids(Q.page_of(book, 2, 2, "due_date", "asc")) == [1, 4]
    for sort, order in (("due_date", "asc"), ("due_date", "desc"), ("total", "desc"), ("created_at", "asc")):
        want, last, seen = ids(Q.sort_invoices(book, sort, order)), None, []
        while rows := Q.page_after(book, last, 1, sort, order).collect():
            seen.append(rows[0].id)
            last = (rows[0][sort], rows[0].id)
        assert seen == want


def test_summary_and_reports(book):
    assert tuple(Q.page_summary(book, 2, 2, source="imported").first()) == (2, 4, 1, 3, 2)
    assert tuple(Q.page_summary(book, 1, 25, q="zzz").first()) == (0, 4, 1, 0, 0)
    assert {tuple(r) for r in Q.status_counts(book).collect()} == {("paid", 1), ("pending", 2), ("overdue", 1)}
    assert [tuple(r) for r in Q.spend_by_vendor(book).collect()] == [
        ("Gamma", "USD", 2000), ("Acme", "USD", 40), ("Beta 50%", "EUR", 30),
    ]
    assert {tuple(r) for r in Q.outstanding_by_currency(book).collect()} == {("USD", 2030), ("EUR", 30)}
    assert ids(Q.overdue(book)) == [3] and ids(Q.over_threshold(book)) == [4] and Q.row_count(book).first()[0] == 4


@pytest.mark.parametrize(
    "sql",
    [
        "", "DELETE FROM invoices", "UPDATE invoices SET total = 0", "DROP TABLE invoices", "PRAGMA x",
        "INSERT INTO invoices VALUES (1)", "WITH gone AS (DELETE FROM invoices RETURNING *) SELECT * FROM gone",
        "SELECT 1; DROP TABLE invoices", "SELECT 1; SELECT 2;", "SELECT 1;; DELETE FROM invoices;",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT reflect('java.lang.System', 'exit', 1)",
        "SELECT try_reflect('a', 'b')", "SELECT * FROM parquet.`/etc/x`", "SELECT TRANSFORM (a) USING 'cat' FROM t",
        "WITH a AS (SELECT r'\\' AS x) INSERT INTO t SELECT '1' --'", "SELECT 1 /* open",
        "SELECT '--' AS x; DROP TABLE t",
    ],
)
def test_guard_refuses(spark, sql):
    spark.range(1).createOrReplaceTempView("invoices")
    with pytest.raises(adhoc.ReadOnlyViolation):
        adhoc.guard_query(sql, spark)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM `text`.`/etc/hosts`", "SELECT * FROM `parquet`.`/x`", "SELECT * FROM IDENTIFIER('text.`/etc/hosts`')",
        "SELECT `reflect`('java.lang.System', 'exit', 1)", "SELECT java_method('java.lang.System', 'nanoTime')",
        "SELECT 1 WHERE EXISTS (SELECT * FROM xml.`/etc/hosts`)", "WITH a AS (SELECT * FROM csv.`/x`) SELECT * FROM a",
        "SELECT (SELECT max(value) FROM `text`.`/etc/hosts`)", "SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime')",
        "SELECT TRANSFORM(id) USING 'cat' AS x FROM invoices", "SELECT * FROM nowhere", "SELECT * FROM other.invoices",
        "WITH a AS (SELECT 1) INSERT INTO invoices SELECT * FROM a", "SELECT * FROM read_files('/x')",
    ],
)
def test_guard_sees_through_spelling(spark, sql):
    spark.range(1).createOrReplaceTempView("invoices")
    with pytest.raises(adhoc.ReadOnlyViolation):
        adhoc.run_query(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM invoices WHERE vendor_name LIKE '%update%'", "SELECT replace(vendor_name, 'a', 'b') FROM invoices",
        "SELECT '--' AS dashes, 'a;b' AS semi FROM invoices", "select 1 -- drop it", "SELECT `delete` FROM t",
        "SELECT transform(array(1), x -> x + 1)", "SELECT created_at, last_update_by FROM t",
        "SELECT call FROM t", "WITH a AS (SELECT id FROM invoices) SELECT count(*) OVER (PARTITION BY id) FROM a ORDER BY 1 LIMIT 3",
        "SELECT * FROM invoices i JOIN t ON i.id = t.id WHERE i.id IN (SELECT id FROM T) UNION ALL SELECT * FROM invoices JOIN t USING (id)",
        "SELECT id, explode(array(1, 2)) FROM invoices LATERAL VIEW explode(array(3)) v AS y", "SELECT * FROM range(3)",
        "SELECT id, sum(id) FROM invoices GROUP BY GROUPING SETS ((id), ()) HAVING sum(id) > 1", "SELECT * FROM VALUES (1), (2) AS v(x)",
    ],
)
def test_guard_accepts(spark, sql):
    spark.range(1).selectExpr("id", "id AS call").createOrReplaceTempView("t")
    spark.range(1).createOrReplaceTempView("invoices")
    assert adhoc.guard_query(sql + " ;", spark) == sql


def test_capped_queries_and_catalogue(spark, book):
    book.createOrReplaceTempView("invoices")
    out = adhoc.run_query(spark, "SELECT id FROM invoices ORDER BY id LIMIT 500;", 3)
    assert ids(out.rows) == [1, 2, 3] and out.truncated
    assert not adhoc.run_query(spark, "SELECT count(*) AS n FROM invoices").truncated
    assert adhoc.capped(spark, "SELECT id FROM invoices", 2).count() == 2
    assert "invoices" in [r.table_name for r in adhoc.list_tables(spark).collect()]
    columns, sample = adhoc.describe_table(spark, "invoices")
    assert columns.where("column_name = 'total'").first().data_type == "decimal(18,2)" and sample.count() == 3
    with pytest.raises(ValueError, match="does not exist. Available tables"):
        adhoc.describe_table(spark, "customers")


def test_intake(spark):
    rows = [("/in/a.CSV", 10), ("/in/b.pdf", 10), ("/in/c.exe", 10), ("/in/d.json", 2097153), ("/in/e.xlsx", 2097152), ("/in/none", 1)]
    got = classify(spark.createDataFrame(rows, "path string, length long"), 2097152).collect()
    assert [r.kind for r in got] == ["export", "document", None, "export", "export", None]
    assert got[3].reject_reason == "d.json is 2097153 bytes; the limit is 2097152 bytes." and got[4].reject_reason is None
    assert "Unsupported file type 'c.exe'" in got[2].reject_reason
    texts = [("x" * 19 + "  ", "too_short"), ("x" * 20, "ok"), ("x" * 20001, "too_long"), (None, "undecodable")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [r.g for r in df.select("i", text_gate(F.col("t")).alias("g")).orderBy("i").collect()] == [w for _, w in texts]


def test_structured_records(spark):
    documents = sample_documents(spark)
    good = parse_records(documents, "record").collect()
    assert all(r.error is None and r.review_notes == [] and not r.needs_review for r in good)
    assert {(r.invoice_number, r.currency, r.total) for r in good} == {
        ("77/B", "USD", D("1003.90")), ("HRP-0019", "EUR", D("2734.60")), ("000482", "GBP", D("56.55")),
    }
    base = json.loads(documents.first().record)
    bad = [
        "{oops", json.dumps({**base, "total": None}), json.dumps({**base, "invoice_date": "soon"}),
        json.dumps({**base, "status": "lost"}), json.dumps({**base, "line_items": [{"description": "x"}]}),
        json.dumps({**base, "total": 1.0}),
    ]
    got = parse_records(spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "i int, record string"), "record").orderBy("i").collect()
    assert all(r.error for r in got[:5]) and all(r.needs_review is None for r in got[:5])
    assert got[5].error is None and got[5].review_notes == ["Subtotal + tax = 1003.90 but the total reads 1.00."]


def test_synthetic_ledger_keeps_its_invariants(spark):
    df = synthetic_invoices(spark.range(300), "id", AS_OF)
    rows = with_review(df).orderBy("index").collect()
    assert len({r.invoice_number for r in rows}) == 300
    assert [r["index"] for r in rows if r.needs_review] == [6]
    assert [r.status for r in rows[:10]] == ["paid"] * 5 + ["overdue"] * 4 + ["pending"]
    for r in rows:
        assert r.invoice_date <= AS_OF and 1 <= len(r.line_items) <= 8
        assert len({line.description for line in r.line_items}) == len(r.line_items)
        assert r.status != "pending" or r.due_date > AS_OF
        assert r.status != "overdue" or r.invoice_date <= r.due_date < AS_OF
        assert all(1 <= line.quantity <= 20 and 25 <= line.unit_price <= 950 for line in r.line_items)
    assert {len(r.line_items) for r in rows} == set(range(1, 9)) and len({r.tax / r.subtotal > 0 for r in rows}) == 2
    again = synthetic_invoices(spark.range(300).repartition(7), "id", AS_OF)
    assert again.exceptAll(df).count() == 0


def test_landing_folder_is_ingested_once(spark, tmp_path):
    landing = tmp_path / "landing"
    os.makedirs(landing)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    run = lambda: ingest_landing(spark, str(landing), ledger, str(tmp_path / "ckpt"), AS_OF, NOW).awaitTermination()
    (landing / "kelp.csv").write_text(FILES["kelp.csv"])
    (landing / "notes.txt").write_text("not an export, and long enough")
    run()
    assert sorted(r.invoice_number for r in ledger.invoices().collect()) == ["QZ-17", "QZ-18", "QZ-19"]
    (landing / "stall.csv").write_text(FILES["stall.csv"])
    (landing / "again.csv").write_text(FILES["kelp.csv"])
    run()
    assert ledger.count() == 5
    assert [r.file.rsplit("/", 1)[-1] for r in ledger.rejects().collect()] == ["notes.txt"]
    row = ledger.invoices().where("invoice_number = 'ST-1'").first()
    assert len(row.line_items) == 2 and row.subtotal == 61 and row.source == "imported" and row.id > 3


def test_long_drafts_of_one_number_keep_their_own_lines(spark, tmp_path):
    day, six, five = date(2026, 1, 5), D(30), D(25)
    columns = (
        "file string, draft_key string, first_row long, invoice_number string, vendor_name string, vendor_email string,"
        " invoice_date date, due_date date, currency string, subtotal decimal(18,2), tax decimal(18,2), total decimal(18,2),"
        " po_number string, status string, line_count long, line_sum decimal(28,2), line_note_count long"
    )
    shared = lambda file, total, n: (
        file, "l1", 2, "L-1", "Acme", None, day, None, "USD", total, D(0), total, None, "paid", n, total, 1,
    )
    drafts = spark.createDataFrame([shared("a.csv", six, 6), shared("b.csv", five, 5)], columns)
    drafts = drafts.withColumn("line_items", F.lit(None).cast(INVOICE["line_items"].dataType))
    lines = [(f, "l1", "L-1", k, f"Part {k}", D(1), D(5), D(5)) for f, n in (("a.csv", 6), ("b.csv", 5)) for k in range(1, n + 1)]
    wide = spark.createDataFrame(
        lines,
        "file string, draft_key string, invoice_number string, line_no long, description string, quantity decimal(18,6),"
        " unit_price decimal(18,2), amount decimal(18,2)",
    )
    ledger = Ledger(spark, str(tmp_path))
    ledger.save(drafts, order=["file", "first_row"], as_of=AS_OF, created_at=NOW, long_lines=wide)
    saved = ledger.invoices().first()
    assert ledger.count() == 1 and saved.line_count == 6 and ledger.long_lines().count() == 6
    assert saved.needs_review and any("note(s) on lines" in n for n in saved.review_notes)
    ledger.replace(ledger.invoices().limit(0), ["invoice_number"])
    assert ledger.long_lines().count() == 0


def test_a_broken_ledger_is_not_an_empty_one(spark, tmp_path):
    (tmp_path / "data" / "x" / "invoices").mkdir(parents=True)
    (tmp_path / "data" / "x" / "invoices" / "part-0.parquet").write_text("no parquet")
    (tmp_path / "manifest").mkdir()
    (tmp_path / "manifest" / f"{1:012d}").write_text("x")
    with pytest.raises(Exception, match="(?i)parquet"):
        Ledger(spark, str(tmp_path)).count()


def numbered(spark, *numbers):
    return frame(spark, *[draft(invoice_number=n) for n in numbers]).withColumn("pos", F.monotonically_increasing_id())


def stored(ledger):
    return [(r.id, r.invoice_number) for r in ledger.invoices().orderBy("id").collect()]


def test_a_failure_between_steps_leaves_the_old_ledger_whole(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rejects = spark.createDataFrame([("a.csv", "no rows")], "file string, reason string")
    ledger.save(numbered(spark, "A-1", "A-2"), ["pos"], as_of=AS_OF, created_at=NOW, rejects=rejects)
    before = stored(ledger)
    rows = to_ledger_rows(numbered(spark, "B-1"), "seed", AS_OF, NOW, keep=["pos"])

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as broken:
        broken.setattr(Ledger, "_commit", crash)
        for attempt in (
            lambda: ledger.replace(rows, ["pos"]),
            lambda: ledger.save(numbered(spark, "C-1"), ["pos"], as_of=AS_OF, created_at=NOW, rejects=rejects),
            lambda: ledger.load_if_empty(rows, ["pos"], force=True),
        ):
            with pytest.raises(OSError):
                attempt()
            assert stored(ledger) == before and ledger.rejects().count() == 1
    ledger.replace(rows, ["pos"])
    assert stored(ledger) == [(1, "B-1")] and ledger.rejects().count() == 0
    # What crashed saves left, and what was replaced, goes when asked.
    assert stored(Ledger(spark, ledger.path, version=1)) == before
    assert len(ledger.vacuum()) == 4 and stored(ledger) == [(1, "B-1")] and ledger.versions() == [2]


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    options = {"order": ["pos"], "as_of": AS_OF, "created_at": NOW}
    first, second = Ledger(spark, path), Ledger(spark, path)
    write = Ledger._write_rows

    def slow(self, *args):
        write(self, *args)
        if self is first:  # the other writer is quicker
            second.save(numbered(spark, "B-1"), **options)

    monkeypatch.setattr(Ledger, "_write_rows", slow)
    with pytest.raises(ConcurrentSave, match="version 1"):
        first.save(numbered(spark, "A-1", "B-1"), **options)
    assert stored(first) == [(1, "B-1")]
    monkeypatch.undo()
    report = first.save(numbered(spark, "A-1", "B-1"), **options)
    assert [r.invoice_number for r in report.created.collect()] == ["A-1"]
    assert stored(second) == [(1, "B-1"), (2, "A-1")]


def test_a_batch_that_is_saved_again_adds_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rejects = spark.createDataFrame([("a.csv", "no rows")], "file string, reason string")
    for _ in range(2):
        ledger.save(numbered(spark, "A-1"), ["pos"], as_of=AS_OF, created_at=NOW, rejects=rejects, batch_id="b-7")
    assert stored(ledger) == [(1, "A-1")] and ledger.rejects().count() == 1


@pytest.mark.parametrize("hot", [False, True])
def test_pages_far_behind_the_first(spark, monkeypatch, hot):
    """Every page of a table with ties and nulls, by ranges cut as often as it takes."""
    monkeypatch.setattr(Q, "DEEP_OFFSET", 2)
    monkeypatch.setattr(Q, "SPLITS", 3)
    rows = [(i, None if i % 11 == 0 else "same" if hot and i % 3 else f"v{i * 7919 % 23:02}") for i in range(1, 61)]
    frame = spark.createDataFrame(rows, "id long, vendor_name string").coalesce(2).cache()
    for order in ("asc", "desc"):
        want = ids(Q.sort_invoices(frame, "vendor_name", order))
        for page in (1, 2, 5, 8, 9, 12):
            got = ids(Q.page_of(frame, page, 7, "vendor_name", order))
            assert got == want[(page - 1) * 7 : page * 7]
    repeated = frame.limit(1).crossJoin(spark.range(9).select()).cache()
    assert len(ids(Q.page_of(repeated, 3, 4, "vendor_name", "asc"))) == 1


def test_counts_with_all(spark, book):
    counted = {r.status: r.invoices for r in Q.counts_with_all(book).collect()}
    assert counted.pop("all") == sum(counted.values()) == 4
    assert [tuple(r) for r in Q.counts_with_all(book.where("false")).collect()] == [("all", 0)]
