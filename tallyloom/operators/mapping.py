"""Which source column feeds which invoice field: set-based over all files at once.

Headers are matched to synonyms by an equi-join on header word sequences, and the one-to-one assignment
is a fold over each file's scored candidates, which its header count bounds. What the values say is decided on all
rows of a file, by aggregates that combine on the map side (any, all, count, first by row number): no task gathers
a file, and a shuffle carries one row per file and task, or one per distinct invoice number where repeats are looked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.cells import CURRENCY_SYMBOLS, is_code, symbol_code
from tallyloom.functions.text import blank_to_empty, contains_any, norm_key, quoted, tokens
from tallyloom.operators.numbering import ensure_checkpoint_dir, measured
from tallyloom.schema import LINE_FIELDS, MAPPED_FIELDS, MAPPING, MONEY_FIELDS, STATUSES

AMOUNT = "amount"

# Header wording per invoice field. Field order is the tie-break order.
SYNONYMS = {
    "invoice_number": (
        "invoice number", "invoice no", "inv no", "invoice #", "invoice id", "number", "reference", "ref",
        "document no",
    ),
    "vendor_name": (
        "vendor", "supplier", "seller", "company", "from", "payee", "merchant", "biller", "vendor name",
    ),
    "vendor_email": ("email", "vendor email", "supplier email", "contact email"),
    "invoice_date": ("invoice date", "date", "issued", "issue date", "bill date", "billing date"),
    "due_date": ("due", "due date", "payment due", "pay by", "due on"),
    "currency": ("currency", "ccy", "cur", "curr"),
    "status": ("status", "state", "payment status", "paid"),
    "subtotal": ("subtotal", "sub total", "net", "net amount", "amount before tax"),
    "tax": ("tax", "vat", "gst", "sales tax", "tax amount"),
    "total": ("total", "grand total", "amount due", "amount", "balance due", "total due", "invoice total"),
    "po_number": ("po", "po number", "purchase order", "po #"),
    "line_item_description": ("description", "item", "product", "service"),
    "line_item_quantity": ("qty", "quantity", "units"),
    "line_item_unit_price": ("unit price", "price", "rate", "unit cost"),
    "line_item_amount": ("line total", "line amount", "amount", "extended"),
    "line_items_json": ("line items", "lines", "items", "line item json", "details"),
}
# Points per match shape; the length of the synonym is added.
EXACT, LEADING, TRAILING, INNER, JSON_LIST = 100, 70, 60, 50, 95


def synonym_table(spark: SparkSession) -> DataFrame:
    """One row per (target, synonym): its normal form, its words and their number."""
    rows = [
        (order, target, synonym)
        for order, (target, synonyms) in enumerate(SYNONYMS.items())
        for synonym in synonyms
    ]
    table = spark.createDataFrame(rows, "target_no int, target string, synonym string").select(
        "target_no",
        "target",
        norm_key(F.col("synonym")).alias("syn_norm"),
        F.array_join(tokens(F.col("synonym")), " ").alias("syn_words"),
    )
    # A bare `amount` is decided after the assignment, once it is known which field wants it.
    undecided = (F.col("syn_norm") == AMOUNT) & F.col("target").isin("total", "line_item_amount")
    return table.where(~undecided)


def header_rows(headers: DataFrame) -> DataFrame:
    """headers ARRAY to one row per header with its place in the file."""
    return headers.select("file", F.posexplode("headers").alias("header_no", "header"))


def _sequences(header: Column) -> Column:
    """Every word sequence a synonym could equal, with the points its place earns."""
    words = tokens(header)

    def at_width(width: int) -> Column:
        starts = F.when(F.size(words) > width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda i: F.struct(
                F.concat(F.lit("words "), F.array_join(F.slice(words, i + 1, width), " ")).alias("key"),
                F.when(i == 0, LEADING).when(i == F.size(words) - width, TRAILING).otherwise(INNER).alias("points"),
            ),
        )

    whole = F.array(F.struct(F.concat(F.lit("whole "), norm_key(header)).alias("key"), F.lit(EXACT).alias("points")))
    longest = max(len(re.findall("[a-z0-9]+", synonym)) for synonyms in SYNONYMS.values() for synonym in synonyms)
    return F.concat(whole, *[at_width(w) for w in range(1, longest + 1)])


def header_candidates(header_table: DataFrame) -> DataFrame:
    """Scored matches of header names: an equi-join of header word sequences with the synonyms.

    A header text is scored where it stands; no pair that does not match is ever produced. The
    synonym side is a fixed table of under a hundred rows.
    """
    synonyms = synonym_table(header_table.sparkSession)
    keyed = synonyms.select(
        "target_no", "target", F.length("syn_norm").alias("length"),
        F.concat(F.lit("whole "), "syn_norm").alias("key"),
    ).unionByName(
        synonyms.select(
            "target_no", "target", F.length("syn_norm").alias("length"),
            F.concat(F.lit("words "), "syn_words").alias("key"),
        )
    )
    exploded = header_table.select(
        "file", "header_no", "header", F.explode(_sequences(F.col("header"))).alias("seq")
    ).select("file", "header_no", "header", F.col("seq.key").alias("key"), F.col("seq.points").alias("points"))
    return exploded.join(F.broadcast(keyed), "key").select(
        "file", "target_no", "target", "header_no", "header", (F.col("points") + F.col("length")).alias("score")
    )


def header_scores(staged_headers: DataFrame) -> DataFrame:
    """Best score of every (file, target, header) that matches at all, by name only."""
    return (
        header_candidates(header_rows(staged_headers))
        .groupBy("file", "target", "header")
        .agg(F.max("score").alias("score"))
    )


def _is_json_list(value: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(value))
    return F.startswith(value, F.lit("[")) & F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))


def json_list_columns(cells: DataFrame) -> DataFrame:
    """(file, json_lists): the columns of a file of which some cell is a JSON list."""
    lists = F.map_filter("cells", lambda _h, v: F.startswith(v, F.lit("[")))
    # Most rows hold no such cell: one look at all cells of a row tells, without a function called for each.
    opened = F.contains(F.concat(F.lit("\x01"), F.array_join(F.map_values("cells"), "\x01")), F.lit("\x01["))
    found = cells.where(opened).select("file", F.explode(lists).alias("header", "value")).where(_is_json_list(F.col("value")))
    # Distinct combines on the map side, so what is collected is a file's header names, once each.
    return found.select("file", "header").distinct().groupBy("file").agg(F.collect_list("header").alias("json_lists"))


def _assign(candidates: Column) -> Column:
    """Best score first, then earlier field, then earlier column; each side is used once."""
    start = F.struct(F.array().cast("array<string>").alias("targets"), F.array().cast("array<string>").alias("headers"))

    def take(done: Column, c: Column) -> Column:
        used = F.array_contains(done["targets"], c["target"]) | F.array_contains(done["headers"], c["header"])
        return F.struct(
            F.when(used, done["targets"]).otherwise(F.array_append(done["targets"], c["target"])).alias("targets"),
            F.when(used, done["headers"]).otherwise(F.array_append(done["headers"], c["header"])).alias("headers"),
        )

    return F.aggregate(F.array_sort(candidates), start, take)


def _field_list(assigned: Column, fields: tuple[str, ...]) -> Column:
    """Headers assigned to the given fields, in field order."""
    return F.array_compact(F.array(*[assigned[name] for name in fields]))


_ISO_CELL = r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]|$)"
_NUMERIC_CELL = r"^(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{1,4})$"
_DATE_FIELDS = ("invoice_date", "due_date")


def _wanted_columns(assigned_files: DataFrame) -> DataFrame:
    """One row per file: the columns whose values are looked at, and for what."""
    assigned = F.col("assigned")
    money = _field_list(assigned, MONEY_FIELDS)
    lined = F.size(_field_list(assigned, LINE_FIELDS)) >= 2
    return assigned_files.select(
        "file",
        F.when(lined, assigned["invoice_number"]).alias("number"),
        assigned["currency"].alias("currency"),
        F.when(F.size(money) > 0, money).otherwise(F.col("headers")).alias("money"),
        *[assigned[name].alias(name) for name in _DATE_FIELDS],
    )


# A first cell is found by one long, so that the aggregates are hashed on the map side: its place, its row, then what it says.
_ROW_BITS, _CODE_BITS, _PART_BITS = 40, 3, 17


def _with_seen(rows: DataFrame) -> DataFrame:
    """(file, row_no, ...): what a row's wanted cells say, each looked up once.

    `hit` is the place of the first money column with a currency symbol, the row and the symbol's number; `day_i` and `second_i` are
    the row and the text of a date part over 12, its length beside its value.
    """
    cells, row = F.col("cells"), F.col("row_no").cast("long")
    codes = F.array(*[F.lit(c) for c in CURRENCY_SYMBOLS.values()])
    hits = F.filter(
        F.transform("money", lambda h, i: F.struct(i.cast("long").alias("place"), symbol_code(cells[h]).alias("code"))), lambda x: x["code"].isNotNull()
    )
    # The columns are gone through only where some cell of the row holds a symbol; other rows leave their cells behind.
    looked = rows.select(
        "file", "row_no", "money", "cells", F.array_join(F.map_values(cells), "").alias("_text"),
        cells[F.col("currency")].alias("_code"), cells[F.col("number")].alias("_number"),
        *[F.coalesce(cells[F.col(name)], F.lit("")).alias(f"_date_{i}") for i, name in enumerate(_DATE_FIELDS)],
    )
    marked = contains_any(F.col("_text"), tuple(CURRENCY_SYMBOLS))
    looked = looked.withColumns({name: F.when(marked, F.col(name)) for name in ("cells", "money")}).drop("_text")
    looked = looked.withColumn("_hit", F.get(hits, F.lit(0))).drop("cells", "money")
    triples = [F.when(F.col(f"_date_{i}").rlike(_NUMERIC_CELL), F.split(f"_date_{i}", r"[/.\-]")).alias(f"_parts_{i}") for i in range(len(_DATE_FIELDS))]
    looked = looked.select("*", *triples)
    place = F.shiftleft("_hit.place", _ROW_BITS + _CODE_BITS) + F.shiftleft(row, _CODE_BITS)
    out = [F.when(F.col("_hit").isNotNull(), place + F.array_position(codes, F.col("_hit.code")) - 1).alias("hit")]
    for i in range(len(_DATE_FIELDS)):
        value, parts = F.col(f"_date_{i}"), F.col(f"_parts_{i}")
        dated, first = value != "", F.get(parts, F.lit(0))
        out += [
            dated.alias(f"dated_{i}"),
            F.when(dated, value.rlike(_ISO_CELL)).alias(f"iso_{i}"),
            parts.isNotNull().alias(f"triple_{i}"),
            (F.length(first) == 4).alias(f"year_first_{i}"),
        ]
        for k, name in enumerate(("day", "second")):
            part = F.get(parts, F.lit(k))
            told = F.shiftleft(row, _PART_BITS) + F.shiftleft(F.length(part).cast("long"), 14) + part.cast("long")
            out.append(F.when(part.cast("int") > 12, told).alias(f"{name}_{i}"))
    return looked.select("file", "row_no", F.col("_code").alias("code"), F.col("_number").alias("number"), *out)


def _part_text(told: Column) -> Column:
    """The text of a date part from the long that _with_seen makes of it."""
    value = F.pmod(told, F.lit(1 << 14)).cast("string")
    return F.lpad(value, F.pmod(F.shiftright(told, 14), F.lit(1 << (_PART_BITS - 14))).cast("int"), F.lit("0"))


def _facts_of_rows() -> list[Column]:
    """Aggregates of a file over all rows: the first currency symbol, and what its date cells look like.

    The symbol is the first by money column, then by row; days and seconds are the first parts of a date over 12, by date
    column, then by row.
    """
    out = [F.min("hit").alias("hit")]
    for i in range(len(_DATE_FIELDS)):
        out += [
            F.count_if(f"dated_{i}").alias(f"dates_{i}"),
            F.bool_and(f"iso_{i}").alias(f"iso_{i}"),
            F.count_if(f"triple_{i}").alias(f"triples_{i}"),
            F.bool_and(f"year_first_{i}").alias(f"year_first_{i}"),
            F.min(f"day_{i}").alias(f"day_{i}"),
            F.min(f"second_{i}").alias(f"second_{i}"),
        ]
    return out


def sniffed(cells: DataFrame, assigned_files: DataFrame) -> DataFrame:
    """What the values of each file say, over all its rows: symbols, codes, dates, and whether invoice numbers repeat."""
    wanted = measured(_wanted_columns(assigned_files))
    rows = _with_seen(cells.join(wanted, "file"))
    facts = rows.groupBy("file").agg(*_facts_of_rows()).join(wanted.select("file", "money").dropDuplicates(["file"]), "file")
    names = F.array(*[F.lit(c) for c in CURRENCY_SYMBOLS.values()])
    code = F.get(names, F.pmod("hit", F.lit(1 << _CODE_BITS)).cast("int"))
    header = F.get("money", F.shiftright("hit", _ROW_BITS + _CODE_BITS).cast("int"))
    texts = {f"{n}_{i}": _part_text(F.col(f"{n}_{i}")) for n in ("day", "second") for i in range(len(_DATE_FIELDS))}
    facts = facts.withColumns({"hit": F.when(F.col("hit").isNotNull(), F.struct(code.alias("code"), header.alias("header"))), **texts}).drop("money")

    # Rows are not read for codes where no file has a column of them.
    if wanted.where(F.col("currency").isNotNull()).isEmpty():
        facts = facts.withColumn("common", F.lit(None).cast("string"))
    else:
        codes = rows.where(is_code(F.col("code"))).groupBy("file", F.upper("code").alias("code")).agg(
            F.count(F.lit(1)).alias("n"), F.min("row_no").alias("seen")
        )
        common = codes.groupBy("file").agg(F.max_by("code", F.struct("n", -F.col("seen"))).alias("common"))
        facts = facts.join(common, "file", "left")

    keys = rows.where(F.col("number") != "").groupBy("file", norm_key(F.col("number")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    repeated = keys.groupBy("file").agg(F.max(F.col("n") > 1).alias("repeats"))
    return facts.join(repeated, "file", "left")


def _currency(df: DataFrame) -> DataFrame:
    common, hit, column = F.col("common"), F.col("hit"), F.col("assigned")["currency"]
    symbol = F.create_map(*[F.lit(x) for s, c in CURRENCY_SYMBOLS.items() for x in (c, s)])
    note = (
        F.when(
            common.isNotNull(),
            F.concat(F.lit("Currency defaults to "), common, F.lit(", the most common value in "), quoted(column), F.lit(".")),
        )
        .when(
            hit.isNotNull(),
            F.concat(
                F.lit("Currency inferred as "), hit["code"], F.lit(" from the "), symbol[hit["code"]],
                F.lit(" symbol in "), quoted(hit["header"]), F.lit("."),
            ),
        )
        .otherwise(F.lit("No currency column or symbol found; assuming USD."))
    )
    return df.withColumns(
        {"currency_default": F.coalesce(common, hit["code"], F.lit("USD")), "currency_note": note}
    )


def _date_order(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")

    def total(name: str) -> Column:
        return sum((F.coalesce(F.col(f"{name}_{i}"), F.lit(0)) for i in range(len(_DATE_FIELDS))), F.lit(0))

    def every(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_0"), F.lit(True)) & F.coalesce(F.col(f"{name}_1"), F.lit(True))

    day, second = (F.coalesce(F.col(f"{name}_0"), F.col(f"{name}_1")) for name in ("day", "second"))
    cases = [
        (total("dates") == 0, "unknown", none),
        (every("iso"), "ISO", none),
        (
            total("triples") == 0,
            "unknown",
            F.lit("Date order could not be determined from the sample; dates are parsed leniently."),
        ),
        (every("year_first"), "YMD", F.lit("Dates read as year-month-day.")),
        (
            day.isNotNull(),
            "DMY",
            F.concat(F.lit("Dates read as day-month-year (a day part of "), day, F.lit(" rules out month-first).")),
        ),
        (
            second.isNotNull(),
            "MDY",
            F.concat(F.lit("Dates read as month-day-year (a part of "), second, F.lit(" rules out day-first).")),
        ),
    ]
    order = F.lit("unknown")
    note = F.lit("Dates like 03/08/2026 are ambiguous; day-month-year was not confirmed.")
    for condition, name, text in reversed(cases):
        order = F.when(condition, F.lit(name)).otherwise(order)
        note = F.when(condition, text).otherwise(note)
    return df.withColumns({"date_format": order, "date_note": note})


def _granularity(df: DataFrame) -> DataFrame:
    number, repeats = F.col("assigned")["invoice_number"], F.coalesce("repeats", F.lit(False))
    return df.withColumns(
        {
            "granularity": F.when(repeats, F.lit("line_item")).otherwise(F.lit("invoice")),
            "granularity_note": F.when(
                repeats,
                F.concat(quoted(number), F.lit(" repeats across rows, so rows are grouped into one invoice per number.")),
            ),
        }
    )


def _bare_amount(df: DataFrame) -> DataFrame:
    """A leftover column called just `amount` is the total, or else the line amount."""
    taken = F.col("taken")
    spare = F.get(
        F.filter("headers", lambda h: (norm_key(h) == AMOUNT) & ~F.array_contains(taken["headers"], h)), F.lit(0)
    )
    df = df.withColumn("_spare", spare).withColumn(
        "_assigned", F.map_from_arrays(taken["targets"], taken["headers"])
    )
    had, bare = F.col("_assigned"), F.col("_spare")
    to_total = bare.isNotNull() & had["total"].isNull()
    to_line = bare.isNotNull() & had["total"].isNotNull() & had["line_item_amount"].isNull()
    return df.withColumns(
        {
            "assigned": F.when(to_total, F.map_concat(had, F.create_map(F.lit("total"), bare)))
            .when(to_line, F.map_concat(had, F.create_map(F.lit("line_item_amount"), bare)))
            .otherwise(had),
            "amount_note": F.when(
                to_total,
                F.concat(F.lit("No invoice-level total column, so "), quoted(bare), F.lit(" is read as the invoice total.")),
            ).when(
                to_line,
                F.concat(quoted(had["total"]), F.lit(" is the invoice total, so "), quoted(bare), F.lit(" is read as the line amount.")),
            ),
        }
    ).drop("_spare", "_assigned", "taken")


def heuristic_mapping(cells: DataFrame, headers: DataFrame, sniff_rows: int | None = None) -> DataFrame:
    """One mapping row per file from header names and sniffed values.

    Values are judged on all rows of a file, or on its first `sniff_rows` rows where a caller wants such a window.
    """
    seen = cells if sniff_rows is None else cells.where(F.col("row_no") <= sniff_rows + 1)
    by_name = header_candidates(header_rows(headers)).groupBy("file").agg(
        F.collect_list(
            F.struct((-F.col("score")).alias("rank"), "target_no", "header_no", "target", "header")
        ).alias("by_name")
    )
    files = headers.join(json_list_columns(seen), "file", "left").join(by_name, "file", "left")
    no_hits = F.array().cast("array<struct<rank:int,target_no:int,header_no:int,target:string,header:string>>")
    files = files.withColumn("by_name", F.coalesce("by_name", no_hits))
    packed = F.transform(
        "headers",
        lambda h, i: F.when(
            F.coalesce(F.array_contains("json_lists", h), F.lit(False)),
            F.struct(
                F.lit(-JSON_LIST).alias("rank"),
                F.lit(list(SYNONYMS).index("line_items_json")).alias("target_no"),
                i.alias("header_no"),
                F.lit("line_items_json").alias("target"),
                h.alias("header"),
            ),
        ),
    )
    scored = files.withColumn("_scored", F.concat("by_name", F.array_compact(packed)))
    taken = scored.withColumn("taken", _assign(F.col("_scored"))).drop("_scored", "by_name", "json_lists")
    ensure_checkpoint_dir(cells.sparkSession)
    # Which column feeds which field, one row per file: fixed before the values of those columns are read.
    assigned_files = _bare_amount(taken).checkpoint()
    decided = assigned_files.join(sniffed(seen, assigned_files), "file", "left")
    decided = _date_order(_currency(_granularity(decided)))
    missing = [
        F.when(
            F.col("assigned")[name].isNull(),
            F.lit(f"No column matched {name.replace('_', ' ')}; it will be derived or left blank."),
        )
        for name in ("invoice_number", "vendor_name", "invoice_date", "total")
    ]
    notes = F.array_compact(F.array("amount_note", "granularity_note", "currency_note", "date_note", *missing))
    chosen = decided.select(
        "file",
        "granularity",
        *[F.col("assigned")[name].alias(name) for name in MAPPED_FIELDS],
        "currency_default",
        "date_format",
        F.create_map().cast("map<string,string>").alias("status_values"),
        notes.alias("notes"),
        F.lit("heuristic").alias("mapping_source"),
    )
    # A decision per file: fixed once, so that every later stage reads the same small table and no
    # filter on it is pushed back through the sniffing.
    return chosen.checkpoint()


# ------------------------------------------------------------------ supplied mappings

_SUPPLIED = ", ".join(
    f"{f.name} {f.dataType.simpleString()}" for f in MAPPING.fields if f.name not in ("file", "mapping_source")
)


def parse_supplied(df: DataFrame, json_column: str) -> DataFrame:
    """Mappings delivered as JSON text per file; `failure` says why one cannot be used."""
    parsed = df.select(
        "file",
        F.from_json(
            json_column, _SUPPLIED + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        ).alias("m"),
    )
    m = F.col("m")
    bad_values = F.exists(F.map_values(F.coalesce(m["status_values"], F.create_map().cast("map<string,string>"))), lambda v: ~v.isin(*STATUSES))
    failure = (
        F.when(m.isNull() | m["_corrupt"].isNotNull(), F.lit("The supplied mapping could not be parsed."))
        .when(~F.coalesce(m["granularity"].isin("invoice", "line_item"), F.lit(False)), F.lit("The supplied mapping has no valid granularity."))
        .when(
            ~F.coalesce(m["date_format"], F.lit("unknown")).isin("ISO", "DMY", "MDY", "YMD", "unknown"),
            F.lit("The supplied mapping has no valid date format."),
        )
        .when(bad_values, F.lit("The supplied mapping translates a status to an unknown value."))
    )
    return parsed.select("file", "m.*", failure.alias("failure")).drop("_corrupt")


def reconcile(supplied: DataFrame, headers: DataFrame) -> DataFrame:
    """Hold a supplied mapping to the columns that exist: keep, repair by normal form, or drop."""
    joined = supplied.drop("mapping_source").join(headers, "file")
    keyed = joined.withColumn("_keys", F.transform("headers", norm_key))
    fixed, notes = {}, []
    for name in MAPPED_FIELDS:
        value = F.col(name)
        place = F.array_position("_keys", norm_key(value))
        near = F.when(place > 0, F.get("headers", (place - 1).cast("int")))
        exact = F.array_contains("headers", value)
        fixed[name] = F.when(value.isNull() | exact, value).otherwise(near)
        notes.append(
            F.when(value.isNotNull() & ~exact & near.isNotNull(),
                   F.concat(F.lit(f"Matched {name} to the column "), quoted(near), F.lit(" (the model wrote "), quoted(value), F.lit(").")))
            .when(value.isNotNull() & ~exact,
                  F.concat(F.lit(f"Dropped {name}: "), quoted(value), F.lit(" is not a column in this file.")))
        )
    code = F.upper(blank_to_empty(F.col("currency_default")))
    usable = code.rlike("^[A-Z]{3}$")
    notes.append(
        F.when((code != "") & ~usable,
               F.concat(F.lit("Ignored currency_default "), quoted(F.col("currency_default")), F.lit(": not a 3-letter ISO code.")))
    )
    empty = F.array().cast("array<string>")
    return keyed.select(
        "file",
        "granularity",
        *[fixed[name].alias(name) for name in MAPPED_FIELDS],
        F.when(usable, code).alias("currency_default"),
        F.coalesce("date_format", F.lit("unknown")).alias("date_format"),
        F.coalesce("status_values", F.create_map().cast("map<string,string>")).alias("status_values"),
        F.concat(F.coalesce("notes", empty), F.array_compact(F.array(*notes))).alias("notes"),
        F.lit("supplied").alias("mapping_source"),
        *(["failure"] if "failure" in supplied.columns else []),
    )


def choose_mapping(cells: DataFrame, headers: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """A usable supplied mapping wins; otherwise the heuristic one, led by the reason."""
    if supplied is None:
        return heuristic_mapping(cells, headers)
    if "failure" not in supplied.columns:
        supplied = supplied.withColumn("failure", F.lit(None).cast("string"))
    checked = reconcile(supplied, headers)
    good = checked.where(F.col("failure").isNull()).drop("failure")
    # Only the files without a usable mapping are sniffed.
    rest = headers.join(good.select("file"), "file", "left_anti")
    reasons = supplied.where(F.col("failure").isNotNull()).select("file", "failure")
    guessed = heuristic_mapping(cells.join(rest.select("file"), "file", "left_semi"), rest).join(
        reasons, "file", "left"
    )
    led = guessed.withColumn(
        "notes", F.concat(F.array_compact(F.array("failure")), F.col("notes"))
    ).drop("failure")
    return good.unionByName(led)


def unmapped_columns(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """Source columns no field uses, in file order."""
    used = F.array_compact(F.array(*[F.col(name) for name in MAPPED_FIELDS]))
    left = headers.join(mapping.select("file", used.alias("used")), "file")
    return left.select(
        "file", F.posexplode("headers").alias("header_no", "header"), "used"
    ).where(~F.array_contains("used", F.col("header"))).drop("used")


# Wording of the mapping report.
GRANULARITY_TEXT = {
    "invoice": "One row per invoice",
    "line_item": "One row per line item, grouped by invoice number",
}
DATE_FORMAT_TEXT = {
    "ISO": "ISO, as in 2026-08-04",
    "DMY": "DMY, day/month/year",
    "MDY": "MDY, month/day/year",
    "YMD": "YMD, year/month/day",
    "unknown": "unknown, parsed leniently",
}
FIELD_LABELS = {
    "invoice_number": "Invoice number",
    "vendor_name": "Vendor",
    "vendor_email": "Vendor email",
    "invoice_date": "Invoice date",
    "due_date": "Due date",
    "currency": "Currency",
    "status": "Status",
    "subtotal": "Subtotal",
    "tax": "Tax",
    "total": "Total",
    "po_number": "PO number",
    "line_item_description": "Line description",
    "line_item_quantity": "Line quantity",
    "line_item_unit_price": "Line unit price",
    "line_item_amount": "Line amount",
    "line_items_json": "Line items (JSON)",
}


def mapping_report(mapping: DataFrame) -> DataFrame:
    """Long form of a mapping: file, position, field, label, value; unset fields are left out."""
    m = F.col

    def entry(field: str, label: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(label).alias("label"), value.cast("string").alias("value"))

    rows = F.when(m("granularity") == "invoice", GRANULARITY_TEXT["invoice"]).otherwise(GRANULARITY_TEXT["line_item"])
    vocabulary = F.array_join(
        F.transform(F.map_entries("status_values"), lambda e: F.concat(e["key"], F.lit(" → "), e["value"])), ", "
    )
    date_text = F.create_map(*[F.lit(x) for pair in DATE_FORMAT_TEXT.items() for x in pair])
    entries = F.array(
        entry("granularity", "Rows", rows),
        *[entry(name, label, F.when(blank_to_empty(m(name)) != "", m(name))) for name, label in FIELD_LABELS.items()],
        entry(
            "currency_default", "Currency default",
            F.concat(m("currency_default"), F.lit(", assumed because there is no currency column")),
        ),
        entry("date_format", "Date format", F.coalesce(date_text[m("date_format")], m("date_format"))),
        entry("status_values", "Status values", F.when(F.size("status_values") > 0, vocabulary)),
    )
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return mapping.select("file", F.posexplode(kept).alias("position", "_e")).select("file", "position", "_e.*")
