"""Messy text cells to typed values: money, dates, statuses and currencies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import blank_to_empty, contains_any
from tallyloom.schema import RAW_MONEY

# Status wording and currency symbols, each list in the order it is tried.
UNPAID_WORDS = ("unpaid", "not paid", "non-paid")
PAID_WORDS = ("paid", "settled", "closed", "complete")
OVERDUE_WORDS = ("overdue", "late", "past due")
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₱": "PHP", "¥": "JPY"}

MONTHS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    "sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
_GAP = r"[ \-/.,]+"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
_YEAR = r"(?:\d{4}|\d{2})"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,. ]+)?"
NUMERIC_DATE = r"^(?:\d{1,2}|\d{4})[/.\-]\d{1,2}[/.\-](?:\d{4}|\d{1,2})$"
WORD_DATE = (
    rf"^{_WEEKDAY}(?:{_DAY}{_GAP}(?:of )?(?:{MONTHS}){_GAP}{_YEAR}"
    rf"|(?:{MONTHS}){_GAP}{_DAY}{_GAP}{_YEAR}"
    rf"|\d{{4}}{_GAP}(?:{MONTHS}){_GAP}{_DAY})$"
)
MONTH_FIRST = rf"^{_WEEKDAY}(?:{MONTHS})(?:[^a-z]|$)"


def _money_raw(text: Column) -> Column:
    return blank_to_empty(F.replace(text, F.lit("\xa0"), F.lit(" ")))


def _money_kept(raw: Column) -> Column:
    """Digits, separators and minus signs, without three-letter currency words."""
    stripped = F.regexp_replace(F.regexp_replace(raw, r"(?i)\b[a-z]{3}\b", ""), r"[^0-9,.\-]", "")
    # Most cells are plain numbers already and skip both passes.
    return F.when(raw.rlike(r"^-?[0-9.,]*$"), raw).otherwise(stripped)


def _money_signed(raw: Column, kept: Column) -> Column:
    """One leading sign, a point as decimal mark, no thousands marks."""
    in_parens = F.startswith(raw, F.lit("(")) & F.endswith(raw, F.lit(")")) & ~F.contains(raw, F.lit("\n"))
    negative = in_parens | F.startswith(kept, F.lit("-"))
    # Two digits after the last comma, and no point after it: the comma is the decimal mark.
    decimal_comma = F.contains(kept, F.lit(",")) & kept.rlike(r",-*\d-*\d-*$")
    digits = F.when(decimal_comma, F.translate(kept, ",.-", ".")).otherwise(F.translate(kept, ",-", ""))
    return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits)


_NUMBER = r"^-?(?:\d+\.?\d*|\.\d+)$"


def _money_value(signed: Column) -> Column:
    # Only text that is a number is cast: a failed decimal cast costs an exception per cell.
    return F.when(signed.rlike(_NUMBER), signed.try_cast(RAW_MONEY))


# Digits, with thousands marks only before a point: the steps would take out the marks and leave the rest.
_PLAIN = r"^-?(?:\d[\d,]*\.\d*|\d+|\.\d+)\z"
# The steps take these out wherever they stand.
_AROUND = "".join(CURRENCY_SYMBOLS) + " \xa0"


def with_money(df: DataFrame, cells: dict[str, str]) -> DataFrame:
    """Add parsed amounts: {new column: text column}.

    `$1,234.50`, `(200.00)`, `1.234,50` and `EUR 99,90` become decimals, unreadable text null. Staged
    so each step reads plain columns.
    """
    if len(cells) > 1:
        return _with_amounts(df, cells)
    df = df.withColumns({f"_raw_{out}": _money_raw(F.col(text)) for out, text in cells.items()})
    df = df.withColumns({f"_kept_{out}": _money_kept(F.col(f"_raw_{out}")) for out in cells})
    df = df.withColumns({f"_signed_{out}": _money_signed(F.col(f"_raw_{out}"), F.col(f"_kept_{out}")) for out in cells})
    values = {out: _money_value(F.col(f"_signed_{out}")) for out in cells}
    return df.withColumns(values).drop(*[f"_{step}_{out}" for out in cells for step in ("raw", "kept", "signed")])


def _with_amounts(df: DataFrame, cells: dict[str, str]) -> DataFrame:
    """with_money for several amounts, whose steps would make the method generated for a stage too long to be compiled.

    Plain numbers are cast at once. The steps for the others are lambdas, which Spark keeps out of that method.
    """

    def plain(text: Column) -> Column:
        return F.replace(text, F.lit(","), F.lit("")).try_cast(RAW_MONEY)

    def amount(text: Column) -> Column:
        bare = F.translate(text, _AROUND, "")
        raw = F.transform(F.array(text), _money_raw)
        kept = F.transform(raw, lambda v: F.struct(v.alias("raw"), _money_kept(v).alias("kept")))
        signed = F.transform(kept, lambda v: _money_signed(v["raw"], v["kept"]))
        others = F.get(F.transform(signed, _money_value), F.lit(0))
        return F.when(text.rlike(_PLAIN), plain(text)).when(bare.rlike(_PLAIN), plain(bare)).when(bare != "", others)

    return df.withColumns({out: amount(F.col(text)) for out, text in cells.items()})


def money_fields(records: Column, money: tuple[str, ...], rest: tuple[str, ...]) -> Column:
    """The same for an array of structs of texts: parse the `money` fields, keep the `rest`."""

    def step(array: Column, make) -> Column:
        return F.transform(
            array, lambda r: F.struct(*[r[k].alias(k) for k in rest], *[make(r[k]).alias(k) for k in money])
        )

    def unless_plain(make):
        return lambda v: F.struct(v["plain"].alias("plain"), F.when(v["text"].isNotNull(), make(v["text"])).alias("text"))

    # Plain numbers are cast at once and skip the other steps.
    split = step(
        records,
        lambda v: F.struct(_money_value(v).alias("plain"), F.when(~F.coalesce(v, F.lit("")).rlike(_NUMBER), F.coalesce(v, F.lit(""))).alias("text")),
    )
    raw = step(split, unless_plain(_money_raw))
    kept = step(raw, unless_plain(lambda v: F.struct(v.alias("raw"), _money_kept(v).alias("kept"))))
    signed = step(kept, unless_plain(lambda v: _money_signed(v["raw"], v["kept"])))
    return step(signed, lambda v: F.coalesce(v["plain"], _money_value(v["text"])))


def _full_year(short: Column, as_of: date) -> Column:
    """Two-digit year to the one within fifty years of the as-of date."""
    guess = short + F.lit(as_of.year - as_of.year % 100)
    return (
        F.when(guess >= as_of.year + 50, guess - 100)
        .when(guess < as_of.year - 50, guess + 100)
        .otherwise(guess)
    )


def with_dates(
    df: DataFrame, cells: dict[str, str], hint: Column | str = "unknown", as_of: date | None = None
) -> DataFrame:
    """Add parsed dates: {new column: text column}, under an order hint (ISO, YMD, DMY, MDY, unknown).

    Reads ISO prefixes, bare yyyymmdd, numeric dates with `/ . -`, and dates with an English month
    name; a trailing time is ignored. An order that cannot be right is swapped (`08/28/2026` under
    DMY). `as_of` fixes the century of two-digit years. Each step reads the columns of the one before,
    which keeps the generated code small.
    """
    as_of = as_of or date.today()
    hint = F.lit(hint) if isinstance(hint, str) else hint
    year_hint = F.coalesce(hint.isin("YMD", "ISO"), F.lit(False))

    def step(frame: DataFrame, make) -> DataFrame:
        columns: dict[str, Column] = {}
        for out in cells:
            columns.update({f"_{k}_{out}": v for k, v in make(lambda k, o=out: F.col(f"_{k}_{o}")).items()})
        return frame.withColumns(columns)

    def split_time(get) -> dict[str, Column]:
        raw = get("raw")
        dated = F.when(F.contains(raw, F.lit(":")), F.regexp_replace(raw, r"[Tt ,]+\d{1,2}:\d{2}.*$", ""))
        return {
            "iso": F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(raw, 1, 10).try_cast("date")),
            "day": F.lower(F.coalesce(dated, raw)),
        }

    def shape(get) -> dict[str, Column]:
        raw, day = get("raw"), get("day")
        kind = (
            F.when(get("iso").isNotNull() | (raw == ""), "none")
            .when(raw.rlike(r"^\d+$"), F.when(F.length(raw) == 8, "compact").otherwise("none"))
            .when(F.length(raw) < 6, "none")
            .when(day.rlike(NUMERIC_DATE), "numeric")
            .when(day.rlike(WORD_DATE), F.when(day.rlike(MONTH_FIRST), "month first").otherwise("month inside"))
            .otherwise("none")
        )
        return {"kind": kind}

    def parts(get) -> dict[str, Column]:
        day, kind = get("day"), get("kind")
        numbers = F.regexp_extract_all(day, F.lit(r"(\d+)"), F.lit(1))
        name = F.substring(F.regexp_extract(day, rf"(?:^|[^a-z])({MONTHS})(?:[^a-z]|$)", 1), 1, 3)
        month = F.floor((F.instr(F.lit(MONTH_STARTS), name) + 2) / 3).cast("string")
        return {
            "p": F.when(kind == "numeric", F.split(day, r"[/.\-]"))
            .when(kind == "compact", F.array(F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
            .when(F.startswith(kind, F.lit("month")), F.array_insert(numbers, 2, month))
        }

    def order(get) -> dict[str, Column]:
        kind = get("kind")
        first, second, third = (F.get(get("p"), F.lit(i)) for i in range(3))
        small_third = (F.length(third) <= 2) & (third.try_cast("int") <= 31)
        year_first = (kind != "month first") & (
            (F.length(first) == 4)
            | (first.try_cast("int") > 31)
            | (year_hint & (second.try_cast("int") <= 12) & small_third)
        )
        day_first = (
            F.startswith(kind, F.lit("month"))
            | (first.try_cast("int") > 12)
            | ((hint == "DMY") & (second.try_cast("int") <= 12))
        )
        return {
            "ymd": F.when(year_first, F.array(first, second, third))
            .when(day_first, F.array(third, second, first))
            .otherwise(F.array(third, first, second))
        }

    frame = df.withColumns({f"_raw_{out}": blank_to_empty(F.col(text)) for out, text in cells.items()})
    for make in (split_time, shape, parts, order):
        frame = step(frame, make)
    found: dict[str, Column] = {}
    for out in cells:
        year = F.get(F.col(f"_ymd_{out}"), F.lit(0))
        full = F.when(F.length(year) <= 2, _full_year(year.try_cast("int"), as_of)).otherwise(year.try_cast("int"))
        rest = F.slice(F.col(f"_ymd_{out}"), 2, 2)
        text = F.concat(F.lpad(full.cast("string"), 4, "0"), F.lit("-"), F.array_join(rest, "-"))
        found[out] = F.coalesce(F.col(f"_iso_{out}"), text.try_cast("date"))
    spent = [f"_{k}_{out}" for out in cells for k in ("raw", "iso", "day", "kind", "p", "ymd")]
    return frame.withColumns(found).drop(*spent)


def parse_status(text: Column, vocabulary: Column | None = None) -> Column:
    """Foreign status wording to paid / pending / overdue; the file's own translation wins."""
    value = F.lower(blank_to_empty(text))
    built_in = (
        F.when(contains_any(value, UNPAID_WORDS), F.lit("pending"))
        .when(contains_any(value, PAID_WORDS), F.lit("paid"))
        .when(contains_any(value, OVERDUE_WORDS), F.lit("overdue"))
        .otherwise(F.lit("pending"))
    )
    if vocabulary is None:
        return built_in
    same = F.filter(F.map_entries(vocabulary), lambda e: F.lower(blank_to_empty(e["key"])) == value)
    return F.coalesce(F.get(same, F.lit(0))["value"], built_in)


def symbol_code(text: Column) -> Column:
    """Code of the first known currency symbol in the text, or null."""
    found = F.lit(None).cast("string")
    for symbol, code in reversed(CURRENCY_SYMBOLS.items()):
        found = F.when(F.contains(text, F.lit(symbol)), F.lit(code)).otherwise(found)
    return found


def is_code(text: Column) -> Column:
    return text.rlike("^[A-Za-z]{3}$")


def parse_currency(text: Column) -> Column:
    """Any three letters, upper-cased; else the code of a symbol; else null."""
    raw = blank_to_empty(text)
    return F.when(is_code(raw), F.upper(raw)).otherwise(symbol_code(raw))
