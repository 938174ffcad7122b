"""Line items: gap filling, packed cells (JSON or text) and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.cells import money_fields
from tallyloom.functions.text import blank_to_empty, norm_key, strip
from tallyloom.schema import LINE_DDL, MONEY, RAW_LINE_DDL, RAW_MONEY

SYNTHESIZED_DESCRIPTION = "Imported invoice"

# Key names accepted inside a packed line, in priority order.
LINE_KEYS = {
    "description": ("description", "desc", "name", "item", "title", "details", "product", "service"),
    "quantity": ("quantity", "qty", "units", "count"),
    "unit_price": ("unitprice", "price", "rate", "unitcost", "cost"),
    "amount": ("amount", "linetotal", "lineamount", "total", "extended", "value", "subtotal"),
}
# Fixed value: `description x quantity @ price`.
TEXT_LINE = r"(?i)^(.+?)\s*[x*×]\s*([\d.,]+)\s*@\s*(.+)$"


def two_places(amount: Column) -> Column:
    """Half-up to two decimals, still in the wide type; null when the product does not fit."""
    return F.round(amount, 2).try_cast(RAW_MONEY)


def build_line(description: Column, quantity: Column, unit_price: Column, amount: Column) -> Column:
    """Fill the gaps among quantity, price and amount; never all three from nothing."""
    qty = F.coalesce(quantity, F.lit(1).cast(RAW_MONEY))
    zero = F.lit(0).cast(RAW_MONEY)
    full_amount = F.when(amount.isNotNull(), amount).when(
        unit_price.isNotNull(), F.coalesce(two_places(qty * unit_price), zero)
    ).otherwise(zero)
    full_price = F.when(unit_price.isNotNull(), unit_price).otherwise(
        F.coalesce(two_places(F.try_divide(full_amount, qty)), zero)
    )
    text = blank_to_empty(description)
    return F.struct(
        F.when(text == "", F.lit(SYNTHESIZED_DESCRIPTION)).otherwise(text).alias("description"),
        qty.alias("quantity"),
        full_price.cast(RAW_MONEY).alias("unit_price"),
        full_amount.cast(RAW_MONEY).alias("amount"),
    ).cast(RAW_LINE_DDL)


def _unless_falsy(entry: Column) -> Column:
    """The text of a JSON value; absent, null, empty, false and the number zero read as missing, the text "0" does not.

    The kind is looked at only where the text could be one of these.
    """
    text = entry["text"]
    doubtful = text.isin("false", "[]", "{}") | text.rlike(r"^-?0[0.]*(?:[eE].*)?$")
    return F.when(text.isNull() | (doubtful & (F.schema_of_variant(entry["value"]) != "STRING")), F.lit("")).otherwise(text)


def json_lines(cell: Column) -> Column:
    """A JSON list of objects to lines; null when the cell is not a JSON list.

    One transform per step keeps every step's input a plain lambda variable.
    """
    items = F.try_variant_get(F.try_parse_json(cell), "$", "array<variant>")
    objects = F.filter(
        F.transform(items, lambda v: v.try_cast("map<string,variant>")), lambda m: m.isNotNull()
    )
    # Backwards, as among equal spellings the last one decides.
    named = F.transform(
        objects,
        lambda m: F.struct(
            F.reverse(F.transform(F.map_keys(m), norm_key)).alias("keys"), F.reverse(F.map_values(m)).alias("values")
        ),
    )

    def first_present(entry: Column, aliases: tuple[str, ...]) -> Column:
        places = [F.nullif(F.array_position(entry["keys"], alias), F.lit(0)) for alias in aliases]
        return F.get(entry["values"], F.coalesce(*places).cast("int") - 1)

    picked = F.transform(
        named, lambda e: F.struct(*[first_present(e, aliases).alias(name) for name, aliases in LINE_KEYS.items()])
    )
    read = F.transform(
        picked,
        lambda p: F.struct(
            *[F.struct(p[name].alias("value"), p[name].try_cast("string").alias("text")).alias(name) for name in LINE_KEYS]
        ),
    )
    texts = F.transform(read, lambda p: F.struct(*[_unless_falsy(p[name]).alias(name) for name in LINE_KEYS]))
    parsed = money_fields(texts, ("quantity", "unit_price", "amount"), ("description",))
    return F.transform(
        parsed, lambda p: build_line(p["description"], p["quantity"], p["unit_price"], p["amount"])
    )


def text_lines(cell: Column) -> Column:
    """`description x quantity @ price` lines split on new lines, semicolons and pipes."""
    # One match per chunk: its three groups are joined by a mark that text cells do not hold.
    mark = "\x01"
    groups = F.filter(
        F.transform(
            F.split(cell, r"[\n;|]+"),
            lambda chunk: F.split(F.regexp_replace(strip(chunk), TEXT_LINE, f"$1{mark}$2{mark}$3"), mark),
        ),
        lambda parts: F.size(parts) == 3,
    )
    texts = F.transform(
        groups,
        lambda parts: F.struct(
            F.get(parts, F.lit(0)).alias("description"),
            F.get(parts, F.lit(1)).alias("quantity"),
            F.get(parts, F.lit(2)).alias("unit_price"),
        ),
    )
    parsed = money_fields(texts, ("quantity", "unit_price"), ("description",))
    missing = F.lit(None).cast(RAW_MONEY)
    return F.transform(
        parsed, lambda p: build_line(p["description"], p["quantity"], p["unit_price"], missing)
    )


def parse_line_cell(text: Column) -> Column:
    """A packed cell to lines: a JSON list stands even when empty, anything else is read as text."""
    raw = blank_to_empty(text)
    none = F.array().cast(f"array<{RAW_LINE_DDL}>")
    as_text = F.when(F.contains(raw, F.lit("@")), text_lines(raw)).otherwise(none)
    return (
        F.when(raw == "", none)
        .when(F.startswith(raw, F.lit("[")), F.coalesce(json_lines(raw), as_text))
        .otherwise(as_text)
    )


def round_line(line: Column) -> Column:
    """Price and amount to two decimals; the quantity keeps its own."""
    return F.struct(
        line["description"].alias("description"),
        line["quantity"].cast(RAW_MONEY).alias("quantity"),
        F.round(line["unit_price"], 2).cast(MONEY).alias("unit_price"),
        F.round(line["amount"], 2).cast(MONEY).alias("amount"),
    ).cast(LINE_DDL)


def sum_amounts(lines: Column, result_type: str = "decimal(28,6)") -> Column:
    """Exact sum of the line amounts of one array."""
    zero = F.lit(0).cast(result_type)
    return F.aggregate(lines, zero, lambda acc, line: (acc + line["amount"]).cast(result_type))
