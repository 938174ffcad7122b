"""Text helpers shared by mapping and conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's trim removes spaces only; exports also carry tabs, line ends, no-break and wide spaces.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space from both ends.

    Trimming a set of characters is slow, so it is left to cells that still start or end with
    something other than visible ASCII once their spaces are gone.
    """
    spaced = F.trim(text)
    visible = F.ascii(spaced).between(33, 126) & F.ascii(F.right(spaced, F.lit(1))).between(33, 126)
    return F.when(visible, spaced).otherwise(F.trim(text, F.lit(WHITESPACE)))


def blank_to_empty(text: Column) -> Column:
    """Null and white space both become the empty string."""
    return strip(F.coalesce(text, F.lit("")))


def norm_key(text: Column) -> Column:
    """Lower case with everything but letters a-z and digits removed."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    """The words of a header, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def quoted(text: Column) -> Column:
    """A value in quotes for a note: double quotes only where the value itself holds a single one."""
    single = F.contains(text, F.lit("'"))
    double = F.contains(text, F.lit('"'))
    mark = F.when(single & ~double, F.lit('"')).otherwise(F.lit("'"))
    special = F.when(single & double, F.lit(r"([\\'])")).otherwise(F.lit(r"(\\)"))
    body = F.regexp_replace(text, special, F.lit(r"\\$1"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\xa0", "\\xa0")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    return F.concat(mark, body, mark)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(word)) for word in words])


def file_stem(name: Column) -> Column:
    """File name without folder and extension, safe inside an invoice number.

    At most 40 characters of it are kept. Where that cuts something off, or the name has a folder, six digits of the
    whole path's hash tell it from others of the same name.
    """
    last = F.regexp_extract(name, r"([^/]*)$", 1)
    base = F.regexp_replace(F.when(name.isNull() | (last == ""), F.lit("import")).otherwise(last), r"\.[^.]*$", "")
    whole = F.trim(F.regexp_replace(base, "[^A-Za-z0-9]+", "-"), F.lit("-"))
    stem = F.when(whole == "", F.lit("file")).otherwise(F.substring(whole, 1, 40))
    mark = F.concat(F.lit("-"), F.substring(F.md5(name), 1, 6))
    return F.concat(stem, F.when((F.length(whole) > 40) | F.contains(name, F.lit("/")), mark).otherwise(F.lit("")))


def money_text(amount: Column) -> Column:
    """Two decimals, the way notes print money."""
    return amount.cast("decimal(28,2)").cast("string")


def quantity_text(quantity: Column) -> Column:
    """Shortest form with at least one decimal: 0.0, 2.5, -3.0."""
    trimmed = F.regexp_replace(quantity.cast("string"), "0+$", "")
    return F.when(F.endswith(trimmed, F.lit(".")), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
