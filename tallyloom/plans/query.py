"""Search, filter, sort, page and report over a ledger frame."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import WHITESPACE
from tallyloom.schema import SOURCES, STATUSES

# What may be searched, sorted and paged.
SEARCHED = ("vendor_name", "invoice_number", "vendor_email", "po_number")
SORTABLE = ("created_at", "invoice_date", "due_date", "total", "vendor_name")
PRESETS = {
    "newest": ("created_at", "desc"),
    "invoice_date": ("invoice_date", "desc"),
    "due_date": ("due_date", "asc"),
    "total_desc": ("total", "desc"),
    "total_asc": ("total", "asc"),
    "vendor": ("vendor_name", "asc"),
}
MAX_PAGE_SIZE = 200
# So many rows may lie before a page where its top-k is taken; further ones are counted away.
DEEP_OFFSET = 1_000
# Keys that cut the rows into ranges in one counting pass.
SPLITS = 64


def _one_of(name: str, value: Any, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}, not {value!r}")


def matches(
    q: str | None = None,
    status: str | None = None,
    needs_review: bool | None = None,
    source: str | None = None,
    wildcards: bool = False,
) -> Column:
    """One predicate for the search text and the filters that are set.

    The text is matched literally and without case; `wildcards=True` lets `%` and `_` act as in LIKE.
    """
    terms: list[Column] = [F.lit(True)]
    needle = (q or "").strip(WHITESPACE)
    if needle:
        if wildcards:
            pattern = "%" + needle.replace("\\", "\\\\") + "%"
            hits = [F.ilike(F.col(c), F.lit(pattern)) for c in SEARCHED]
        else:
            hits = [F.contains(F.lower(F.col(c)), F.lower(F.lit(needle))) for c in SEARCHED]
        terms.append(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))
    if status is not None:
        _one_of("status", status, STATUSES)
        terms.append(F.col("status") == status)
    if needs_review is not None:
        terms.append(F.col("needs_review") == F.lit(needs_review))
    if source is not None:
        _one_of("source", source, SOURCES)
        terms.append(F.col("source") == source)
    return reduce(lambda a, b: a & b, terms)


def filter_invoices(df: DataFrame, **filters: Any) -> DataFrame:
    return df.where(matches(**filters))


def sort_keys(sort: str = "created_at", order: str = "desc") -> list[Column]:
    """Sort column, then newest id; nulls count as smallest."""
    _one_of("sort", sort, SORTABLE)
    _one_of("order", order, ("asc", "desc"))
    column = F.col(sort)
    return [column.asc_nulls_first() if order == "asc" else column.desc_nulls_last(), F.col("id").desc()]


def preset_keys(preset: str) -> list[Column]:
    return sort_keys(*PRESETS[preset])


def sort_invoices(df: DataFrame, sort: str = "created_at", order: str = "desc") -> DataFrame:
    return df.orderBy(*sort_keys(sort, order))


def _check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")


def page_of(
    df: DataFrame, page: int = 1, page_size: int = 25, sort: str = "created_at", order: str = "desc"
) -> DataFrame:
    """One page, by a top-k over the range of rows that it begins in; a page beyond the last row is empty."""
    _check_page(page, page_size)
    rows, skip = _begin_of_page(df, (page - 1) * page_size, page_size, sort, order)
    return rows.orderBy(*sort_keys(sort, order)).offset(skip).limit(page_size)


def _begin_of_page(df: DataFrame, skip: int, page_size: int, sort: str, order: str) -> tuple[DataFrame, int]:
    """The range of rows that holds the page, and how many of its rows come before it.

    Keys chosen by their hash cut the rows into ranges of about the same size, however the sort column is spread, as the id
    settles ties. One pass counts what each key leaves behind it; the range around the page is cut again until few rows
    lie before the page. Every pass reads two columns; the driver sees `SPLITS` keys and counts.
    """
    keys = sort_keys(sort, order)
    while skip > DEEP_OFFSET:
        chosen = df.select(F.col(sort).alias("value"), "id").orderBy(F.xxhash64("id"), "id").limit(SPLITS).collect()
        kept = [F.count_if(~_beyond(row.value, row.id, sort, order)).alias(f"n{i}") for i, row in enumerate(chosen)]
        *counts, total = df.agg(*kept, F.count(F.lit(1)).alias("total")).first()
        passed = max(((n, i) for i, n in enumerate(counts) if n <= skip), default=None)
        ended = min(((n, i) for i, n in enumerate(counts) if skip + page_size <= n < total), default=None)
        if skip >= total:
            return df.orderBy(*keys).limit(0), 0
        if passed is None and ended is None:
            break
        if ended is not None:
            last = chosen[ended[1]]
            df = df.where(~_beyond(last.value, last.id, sort, order))
        if passed is not None:
            last = chosen[passed[1]]
            df, skip = df.where(_beyond(last.value, last.id, sort, order)), skip - passed[0]
    return df, skip


def _beyond(value: Any, last_id: int, sort: str, order: str) -> Column:
    """True for rows that come after the key (sort value, id), never null."""
    column, older = F.col(sort), F.col("id") < F.lit(last_id)
    if order == "asc":
        beyond = column.isNotNull() if value is None else column > F.lit(value)
    else:
        beyond = F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()
    tied = (column.isNull() if value is None else column == F.lit(value)) & older
    return F.coalesce(beyond | tied, F.lit(False))


def page_after(
    df: DataFrame,
    last: tuple[str | int | float | Decimal | date | datetime | None, int] | None,
    page_size: int = 25,
    sort: str = "created_at",
    order: str = "desc",
) -> DataFrame:
    """The page after a known last row (sort value, id): a filter and a top-k at any depth."""
    _check_page(1, page_size)
    keys = sort_keys(sort, order)
    if last is None:
        return df.orderBy(*keys).limit(page_size)
    return df.where(_beyond(*last, sort, order)).orderBy(*keys).limit(page_size)


def page_summary(df: DataFrame, page: int = 1, page_size: int = 25, **filters: Any) -> DataFrame:
    """One row: matches, all rows, page count and the row range shown, from one pass."""
    _check_page(page, page_size)
    counts = df.agg(
        F.count_if(matches(**filters)).alias("total"), F.count(F.lit(1)).alias("base_total")
    )
    total = F.col("total")
    return counts.select(
        "total",
        "base_total",
        F.greatest(F.lit(1), F.ceil(total / page_size)).cast("long").alias("pages"),
        F.when(total == 0, 0).otherwise((page - 1) * page_size + 1).cast("long").alias("first_row"),
        F.least(F.lit(page * page_size), total).cast("long").alias("last_row"),
    )


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("invoices"))


def counts_with_all(df: DataFrame) -> DataFrame:
    """status_counts and a row `all` with the sum of them, from one pass; of no rows, `all` is 0."""
    # A row for each status, of which there are few.
    counted = status_counts(df).agg(
        F.collect_list(F.struct("status", "invoices")).alias("each"), F.coalesce(F.sum("invoices"), F.lit(0)).alias("invoices")
    )
    return counted.select(F.inline(F.array_append("each", F.struct(F.lit("all").alias("status"), "invoices"))))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("invoices"))


def spend_by_vendor(df: DataFrame) -> DataFrame:
    """Spend per vendor and currency, largest first; currencies are never mixed."""
    return (
        df.groupBy("vendor_name", "currency")
        .agg(F.sum("total").alias("spend"))
        .orderBy(F.col("spend").desc(), "vendor_name", "currency")
    )


def overdue(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "overdue")


def outstanding_by_currency(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") != "paid").groupBy("currency").agg(F.sum("total").alias("outstanding"))


def over_threshold(df: DataFrame, amount: int | Decimal = 1000) -> DataFrame:
    return df.where(F.col("total") > F.lit(amount))
