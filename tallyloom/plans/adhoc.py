"""Guarded read-only SQL: refuse anything but one SELECT, cap the rows, describe the tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ROW_LIMIT = 50
MAX_ROW_LIMIT = 500

# Verbs that write or administer, named in the refusal where the statement starts with one.
REFUSED_WORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke",
    "attach", "detach", "pragma", "replace", "merge", "vacuum", "reindex", "copy", "call", "do",
    "execute", "commit", "rollback", "savepoint", "lock", "refresh", "analyze",
)
# Functions that run code or read what is no table.
REFUSED_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect"})
TABLE_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"})
# Plan nodes that only read; whatever the parser may give besides them is refused.
READING_NODES = frozenset(
    (
        "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate",
        "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project",
        "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable",
        "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot",
        "Window", "WithWindowDefinition",
    )
)

# One pass over literals, comments and quoted names, so that neither hides the other.
_QUIET = re.compile(
    r"(?P<literal>\b[rR]'[^']*'|\b[rR]\"[^\"]*\"|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")"
    r"|(?P<comment>--[^\n]*|/\*.*?\*/)"
    r"|(?P<name>`(?:[^`]|``)*`)",
    re.DOTALL,
)


class ReadOnlyViolation(ValueError):
    """The text is not a single read-only query."""


@dataclass(frozen=True)
class CappedResult:
    rows: DataFrame
    truncated: bool
    query: str


def _scrub(sql: str) -> str:
    """Literals become '', comments a space, quoted names a bare marker."""

    def blank(match: re.Match) -> str:
        if match.lastgroup == "comment":
            return " "
        return "''" if match.lastgroup == "literal" else "`"

    return _QUIET.sub(blank, sql)


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _check_plan(spark: SparkSession, sql: str) -> None:
    """Refuse by what the parser makes of the statement: nodes that do not read, relations that are not
    registered, functions that run code. Quoting and spelling make no difference there."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as problem:
        raise ReadOnlyViolation(f"The query could not be parsed: {str(problem).splitlines()[0]}") from problem
    gateway = spark.sparkContext._gateway
    catalyst = "org.apache.spark.sql.catalyst"

    def is_a(node, name: str) -> bool:
        return is_instance_of(gateway, node, f"{catalyst}.{name}")

    named: set[str] = set()
    relations: list[list[str]] = []
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        is_plan = is_a(node, "plans.logical.LogicalPlan")
        if is_plan and kind not in READING_NODES:
            raise ReadOnlyViolation(f"This connection is read-only; {kind} is not allowed.")
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                named.add(pair._1().lower())
                todo.append(pair._2())
        if kind == "UnresolvedRelation":
            relations.append(_items(node.multipartIdentifier()))
        if kind == "UnresolvedTableValuedFunction":
            name = _items(node.name())[-1].lower()
            if name not in TABLE_FUNCTIONS:
                raise ReadOnlyViolation(f"This connection is read-only; {name} is not allowed.")
        if kind == "UnresolvedFunction":
            name = _items(node.nameParts())[-1].lower()
            if name in REFUSED_FUNCTIONS:
                raise ReadOnlyViolation(f"This connection is read-only; {name.upper()} is not allowed.")
        if kind in ("PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"):
            raise ReadOnlyViolation("This connection is read-only; IDENTIFIER is not allowed.")
        if is_plan:
            todo += _items(node.expressions())
        todo += _items(node.children())
        if is_a(node, "expressions.SubqueryExpression"):
            todo.append(node.plan())
    known = {row.table_name.lower() for row in list_tables(spark).collect()}
    for parts in relations:
        home = len(parts) == 1 or (len(parts) == 2 and parts[0].lower() == spark.catalog.currentDatabase().lower())
        if not home or parts[-1].lower() not in (known | named if len(parts) == 1 else known):
            raise ReadOnlyViolation(f"{'.'.join(parts)} is not a registered table; files cannot be queried directly.")


def guard_query(sql: str | None, spark: SparkSession | None = None) -> str:
    """Return the statement without its closing semicolon, or raise `ReadOnlyViolation`."""
    raw = (sql or "").strip()
    if not raw:
        raise ReadOnlyViolation("Empty query.")
    scrubbed = _scrub(raw).strip()
    if "/*" in scrubbed:
        raise ReadOnlyViolation("A comment is not closed.")
    body = scrubbed.rstrip("; \t\r\n")
    if ";" in body:
        raise ReadOnlyViolation("Multiple statements are not allowed; send one SELECT at a time.")
    if not re.match(r"\(*\s*(select|with)\b", body, re.IGNORECASE):
        first = re.match(r"\w*", body)[0].lower()
        if first in REFUSED_WORDS:
            raise ReadOnlyViolation(f"This connection is read-only; {first.upper()} is not allowed.")
        raise ReadOnlyViolation("Only SELECT (or WITH ... SELECT) queries are allowed.")
    kept = raw
    while kept.rstrip().endswith(";"):
        kept = kept.rstrip()[:-1]
    kept = kept.rstrip()
    _check_plan(spark or SparkSession.active(), kept)
    return kept


def capped(spark: SparkSession, sql: str, row_limit: int = DEFAULT_ROW_LIMIT) -> DataFrame:
    """The guarded query as a lazy frame of at most `row_limit` rows; `run_query` also says whether there were more."""
    if not 1 <= row_limit <= MAX_ROW_LIMIT:
        raise ValueError(f"row_limit must be between 1 and {MAX_ROW_LIMIT}")
    return spark.sql(guard_query(sql, spark)).limit(row_limit)


def run_query(spark: SparkSession, sql: str, row_limit: int = DEFAULT_ROW_LIMIT) -> CappedResult:
    """Run a guarded query; fetches one row past the cap to say whether more were there."""
    if not 1 <= row_limit <= MAX_ROW_LIMIT:
        raise ValueError(f"row_limit must be between 1 and {MAX_ROW_LIMIT}")
    query = guard_query(sql, spark)
    frame = spark.sql(query)
    got = frame.limit(row_limit + 1).collect()
    rows = spark.createDataFrame(got[:row_limit], frame.schema)
    return CappedResult(rows, len(got) > row_limit, query)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables and views a query can read, sorted."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("table_name")).orderBy("table_name")


def describe_table(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """(columns with type and nullability, up to three sample rows) of one registered table."""
    known = [row.table_name for row in list_tables(spark).collect()]
    if name not in known:
        raise ValueError(f"Table {name!r} does not exist. Available tables: {', '.join(known)}")
    table = spark.table(name)
    described = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), not f.nullable) for i, f in enumerate(table.schema.fields)],
        "position int, column_name string, data_type string, not_null boolean",
    )
    return described, table.limit(3)
