"""Documents to a training mix, stage by stage; every stage applies one operator of tallyloom.llm to all it is given."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, discard, settle, settled_into, table
from tallyloom.llm.mixing import copies, mix
from tallyloom.llm.pii_disclosure import disclosures, sanitised
from tallyloom.llm.quality_rules import judge
from tallyloom.llm.shingle_copies import near_copies as linked_copies
from tallyloom.llm.simhash import joined_roots, near_duplicates, surplus_rows
from tallyloom.llm.winnowing import contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Row numbers up to this many are broadcast, 16 bytes each.
FEW_ROWS = 1_000_000
#: Rows with personal data up to this many are broadcast, some hundred bytes each.
FEW_FOUND = 100_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The stage that this thread called last, and the tables below its result.
_before: ContextVar[tuple[str, list[DataFrame]]] = ContextVar("before", default=("", []))


def stage(after: str = "", last: bool = False) -> Callable[[Stage], Stage]:
    """A stage gives back the tables below the result of the stage before, which has been written when it is given to the next.

    Only a stage that follows the named one does so, and only in the thread that called both. What the last stage reads is
    left alone, because its result is the caller's.
    """

    def wrap(fn: Stage) -> Stage:
        @wraps(fn)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            name, tables = _before.get()
            if after and name == after:
                discard(*tables)
            used: list[DataFrame] = []
            with settled_into(used):
                out = fn(spark, docs, sf_dir)
            _before.set(("", []) if last else (fn.__name__, used))
            return out

        return run

    return wrap


def _numbered(docs: DataFrame, label: str) -> DataFrame:
    """Documents with a row number that cannot change, so that rows with one doc_id, or none, stay apart."""
    return settle(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), label)


@stage()
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, and those of hosts that do, go."""
    judged = judge(docs.select(*COLUMNS), host="source", keep=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(*COLUMNS)


@stage(after="quality_rules")
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Copies are linked by SimHash fingerprints at most two bits apart, and by 0.8 of the five-word shingles, which lie further apart.
    """
    rows = _numbered(docs, "stage-rows")
    prints = near_duplicates(rows, row="row")
    linked = settle(joined_roots(linked_copies(rows, shingle=5, share=0.8), prints), "stage-linked")
    gone = broadcast_if_small(settle(surplus_rows(linked), "stage-surplus"), FEW_ROWS)
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


@stage(after="near_copies")
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    rows = _numbered(docs, "stage-rows")
    found = contamination(rows, table(spark, sf_dir, "benchmark"), span=10, gram=5, row="row")
    gone = broadcast_if_small(settle(found.where("contaminated").select("row"), "stage-leaks"), FEW_ROWS)
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


@stage(after="decontaminate")
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and terms that disclose it are generalised or removed."""
    rows = _numbered(docs, "stage-rows")
    found = disclosures(rows, row="row").where("size(spans) > 0 or size(terms) > 0").select("row", "spans", "terms")
    found = broadcast_if_small(settle(found, "stage-found"), FEW_FOUND)
    changed = sanitised(rows.drop("n_chars").join(found, "row")).withColumn("n_chars", F.length("text").cast("long"))
    return rows.join(found.select("row"), "row", "left_anti").select(*COLUMNS).unionByName(changed.select(*COLUMNS))


@stage(after="personal_data", last=True)
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights 3, 1, 2, at most twice each: one row per copy that the mix takes, texts whole."""
    mixed = copies(mix(docs, cycle=(3, 1, 2), share=1.5, max_epochs=2.0, carry=("text", "lang")), whole=True)
    return mixed.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "copy")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: Shingle hashes and the draws need hashes that DuckDB lacks; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result but the last is written, read again by the next stage and then given back."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES[:-1]:
        out = settle(apply(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        docs = written = out
    return STAGES[-1][1](spark, docs, sf_dir)
