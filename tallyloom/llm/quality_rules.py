"""Document rules and a verdict on hosts whose documents fail them.

Rules judge each text by itself. For every rule the failures are counted by host; a host's rate is shrunk
towards all hosts' mean by a beta prior whose mean and weight are fitted to the spread of the host rates
(method of moments). A host whose shrunk rate exceeds a limit loses all its documents, so a host with few
documents is not condemned by a few failures and one with many is not saved by the mean.

Everything is built-in expressions. Three-word windows are compared inside a row (sorted hashes, n log n in the
words of one text). Counting by host combines on the map side; hosts meet documents by an equi-join, whose small
side Spark broadcasts if it measures it as small and otherwise splits where it is skewed.

Null texts have no words, so they fail the length rule. A null host is a host of its own. Repeated rows count
each. Columns other than doc_id, text and the host are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import settle

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Rules on the counts of measures(), each true where a document fails.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
}
BASE = ("short", "repeats")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the counts that the rules use."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(*keep, text.alias("_text")).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    out = out.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
        F.expr(
            "transform(slice(_words, 1, greatest(size(_words) - 2, 0)),"
            " (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2)))"
        ).alias("_windows"),
    )
    # Windows with their places, in order of their hashes: repeated ones lie side by side.
    out = out.withColumn(
        "_sorted",
        F.expr(
            "case when size(array_distinct(_windows)) < size(_windows)"
            " then sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))) end"
        ),
    )
    out = out.withColumn(
        "_places",
        F.expr(
            "sort_array(transform(filter(_sorted, (x, k) ->"
            " coalesce(get(_sorted, k - 1).h = x.h, false) or coalesce(get(_sorted, k + 1).h = x.h, false)), x -> x.i))"
        ),
    )
    covered = "aggregate(transform(_places, (p, k) -> least(3, coalesce(get(_places, k + 1) - p, 3))), 0L, (a, x) -> a + x)"
    return out.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_rates(judged: DataFrame, rules: dict[str, str], host: str = "host") -> DataFrame:
    """(host, n, one shrunk failure rate for each rule)."""
    failures = judged.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(r).cast("long")).alias(f"f_{k}") for k, r in rules.items()]
    )
    failures = settle(failures, "host-failures")
    # One row: each rule's overall mean, and the spread of host rates beyond what chance alone would give.
    totals = failures.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"f_{k}").alias(f"m_{k}") for k in rules],
        *[F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / F.col("n")).alias(f"s_{k}") for k in rules],
    ).first()
    out = failures
    for k in rules:
        mean, weight = _beta_prior(totals.n, totals.hosts, totals[f"m_{k}"] or 0, totals[f"s_{k}"] or 0.0)
        rate = (F.col(f"f_{k}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        out = out.withColumn(f"rate_{k}", rate)
    return out.select(host, "n", *[f"rate_{k}" for k in rules])


def _beta_prior(n: int, hosts: int, failed: int, squares: float) -> tuple[float, float]:
    """Mean and weight (alpha + beta) of the prior: variance between hosts is what exceeds binomial variance."""
    if n == 0:
        return 0.0, 1.0
    mean = failed / n
    spread = squares / n - mean * mean
    chance = mean * (1 - mean) * hosts / n
    between = spread - chance
    if between <= 0 or mean in (0.0, 1.0):
        return mean, 1000.0
    return mean, min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0)


def judge(
    docs: DataFrame,
    host: str = "source",
    rules: dict[str, str] | None = None,
    base: tuple[str, ...] = BASE,
    limit: float = 0.5,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The measures of every row with base_failed, host_rejected and kept.

    A row fails if it breaks a rule of `base`, or if its host's shrunk rate of any rule exceeds `limit`.
    """
    rules = rules or RULES
    columns = ["doc_id", *keep]
    judged = settle(measures(docs.withColumn("_host", F.col(host).cast("string")), *columns, "_host"), "quality-measures")
    rates = host_rates(judged, rules, "_host")
    bad = rates.where(" or ".join(f"rate_{k} > {limit}" for k in rules)).select(
        F.col("_host").alias("_bad_host"), F.lit(True).alias("_bad")
    )
    joined = judged.join(bad, judged["_host"].eqNullSafe(bad["_bad_host"]), "left")
    failed = F.expr(" or ".join(f"({rules[k]})" for k in base))
    rejected = F.coalesce("_bad", F.lit(False))
    return joined.select(
        *columns,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        rejected.alias("host_rejected"),
        (~failed & ~rejected).alias("kept"),
    )
