"""What each of five filters removes in every order of applying them: an audit by recursive enumeration.

The filters, by letter; a document fails A if it has fewer than `min_words` words, B if fewer than half of its words are distinct, C if
over 3 % of its code points are A-Z, D if it holds any of #$%&*|, E if its text is the text of a document with a smaller doc_id,
wherever in the table that is and whether or not a filter removes it.

Mask cells. Which filters a document fails is a mask of five bits. All that the audit counts depends on the mask, so documents are
counted by part (the lang value, null as the empty string) and mask: at most 32 cells a part, combined on the map side.

Recursion. A recursive CTE starts at each part's empty prefix and extends a prefix by every letter it does not hold. A row carries the
bits applied so far; a level joins the cells of the part and states its step's figures from cells, bits and the new letter: 325
rows a part, whatever the size of the table. An order's five rows are those of its five prefixes.

Copies. Texts are told apart by SHA-256. Rows are counted by (text, part, labels) before they meet, so a text that a third of
all rows hold is a few rows; the smallest doc_id of a text is then a window over those.

Null and empty texts have no words: they fail A, and E if a smaller doc_id has one. A row without doc_id never fails E and is no
smaller row for another. Repeated rows count each; those with the smallest doc_id of their text all pass E. A document is good or
toxic if any label of its doc_id says 1. Other columns are ignored. An empty table has no parts and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import settle
from tallyloom.llm.periodic_runs import word_array

LETTERS = "ABCDE"
#: Rows of the recursion for one part: the prefixes of five letters, the empty one included.
PREFIXES = 326
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column, min_words: int = 200) -> Column:
    """Bits of A to D, from the lowest. The text must not be null."""
    worded = text.rlike("[^ \t-\r]")
    words = F.when(worded, word_array(text)).otherwise(F.array().cast("array<string>"))
    few = F.size(words) < min_words
    alike = 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    loud = 100 * capitals.cast("long") > 3 * F.length(text)
    marked = text.rlike("[#$%&*|]")
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate((few, alike, loud, marked))]
    return sum(bits[1:], bits[0])


def mask_cells(docs: DataFrame, labels: DataFrame, min_words: int = 200) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail, and how many are labelled good and toxic."""
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = text.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), text_failures(F.col("text"), min_words).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n")).join(marks, "doc_id", "left")
    kind = ["part", "same", "mask", "good", "toxic"]
    rows = rows.select("doc_id", "n", "part", "same", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # `first` of the `n` rows have the least doc_id of their kind; those without doc_id pass.
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    kinds = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), nameless.alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("first")
    )
    least = F.min("least").over(Window.partitionBy("same"))
    passed = F.col("nameless") + F.when(F.col("least") == F.col("of_text"), F.col("first")).otherwise(0)
    kinds = kinds.withColumn("of_text", least).withColumn("passed", passed)
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("passed").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))
    cells = kinds.select("part", "good", "toxic", both.alias("cell")).select("part", "good", "toxic", "cell.mask", "cell.n")
    return (
        cells.where("n > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


def _total(what: str, where: str) -> str:
    return f"coalesce(aggregate(filter(c.cells, x -> {where}), 0L, (sum, x) -> sum + x.{what}), 0L)"


#: A cell fails the new letter if it has its bit, and is still there if it has none of the bits applied before.
_FAILS, _THERE = "x.mask & s.l.bit <> 0", "x.mask & s.bits = 0"

STEPS = f"""
WITH RECURSIVE steps (part, filter_order, bits, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) MAX RECURSION LEVEL 8 AS (
    SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
    UNION ALL
    SELECT s.part, concat(s.filter_order, s.l.letter), s.bits | s.l.bit, s.step + 1, s.l.letter,
        {_total("n", f"{_THERE} AND x.mask & s.l.bit = 0")},
        {_total("n", f"{_THERE} AND {_FAILS}")},
        {_total("n", f"NOT ({_THERE}) AND {_FAILS}")},
        {_total("n", "x.mask = s.l.bit")},
        {_total("good", f"{_THERE} AND {_FAILS}")},
        {_total("toxic", f"{_THERE} AND {_FAILS}")}
    FROM (
        SELECT part, filter_order, bits, step,
            explode(filter({{letters}}, x -> NOT contains(filter_order, x.letter))) AS l
        FROM steps WHERE step < {len(LETTERS)}
    ) s JOIN {{cells}} c ON c.part = s.part
)
SELECT * FROM steps WHERE step > 0
"""


def steps_of(cells: DataFrame) -> DataFrame:
    """(part, filter_order, bits, step, letter, ...) of every prefix of letters, by the recursive CTE; cells as of mask_cells."""
    spark = cells.sparkSession
    packed = settle(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "audit-cells")
    needed = (packed.count() + 1) * PREFIXES
    if 0 <= int(spark.conf.get(_ROW_LIMIT)) < needed:
        spark.conf.set(_ROW_LIMIT, needed)
    letters = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(LETTERS))
    return spark.sql(STEPS.replace("{letters}", f"array({letters})"), cells=packed)


def audit(docs: DataFrame, labels: DataFrame, min_words: int = 200) -> DataFrame:
    """One row per part, order of the five letters and step (1 to 5; its filter is that letter of `filter_order`).

    kept: documents left after the step; removed: here; redundant: failing its filter, removed earlier; unique_fails: failing its filter
    alone; good_lost, toxic_lost: removed here and labelled so; shapley: removed by this filter, summed over all orders.
    """
    steps = settle(steps_of(mask_cells(docs, labels, min_words)), "audit-steps")
    # A prefix of k letters begins (5 - k)! orders.
    orders = F.expr(f"cast(factorial({len(LETTERS)} - step) as long)")
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("filter_order").alias("whole"))
    taken = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS))))).withColumn(
        "filter_order", F.expr("left(whole, step)")
    )
    out = taken.join(steps, ["part", "step", "filter_order"]).join(shapley, ["part", "letter"])
    return out.select("part", F.col("whole").alias("filter_order"), "step", *_MEASURES, "shapley")
