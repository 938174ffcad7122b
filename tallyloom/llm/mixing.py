"""Mixing sources to target weights by capped water-filling.

Each source is to give a share of the mix in proportion to its weight, but no document more than `max_epochs`
times. Sources that would exceed this are clamped at it and their excess is shared out again by weight, until no
source is above its cap. Every document of a source is then taken a whole number of times, and a seeded draw takes
some of them once more, so that the words taken meet the source's target to the word: documents in the order of a
seeded hash are taken whole until the target is reached, the last of them in part.

Only the sizes of texts are moved. The filling works on one row per source and passes two numbers to the driver
each round. Draws are made by (source, slice of the hash), 65,536 slices a source, so a source that holds a third of
all documents is spread over many tasks and a slice is never summed as a whole with others.

Null and empty texts have size 0 and give nothing. A null source is a source of its own. A source without a weight
row, or with a weight of 0, gives nothing. Repeated rows are documents each. Other columns may be carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import settle
from tallyloom.operators.numbering import ordered_positions

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 16


def cyclic_weights(sources: DataFrame, cycle: list[int]) -> DataFrame:
    """(source, weight): weights repeat along the sources in code point order, null last."""
    placed = ordered_positions(sources.select("source").distinct(), [F.col("source").asc_nulls_last()], "_place", start=0)
    weights = F.array(*[F.lit(w) for w in cycle])
    return placed.select("source", F.get(weights, (F.col("_place") % len(cycle)).cast("int")).cast("double").alias("weight"))


def water_fill(sources: DataFrame, total: Column, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size, weight); targets add up to `total` if the caps allow."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    sources = settle(sources, "mix-sources")
    first = sources.agg(total.cast("double").alias("total"), F.sum("weight").alias("weight")).first()
    level, clamped = ((first.total or 0.0) / first.weight if first.weight else 0.0), -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        now = sources.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if now.n == clamped or now.n == 0 or now.weight == 0:
            break
        level, clamped = (first.total - now.held) / now.weight, now.n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    cycle: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, extra, taken) and the carried columns of every row.

    A row is taken `repeats` times whole, and `extra` of its words once more; `taken` is the words in all.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("_draw"),
        *[F.col(c) for c in carry if c not in ("doc_id", "source")],
    )
    sized = settle(sized.withColumn("_slice", F.expr(f"shiftrightunsigned(_draw, {64 - SLICES})")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = weights if weights is not None else cyclic_weights(totals, list(cycle))
    both = totals.join(weights.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left").select(
        "source", "source_size", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight")
    )
    filled = water_fill(both, F.sum("source_size") * F.lit(float(share)), max_epochs)
    epochs = F.floor(F.col("target") / F.col("source_size"))
    filled = filled.withColumn("repeats", F.when(F.col("source_size") > 0, epochs).otherwise(0).cast("long"))
    rest = F.round("target").cast("long") - F.col("repeats") * F.col("source_size")
    filled = settle(filled.withColumn("_rest", F.greatest(rest, F.lit(0))).withColumnRenamed("source", "_of"), "mix-targets")

    slices = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_slice_size"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_slice_size").over(earlier), F.lit(0)))
    slices = slices.join(filled, F.col("source").eqNullSafe(F.col("_of"))).select(
        F.col("source").alias("_of"),
        F.col("_slice").alias("_of_slice"),
        "source_size",
        "target",
        "repeats",
        F.greatest(F.least(F.col("_rest") - F.col("_before"), "_slice_size"), F.lit(0)).alias("_left"),
    )
    joined = sized.join(slices, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_of_slice")))
    within = Window.partitionBy("source", "_slice").orderBy("_draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = F.greatest(F.least(F.col("_left") - ahead, "size"), F.lit(0))
    return joined.withColumn("extra", extra).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "repeats",
        "extra",
        (F.col("repeats") * F.col("size") + F.col("extra")).alias("taken"),
        *[c for c in carry if c not in ("doc_id", "source")],
    )


def copies(mixed: DataFrame, whole: bool = False) -> DataFrame:
    """One row per repetition, with `copy` from 1 on; a repetition taken in part keeps the first words of the text.

    With `whole` texts are never cut: a repetition taken in part is given whole if at least half of its words are due,
    and else left out, so a source is off its target by less than one document.
    """
    due = F.col("extra") * 2 >= F.col("size") if whole else F.col("extra") > 0
    times = F.col("repeats") + due.cast("long")
    rows = mixed.where("size > 0").select("*", F.explode(F.expr("sequence(1L, 1L + repeats)")).alias("copy")).where(F.col("copy") <= times)
    if whole:
        return rows
    part = (F.col("copy") > F.col("repeats")) & (F.col("extra") < F.col("size"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int"))
    return rows.withColumn("text", F.when(part, F.array_join(words, " ")).otherwise(F.col("text")))
