"""SimHash fingerprints and their links by multi-index hashing.

Links join fingerprints that differ in at most two bits. Each fingerprint is cut into two segments of 32 bits, and each
segment has a table of the fingerprints by its value. Of two fingerprints within two bits one segment differs in one bit at
most, so every fingerprint looks up its own segment values and those one bit away, and whole distances are compared.
A value that many fingerprints share would give all of their pairs. Its fingerprints are looked up a second time by the
value and the rest of the bits together: such an entry holds 65 fingerprints at most, tied to their smallest.
No entry has a cap and no pair is lost.

Null and empty texts have fingerprint zero, which is linked like any other. Repeated rows stay separate rows
of one component. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, components, map_batches, settle, texts_of

SEED = 42
_BLOCK = 1 << 14
#: Segments of a fingerprint and their bits.
SEGMENTS = 2
_WIDTH = 64 // SEGMENTS
#: A segment value of more fingerprints is looked up with the rest of the bits; so many such values are broadcast at most.
HOT, HOT_ROWS = 32, 200_000


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; zero without words."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def with_fingerprints(docs: DataFrame, shingle: int = 3, row: str | None = None) -> DataFrame:
    """(row, doc_id, fp): the fingerprint of every whole text as a signed long; row is null unless a column is named."""

    def run(batch):
        prints = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(2))], np.uint64)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["row", "doc_id", "fp"])

    number = F.col(row) if row else F.lit(None)
    columns = docs.select(number.cast("long").alias("row"), F.col("doc_id").cast("long"), "text")
    return map_batches(columns, run, "row long, doc_id long, fp long")


def _segment(fp: str, number: str) -> Column:
    """A segment's number and value in one long."""
    return F.expr(f"shiftright({fp}, {number} * {_WIDTH}) & {(1 << _WIDTH) - 1}L | shiftleft(CAST({number} AS long), {_WIDTH})")


def _own_keys(fingerprints: DataFrame) -> DataFrame:
    """(fp, number, key): the segment tables, a row for each segment of each fingerprint."""
    cut = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("number"))
    return cut.select("fp", "number", _segment("fp", "number").alias("key"))


def _ball_keys(fingerprints: DataFrame) -> DataFrame:
    """(fp, number, key, place): what clearing one set bit of a segment makes of the segment and of the whole fingerprint.

    Of two segments one bit apart just one has that bit set, so half of the ball finds every pair once.
    """
    bits = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where("shiftright(fp, bit) & 1 = 1")
    cleared = bits.select("fp", F.expr(f"bit div {_WIDTH}").cast("int").alias("number"), F.expr("fp ^ shiftleft(1L, bit)").alias("place"))
    return cleared.select("fp", "number", _segment("place", "number").alias("key"), "place")


def links(fingerprints: DataFrame, max_distance: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of fingerprints within `max_distance` bits that connect whatever such pairs connect.

    `fingerprints` has one row per value. Pairs that meet at values of at most `hot` fingerprints are all written; the
    entries of a hot value are tied to their smallest member. For `max_distance` 1 all pairs are written.
    """
    if max_distance not in (1, 2):
        raise ValueError("max_distance must be 1 or 2")
    own = _own_keys(fingerprints)
    crowded = settle(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "simhash-hot")
    crowded = broadcast_if_small(crowded, HOT_ROWS)
    looked_up = own.select("fp", "key")
    if max_distance >= SEGMENTS:
        looked_up = looked_up.unionByName(_ball_keys(fingerprints).select("fp", "key"))
    stored = own.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("b"))
    met = looked_up.withColumnRenamed("fp", "a").join(stored, "key").where(f"a <> b and bit_count(a ^ b) <= {max_distance}")
    ends = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return met.select(*ends).unionByName(_hot_links(fingerprints, own, crowded, max_distance).select(*ends)).distinct()


def _hot_links(fingerprints: DataFrame, own: DataFrame, crowded: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): links of the fingerprints that meet at a hot segment value, by a second look-up in the rest of the fingerprint.

    An entry is a hot value with one value of the other bits. Its members hold the value and differ from the rest in one
    bit at most, or hold exactly the rest and differ from the value in one bit: 65 at the very most.
    """
    held = own.join(crowded, "key", "left_semi")
    others = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    turned = held.select("fp", "number", others).where(f"bit div {_WIDTH} <> number")
    turned = turned.select("fp", "number", F.expr("fp ^ shiftleft(1L, bit)").alias("place"))
    exact = held.select("fp", "number", F.col("fp").alias("place"))
    if max_distance == 1:
        found = turned.withColumnRenamed("fp", "a").join(exact.withColumnRenamed("fp", "b"), ["number", "place"])
        return found.where("bit_count(a ^ b) <= 1").select("a", "b")
    beside = _ball_keys(fingerprints).join(crowded, "key", "left_semi").select("fp", "number", "place", F.lit(False).alias("holds"))
    members = turned.unionByName(exact).withColumn("holds", F.lit(True)).unionByName(beside)
    least = F.min(F.when(F.col("holds"), F.col("fp"))).over(Window.partitionBy("number", "place"))
    tied = members.withColumn("least", least).where(f"fp <> least and bit_count(fp ^ least) <= {max_distance}")
    return tied.select(F.col("fp").alias("a"), F.col("least").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, row: str | None = None) -> DataFrame:
    """(row, doc_id, fp, root, component_id) of every row.

    `root` names the component by its smallest fingerprint, component_id is the smallest doc_id in it. `row` is
    passed on from the column so named.
    """
    prints = settle(with_fingerprints(docs, shingle, row), "simhash-prints")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(values.select("fp"), max_distance), "simhash-links")
    rooted = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = rooted.join(firsts, "root").select("fp", "root", "component_id")
    return prints.join(labelled, "fp").select("row", "doc_id", "fp", "root", "component_id")


def joined_roots(linked: DataFrame, prints: DataFrame) -> DataFrame:
    """(row, doc_id, root) of every row of `linked`, with the components joined that `prints` (row, root) ties together.

    Both have each row once. A component of `prints` ties the roots of its rows to the smallest of them.
    """
    held = settle(linked.join(prints.select("row", F.col("root").alias("print")), "row"), "copies-joined")
    least = held.groupBy("print").agg(F.min("root").alias("b"))
    edges = held.select("print", F.col("root").alias("a")).distinct().join(least, "print").where("a <> b").select("a", "b")
    roots = components(edges, "copies-united").withColumnRenamed("root", "top")
    united = held.join(roots, held.root == F.col("node"), "left")
    return united.select("row", "doc_id", F.coalesce("top", held.root).alias("root"))


def surplus_rows(linked: DataFrame) -> DataFrame:
    """(row) of every row but one of each component; the one with the smallest doc_id stays, rows without one last."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = linked.groupBy("root").agg(F.min(place).alias("first")).select("first.row")
    return linked.select("row").join(firsts, "row", "left_anti")
