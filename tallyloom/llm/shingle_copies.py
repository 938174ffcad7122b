"""Near copies by the Jaccard similarity of word shingle sets: candidates by MinHash, every pair compared in full.

Texts with the same set are one node. Each set has 128 minima, cut into 32 bands of four; sets that share a band are
candidates. Two sets of similarity s share none with probability (1 - s^4)^32: 5e-8 at 0.8, less above. A candidate pair
is linked only if the whole sets reach the share, so no link is wrong. Links are made in two rounds. The first compares
each set of a bucket to the bucket's first row, which ties a large group of copies together by as many pairs as it
has rows. The second compares the pairs of a bucket that the first left in different components, so the components are
those of all candidate pairs. It first counts, for the rows of such buckets, the shingles that any other of them has: rows and sizes that
cannot reach the share are never joined, so a large family of versions that are alike but not alike enough costs what it has rows.

Words are what ASCII white space separates, ASCII capitals small. A text with fewer words than a shingle is one shingle.
Null and empty texts are copies of each other. Repeated rows are separate rows of one component.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordHashes, broadcast_if_small, components, known_words, map_batches, settle, texts_of

BANDS, BAND_ROWS = 32, 4
_BLOCK = 512
_FEW_ROWS = 1_000_000
#: Words of 64 bits that the parities of a set take.
_WORDS = 16
_draw = np.random.default_rng(42)
_FLIPS = _draw.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)
_FACTORS = _draw.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32) | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    keys = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _STEP + keys[i : i + len(out)]
    return np.unique(_mixed(out))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the set's minima."""
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for i in range(0, len(high), _BLOCK):
        np.minimum(least, ((high[i : i + _BLOCK] ^ _FLIPS) * _FACTORS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys * _STEP + column)
    return keys


def with_bands(docs: DataFrame, shingle: int, row: str) -> DataFrame:
    """(row, doc_id, set_id, n, bands) of every row: n distinct shingles; bands are empty without words."""

    def run(batch):
        hashes, sets, sizes, bands = known_words(), [], [], []
        for raw in texts_of(batch.column(2)):
            own = shingle_set(raw, shingle, hashes)
            sets.append(xxhash.xxh64_intdigest(own.tobytes()))
            sizes.append(len(own))
            bands.append(band_keys(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array(np.array(sets, np.uint64).view(np.int64)),
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands))),
        ]
        yield pa.record_batch(columns, ["row", "doc_id", "set_id", "n", "bands"])

    columns = docs.select(F.col(row).cast("long").alias("row"), F.col("doc_id").cast("long"), "text")
    return map_batches(columns, run, "row long, doc_id long, set_id long, n long, bands array<long>")


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, share: float, label: str) -> DataFrame:
    """The pairs (a, b) of row numbers whose whole shingle sets have a Jaccard similarity of `share` or more."""
    pairs = settle(pairs, f"{label}-pairs")
    rows = settle(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), f"{label}-rows")
    held = texts.join(broadcast_if_small(rows, _FEW_ROWS), "row", "left_semi")
    sides = [held.select(F.col("row").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
    both = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")

    def run(batch):
        hashes = known_words()
        sets = lru_cache(64)(lambda raw: shingle_set(raw, shingle, hashes))
        keep = []
        for x, y in zip(texts_of(batch.column(2)), texts_of(batch.column(3))):
            x, y = sets(x), sets(y)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common >= share * (len(x) + len(y) - common) - 1e-9)
        yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def shared_counts(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(row, common, b0, b1, ...): how many shingles of a row's set any other of these rows has, and the parities of those, a bit for each hash value.

    Two rows differ in all shingles that only one of the rows has, and in at least as many more as bits are unlike.
    """

    def run(batch):
        hashes = known_words()
        for row, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            own = shingle_set(raw, shingle, hashes).view(np.int64)
            yield pa.record_batch([pa.array(np.full(len(own), row, np.int64)), pa.array(own)], ["row", "gram"])

    held = texts.join(broadcast_if_small(settle(rows, "copies-rows"), _FEW_ROWS), "row", "left_semi")
    grams = settle(map_batches(held.select("row", "text"), run, "row long, gram long"), "copies-grams")
    several = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("gram")
    bit = F.expr("shiftleft(1L, cast(gram & 63 as int))")
    word = F.expr(f"shiftright(gram, 6) & {_WORDS - 1}")
    parities = [F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0).cast("long")).alias(f"b{i}") for i in range(_WORDS)]
    return grams.join(several, "gram", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("common"), *parities)


def fitting_pairs(placed: DataFrame, share: float) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's rows (key, row, n, root, first, and what shared_counts says) that can reach the share.

    A pair of sets has share / (1 + share) of both sizes in common, or it does not reach the share. So what a row has in common with any
    other bounds the size of its partners, and rows are joined by (bucket, size class) with the classes they may have a partner in: the larger
    one looks for the smaller. Versions of one text with many changes each, which are alike but not enough, have shingles that no other row has,
    and thereby find no class to look in, however many they are. Of the pairs that meet, those go whose bits show that they differ in
    more than (1 - share) / (1 + share) of both sizes. No bound leaves out a pair that reaches the share.
    """
    most = f"common * {(1 + share) / share!r} - n + 1e-6"
    level = "cast(floor(ln({}) / ln(1.02)) as int)"
    sized = placed.withColumn("most", F.expr(most)).where(f"most >= {share} * n - 1e-6")
    homes = sized.select("key", F.expr(level.format("n")).alias("level"), F.col("row").alias("row_b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("root").alias("root_b"), F.col("common").alias("common_b"), *[F.col(f"b{i}").alias(f"c{i}") for i in range(_WORDS)])
    unlike = " + ".join(f"bit_count(b{i} ^ c{i})" for i in range(_WORDS))
    apart = f"(n - common) + (n_b - common_b) + {unlike} <= {(1 - share) / (1 + share)!r} * (n + n_b) + 1e-6"
    # Rounding in the logarithm is met by one class more at either end.
    low, high = level.format(f"greatest({share} * n, 1)"), level.format("greatest(least(n, most), 1)")
    probes = sized.withColumn("level", F.explode(F.expr(f"sequence({low} - 1, {high} + 1)")))
    met = probes.join(homes, ["key", "level"]).where(
        f"n_b <= n and n_b >= {share} * n - 1e-9 and n_b <= most and n <= most_b and root <> root_b and first <> row_b and first <> row and {apart}"
    )
    return met.select(F.greatest("row", "row_b").alias("a"), F.least("row", "row_b").alias("b")).distinct()


def near_copies(docs: DataFrame, shingle: int = 5, share: float = 0.8, row: str = "row") -> DataFrame:
    """(row, doc_id, root) of every row: root is the same for all rows of one component of near copies."""
    fits = f"least(n, n_b) >= {share} * greatest(n, n_b) - 1e-9"
    texts = docs.select(F.col(row).cast("long").alias("row"), "text")
    base = settle(with_bands(docs, shingle, row), "copies-bands")
    sets = settle(base.groupBy("set_id").agg(F.min("row").alias("node")), "copies-sets")
    keys = base.join(sets.select(F.col("node").alias("row")), "row", "left_semi").select("row", "n", F.explode("bands").alias("key"))
    counts = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"), "copies-counts")
    keys = settle(keys.join(counts, "key"), "copies-keys")
    # The row that shares its bands with the most others is a bucket's first: an original rather than one of its many versions.
    weights = keys.groupBy("row").agg(F.sum("_rows").alias("weight"))
    first = F.max_by(F.struct("row", "n"), F.struct("weight", -F.col("row")))
    buckets = keys.join(weights, "row").groupBy("key").agg(first.alias("first"))
    buckets = buckets.select("key", F.col("first.row").alias("b"), F.col("first.n").alias("n_b"))
    shared = settle(keys.drop("_rows").join(buckets, "key"), "copies-buckets")

    stars = shared.where(f"row <> b and {fits}").select(F.col("row").alias("a"), "b").distinct()
    linked = settle(alike(stars, texts, shingle, share, "copies-stars"), "copies-starred")
    roots = components(linked, "copies-first")

    node = F.col("node")
    placed = shared.join(roots, shared.row == node, "left").select("key", "row", "n", F.col("b").alias("first"), F.coalesce("root", "row").alias("root"))
    # The component of a bucket's first row is tied already: pairs have at least one row outside of it.
    tops = roots.select(F.col("node").alias("first"), F.col("root").alias("top"))
    placed = settle(placed.join(tops, "first", "left").withColumn("top", F.coalesce("top", "first")), "copies-placed")
    tied = placed.groupBy("key").agg((F.min("root") == F.max("root")).alias("tied"))
    mixed = settle(placed.join(tied.where("not tied").select("key"), "key", "left_semi"), "copies-mixed")
    known = settle(shared_counts(mixed.select("row").distinct(), texts, shingle), "copies-shared")
    pairs = settle(fitting_pairs(mixed.join(known, "row"), share), "copies-fitting")
    more = alike(pairs, texts, shingle, share, "copies-rest")
    tree = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(tree.unionByName(more), "copies-all")

    named = sets.join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("root"))
    return base.join(named, "set_id").select("row", "doc_id", "root")
