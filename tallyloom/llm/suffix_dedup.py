"""Removal of repeated byte strings by distributed prefix doubling over a sparse suffix array.

A byte goes if a string of `length` bytes that covers it also starts at another place, in the same text or
another. Sorting every suffix of the corpus would move many times the input, so the suffixes that are sorted
start at sampled positions which depend on the surrounding bytes alone: winnowing keeps the positions whose
hashed gram is least in some window of `w` positions. Equal strings of `length` bytes therefore hold the same
sampled positions, but for `w` bytes at either end, and at least `phrases + 1` of them.

Doubling. Between neighbouring positions lies a phrase; its hash is the first rank of the position it starts
at. Each round pairs a position's rank with the rank at a growing offset (1, 2, 4, ... phrases on), lets Spark
bring equal pairs together, gives them one new rank, and drops positions whose pair occurs once. A rank is a 64-bit hash of
its pair and not a place in the sorted order, which nothing here needs: ranks are only compared for equality, and what
they let through is compared by its bytes. The rounds end when the ranks cover all the phrases that a repeated string must hold.

Bytes. A string that starts at p is judged at the first sampled position at p + w - 1 or later. All strings
judged at one position share its core bytes; each is its core with some bytes to the left and the rest to the
right. Cores that occur once are dropped. Positions of equal core and equal edges form a class; if there are
two of them all their strings repeat. Where a core has several classes, each class writes its strings out once
and those that two classes share repeat. Cores are compared by a 64-bit hash, what lies around them by its bytes or
their 128-bit hash.

Skew: ranks of a passage that a third of all texts hold are a few of the many ranks of those texts, and
windows over them only look at their two ends. Copies of one text count once. No group is gathered; the
arrays collected for a text are no longer than the text.

Null and empty texts have no bytes. A text shorter than `length` keeps all its bytes. Repeated rows count as
copies. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Bloom, bloom_of, discard, map_batches, settle, texts_of

#: Bytes of text that are worked on at once inside a task.
_BLOCK = 1 << 21


class Sampling:
    """Gram length, window and guaranteed phrases for strings of `length` bytes."""

    def __init__(self, length: int):
        if length < 24:
            raise ValueError("length must be 24 or more")
        self.length = length
        self.gram = 8 if length >= 64 else 4
        # First sampled position within w of p + w - 1, then `phrases` steps of at most w, all w from the end.
        self.phrases = 3
        self.w = min(64, 1 << int(np.log2((length - self.gram + 3) // (self.phrases + 3))))
        while (self.phrases + 4) * self.w <= length - self.gram + 3:
            self.phrases += 1

    @property
    def core(self) -> tuple[int, int]:
        """Start and end, from a sampled position, of the bytes that all strings judged there hold."""
        return -(self.w - 1), self.length - 2 * (self.w - 1)


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over windows of w (a power of two) items that start at each item."""
    step = 1
    while step < w:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    x = (b.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    step = 1
    while step < gram:
        x = x[:-step] * np.uint32(2246822519 + 2 * step) + x[step:]
        x ^= x >> np.uint32(15)
        step *= 2
    x *= np.uint32(3266489917)
    x ^= x >> np.uint32(16)
    return x


def sampled_positions(block: np.ndarray, bounds: np.ndarray, s: Sampling) -> np.ndarray:
    """Sampled positions of the texts that lie side by side in a block; text i is block[bounds[i]:bounds[i+1]]."""
    n = len(block)
    if n < s.gram + s.w:
        return np.zeros(0, np.int64)
    h = _gram_hashes(block, s.gram)
    h |= np.uint32(1)  # zero marks windows that cross texts
    least = _slide(h, s.w, np.minimum)
    # A window is a text's own if it starts in it and its last gram ends in it.
    crosses = np.zeros(len(least) + 1, np.int32)
    reach = s.w + s.gram - 1
    starts = np.maximum(bounds[1:] - reach + 1, bounds[:-1])
    np.add.at(crosses, np.minimum(starts, len(least)), 1)
    np.add.at(crosses, np.minimum(bounds[1:], len(least)), -1)
    least[np.cumsum(crosses[:-1]) > 0] = 0
    padded = np.concatenate([np.zeros(s.w - 1, np.uint32), least, np.zeros(s.w - 1, np.uint32)])
    most = _slide(padded, s.w, np.maximum)
    return np.flatnonzero(most[: len(h)] == h)


def _blocks(texts: list[bytes]):
    """(index of the first text, texts) of about _BLOCK bytes."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= _BLOCK:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _positions(texts: list[bytes], s: Sampling) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, their bounds, all sampled positions, and where each text's positions begin among them."""
    joined = b"".join(texts)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    places = sampled_positions(np.frombuffer(joined, np.uint8), bounds, s)
    return joined, bounds, places, np.searchsorted(places, bounds)


def with_phrases(docs: DataFrame, s: Sampling) -> DataFrame:
    """(doc_id, th, id, n_bytes, sha256, phrases): hashes of a text, and of its phrases in order."""

    def run(batch):
        ids, texts = batch.column(0), texts_of(batch.column(1))
        digest = xxhash.xxh3_64_intdigest
        for first, group in _blocks(texts):
            joined, _, places, cuts = _positions(group, s)
            at = places.tolist()
            hashes = np.fromiter((digest(joined[i:j]) for i, j in zip(at, at[1:])), np.uint64, max(len(at) - 1, 0))
            # The last position of a text starts no phrase.
            lasts = cuts[1:] - 1
            keep = np.ones(len(at), bool)
            keep[lasts[cuts[1:] > cuts[:-1]]] = False
            phrases = np.append(hashes, np.uint64(0))[: len(at)][keep].view(np.int64)
            counts = np.maximum(cuts[1:] - cuts[:-1] - 1, 0)
            th = [hashlib.md5(x).digest() for x in group]
            yield pa.record_batch(
                [
                    ids.slice(first, len(group)),
                    pa.array(th, pa.binary()),
                    pa.array([int.from_bytes(x[:8], "little", signed=True) for x in th], pa.int64()),
                    pa.array([len(x) for x in group], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in group]),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(phrases)
                    ),
                ],
                ["doc_id", "th", "id", "n_bytes", "sha256", "phrases"],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, th binary, id long, n_bytes long, sha256 string, phrases array<long>",
    )


def _repeated(ranked: DataFrame) -> DataFrame:
    """Positions whose rank occurs at two places or more; places are told apart on the map side."""
    place = F.struct("id", "idx")
    several = ranked.groupBy("rank").agg((F.min(place) != F.max(place)).alias("repeats")).where("repeats").select("rank")
    return ranked.join(several, "rank", "left_semi")


def across_texts(ranked: DataFrame, phrases: int, longer: int) -> DataFrame:
    """(id, idx) of the positions from which `longer` phrases repeat in another text, from the ranks that cover `phrases`."""
    ahead = Window.partitionBy("id").orderBy("idx")
    offset = longer - phrases
    paired = ranked.withColumns({"next": F.lead("rank", offset).over(ahead), "next_idx": F.lead("idx", offset).over(ahead)})
    paired = paired.where(F.col("next_idx") == F.col("idx") + offset).select("id", "idx", F.xxhash64("rank", "next").alias("rank"))
    shared = paired.groupBy("rank").agg((F.min("id") != F.max("id")).alias("across")).where("across").select("rank")
    return paired.join(shared, "rank", "left_semi").select("id", "idx")


def repeated_positions(hashed: DataFrame, phrases: int) -> DataFrame:
    """(id, idx) of the sampled positions from which a run of `phrases` phrases repeats: the doubling rounds."""
    ranked = hashed.select("id", F.posexplode("phrases").alias("idx", "rank"))
    ranked = settle(_repeated(ranked).dropDuplicates(["id", "idx"]), "suffix-ranks")
    covered = 1
    while covered < phrases:
        offset = min(covered, phrases - covered)
        ahead = Window.partitionBy("id").orderBy("idx")
        paired = ranked.withColumn("next", F.lead("rank", offset).over(ahead)).withColumn(
            "next_idx", F.lead("idx", offset).over(ahead)
        )
        # What lies between repeats too if the whole run does.
        paired = paired.where(F.col("next_idx") == F.col("idx") + offset)
        before = ranked
        ranked = settle(_repeated(paired.select("id", "idx", F.xxhash64("rank", "next").alias("rank"))), "suffix-ranks")
        discard(before)
        covered += offset
    return ranked


def _texts_with(docs: DataFrame, wanted: DataFrame, bloom: Bloom) -> DataFrame:
    """(id, th, text) of rows whose (id, doc_id) may be in `wanted`."""

    def run(batch):
        raw = texts_of(batch.column(1))
        th = [hashlib.md5(x).digest() for x in raw]
        ids = np.array([int.from_bytes(x[:8], "little", signed=True) for x in th], np.int64)
        keep = np.flatnonzero(bloom.hits(_row_key(ids, batch.column(0)))).tolist()
        yield pa.record_batch(
            [pa.array(ids[keep]), pa.array([th[i] for i in keep], pa.binary()), pa.array([raw[i] for i in keep], pa.binary())],
            ["id", "th", "text"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "id long, th binary, text binary")


def _row_key(ids: np.ndarray, doc_ids: pa.Array) -> np.ndarray:
    """The key of _row_key_column, in numpy."""
    d = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return ids.view(np.uint64) ^ (d * np.uint64(0x9E3779B97F4A7C15))


def _wanted(hashed: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, key) of one row of every text with positions."""
    first = hashed.groupBy("id").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc"))
    wanted = positions.select("id").distinct().join(first, "id")

    def run(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.record_batch([batch.column(0), pa.array(_row_key(ids, batch.column(1)).view(np.int64))], ["id", "key"])

    return map_batches(wanted.select("id", "doc"), run, "id long, key long")


def _edges_of(texts: DataFrame, s: Sampling) -> DataFrame:
    """(tid, at, core, left, right, low, high): the strings judged at each position, in bytes around its core.

    A string with `d` bytes to the left of the core has w - 1 - d bytes to the right of it; `low` and `high`
    bound d for the strings that lie in the text.
    """
    w, (a, b) = s.w, s.core

    def run(batch):
        tids, idxs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))
        out: list[tuple] = []
        digest = xxhash.xxh3_64_intdigest
        for first, group in _blocks(texts):
            _, bounds, places, cuts = _positions(group, s)
            for k, text in enumerate(group):
                own = (places[cuts[k] : cuts[k + 1]] - bounds[k]).tolist()
                n, tid = len(text), tids[first + k]
                for i in sorted(set(idxs[first + k])):
                    if i >= len(own):
                        continue
                    at = own[i]
                    high = min((at - own[i - 1] if i else at + 1) - 1, w - 1, at - (w - 1))
                    low = max(0, at - (w - 1) - (n - s.length))
                    if low > high:
                        continue
                    out.append((tid, at, digest(text[at + a : at + b]) - (1 << 63), text[at + a - high : at + a], text[at + b : at + b + w - 1 - low], low, high))
        for i in range(0, len(out), 50_000):
            cols = list(zip(*out[i : i + 50_000]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(cols, kinds)], ["tid", "at", "core", "left", "right", "low", "high"]
            )

    return map_batches(
        texts.select("tid", "idxs", "text"),
        run,
        "tid long, at int, core long, left binary, right binary, low int, high int",
    )


def _masks(edges: DataFrame, w: int) -> tuple[DataFrame, list[DataFrame]]:
    """(tid, at, mask): bit d of the mask is set if the string with d bytes left of the core repeats; the settled tables below."""
    place = F.xxhash64("tid", "at")
    same = Window.partitionBy("core")
    edges = edges.withColumn("class", F.xxhash64("core", "low", "high", "left", "right"))
    edges = settle(
        edges.withColumn("repeats", F.min(place).over(same) != F.max(place).over(same)).where("repeats").drop("repeats"),
        "suffix-edges",
    )
    classes = edges.groupBy("core", "class").agg(
        (F.min(place) != F.max(place)).alias("twice"),
        *[F.min(c).alias(c) for c in ("left", "right", "low", "high")],
    )
    several = F.min("class").over(same) != F.max("class").over(same)
    classes = settle(classes.withColumn("several", several), "suffix-classes")
    # Bits low..high, without shifting by 64.
    whole = F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (high - low)), low)")
    full = classes.where("twice").select("core", "class", whole.alias("mask"))
    strings = classes.where("several").select(
        "core", "class", "twice", "left", "right", F.explode(F.sequence("low", "high")).alias("d")
    )
    # The bytes around the core name the string, and the core tells it from others.
    around = F.concat(F.expr("substring(left, length(left) - d + 1, d)"), F.expr(f"substring(right, 1, {w - 1} - d)"))
    strings = strings.select("core", "class", "twice", "d", F.unhex(F.md5(around)).alias("around"))
    alike = Window.partitionBy("core", "d", "around")
    shared = (
        strings.withColumn("shared", F.min("class").over(alike) != F.max("class").over(alike))
        .where("shared and not twice")
        .groupBy("core", "class")
        .agg(F.bit_or(F.expr("shiftleft(1L, d)")).alias("mask"))
    )
    masks = edges.select("tid", "at", "core", "class").join(full.unionByName(shared), ["core", "class"]).select("tid", "at", "mask")
    return masks, [edges, classes]


def _shared_bytes(texts: DataFrame, s: Sampling, phrases: int) -> DataFrame:
    """(th, n_shared) of texts with `shared`: bytes from a sampled position in it to the one `phrases` further on."""

    def run(batch):
        rows = []
        for th, text, shared in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
            _, _, places, _ = _positions([text], s)
            turn = np.zeros(len(text) + 1, np.int32)
            start = np.array([i for i in set(shared) if i + phrases < len(places)], np.int64)
            np.add.at(turn, places[start], 1)
            np.add.at(turn, places[start + phrases], -1)
            rows.append((th, int((np.cumsum(turn) > 0).sum())))
        th, n = zip(*rows)
        yield pa.record_batch([pa.array(th, pa.binary()), pa.array(n, pa.int64())], ["th", "n_shared"])

    return map_batches(texts.select("th", "text", "shared"), run, "th binary, n_shared long")


def _cut(texts: DataFrame, s: Sampling) -> DataFrame:
    """(th, n_removed, n_spans, kept_sha256, spans) of texts with their masks."""
    w, bits = s.w, np.arange(s.w, dtype=np.uint64)

    def run(batch):
        rows = []
        for th, text, hits in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
            n = len(text)
            turn = np.zeros(n + 1, np.int32)
            at = np.array([x["at"] for x in hits], np.int64)
            mask = np.array([x["mask"] for x in hits], np.int64).view(np.uint64)
            string, d = np.nonzero((mask[:, None] >> bits[None, :]) & np.uint64(1))
            starts = np.unique(at[string] - (w - 1) - d)
            turn[starts] += 1
            turn[starts + s.length] -= 1
            gone = np.cumsum(turn[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((th, int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist()))
        cols = list(zip(*rows))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(cols, kinds)], ["th", "n_removed", "n_spans", "kept_sha256", "spans"]
        )

    return map_batches(
        texts.select("th", "text", "hits"),
        run,
        "th binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>",
    )


def remove_repeats(docs: DataFrame, length: int = 400, report: int = 6) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_shared) of every row.

    `spans` holds the removed runs as start, end, start, end, ... in bytes of the text. `n_shared` is only told and removes nothing: bytes in
    runs of `report` phrases that stand in another text too (in all of a text that has copies). A phrase reaches from one
    sampled position to the next, some 32 bytes at the default length, so these are passages that may be shorter than `length`.
    """
    s = Sampling(length)
    phrased = settle(with_phrases(docs, s), "suffix-phrases")
    hashed = settle(phrased.drop("phrases"), "suffix-texts")
    positions = repeated_positions(phrased, s.phrases)
    discard(phrased)
    longer = s.phrases + min(max(report - s.phrases, 0), s.phrases)
    shared = settle(across_texts(positions, s.phrases, longer), "suffix-shared")
    wanted = settle(_wanted(hashed, positions), "suffix-wanted")
    bloom = bloom_of(wanted, "key")
    told = positions.select("id", "idx", F.lit(False).alias("told")).unionByName(shared.select("id", "idx", F.lit(True).alias("told")))
    by_text = told.groupBy("id").agg(
        F.collect_list(F.when(~F.col("told"), F.col("idx"))).alias("idxs"), F.collect_list(F.when(F.col("told"), F.col("idx"))).alias("shared")
    )
    texts = _texts_with(docs, wanted, bloom).join(by_text, "id")
    texts = settle(texts.select(F.monotonically_increasing_id().alias("tid"), "th", "idxs", "shared", "text"), "suffix-wanted-texts")
    discard(positions, wanted, shared)
    masks, below = _masks(_edges_of(texts, s), s.w)
    hits = masks.groupBy("tid").agg(F.collect_list(F.struct("at", "mask")).alias("hits"))
    cut = _cut(texts.join(hits, "tid"), s)
    # Texts that passed the filter by chance, or rows repeated with their id, give one line each.
    cut = settle(cut.dropDuplicates(["th"]), "suffix-cut")
    of_text = settle(_shared_bytes(texts.where("size(shared) > 0"), s, longer).dropDuplicates(["th"]), "suffix-told")
    discard(texts, *below)
    copies = hashed.groupBy("th").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    out = hashed.drop("id").join(cut, "th", "left").join(copies, "th", "left").join(of_text, "th", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"), "n_bytes"))
        .otherwise(F.coalesce("spans", F.array().cast("array<long>")))
        .alias("spans"),
        F.when(F.col("copies") > 1, F.col("n_bytes")).otherwise(F.coalesce("n_shared", F.lit(0))).cast("long").alias("n_shared"),
    )
