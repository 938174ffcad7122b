"""Benchmark passages in texts, found by winnowing.

A window is `span` consecutive words of a benchmark item; an item of fewer words is one window. Texts and items
are reduced to fingerprints: of the hashes of `gram` consecutive words, the least in every run of
span - gram + 1 of them. A passage of `span` shared words has one such run in common, whose least hash is a
fingerprint of both, so a join of fingerprints finds every shared window. Each hit is then extended: the words
around the two places are compared outwards, and a run of `span` equal words or more is marked. Items shorter
than `span` words have no such run; their one window is its own fingerprint, and texts are read for it at every
place.

A Bloom filter of the benchmark's fingerprints, of bounded size, lets texts drop what no item holds before
anything is shuffled; a full filter would drop less and lose nothing. Hot passages are joined as rows, which
Spark splits where they are skewed. What is gathered for a text are the items in it and its own places.

Null texts have no words and are not hit. Items without words have no windows. Repeated rows of documents are
answered each; repeated items count once by item_id, and items without an id are marked but not listed. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Bloom, WordHashes, bloom_of, known_words, map_batches, settle, texts_of, words_of

_BASE = np.uint64(0x9E3779B97F4A7C15)
def word_hashes(raw: bytes, known: WordHashes) -> np.ndarray:
    words = words_of(raw)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; runs of other sizes get other hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * _BASE + words[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))) | np.uint64(1)


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    n, step = len(x) - size + 1, 1
    while 2 * step <= size:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[:n], x[size - step : size - step + n]) if size > step else x[:n]


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some run of `window` hashes."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least = _sliding(grams, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), window, np.maximum)
    return np.flatnonzero(most == grams)


def _around(words: np.ndarray, places: np.ndarray, span: int, gram: int, outside: int) -> np.ndarray:
    """Words around each place: all that a window over the gram there can hold."""
    before = span - gram
    padded = np.concatenate([np.full(before, outside, np.uint64), words, np.full(span, outside, np.uint64)])
    return padded[places[:, None] + np.arange(before + span)[None, :]]


def _longs(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([x.ravel() for x in rows]) if rows else np.zeros(0, np.uint64)
    sizes = np.array([len(r) for x in rows for r in x], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))


def item_prints(items: DataFrame, span: int, gram: int) -> DataFrame:
    """(item_id, size, fp, around): fingerprints of items, with the words around them."""

    def run(batch):
        known = known_words()
        ids, sizes, prints, around = [], [], [], []
        for item, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            words = word_hashes(raw, known)
            n = min(len(words), span)
            if not n:
                continue
            if n < span:
                got, near = gram_hashes(words, n), words[None, :]
            else:
                grams = gram_hashes(words, gram)
                places = winnow(grams, span - gram + 1)
                got, near = grams[places], _around(words, places, span, gram, 1)
            ids += [item] * len(got)
            sizes += [n] * len(got)
            prints.append(got)
            around.append(near)
        flat = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        yield pa.record_batch(
            [pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64)), _longs(around)],
            ["item_id", "size", "fp", "around"],
        )

    return map_batches(
        items.select(F.col("item_id").cast("string"), "text"), run, "item_id string, size int, fp long, around array<long>"
    )


def text_prints(docs: DataFrame, bloom: Bloom, short: list[int], span: int, gram: int, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, size, fp, place, around): a text's words, and its fingerprints that some item may have."""

    def run(batch):
        known = known_words()
        counts, lengths, sizes, prints, places, around = [], [], [], [], [], []
        for raw in texts_of(batch.column(2)):
            words = word_hashes(raw, known)
            counts.append(len(words))
            before = len(sizes)
            grams = gram_hashes(words, gram)
            at = winnow(grams, span - gram + 1)
            at = at[bloom.hits(grams[at])]
            if len(at):
                sizes += [span] * len(at)
                prints.append(grams[at])
                places.append(at)
                around.append(_around(words, at, span, gram, 0))
            for n in short:
                grams = gram_hashes(words, n)
                at = np.flatnonzero(bloom.hits(grams))
                if len(at):
                    sizes += [n] * len(at)
                    prints.append(grams[at])
                    places.append(at)
                    around.append(words[at[:, None] + np.arange(n)[None, :]])
            lengths.append(len(sizes) - before)
        cuts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((prints, np.uint64), (places, np.int64))]
        columns = [
            pa.array(sizes, pa.int32()),
            pa.array(flat[0].view(np.int64)),
            pa.array(flat[1].astype(np.int32)),
            _longs(around),
        ]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), *[pa.ListArray.from_arrays(cuts, c) for c in columns]],
            ["row", "doc_id", "n_words", "size", "fp", "place", "around"],
        )

    return map_batches(
        docs.select((F.col(row) if row else F.lit(None)).cast("long").alias("row"), F.col("doc_id").cast("long"), "text"),
        run,
        "row long, doc_id long, n_words long, size array<int>, fp array<long>, place array<int>, around array<array<long>>",
    )


def _extend(pairs: DataFrame, span: int, gram: int) -> DataFrame:
    """(row, item_id, start, stop): the runs of equal words around each hit that are long enough."""
    before = span - gram

    def run(batch):
        size = batch.column("size").to_numpy(zero_copy_only=False)
        place = batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
        start, stop = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for n in np.unique(size):
            of = np.flatnonzero(size == n)
            width = before + span if n == span else int(n)
            take = pa.array(of)
            a, b = (batch.column(c).take(take).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("around", "item_around"))
            same = a == b
            if n < span:
                stop[of] = np.where(same.all(axis=1), n, 0)
                continue
            left = np.cumprod(same[:, :before][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, before:], axis=1).sum(axis=1)
            found = (right >= gram) & (left + right >= span)
            start[of], stop[of] = np.where(found, -left, 0), np.where(found, right, 0)
        hit = pa.array(stop > start)
        yield pa.record_batch(
            [batch.column("row"), batch.column("item_id"), pa.array(place + start), pa.array(place + stop)],
            ["row", "item_id", "start", "stop"],
        ).filter(hit)

    return map_batches(pairs, run, "row long, item_id string, start long, stop long")


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, gram: int = 5, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated, spans) of every row of docs.

    `spans` lists the marked runs as (start, stop) in words; `row` is passed on from the column so named, else a number.
    """
    known = settle(item_prints(items, span, gram), "winnow-items")
    short = sorted(r[0] for r in known.where(F.col("size") < span).select("size").distinct().collect())  # under `span` values
    bloom = bloom_of(known, "fp")
    base = text_prints(docs, bloom, short, span, gram, row)
    if row is None:
        base = base.withColumn("row", F.monotonically_increasing_id())
    base = settle(base, "winnow-texts")
    hits = base.select("row", F.explode(F.arrays_zip("size", "fp", "place", "around")).alias("h")).select("row", "h.*")
    pairs = hits.join(known.withColumnRenamed("around", "item_around"), ["fp", "size"])
    runs = settle(
        _extend(pairs.select("row", "item_id", "size", "place", "around", "item_around"), span, gram).distinct(), "winnow-runs"
    )
    spans = runs.select("row", "start", "stop").distinct()
    places = spans.select("row", F.explode(F.expr("sequence(start, stop - 1)")).alias("place")).distinct()
    n_hit = places.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    found = runs.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    where = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    out = base.select("row", "doc_id", "n_words").join(n_hit.join(found, "row").join(where, "row"), "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
    )

