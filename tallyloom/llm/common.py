"""Helpers shared by the operators: settled tables, a bounded Bloom filter, components, task-side batches."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.numbering import ensure_checkpoint_dir
from tallyloom.session import ship_package

#: Rows of one Arrow batch that a task hands back to the JVM.
OUT_ROWS = 65_536
#: Bytes of one Arrow batch that a task is given: the texts that it holds at once, on either side of Python.
BATCH_BYTES = 8 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the checkpoint folder that driver and executors share; it goes when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut and no row can change any more."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    for tables in _watched.get():
        tables.append(out)
    return out


#: Lists that get every table settled while they are watched; another thread has lists of its own.
_watched: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("watched", default=())


@contextmanager
def settled_into(tables: list[DataFrame]) -> Iterator[None]:
    """Meanwhile tables that this thread settles are noted in `tables`, for whoever knows when they are done with."""
    before = _watched.set((*_watched.get(), tables))
    try:
        yield
    finally:
        _watched.reset(before)


def broadcast_if_small(settled: DataFrame, max_rows: int) -> DataFrame:
    """The settled table, marked for broadcast if its counted rows are few; beyond that Spark shuffles."""
    return F.broadcast(settled) if settled.count() <= max_rows else settled


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, to give their disk back before the job ends."""
    for df in settled:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; the session's batches are cut to BATCH_BYTES unless they are smaller."""
    spark = df.sparkSession
    ship_package(spark)
    if not 0 < _bytes_of(spark.conf.get(_BATCH_LIMIT)) <= BATCH_BYTES:
        spark.conf.set(_BATCH_LIMIT, BATCH_BYTES)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def _bytes_of(setting: str) -> int:
    """Bytes of a size as Spark writes it: 8388608, 8388608b, 8m, 64MB."""
    number = setting.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(number[-1:], 0)
    return int(number.rstrip("kmg")) << unit


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


#: Bytes that separate words become spaces, ASCII capitals small letters; all bytes over 7F belong to words.
_WORDS = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
#: Words that a task remembers, and their longest length in bytes.
_CACHE, _LONGEST = 150_000, 64


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text in small ASCII letters."""
    return raw.translate(_WORDS).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound. 0 and 1 are no word's hash."""

    def __missing__(self, word: bytes) -> int:
        value = max(xxhash.xxh3_64_intdigest(word), 2)
        if len(word) <= _LONGEST:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=1)
def known_words() -> WordHashes:
    """The words that this process remembers from batch to batch."""
    return WordHashes()


# ------------------------------------------------------------------ Bloom filter


class Bloom:
    """A bit table over 64-bit keys. It never misses a key it was given; its size is fixed beforehand."""

    def __init__(self, bits: int, probes: int, table: np.ndarray | None = None):
        self.bits, self.probes = bits, probes
        self.table = np.zeros(bits // 8, np.uint8) if table is None else table

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            y = (x * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
            for i in range(self.probes):
                z = x + np.uint64(i) * y
                yield (z ^ (z >> np.uint64(32))) & np.uint64(self.bits - 1)

    def add(self, keys: np.ndarray) -> None:
        for place in self._places(keys):
            np.bitwise_or.at(self.table, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def hits(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in self._places(keys):
            found &= (self.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bloom_of(keys: DataFrame, column: str, max_bytes: int = 1 << 22, probes: int = 4) -> Bloom:
    """Filter over the long `column`, at most `max_bytes` large however many keys there are.

    Tasks fill pieces of the table, which are OR-ed by piece in a shuffle, so the driver receives one
    table and nothing that grows with the input. A full table lets more rows through and loses none.
    """
    n = keys.count()
    bits = 1 << max(10, min(math.ceil(math.log2(max(n, 1) * 12)), int(math.log2(max_bytes * 8))))
    size = bits // 8
    piece = min(size, 1 << 15)

    def fill(batches):
        own = Bloom(bits, probes)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        parts = [(i, own.table[i * piece : (i + 1) * piece]) for i in range(size // piece)]
        parts = [(i, x.tobytes()) for i, x in parts if x.any()]
        yield pa.record_batch(
            [pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["piece", "bits"]
        )

    def unite(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, np.uint8)
                found[i] = found[i] | x if i in found else x
        yield pa.record_batch(
            [pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())],
            ["piece", "bits"],
        )

    pieces = keys.select(F.col(column).cast("long")).mapInArrow(fill, "piece int, bits binary")
    rows = pieces.repartition("piece").mapInArrow(unite, "piece int, bits binary").collect()
    out = np.zeros(size, np.uint8)
    for row in rows:
        out[row.piece * piece : (row.piece + 1) * piece] |= np.frombuffer(row.bits, np.uint8)
    return Bloom(bits, probes, out)


# ------------------------------------------------------------------ components


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node but the roots: root is the smallest node reachable over the undirected edges (a, b) of longs.

    Alternating large-star and small-star rounds. A node's smallest neighbour comes from a map-side
    combined minimum and a join, so no task gathers the neighbours of a node. The driver sees two
    numbers a round.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        edges = settle(_small_star(_large_star(edges)), label)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points to its smaller end, so the neighbours of `a` are all smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
