"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q and length 2q or more that no neighbouring word extends. Words are
numbered, so that equal words have equal numbers, and everything below compares numbers.

Scales. A run of period q is looked for at the scale s, a power of two, with 3s - 1 <= q <= 6s - 2. A position belongs
to the scale's synchronising set if, among the hashes of the s-word grams at it and at the s places after it, the least
stands at one of the two ends; grams of period s/3 or less do not compete. Whether a position is chosen depends on the 2s words
that follow it and on nothing else, so equal contexts are chosen alike, and some position is chosen in every s places
unless the 3s - 1 words from the first of them have a period of s/3 or less.

Proposals. Two chosen positions with equal context, q apart, propose the period q. Contexts overlap themselves at distances
over s/3 only, so no more than eighteen followers lie within reach. The periods 1 to 10 are compared word by word beforehand;
runs found so far with periods up to s/3 are the regions the set leaves out. A run whose whole first period lies in such a region consists of
two adjacent regions of equal root, and those propose their distances themselves.

Every proposal is extended word by word and counts only if it spans two periods, so a hash collision costs a comparison and
cannot change a result. A multiple of a period gives a stretch that is already there under the smaller one.

Texts lie side by side in blocks, each followed by a number of its own, which no run can hold. A text is worked on whole in
one task; the work is proportional to its words times the logarithm of their number, and there are no more runs than words.

Null and empty texts have no words and no runs. Repeated rows are answered each. Columns that are not carried are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_batches, texts_of

#: Bytes of text that are worked on side by side.
_BLOCK = 1 << 20
#: Periods that are compared word by word; the first scale begins after them.
_DIRECT = 10


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of the w items from each place on."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _inside(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places that lie in one of the intervals."""
    turn = np.zeros(n + 1, np.int32)
    np.add.at(turn, start, 1)
    np.add.at(turn, stop, -1)
    return np.cumsum(turn[:-1]) > 0


class _Found:
    """Runs by (start, stop), each with the smallest period that was found; proposals are to come by growing period."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}

    def add(self, start: int, stop: int, q: int) -> None:
        if stop - start >= 2 * q:
            self.period.setdefault((start, stop), q)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.period:
            return (np.zeros(0, np.int64),) * 3
        spans = np.array(list(self.period), np.int64)
        return spans[:, 0], spans[:, 1], np.fromiter(self.period.values(), np.int64, len(spans))


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """Equal items at the beginning of both."""
    n, done, step = min(len(x), len(y)), 0, 64
    while done < n:
        part = x[done : done + step] != y[done : done + step]
        if part.any():
            return done + int(part.argmax())
        done += step
        step *= 2
    return n


def _extend(t: np.ndarray, proposals: np.ndarray, found: _Found) -> None:
    """Stretches of equal words q apart around each (q, place), in order; one stretch is compared once."""
    last, end = 0, 0
    for q, at in proposals.tolist():
        if q == last and at < end:
            continue
        right = at + _reach(t[at:-q], t[at + q :])
        left = at - _reach(t[:at][::-1], t[q : at + q][::-1])
        found.add(left, right + q, q)
        last, end = q, max(right, at + 1)


def _direct(t: np.ndarray, q: int, found: _Found) -> None:
    same = np.zeros(len(t) - q + 2, np.int8)
    same[1:-1] = t[:-q] == t[q:]
    turn = np.flatnonzero(np.diff(same))
    start, stop = turn[::2], turn[1::2]
    # Stretches of under four words bound no gram of any scale.
    long = stop - start >= max(q, 4 - q)
    for a, b in zip(start[long].tolist(), stop[long].tolist()):
        found.add(a, b + q, q)


def _rotation(a: np.ndarray, b: np.ndarray) -> int | None:
    """k such that b is a[k:] followed by a[:k]."""
    twice, part = np.concatenate([a, a]).tobytes(), b.tobytes()
    at = twice.find(part)
    while at >= 0 and at % 8:
        at = twice.find(part, at + 1)
    return None if at < 0 else at // 8


def _adjacent(t: np.ndarray, s: int, found: _Found) -> list[tuple[int, int]]:
    """(q, place) of runs at scale s that consist of two neighbouring regions of one small period."""
    start, stop, period = found.arrays()
    region = (period <= s // 3) & (stop - start >= 3 * s - 1)
    if region.sum() < 2:
        return []
    start, stop, period = start[region], stop[region], period[region]
    order = np.lexsort((start, period))
    start, stop, period = start[order], stop[order], period[order]
    near = np.flatnonzero((period[:-1] == period[1:]) & (stop[:-1] >= start[1:]))
    out = []
    for i in near.tolist():
        p, b1, e1, b2, e2 = (int(x) for x in (period[i], start[i], stop[i], start[i + 1], stop[i + 1]))
        k = _rotation(t[e1 - p : e1], t[b2 : b2 + p])
        if k is None:
            continue
        least, most = 3 * s - 1, min(6 * s - 2, e1 - b1, e2 - b2)
        first = least + (b2 - e1 - k - least) % p
        out += [(q, max(b1, b2 - q)) for q in range(first, most + 1, p)]
    return out


def _synchronised(t: np.ndarray, grams: np.ndarray, s: int, found: _Found) -> np.ndarray:
    """Positions of the synchronising set of scale s; grams are the hashes of the s-word grams."""
    start, stop, period = found.arrays()
    small = (period <= s // 3) & (stop - start >= s)
    ranks = grams | np.uint64(1)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    if small.any():
        ranks[_inside(len(ranks), start[small], stop[small] - s + 1)] = none
    least = _least(ranks, s + 1)
    n = len(least)
    return np.flatnonzero(((ranks[:n] == least) | (ranks[s : s + n] == least)) & (least != none))


def _pairs(chosen: np.ndarray, context: np.ndarray, s: int) -> np.ndarray:
    """(q, place) of chosen positions with equal context whose distance q belongs to the scale."""
    order = np.lexsort((chosen, context))
    at, same = chosen[order], context[order]
    out, k = [], 1
    while k < len(at):
        apart = np.where(same[k:] == same[:-k], at[k:] - at[:-k], 6 * s)
        if not (apart <= 6 * s - 2).any():
            break
        fits = np.flatnonzero((apart >= 3 * s - 1) & (apart <= 6 * s - 2))
        out.append(np.column_stack([apart[fits], at[fits]]))
        k += 1
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def runs_of(t: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of every run of four words or more, by start, then period. `longest` bounds the length of a run."""
    found = _Found()
    n = len(t)
    longest = n if longest is None else longest
    with np.errstate(over="ignore"):
        for q in range(1, min(_DIRECT, longest // 2) + 1):
            _direct(t, q, found)
        s, grams = 4, None
        while 2 * (3 * s - 1) <= longest:
            if grams is None:
                one = _spread(t.astype(np.uint64) + np.uint64(1))
                two = _spread(one[:-1] * np.uint64(3) + one[1:])
                grams = _spread(two[:-2] * np.uint64(3) + two[2:])
            context = _spread(grams[:-s] * np.uint64(3) + grams[s:])
            chosen = _synchronised(t, grams, s, found)
            proposals = _pairs(chosen, context[chosen], s)
            regions = _adjacent(t, s, found)
            if regions:
                proposals = np.concatenate([proposals, np.array(regions, np.int64)])
            _extend(t, proposals[np.lexsort((proposals[:, 1], proposals[:, 0]))], found)
            grams, s = context, 2 * s
    start, stop, period = found.arrays()
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    first, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= _BLOCK:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def _rows(texts: list[bytes], min_length: int) -> Iterator[tuple[int, list[dict], str]]:
    """(words, runs, collapsed text) of each text of a block."""
    words = [x.split() for x in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    # A text ends with a number that occurs nowhere else.
    ends = np.cumsum(sizes + 1)
    t = np.empty(int(ends[-1]), np.int64)
    own = np.ones(len(t), bool)
    own[ends - 1] = False
    t[own] = numbered([w for x in words for w in x])
    t[~own] = -1 - np.arange(len(words))
    start, stop, period = runs_of(t, int(sizes.max()))
    keep = stop - start >= min_length
    start, stop, period = start[keep], stop[keep], period[keep]
    gone = _inside(len(t), start + period, stop)
    cuts = np.searchsorted(start, ends)
    for i, w in enumerate(words):
        base, a, b = int(ends[i] - sizes[i] - 1), int(cuts[i - 1]) if i else 0, int(cuts[i])
        runs = [
            {"start": x - base, "length": y - x, "period": q}
            for x, y, q in zip(start[a:b].tolist(), stop[a:b].tolist(), period[a:b].tolist())
        ]
        left = w if a == b else [w[j] for j in np.flatnonzero(~gone[base : base + len(w)]).tolist()]
        yield len(w), runs, b" ".join(left)


def periodic_runs(docs: DataFrame, min_length: int = 12, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row, and the columns of `carry`, which must not have one of these names.

    `runs` are (start, length, period) in words from 0, those of `min_length` words or more, by start, then period. `collapsed` is the
    text with the words of each run after its first period left out, words joined by one space.
    """
    if min_length < 4:
        raise ValueError("min_length must be 4 or more")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kept = docs.select("doc_id", "text", *carry)
    names = ["doc_id", "n_words", "runs", "collapsed", *carry]
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    schema += "".join(f", `{c}` {kept.schema[c].dataType.simpleString()}" for c in carry)

    def answer(batch):
        at = 0
        for group in _blocks(texts_of(batch.column(1))):
            part = batch.slice(at, len(group))
            at += len(group)
            sizes, runs, texts = zip(*_rows(group, min_length))
            own = [pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.record_batch([part.column(0), *own, *part.columns[2:]], names)

    return map_batches(kept, answer, schema)


def word_array(text: Column) -> Column:
    """Words of a text that does not consist of blanks alone."""
    return F.split(F.trim(text, F.lit(" \t\n\x0b\f\r")), "[ \t-\r]+")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the crc32 of doc_id and g = h div 10, every tenth text repeats the p words from word g mod n on to its end.

    p is 1 + (n - a) div (3 + g mod 8), with n the number of words and a = g mod n. Rows without doc_id, or without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = (h % 10 == 0) & F.col("text").rlike("[^ \t-\r]")
    words = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, word_array(F.col("text"))).alias("words"))
    words = words.withColumn("n", F.size("words")).withColumn("a", F.expr("cast(g % n as int)"))
    words = words.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    block = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    planted = F.array_join(F.concat(F.expr("slice(words, 1, a)"), block), " ")
    return words.select("doc_id", F.when(F.col("words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def digest_of_runs(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run and hashes of all."""
    first = "reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (m, x) -> if(m is null or x.length > m.length, x, m))"
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    longest = found.withColumn("longest", F.expr(first))
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"longest.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
