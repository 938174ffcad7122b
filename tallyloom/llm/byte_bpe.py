"""Byte-level BPE by tree reduction: halves are encoded apart and joined, and ids are decoded back to bytes.

A text is cut into pieces by a pattern, and each piece is encoded by itself: a piece that is in the vocabulary is one token; otherwise
the adjacent pair whose bytes have the lowest rank is merged, leftmost first, until no adjacent pair is in the vocabulary.

Tree. A piece of up to `leaf` bytes is encoded directly. A longer one is cut near its middle, at a multiple of `leaf`, the halves are encoded the same way, and
the two token sequences are joined: some tokens on either side of the cut are taken back to bytes and encoded anew, more of them on
a side until the tokens outside provably stand. The proof rests on this: a sequence of tokens is the encoding of its
bytes if, and only if, every two neighbours of it are the encoding of their own bytes. (Before the first merge across a
boundary, the merges inside the two tokens beside it come in the order in which they come when the two stand alone, so that
merge would also be made there.) Neighbours in the left half, in the right half and in the window are encodings already, so
the two pairs at the window's ends are all that is tested. Joining is associative: the result depends on the bytes alone.

Pieces are the roots of these trees; a text is the concatenation of its pieces' tokens, as no merge crosses a piece. Decoding
concatenates the tokens' bytes up a tree of halves.

The vocabulary is read once by the driver, at a path that is a parameter, and broadcast (about a megabyte). Null and empty texts have no
tokens. Repeated rows are answered each. Columns that are not carried are ignored. Tasks remember the tokens of short
pieces up to a bound. Very long texts are cut into pieces whole; a piece without end, such as a megabyte of one letter, is the tree.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_batches

#: Pieces that a task remembers, and their longest length in characters.
_REMEMBERED, _SHORT = 200_000, 32
#: Windows up to so many bytes are remembered.
_SMALL = 12
#: Windows over so many bytes are merged with a heap.
_LONG = 96
#: Ids that are joined at once at the foot of a decoding tree.
_FOOT = 4096


class _Remembered(dict):
    """The ids of pieces as bytes of int32. What was asked for lately outlives the bound."""

    def __init__(self, of: Vocabulary):
        self.of, self.older = of, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.of.piece(piece)).tobytes()
        if len(piece) <= _SHORT:
            if len(self) >= _REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Ranks of byte strings; all 256 single bytes are among them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 4):
        self.ranks, self.leaf = ranks, leaf
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._beyond = max(self.bytes_of) + 1
        self.pieces = regex.compile(pattern)
        self._shorts: dict[bytes, list[int]] = {}
        self._stands: dict[int, bool] = {}
        self._known = _Remembered(self)

    def merged(self, raw: bytes) -> list[int]:
        """Tokens of a short byte string by merging the lowest-ranked pair, leftmost first, until there is none."""
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        # The rank of each part joined with its successor; the last has none.
        beyond = self._beyond
        joined = [ranks.get(a + b, beyond) for a, b in zip(parts, parts[1:])]
        while joined:
            low = min(joined)
            if low == beyond:
                break
            i = joined.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i < len(joined):
                joined[i] = ranks.get(parts[i] + parts[i + 1], beyond)
            if i:
                joined[i - 1] = ranks.get(parts[i - 1] + parts[i], beyond)
        return [ranks[p] for p in parts]

    def merged_long(self, raw: bytes) -> list[int]:
        """The same for a long byte string: pairs wait in a heap by rank and place, neighbours are linked."""
        ranks, n = self.ranks, len(raw)
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(waiting)
        while waiting:
            _, i, size = heappop(waiting)
            j = after[i] if parts[i] is not None else n
            # Either part may have changed since the pair was noted; then it has another length.
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heappush(waiting, (r, i, len(parts[i]) + len(parts[k])))
            h = before[i]
            if h >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heappush(waiting, (r, h, len(parts[h]) + len(parts[i])))
        return [ranks[p] for p in parts if p is not None]

    def stands(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        key = a << 32 | b
        known = self._stands.get(key)
        if known is None:
            if len(self._stands) > 2 * _REMEMBERED:
                self._stands.clear()
            known = self._stands[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def short(self, raw: bytes) -> list[int]:
        """Tokens of a leaf or a small window, remembered: few of them are new, as there are few byte strings of such length."""
        known = self._shorts.get(raw)
        if known is None:
            if len(self._shorts) >= _REMEMBERED:
                self._shorts.clear()
            known = self._shorts[raw] = self.merged(raw)
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            window = b"".join(map(self.bytes_of.__getitem__, chain(left[-i:], right[:j])))
            size = len(window)
            middle = self.short(window) if size <= _SMALL else self.merged(window) if size <= _LONG else self.merged_long(window)
            before, after = left[:-i], right[j:]
            grow_left = before and not self.stands(before[-1], middle[0])
            grow_right = after and not self.stands(middle[-1], after[0])
            if not grow_left and not grow_right:
                return before + middle + after
            # Whole halves are the last window: nothing is left outside to be tested.
            i = min(2 * i, len(left)) if grow_left else i
            j = min(2 * j, len(right)) if grow_right else j

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= self.leaf:
            return self.short(raw)
        half = max(len(raw) // 2 // self.leaf, 1) * self.leaf
        return self.joined(self.tree(raw[:half]), self.tree(raw[half:]))

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.tree(raw)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._known.__getitem__, self.pieces.findall(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= _FOOT:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def vocabulary(raw: bytes, pattern: str, leaf: int = 4) -> Vocabulary:
    """From the lines of a rank file: a token in base64, a blank, its rank."""
    lines = (line.split() for line in raw.splitlines() if line.strip())
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in lines}, pattern, leaf)


def _broadcast(docs: DataFrame, ranks: str):
    with open(ranks, "rb") as lines:
        return docs.sparkSession.sparkContext.broadcast(lines.read())


def _carried(frame: DataFrame, carry: tuple[str, ...]) -> str:
    return "".join(f", `{c}` {frame.schema[c].dataType.simpleString()}" for c in carry)


def encoded(docs: DataFrame, ranks: str, pattern: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(ids, *carry): the tokens of every text, as array<int>. `ranks` is the path of the rank file, which the driver reads."""
    raw = _broadcast(docs, ranks)

    def run(batch):
        words = vocabulary(raw.value, pattern)
        column, first = batch.column(0), 0
        for i in range(0, len(column), 256):
            part = [np.zeros(0, np.int32) if x is None else words.encode(x) for x in column.slice(i, 256).to_pylist()]
            stops = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in part])]), pa.int32())
            ids = pa.ListArray.from_arrays(stops, pa.array(np.concatenate(part), pa.int32()))
            first = i + len(part)
            yield pa.record_batch([ids, *batch.slice(i, first - i).columns[1:]], ["ids", *carry])

    return map_batches(docs.select("text", *carry), run, "ids array<int>" + _carried(docs, carry))


def decoded(tokens: DataFrame, ranks: str, pattern: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(bytes, *carry): what the ids of every row stand for; null ids stand for nothing, an id out of the vocabulary raises KeyError."""
    raw = _broadcast(tokens, ranks)

    def run(batch):
        words = vocabulary(raw.value, pattern)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            ids, stops = part.column(0).flatten().to_numpy(), np.cumsum(pc.list_value_length(part.column(0)).fill_null(0).to_numpy())
            whole = [words.decode(x.tolist()) for x in np.split(ids, stops[:-1])]
            yield pa.record_batch([pa.array(whole, pa.binary()), *part.columns[1:]], ["bytes", *carry])

    return map_batches(tokens.select("ids", *carry), run, "bytes binary" + _carried(tokens, carry))


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded."""
    tokens = encoded(docs, ranks, pattern, carry=("doc_id",))
    digests = tokens.select(
        "ids", "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    )
    back = decoded(digests, ranks, pattern, carry=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
