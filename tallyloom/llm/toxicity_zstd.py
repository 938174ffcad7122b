"""Toxicity by compression distance.

Two Zstandard dictionaries are trained. The ordinary one comes from Zstandard's trainer over windows of ordinary text.
The toxic one holds what toxic texts share and ordinary texts lack: as in that trainer's cover method, the piece that
most samples still lack is added, again and again, but pieces are words and word beginnings, each kept whole. A window is compressed with the ordinary dictionary and with the ordinary dictionary that follows the toxic
one, so ordinary text comes out equally long and the difference is what the toxic dictionary explains. Windows
overlap and cover the whole text. The largest differences of a text, against thresholds calibrated on rows that the
dictionaries were not trained on, give its score.

Learning uses a bounded sample: at most `per_class` labelled rows of each class, of at most `max_bytes` each. One row
in three calibrates. Scoring is one pass in tasks and moves nothing.

Null and empty texts score as a text without any difference. Without toxic rows to learn from every score is 0.
Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_batches, texts_of
from tallyloom.llm.learning import fit_logistic, label_share, labelled_sample, sigmoid

LEVEL, WINDOW, STRIDE = 6, 96, 64
ORDINARY_BYTES = 12_288
#: Fixed value: the repeat offsets that end a trained dictionary's tables; its content follows.
_REPEATS = bytes((1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0))


@dataclass
class Model:
    """Dictionary contents, and the weights of a text's features."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(features))
        return sigmoid(np.column_stack([features, np.ones(len(features))]) @ self.weights)


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    sizes = {"source_size": WINDOW, "dict_size": len(raw)}
    return zstandard.ZstdCompressor(
        dict_data=held, compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, **sizes, **bare)
    )


def windows(raw: bytes) -> list[bytes]:
    """Overlapping windows that cover the text; any run of WINDOW - STRIDE bytes lies whole in one of them."""
    return [raw[i : i + WINDOW] for i in range(0, max(len(raw) - WINDOW + STRIDE, 1), STRIDE)]


def _content(samples: list[bytes]) -> bytes:
    """What a dictionary trained on ordinary windows holds, without its header and entropy tables."""
    try:
        trained = zstandard.train_dictionary(ORDINARY_BYTES, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[-ORDINARY_BYTES:]
    return trained.partition(_REPEATS)[2] or trained


def _shared(texts: list[set[bytes]], allowed: set[bytes], least: int, times: int = 3) -> set[bytes]:
    """Tokens of which most texts hold several: the one in most texts that hold fewer than `times` so far, again and again."""
    open_, chosen = [[times, t & allowed] for t in texts], set()
    while True:
        held = Counter(w for _, t in open_ for w in t if w not in chosen)
        if not held or max(held.values()) < least:
            return chosen
        best = min(held, key=lambda w: (-held[w], -len(w), w))
        chosen.add(best)
        # A token that goes on from the chosen one, or that it goes on from, says nothing more.
        open_ = [[n - (best in t), {w for w in t if not (w.startswith(best) or best.startswith(w))} if best in t else t] for n, t in open_]
        open_ = [x for x in open_ if x[0] and x[1]]


def features(raw: bytes, plain, toxic) -> tuple[float, float, float]:
    """The two largest differences of a text's windows, and the logarithm of how many there are."""
    first = second = 0
    cut = windows(raw.lower())
    for w in cut:
        gain = len(plain.compress(w)) - len(toxic.compress(w))
        if gain > second:
            first, second = max(first, gain), min(first, gain)
    return min(first, 12), min(second, 12), float(np.log2(1 + len(cut)))


def _tokens(raw: bytes) -> set[bytes]:
    """The words of a text between blanks, and their beginnings after one."""
    words = {w.strip(b".,;:!?\"'()") for w in raw.lower().split()}
    return {b" " + w + b" " for w in words if len(w) > 2} | {b" " + w[:k] for w in words for k in (4, 5, 6) if len(w) > k}


def train(sample: pd.DataFrame, share: float) -> Model:
    """Dictionaries from two rows in three, thresholds from the others, weighted to the share of toxic rows."""
    texts = [t.encode() for t in sample["text"]]
    y, part = sample["y"].to_numpy(), (sample["draw"].to_numpy() % 3 == 0)
    toxic = [_tokens(t) for t, v, p in zip(texts, y, part) if v == 1 and not p]
    plain = [t for t, v, p in zip(texts, y, part) if v == 0 and not p]
    if not toxic or not plain or len(set(y[part])) < 2:
        return Model(b"", b"", np.zeros(4))
    held = Counter(w for words in toxic for w in words)
    common = Counter(w for t in plain for w in _tokens(t) if w in held)
    # Words and beginnings that are at least twenty times as frequent in toxic texts; of them, those that most toxic texts share.
    least = max(2, len(toxic) // 50)
    marked = {w for w, n in held.items() if n >= least and n * len(plain) > 20 * common[w] * len(toxic)}
    marked = _shared(toxic, marked, least)
    if not marked:
        return Model(b"", b"", np.zeros(4))
    pieces = [w for t in plain for w in windows(t.lower())[::2]]
    model = Model(_content(pieces), b"".join(sorted(marked)), np.zeros(4))
    a, b = model.compressors()
    x = np.array([features(t, a, b) for t, p in zip(texts, part) if p])
    y = y[part]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.weights = fit_logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batch):
        if model.toxic:
            a, b = model.compressors()
            found = np.array([features(x, a, b) for x in texts_of(batch.column(1))])
        else:
            found = np.zeros((batch.num_rows, 3))
        yield pa.record_batch([batch.column(0), pa.array(model.score(found))], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 3000, max_bytes: int = 32_768, label: str = "toxic"
) -> DataFrame:
    """(doc_id, score) of every row, learned from the labelled rows that `learn` allows."""
    sample = labelled_sample(docs, labels, label, learn, per_class, max_bytes)
    return score(docs, train(sample, label_share(labels, label, learn)))
