"""Text quality by a convolutional network over bytes, in numpy.

Bytes are embedded, filters of WIDTH bytes slide over chunks of CHUNK bytes that start every STRIDE bytes and so
overlap and cover the whole text. Each filter's largest response in a chunk goes through a rectifier; a chunk's
responses give its logit, and the mean of the chunk logits gives the text's probability.

The filters are linear in the embedded bytes, so for scoring embedding and filters fold into two tables that are
looked up by pairs of bytes: two gathers and one addition for a position.

Learning uses a bounded sample: at most `per_class` labelled rows of each class, of at most `max_bytes` each, and in
each epoch at most EPOCH_CHUNKS chunks of a text, drawn from all of it. Scoring uses every chunk of every text, in one
pass in tasks that moves nothing.

Null and empty texts are one chunk of padding. Without rows of both classes every score is the share of label 1 among
the labels. Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_batches, texts_of
from tallyloom.llm.learning import label_share, labelled_sample, sigmoid

CHUNK, STRIDE, WIDTH = 256, 192, 4
DEPTH, FILTERS = 8, 24
EPOCHS, LEAST_STEPS, EPOCH_CHUNKS, BATCH, RATE = 8, 400, 6, 64, 0.01
#: Chunks that are scored at once inside a task.
_BLOCK = 256


@dataclass
class Net:
    embed: np.ndarray  # 256 x DEPTH
    conv: np.ndarray  # WIDTH x DEPTH x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    base: float
    shift: float = 0.0  # from the sample's share of label 1 to that of the labels

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses to the first and last two bytes of a window, by byte pair."""
        each = [(self.embed @ self.conv[k]).astype(np.float32) for k in range(WIDTH)]
        return tuple((a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS) for a, b in (each[:2], each[2:]))


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping chunks of a text, the last padded with zeros; any WIDTH bytes lie whole in one of them."""
    n = max(1, -(-max(len(raw) - CHUNK, 0) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def chunk_logits(x: np.ndarray, net: Net, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    best = np.empty((len(x), FILTERS), np.float32)
    for i in range(0, len(x), 16):
        p = pairs[i : i + 16]
        h = tables[0].take(p[:, :-2], axis=0)
        h += tables[1].take(p[:, 2:], axis=0)
        best[i : i + 16] = h.max(axis=1)
    return np.maximum(best + net.bias, 0) @ net.out + net.base


def _forward(x: np.ndarray, net: Net):
    tables = [net.embed @ net.conv[k] for k in range(WIDTH)]
    n = CHUNK - WIDTH + 1
    h = sum(tables[k][x[:, k : k + n]] for k in range(WIDTH))
    at = h.argmax(axis=1)
    raw = np.take_along_axis(h, at[:, None, :], axis=1)[:, 0] + net.bias
    return at, raw, np.maximum(raw, 0) @ net.out + net.base


def train(sample: pd.DataFrame, share: float, seed: int = 5) -> Net:
    """Fit by Adam on the mean log loss of texts, both classes weighing the same."""
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.5, (256, DEPTH)),
        rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH, DEPTH, FILTERS)),
        np.zeros(FILTERS),
        rng.normal(0, 0.1, FILTERS),
        0.0,
    )
    y = sample["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        net.out[:], net.base = 0, float(np.log(share / (1 - share)))
        return net
    texts = [chunks(t.encode()) for t in sample["text"]]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    names = ("embed", "conv", "bias", "out")
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names} | {"base": [0.0, 0.0]}
    steps = 0
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(texts))):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            picked = [t if len(t) <= EPOCH_CHUNKS else t[np.sort(rng.choice(len(t), EPOCH_CHUNKS, replace=False))] for t in (texts[r] for r in rows)]
            counts = np.array([len(p) for p in picked])
            x = np.concatenate(picked)
            of = np.repeat(np.arange(len(rows)), counts)
            at, raw, logit = _forward(x, net)
            mean = np.bincount(of, logit, len(rows)) / counts
            slope = ((sigmoid(mean) - y[rows]) * balance[rows] / len(rows) / counts)[of]
            back = (slope[:, None] * net.out[None, :]) * (raw > 0)
            grads = {"out": np.maximum(raw, 0).T @ slope, "bias": back.sum(axis=0), "base": slope.sum()}
            grads["embed"], grads["conv"] = np.zeros_like(net.embed), np.zeros_like(net.conv)
            column = np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                cell = np.take_along_axis(x, at + k, axis=1).astype(np.int64) * FILTERS + column
                table = np.bincount(cell.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                grads["embed"] += table @ net.conv[k].T
                grads["conv"][k] = net.embed.T @ table
            steps += 1
            for k, g in grads.items():
                m, v = state[k]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                state[k] = [m, v]
                moved = RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
                setattr(net, k, getattr(net, k) - moved)
    net.shift = float(np.log(share / (1 - share)))
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batch):
        tables = net.tables()
        out = []
        pending, owner, rows = [], [], 0

        def close():
            logits = chunk_logits(np.concatenate(pending), net, tables)
            np.add.at(sums, np.repeat(owner, [len(p) for p in pending]), logits)

        texts = texts_of(batch.column(1))
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for i, raw in enumerate(texts):
            cut = chunks(raw)
            counts[i] = len(cut)
            pending.append(cut)
            owner.append(i)
            rows += len(cut)
            if rows >= _BLOCK:
                close()
                pending, owner, rows = [], [], 0
        if pending:
            close()
        out = sigmoid(sums / np.maximum(counts, 1) + net.shift)
        yield pa.record_batch([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2000, max_bytes: int = 32_768, label: str = "quality"
) -> DataFrame:
    """(doc_id, score) of every row, learned from the labelled rows that `learn` allows."""
    sample = labelled_sample(docs, labels, label, learn, per_class, max_bytes)
    return score(docs, train(sample, label_share(labels, label, learn)))
