"""Helpers for classifiers: a bounded labelled sample, and logistic regression on a few features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_bytes: int) -> pd.DataFrame:
    """At most `per_class` rows of each label, as (text, y, draw), in an order drawn by a hash of the id.

    The rows are chosen from the labels alone (`learn` says which may be used) and then looked up in the
    documents, so what is broadcast and what reaches the driver are bounded by the two limits. Documents longer
    than `max_bytes` are not learned from; they are scored like any other.
    """
    rows = labels.where(F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(11), "doc_id"))
    chosen = rows.where("y = 0").orderBy("draw", "doc_id").limit(per_class).unionByName(
        rows.where("y = 1").orderBy("draw", "doc_id").limit(per_class)
    )
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    found = texts.join(F.broadcast(chosen), "doc_id").orderBy("draw", "doc_id").limit(2 * per_class).select("text", "y", "draw")
    return found.toPandas()


def label_share(labels: DataFrame, label: str, learn: Column) -> float:
    """Share of label 1 among the rows that may be learned from."""
    share = labels.where(F.col(label).isin(0, 1) & learn).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if share is None else min(max(share, 0.001), 0.999)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    damp = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + damp @ w
        bend = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + damp
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
