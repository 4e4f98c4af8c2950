"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the presence of hashed character n-grams (ORDERS, of code points) of the text with
A-Z in lower case. Each is scaled by r = log of its smoothed share among the presences of toxic training
texts over that among the others. Of the n-grams that at least MIN_TEXTS training texts have, the SELECTED
ones with the largest abs(r) * sqrt(number of texts) are the inputs of a logistic regression: a large ratio
of few texts may be chance. The counts behind r are summed on the executors; the sample is bounded
(PER_CLASS rows of each label). With fewer than FULL sampled rows the penalty on weights is larger in
proportion (DECAY * FULL / rows), so few labels give a more cautious model.

Defined cases: null text is empty and is scored by the bias; without labels of both kinds every score
is the share of label 1 among those there are (0 without any); a null id is not held out; repeated rows
are scored alike; a very long text is read whole, in memory of its own size; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_crc
from .labelled import labelled_sample

ORDERS = (4, 5, 6)
BITS = 18
SELECTED = 4096
MIN_TEXTS = 5
PER_CLASS = 4000
SMOOTH = 1.0
EPOCHS = 40
DECAY, FULL = 2e-4, 4000
_MULT = np.uint32(0x9E3779B1)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of each order, one for each place in the text."""
    b = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    b[(b >= 65) & (b <= 90)] += np.uint32(32)
    h, k = np.full(len(b), 0x811C9DC5, np.uint32), 0
    for order in ORDERS:
        while k < order:
            h = (h[:-1] if k else h) * _MULT if len(h) else h
            h = h ^ (b[k : k + len(h)] + np.uint32(0x7F4A7C15))
            h = h ^ (h >> np.uint32(15))
            k += 1
        yield ((h * _MULT) >> np.uint32(32 - BITS)) ^ np.uint32(order * 0x9E5 & ((1 << BITS) - 1))
        if len(h) <= 1:
            return


def present(text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    mask = np.zeros(1 << BITS, bool)
    for g in grams(text):
        mask[g] = True
    return np.flatnonzero(mask)


@dataclass
class Linear:
    """``column``: the input of each bucket, or -1; ``weight``: of each input, r and w together."""

    column: np.ndarray
    weight: np.ndarray
    bias: float

    def inputs(self, text: str | None) -> np.ndarray:
        hits = [c[c >= 0] for c in (self.column[g] for g in grams(text))]
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[self.inputs(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def ratios(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of each n-gram from its texts of label 0 and 1."""
    return np.log((n1 + SMOOTH) / max(1.0, (n1 + SMOOTH).sum())) - np.log((n0 + SMOOTH) / max(1.0, (n0 + SMOOTH).sum()))


def fit(x: np.ndarray, y: np.ndarray, r: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """(weights of the presences, bias) by Adam on the logistic loss, both labels weighing the same."""
    rng = np.random.default_rng(seed)
    scale = r / max(1e-6, np.abs(r).max())
    w, bias, a, q, ab, qb, step = np.zeros(x.shape[1]), 0.0, 0.0, 0.0, 0.0, 0.0, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    decay = DECAY * max(1.0, FULL / len(y))
    for epoch in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            step += 1
            b = x[at].astype(np.float32) * scale.astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(b @ w + bias, -40, 40)))
            g = (p - y[at]) * weight[at] / len(at)
            gw, gb = b.T @ g + decay * w, g.sum()
            a, q = 0.9 * a + 0.1 * gw, 0.999 * q + 0.001 * gw * gw
            ab, qb = 0.9 * ab + 0.1 * gb, 0.999 * qb + 0.001 * gb * gb
            rate = 0.05 * (1 - epoch / EPOCHS) + 0.001
            f, s = 1 - 0.9**step, 1 - 0.999**step
            w = w - rate * (a / f) / (np.sqrt(q / s) + 1e-7)
            bias -= rate * (ab / f) / (np.sqrt(qb / s) + 1e-7)
    return w * scale, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Linear:
    """Fit on the labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, label, folds, held_out, per_class, ["text"]).select("doc_id", "y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n[y, present(t)] += 1
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "n0", "n1"])

    sums = sample.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = sums.filter(F.col("n0") + F.col("n1") >= MIN_TEXTS).toArrow()  # 2**BITS rows at most
    bucket, n0, n1 = (got.column(c).to_numpy() for c in ("bucket", "n0", "n1"))
    r = ratios(n0, n1)
    top = np.lexsort((bucket, -np.abs(r) * np.sqrt(n0 + n1)))[:SELECTED]
    column = np.full(1 << BITS, -1, np.int32)
    column[bucket[top]] = np.arange(len(top))
    chosen = Linear(column, np.zeros(len(top)), 0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [chosen.inputs(t).astype("<u2").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    data = sample.mapInArrow(rows, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    y = np.array(data.column("y").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Linear(np.full(1 << BITS, -1, np.int32), np.zeros(1), float(np.log(p / (1 - p))))
    x = np.zeros((len(y), len(top)), np.uint8)
    for i, ids in enumerate(data.column("x").to_pylist()):
        x[i, np.frombuffer(ids, "<u2")] = 1
    weight, bias = fit(x, y, r[top])
    return Linear(column, weight, bias)


def classify(docs: DataFrame, model: Linear, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(id_crc(F.col("doc_id")) % folds == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
