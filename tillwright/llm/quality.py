"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is computed in time
linear in the inputs as half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2. Inputs x: the square
root of each hashed word's share of the text, statistics of the whole text (classes of bytes, word
lengths, repetition, lines), and the metadata the row itself carries (n_chars and how far it is from
the text's length). Labels, lang, source and doc_id are no inputs.

Fitted on the driver from a bounded sample (PER_CLASS rows of each label). Defined cases: null text is
empty and is scored like any text; a null or absent n_chars is one of its own; without labels of both
kinds every score is the share of label 1 among those there are (0.5 without any); a null id is not
held out; repeated rows are scored alike; a very long text is read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, bounded_batches, id_crc
from .labelled import labelled_sample

WORDS = 1024
FACTORS = 8
PER_CLASS = 4000
EPOCHS = 25
_LETTERS = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), [32], [10], b".,;:?", b"!", b"#$%&*@^~", b"|/\\<>{}[]=_+", b"'\"()-"]
STATS = len(_LETTERS) + 14
_CLASSES = np.zeros((256, len(_LETTERS)))
for _i, _of in enumerate(_LETTERS):
    _CLASSES[list(_of), _i] = 1


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % WORDS


_buckets = WordCache(_bucket, 150_000)


def _entropy(n: np.ndarray) -> float:
    p = n[n > 0] / n.sum()
    return float(-(p * np.log(p)).sum())


def features(text: str | None, n_chars: int | None) -> np.ndarray:
    """WORDS word inputs and STATS statistics of a text."""
    t = text or ""
    data = t.encode("utf-8", "replace")
    words = data.split()
    x = np.zeros(WORDS + STATS, np.float32)
    n = len(words)
    stats = np.zeros(STATS)
    if n:
        lowered = data.lower().split()
        x[:WORDS] = np.sqrt(np.bincount([_buckets[w] for w in lowered], minlength=WORDS) / n)
        hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        k = len(_LETTERS)
        stats[:k] = np.sqrt(hist @ _CLASSES / len(data))
        distinct = len(set(lowered))
        lines = data.split(b"\n")
        stats[k:] = [
            np.log1p(n) / 10, len(data) / n / 10, distinct / n, _entropy(hist) / 4,
            sum(a == b for a, b in zip(lowered, lowered[1:])) / n,
            len(set(zip(lowered, lowered[1:], lowered[2:]))) / max(1, n - 2), len(set(lines)) / len(lines), np.log1p(len(lines)) / 5,
            min(2.0, len(zlib.compress(data, 1)) / len(data)), max(map(len, lowered)) / 50 if n < 50 else min(4.0, max(map(len, lowered)) / 50),
            sum(w.isupper() for w in words) / n, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
            float(n_chars is None), 0.0 if n_chars is None else min(4.0, abs(np.log1p(max(0, n_chars)) - np.log1p(len(t)))),
        ]
    x[WORDS:] = np.clip(stats, -4, 4)
    return x


@dataclass
class Machine:
    """Parameters of a factorisation machine, and the mean and spread of the statistics."""

    mean: np.ndarray
    spread: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, WORDS:] = np.clip((x[:, WORDS:] - self.mean) / self.spread, -5, 5) / 3
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s).sum(axis=1) - (x * x) @ (self.v * self.v).sum(axis=1))

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.scaled(raw)).astype(float), -40, 40)))


def fit(raw: np.ndarray, y: np.ndarray, seed: int = 5) -> Machine:
    """By Adam on the logistic loss with both labels weighing the same; rows in random order, fixed by the seed."""
    some = raw[:, WORDS:] if len(raw) else np.zeros((1, raw.shape[1] - WORDS))
    mean, spread = some.mean(axis=0), some.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    d = raw.shape[1]
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        zero = np.zeros(d, np.float32)
        return Machine(mean, spread, float(np.log(p / (1 - p))), zero, np.zeros((d, FACTORS), np.float32))
    m = Machine(mean, spread, 0.0, np.zeros(d, np.float32), rng.normal(0, 0.01, (d, FACTORS)).astype(np.float32))
    x = m.scaled(raw)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (np.zeros(1), m.w, m.v)]
    step = 0
    for epoch in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            b, step = x[at], step + 1
            s = b @ m.v
            p = 1 / (1 + np.exp(-np.clip(m.margin(b), -40, 40)))
            g = ((p - y[at]) * weight[at] / len(at)).astype(np.float32)
            b2 = b * b
            grads = [np.array([g.sum()]), b.T @ g + 1e-4 * m.w, b.T @ (g[:, None] * s) - m.v * (b2.T @ g)[:, None] + 1e-3 * m.v]
            params = [np.array([m.bias]), m.w, m.v]
            rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
            for i, (p_, g_, (a, q)) in enumerate(zip(params, grads, state)):
                a *= 0.9
                a += 0.1 * g_
                q *= 0.999
                q += 0.001 * g_ * g_
                new = p_ - rate * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-7)
                if i == 0:
                    m.bias = float(new[0])
                elif i == 1:
                    m.w = new.astype(np.float32)
                else:
                    m.v = new.astype(np.float32)
    return m


def _inputs(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), n.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Machine:
    """Fit on the labelled rows outside the held-out fold. Inputs are made on the executors."""
    sample = labelled_sample(_inputs(docs), labels, label, folds, held_out, per_class, ["text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t, n).astype(np.float16).tobytes() for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    bounded_batches(docs.sparkSession)
    got = sample.select("doc_id", "y", "text", "n_chars").mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WORDS + STATS).astype(np.float32)
    return fit(x, np.array(got.column("y").to_pylist(), np.float32))


def scores(machine: Machine, texts: list[str | None], n_chars: list[int | None]) -> np.ndarray:
    """Scores of a batch, 256 texts at a time."""
    parts = [machine.score(np.stack([features(t, n) for t, n in zip(texts[i : i + 256], n_chars[i : i + 256])])) for i in range(0, len(texts), 256)]
    return np.concatenate(parts) if parts else np.zeros(0)


def classify(docs: DataFrame, machine: Machine, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(machine, b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = _inputs(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(id_crc(F.col("doc_id")) % folds == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns as they were, in one pass."""
    bounded_batches(docs.sparkSession)
    i, names = docs.columns.index("text"), docs.columns
    j = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(j).to_pylist() if j is not None else [None] * b.num_rows
            s = scores(machine, b.column(i).to_pylist(), n)
            yield b.filter(pa.array(s >= least))

    return docs.mapInArrow(run, docs.schema)
