"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Over every window of five bytes, six triplets that hold the window's first byte are hashed, each kind
with its own salt, and counted in BUCKETS buckets. A bucket is encoded by the quartile of all buckets
in which its count lies (two bits); a header holds the length on a logarithmic scale and the ratios
of the quartiles. Two digests differ by the sum over buckets of the distance of their quartiles (0,
1, 2 or FAR) and of the header's parts, each bounded; likeness is one less the difference over its
largest value, so it lies in 0..1 and equal texts have likeness 1.

Defined cases: null text is empty; texts of fewer than five bytes have no window, so all counts are
0; the next document is the one with the next larger doc_id, null ids last, repeated ids ordered by
text; the document after the last is the first, so a single row is
its own next; repeated rows follow each other; a very long text is read once, whole; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, deal_ranges, range_count

BUCKETS = 256
#: Fixed by this digest's format: places in the window of a triplet's second and third byte, and salts.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
FAR = 6
_STEP = np.array([[0, 1, 2, FAR], [1, 0, 1, 2], [2, 1, 0, 1], [FAR, 2, 1, 0]], np.int64)
_HEADER_MOST = (48, 12, 12)
MOST = BUCKETS * FAR + sum(_HEADER_MOST)
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def counts(data: bytes) -> np.ndarray:
    """Triplets by bucket."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(b) - 4
    out = np.zeros(BUCKETS, np.int64)
    if n <= 0:
        return out
    first = b[:n] * _M1
    for salt, (i, j) in enumerate(TRIPLETS):
        x = first + b[i : i + n] * _M2 + b[j : j + n] * _M3 + np.uint32(salt * 0x27D4EB2F)
        x ^= x >> np.uint32(15)
        x *= _M1
        out += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(data: bytes) -> np.ndarray:
    """Header (length code, two quartile ratios in sixteenths) and a code 0..3 for each bucket."""
    c = counts(data)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (c[:, None] > q).sum(axis=1)
    length = min(255, round(8 * np.log2(1 + len(data))))
    ratios = (q[:2] * 16) // max(1, int(q[2]))
    return np.concatenate([[length], ratios, codes]).astype(np.int64)


def to_text(d: np.ndarray) -> str:
    codes = d[3:].reshape(-1, 4)
    packed = (codes << np.array([6, 4, 2, 0])).sum(axis=1).astype(np.uint8)
    return bytes(d[:3].astype(np.uint8)).hex() + packed.tobytes().hex()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(s), np.uint8).astype(np.int64)
    return np.concatenate([raw[:3], ((raw[3:, None] >> np.array([6, 4, 2, 0])) & 3).ravel()])


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 (equal digests) to MOST."""
    head = sum(min(int(abs(x - y)), most) for x, y, most in zip(a[:3], b[:3], _HEADER_MOST))
    return head + int(_STEP[a[3:], b[3:]].sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b) / MOST


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text (the second half replaced by the start of the
    next document) and its likeness to that and to the next document.

    Rows are dealt once, by ranges of (id, start of the text) whose bounds are actual keys; the first rows
    of a range go also to the range before it, and those of all to the last, so that each range finds the
    successor of its last row within itself and streams through in order with one row held back. Null and
    repeated ids are spread by their texts; only rows with one id and one start share a range.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.substring("text", 1, 32).alias("start")))
    n, parts = range_count(rows, F.octet_length("text"))
    ordered = deal_ranges(rows, n, parts, (("first", -1),), wrap=True).sortWithinPartitions("turn", "k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (doc_id, text, digest), not yet returned
        for batch in batches:
            out = []
            for doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is None and not own:
                    continue
                d = held[2] if held is not None and held[1] == text else digest(text.encode("utf-8", "replace"))
                if held is not None:
                    out.append(_row(held, text, d))
                held = (doc, text, d) if own else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], [x.split()[0] for x in OUT.split(", ")])

    return ordered.select("doc_id", "text", "own").mapInArrow(run, OUT)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _row(held: tuple, after: str, after_digest: np.ndarray) -> tuple:
    doc, text, d = held
    n = len(text)
    edited = (text[: n - n // 2] + after[: n // 2]).encode("utf-8", "replace")
    e = digest(edited)
    return doc, n, hashlib.sha256(edited).hexdigest(), to_text(d), to_text(e), likeness(d, e), likeness(d, after_digest)
