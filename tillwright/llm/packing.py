"""Packing tokens into sequences by Karmarkar-Karp multiway differencing.

A document's tokens past its last full sequence are an item. Items are gathered into blocks; a block
is split into windows by largest differencing: the two partial partitions with the largest spread are
merged, the larger windows of one with the smaller windows of the other, until one partition is left,
whose windows are near-equal. While a window exceeds the capacity, the number of windows rises by one and
differencing runs again, so items stay whole. What that leaves empty would be padding: as many windows
as hold a block's tokens when full are kept, the heaviest, and the items of the few lighter ones go into
their room, cut only there. Less than a window is left over and waits for the next block; after the last
block of a partition it is cut into sequences whose lengths are powers of two, the longest first. All blocks, full or
not, go the same way. A block is bounded (BLOCK_WINDOWS windows), tokens are never shuffled, and a lost
task is repeated from its input alone.

Defined cases: null text is empty and is one token, the end id; repeated rows are packed once each; a
very long text is cut into full sequences first, and only its rest is an item; rows with a null id are
packed as others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches

CAPACITY = 2048
END_ID = 1
BLOCK_WINDOWS = 128
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in k windows of near-equal sums."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]  # windows of a partition: (sum, tree of items), largest first; the rest are empty
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(a) + len(b) - k  # so many windows of a must share with one of b
        if both > 0:
            free_a, free_b = len(a) - both, len(b) - both
            mixed = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[free_a:], reversed(b[free_b:]))]
            merged = a[:free_a] + b[:free_b] + mixed
        else:
            merged = a + b
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def balance(sizes: list[int], capacity: int) -> list[list[int]]:
    """Whole items (each of ``capacity`` at most) in near-equal windows, as many as it takes for none
    to exceed the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


def fill(windows: list[list[int]], sizes: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of pieces (item, start, length), and the pieces left over, less than a window. The heaviest
    windows stay and the items of the others fill their room; only those are cut."""
    full = sum(sizes) // capacity
    weight = lambda w: sum(sizes[i] for i in w)
    windows = sorted(windows, key=weight, reverse=True)
    over = [(i, 0, sizes[i]) for w in reversed(windows[full:]) for i in w if sizes[i]]
    out = []
    for w in windows[:full]:
        kept, room = [(i, 0, sizes[i]) for i in w if sizes[i]], capacity - weight(w)
        while room:
            i, start, n = over.pop()
            m = min(n, room)
            kept.append((i, start, m))
            room -= m
            if m < n:
                over.append((i, start + m, n - m))
        out.append(kept)
    return out, over


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Windows of the pieces whose lengths are powers of two, the longest first."""
    total, out, todo = sum(n for _, _, n in pieces), [], list(reversed(pieces))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        window = []
        while room:
            i, start, n = todo.pop()
            m = min(n, room)
            window.append((i, start, m))
            room -= m
            if m < n:
                todo.append((i, start + m, n - m))
        out.append(window)
    return out


class Encoder:
    """Ids as little-endian 32-bit bytes by a byte-level BPE vocabulary file of the tokenizers library,
    with END_ID at each text's end. Added tokens inside a text become their ids, the library's default.

    The file's ranks are handed to the faster byte-pair engine of tiktoken; it gives the library's ids
    for this kind of file: one whose merges stand in the order of their ids, each id but the single bytes'
    made by exactly one of them (checked on the whole file). A probe text is compared too. If the probe or
    the file's kind differs, the library itself encodes.
    """

    PROBE = " It's 3rd  of\n\n\tMärz 2024,\u3000x\u00a0 y'll…  \U0001f600 aaaaaaaaaaaa 1234567   \n"

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.engine = self._engine(vocabulary)
        if self.engine and self.engine(self.PROBE) != self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids:
            self.engine = None

    def _engine(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model["type"] != "BPE" or not plain:
            return None
        made = [model["vocab"].get("".join(pair.split(" ") if isinstance(pair, str) else pair)) for pair in model["merges"]]
        whole = [i for token, i in model["vocab"].items() if len(token) > 1 and token not in self.added]
        if made != sorted(whole):
            return None
        # the file writes each byte as one printable character: its own where it has one, else 256, 257, ... in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.engine is None:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.split is None or not any(t in text for t in self.added):
            return self.engine(text)
        return [i for part in self.split.split(text) for i in ([self.added[part]] if part in self.added else self.engine(part))]

    def encode(self, text: str) -> bytes:
        return np.array(self.ids(text) + [END_ID], "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces (PIECES) of all documents; with_ids also the ids of each piece. Sequences are
    numbered within the partition, whose number stands in the upper bits of the sequence_id."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first = encoder(vocabulary), TaskContext.get().partitionId() << 32
        done, rows = 0, []
        waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        tokens = 0

        def put(window: list[tuple]) -> None:
            nonlocal done
            offset = 0
            for doc, start, ids, doc_tokens in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), doc_tokens, first + done, offset) + ((ids,) if with_ids else ()))
                offset += n
            done += 1

        def piece(i: int, start: int, n: int) -> tuple:
            doc, at, ids, doc_tokens = waiting[i]
            return doc, at + start, ids[4 * start : 4 * (start + n)], doc_tokens

        def block(last: bool) -> None:
            nonlocal waiting, tokens
            sizes = [len(x[2]) // 4 for x in waiting]
            windows, left = fill(balance(sizes, capacity), sizes, capacity)
            for w in windows + (powers(left) if last else []):
                put([piece(*p) for p in w])
            waiting = [] if last else [piece(*p) for p in left]
            tokens = sum(len(x[2]) // 4 for x in waiting)

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc, text in zip(ids_of, texts):
                ids = enc.encode(text or "")
                n = len(ids) // 4
                full = n - n % capacity
                for start in range(0, full, capacity):
                    put([(doc, start, ids[4 * start : 4 * (start + capacity)], n)])
                if full < n:
                    waiting.append((doc, full, ids[4 * full :], n))
                    tokens += n - full
                if tokens >= BLOCK_WINDOWS * capacity:
                    block(False)
            if rows:
                yield out()
                rows = []
        block(True)
        if rows:
            yield out()

    schema = PIECES + ", ids binary" * with_ids
    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, schema)
