"""Token counts by prefix dynamic programming over a SentencePiece BPE vocabulary.

The encoding of a prefix ends with exactly one token, and what comes before that token is the
encoding of the shorter prefix. So ``count[i] = count[i - len(t)] + 1`` for the one token t that ends
at i and can follow the last token of the prefix before it; two tokens can follow each other if the
merges of their joined text give them back. One pass over a text gives the count of every prefix,
which answers "how many tokens have the first n characters" and "how many characters fit a budget of
k tokens" by a look-up or a bisection, with no further encoding.

No piece of the vocabulary has a space mark after another character, so a text falls into runs of
space marks, each followed by a word, that are solved one by one and kept by word. Characters
without a piece count as many tokens as they have UTF-8 bytes and nothing merges across them.

Defined cases: null text is empty and has no token; an empty text has none; special strings are
ordinary text; a null id is kept; repeated rows are counted alike; a very long text is counted whole, in
memory in proportion to it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordCache, bounded_batches

SPACE = "▁"
#: Characters of a word up to which solved prefixes are kept.
STEM = 7
_SEGMENT = re.compile(f"({SPACE}*)([^{SPACE}]*)")


class PrefixCounter:
    """Counts for one vocabulary. ``model``: path of a SentencePiece BPE model with byte fallback,
    an identity normaliser and a dummy prefix."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        scored = sorted(
            (-sp.get_score(i), i, sp.id_to_piece(i))
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        )
        #: rank of a piece: merges that make lower ranks come first. Equal scores, which only runs of
        #: space marks have, share a rank.
        self.rank: dict[str, int] = {}
        for n, (score, _, piece) in enumerate(scored):
            self.rank[piece] = n if not n or score != scored[n - 1][0] else self.rank[scored[n - 1][2]]
        self.longest = max(map(len, self.rank))
        self.span = len(scored) + 1
        # by rank: the ranks of the two pieces whose merge makes a piece (itself, if a character), and
        # whether merging its characters makes it at all
        self.left, self.right, self.made = list(range(self.span)), list(range(self.span)), [True] * self.span
        self.join: dict[int, int] = {}
        #: by string: the rank of the piece, or -1 if it is only the end of one
        self.ends: dict[str, int] = {}
        self.sizes = [1] * self.span
        for piece, r in self.rank.items():
            for k in range(1, len(piece)):
                a, b = self.rank.get(piece[:k]), self.rank.get(piece[k:])
                if a is not None and b is not None:
                    self.join[a * self.span + b] = r
                self.ends.setdefault(piece[k:], -1)
            self.ends[piece] = r
            self.sizes[r] = len(piece)
            if len(piece) > 1 and SPACE * 2 not in piece:
                parts = self.merge(piece, 2)
                if len(parts) == 2 and parts[0] in self.rank and parts[1] in self.rank:
                    self.left[r], self.right[r] = self.rank[parts[0]], self.rank[parts[1]]
                else:
                    self.made[r] = False
        self.follows = WordCache(self._follows, 500_000)
        self.words = WordCache(self._word, 250_000)
        self.stems = WordCache(None, 100_000)
        self.longest_run = max(len(p) for p in self.rank if not p.strip(SPACE))
        self.runs = [0] + [len(self.merge(SPACE * k)) for k in range(1, self.longest_run + 1)]

    def merge(self, text: str, until: int = 1) -> list[str]:
        """The pieces of ``text`` by merging, as encoding does, or when ``until`` are left. For short strings."""
        parts, rank = list(text), self.rank
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, pair: int) -> bool:
        """Whether no merge across the border of two pieces comes before those that make them. Undoes
        the later of their last merges until the border's pair would have merged, or both are characters."""
        a, b = divmod(pair, self.span)
        join, left, right, limit = self.join, self.left, self.right, self.span
        while True:
            r = join.get(a * self.span + b)
            if r is not None and r < limit:
                return False
            undo_a = right[a] != a and (a > b or left[b] == b)
            if undo_a:
                limit, a = a, right[a]
            elif left[b] != b:
                limit, b = b + 1, left[b]
            else:
                return True

    def _extend(self, word: str, counts: list[int], last: list[int]) -> None:
        """Go on from the solved prefixes (0 to len(counts) - 1 characters) to the whole word. Only one
        token can end at a place, so the shorter ones are tried first, up to where no piece ends so."""
        ends, follows, made, span = self.ends, self.follows, self.made, self.span
        for i in range(len(counts), len(word) + 1):
            for j in range(i - 1, -1, -1):
                t = ends.get(word[j:i])
                if t is None:
                    j = -1
                    break
                if t >= 0 and made[t]:
                    before = last[j]
                    if before < 0 or follows[before * span + t]:
                        counts.append(counts[j] + 1)
                        last.append(t)
                        break
            else:
                j = -1
            if j < 0:  # a character without a piece
                counts.append(counts[i - 1] + len(word[i - 1].encode("utf-8", "replace")))
                last.append(-1)

    def solve(self, word: str) -> tuple[list[int], list[bool]]:
        """For each prefix of a word: its tokens, and whether the first of them is one character."""
        counts, last, alone = [0], [-1], [False]
        self._extend(word, counts, last)
        for i in range(1, len(word) + 1):
            t = last[i]
            size = self.sizes[t] if t >= 0 else 1
            alone.append(size == 1 if size == i else alone[i - size])
        return counts, alone

    def _word(self, word: str) -> bytes:
        """Steps of a space mark and a word: the count of each prefix less that of the one before, as
        signed bytes. Goes on from the longest known stem."""
        stems, k = self.stems, min(len(word) - 1, STEM)
        while k > 1 and word[:k] not in stems:
            k -= 1
        if k > 1:
            counts, last = map(list, stems[word[:k]])
        else:
            counts, last = [0], [-1]
        known = len(counts)
        self._extend(word, counts, last)
        for i in range(max(known, 2), min(len(word), STEM + 1)):
            stems.put(word[:i], (counts[: i + 1], last[: i + 1]))
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])

    def _run(self, k: int) -> int:
        """Tokens of k space marks and nothing after them: the longest run again and again from the left."""
        full, rest = divmod(k, self.longest_run)
        return full + self.runs[rest]

    def _long(self, marks: int, word: str) -> bytes:
        """Steps for several space marks and a word. The last mark belongs to the word where merges
        join them, else to the run before it."""
        counts = [self._run(i) for i in range(1, marks + 1)]
        own, alone = self.solve(SPACE + word)
        for i in range(2, len(own)):
            counts.append(self._run(marks) + own[i] - 1 if alone[i] else self._run(marks - 1) + own[i])
        steps = [b - a for a, b in zip([0, *counts], counts)]
        return bytes(x & 255 for x in steps)

    def steps(self, text: str) -> bytes:
        """For each character: tokens of the prefix up to it less those of the prefix before it, as
        a signed byte. The first belongs to the space mark that encoding puts before every text."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        parts = marked.split(SPACE)[1:]
        words = self.words
        if "" not in parts:  # no two spaces in a row: the usual case
            return b"".join([words[SPACE + w] for w in parts])
        out = []
        for marks, word in _SEGMENT.findall(marked):
            if len(marks) <= 1:
                out.append(words[marks + word] if marks + word else b"")
            else:
                out.append(self._long(len(marks), word))
        return b"".join(out)


def prefix_counts(steps: bytes) -> np.ndarray:
    """Tokens of each prefix, of 0, 1, 2, ... characters, from what ``steps`` gives."""
    if not steps:
        return np.zeros(1, np.int64)
    counts = np.cumsum(np.frombuffer(steps, np.int8).astype(np.int64))
    return np.concatenate([[0], counts[1:]])


def longest_prefix(steps: bytes, budget: int) -> int:
    """Most characters such that this prefix and all shorter ones have ``budget`` tokens at most.
    (A count may fall by a character that completes a long piece, so later prefixes may fit too.)"""
    top = np.maximum.accumulate(prefix_counts(steps))
    return int(np.searchsorted(top, budget, side="right")) - 1


_counters: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """One per Python worker and vocabulary."""
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def count_tokens(docs: DataFrame, model: str, with_steps: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of each whole text; with_steps also the prefix table (``steps``)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            steps = [c.steps(t) if t else b"" for t in texts]
            tokens = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            sizes = [len(t.encode("utf-8")) if t else 0 for t in texts]
            cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(steps, pa.binary())] if with_steps else []), ["doc_id", "n_bytes", "n_tokens", "steps"][: 3 + with_steps])

    schema = "doc_id long, n_bytes long, n_tokens long" + ", steps binary" * with_steps
    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, schema)
