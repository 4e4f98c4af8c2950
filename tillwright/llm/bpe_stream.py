"""Byte-pair encoding and decoding as streaming transducers with bounded lookahead.

Encoding reads the symbols of a word from left to right and emits a token as soon as no further symbol
can change it. How far it must look is a property of the merge list alone. Two runs over texts that
agree on their first n symbols differ, at every merge, only to the right of an edge; the merge (u, v)
can move that edge to the left only where u stands at the edge and v begins with what stood there
before. The pairs of one chain have falling priority, so the longest chain, by the symbols of its left
parts, bounds the way back: ``lookahead`` finds it in one pass over the list. Tokens that end further
back than that are emitted, what follows them is merged again with the next symbols (the tokens of
a suffix that starts at a token are the suffix of the tokens), and memory is the same at any length.

Normalising and splitting are those of the vocabulary file, done by the library's own parts, on pieces
cut where neither a composed character nor a match of the splitting pattern can span the cut. Words
and the blank-free chunks they come from are kept in bounded caches.

Decoding is a state machine that takes one id at a time: ``Joiner`` writes the token strings as the
library does for a vocabulary without a decoder, ``TextDecoder`` turns their byte letters into text
and holds at most the three bytes of an unfinished character.

Defined cases: null text is empty; an empty text has no token and decodes to an empty text; the
vocabulary's special strings are special tokens wherever they stand in a text; a null id is kept;
repeated rows get equal results; a very long text, even without any blank, is read block by block;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import WordCache, bounded_batches

#: Blanks that Python's split takes and the vocabulary's pattern doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Printable ASCII without the space, and the letters of Latin-1 that compose with nothing but marks.
SIMPLE = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Characters of a chunk that are read at once; chunks up to CACHED characters are kept.
BLOCK = 4096
CACHED = 40
#: Chunks, or ids of a long chunk, that are hashed at once.
STEP = 8192


def lookahead(merges: Iterable[tuple[str, str]], size: dict[str, int]) -> int:
    """Symbols that a token must lie behind the last one read to be final; ``size``: symbols of a token."""
    longest: dict[str, int] = {}  # by left part of the chain's last merge
    left: dict[str, str] = {}  # by token: the left part of the merge that makes it
    most = 0
    for u, v in merges:
        way, start = 0, v
        while start is not None:  # what v begins with, at any time of its making
            way, start = max(way, longest.get(start, 0)), left.get(start)
        way += size[u]
        longest[u] = max(longest.get(u, 0), way)
        left.setdefault(u + v, u)
        most = max(most, way)
    return most


class Vocabulary:
    """The parts of a tokenizer file that encoding and decoding need."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(self.merges)}
        self.made, self.none = [u + v for u, v in self.merges], len(self.merges)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        size = {t: len(t.removesuffix(self.end)) for t in self.ids}
        made = set()
        for u, v in self.merges:  # the proof needs parts that are made before they are used, each in one way
            if (size[u] > 1 and u not in made) or (size[v] > 1 and v not in made) or u + v in made:
                raise ValueError(f"not a proper merge list: {u} {v}")
            made.add(u + v)
        self.lookahead = lookahead(self.merges, size)
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        self.plain = _plain_pattern(spec)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None


def byte_letters() -> dict[str, int]:
    """Letter for each byte: printable Latin-1 characters stand for themselves, the others, in order,
    for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


#: By byte: the code of its letter.
LETTERS = {b: ord(c) for c, b in byte_letters().items()}


def _plain_pattern(spec: dict):
    """What splits a chunk of printable ASCII and Latin-1 letters after lower-casing, if the file's normaliser and splitter
    do to such a chunk no more than that (none of these letters changes by composing). Other chunks, and files, go
    through the library's parts."""
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    fits = (
        steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
        and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)])
    return regex.compile(split["pattern"]["Regex"]) if fits else None


class Transducer:
    """One word, in parts: ``feed`` takes symbols (the letters of its bytes) and returns the tokens that
    no further symbol can change; ``finish`` ends the word."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.keep = vocabulary.lookahead + 1  # the last symbol read becomes another one if the word ends there
        self.wait = 2 * self.keep
        self.held: list[str] = []

    def feed(self, symbols: str) -> list[str]:
        out: list[str] = []
        for i in range(0, len(symbols), self.wait):
            self.held.extend(symbols[i : i + self.wait])
            if len(self.held) >= self.wait:
                out.extend(self._stable())
        return out

    def _stable(self) -> list[str]:
        tokens, at, n = self.merge(self.held), 0, 0
        while at + len(tokens[n]) <= len(self.held) - self.keep:
            at += len(tokens[n])
            n += 1
        del self.held[:at]
        return tokens[:n]

    def finish(self) -> list[str]:
        if not self.held:
            return []
        self.held[-1] += self.v.end
        out, self.held = self.merge(self.held), []
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of a short run of symbols: merges by priority, from the left."""
        parts, get, made, none = list(symbols), self.v.rank.get, self.v.made, self.v.none
        found = [get(p, none) for p in zip(parts, parts[1:])]
        while found and (best := min(found)) != none:
            uv, i = made[best], found.index(best)
            while True:
                parts[i] = uv
                del parts[i + 1], found[i]
                if i:
                    found[i - 1] = get((parts[i - 1], uv), none)
                if i < len(found):
                    found[i] = get((uv, parts[i + 1]), none)
                if best not in found:
                    break
                i = found.index(best)
        return parts


def _cuts(chunk: str, block: int) -> Iterator[str]:
    """A long chunk in parts. A cut stands before a character that composes with nothing before it and
    after three characters without an apostrophe, so that no contraction spans it."""
    start = 0
    while len(chunk) - start > block:
        at = start + block
        while at < len(chunk) and (unicodedata.category(chunk[at])[0] == "M" or "\u1100" <= chunk[at] <= "\u11ff" or "'" in chunk[at - 3 : at + 1]):
            at += 1
        yield chunk[start:at]
        start = at
    if start < len(chunk):
        yield chunk[start:]


class Encoder:
    """Ids of texts under one vocabulary, as the library gives them without added special tokens."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.words = WordCache(self._word, 200_000)
        self.chunks = WordCache(self._chunk, 200_000)
        self.written = WordCache(self._written, 200_000)

    def _word(self, word: str) -> tuple[int, ...]:
        t, ids = Transducer(self.v), self.v.ids
        return tuple([ids[x] for x in [*t.feed(word), *t.finish()]])

    def split(self, piece: str) -> list[str]:
        """Words of a piece, normalised, in the letters that stand for bytes."""
        if self.v.plain is not None and SIMPLE.fullmatch(piece):
            words = self.v.plain.findall(piece.lower())
            return words if piece.isascii() else [w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(LETTERS) for w in words]
        return [w for w, _ in self.v.splitter.pre_tokenize_str(self.v.normalizer.normalize_str(piece))]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        words = self.split(chunk)
        return self.words[words[0]] if len(words) == 1 else tuple([i for w in words for i in self.words[w]])

    def _written(self, chunk: str) -> tuple[int, bytes, bytes]:
        """Number of ids of a chunk, the ids and the token strings, each with a space before it."""
        ids = self._chunk(chunk)
        return len(ids), b"".join([b" %d" % i for i in ids]), "".join([" " + self.v.token[i] for i in ids]).encode("utf-8")

    def _long(self, chunk: str) -> Iterator[int]:
        """A chunk block by block: a word goes on over a cut if both sides of it split as one word."""
        t, open_, before = Transducer(self.v), False, ""
        for piece in _cuts(chunk, BLOCK):
            words = self.split(piece)
            on = open_ and bool(words) and len(self.split(before + piece[:1])) == len(self.split(before))
            for k, w in enumerate(words):
                if open_ and not (k == 0 and on):
                    yield from (self.v.ids[x] for x in t.finish())
                yield from (self.v.ids[x] for x in t.feed(w))
                open_ = True
            last = len(piece) - 1
            while last and unicodedata.category(piece[last])[0] == "M":
                last -= 1
            before = piece[last:]  # a character with its marks
        yield from (self.v.ids[x] for x in t.finish())

    def _parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(special token, none) and (None, chunks) in order."""
        start = 0
        for m in self.v.special.finditer(text) if self.v.special else ():
            yield None, _chunks(text[start : m.start()])
            yield self.v.specials[m.group()], []
            start = m.end()
        yield None, _chunks(text[start:] if start else text)

    def encode(self, text: str) -> Iterator[int]:
        """The ids of ``text``, one after the other."""
        known = self.chunks
        for special, chunks in self._parts(text):
            if special is not None:
                yield special
            for c in chunks:
                yield from known[c] if len(c) <= CACHED else self._long(c)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text. Chunks are decoded one by one: the joiner's state
        between them is only whether anything was written, as a chunk's tokens are whole."""
        hashes, n = (hashlib.sha256(), hashlib.sha256()), 0

        def add(ids: bytes, decoded: bytes, count: int) -> None:
            nonlocal n
            for h, b in zip(hashes, (ids, decoded)):
                h.update(b if n else b[1:])  # no space before the first
            n += count

        known = self.written
        for special, chunks in self._parts(text):
            if special is not None:
                add(b" %d" % special, f" {self.v.token[special]}".encode(), 1)
            for start in range(0, len(chunks), STEP):
                some = chunks[start : start + STEP]
                if max(map(len, some)) <= CACHED:
                    found = [known[c] for c in some]
                    add(b"".join([f[1] for f in found]), b"".join([f[2] for f in found]), sum([f[0] for f in found]))
                else:
                    for c in some:
                        if len(c) <= CACHED:
                            add(known[c][1], known[c][2], known[c][0])
                        else:
                            self._add_long(c, add)
        return n, hashes[0].hexdigest(), hashes[1].hexdigest()

    def _add_long(self, chunk: str, add) -> None:
        ids = self._long(chunk)
        while some := list(islice(ids, STEP)):
            add(b"".join([b" %d" % i for i in some]), "".join([" " + self.v.token[i] for i in some]).encode("utf-8"), len(some))


def _chunks(text: str) -> list[str]:
    """The runs of a text without blanks."""
    return [c for c in BLANKS.split(text) if c] if SEPARATORS.search(text) else text.split()


class Joiner:
    """Token strings with one space between them: what the library decodes to without a decoder."""

    def __init__(self, vocabulary: Vocabulary):
        self.token, self.first = vocabulary.token, True

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids add; an id outside of the vocabulary adds nothing."""
        out = " ".join([self.token[i] for i in ids if i in self.token])
        if out and not self.first:
            out = " " + out
        self.first = self.first and not out
        return out


class TextDecoder:
    """Readable text of ids, one at a time: bytes of a token go through an incremental UTF-8 decoder,
    which holds those of an unfinished character; a word's end becomes a space."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.bytes = vocabulary, byte_letters()
        self.special = set(vocabulary.specials.values())
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.gap = False

    def feed(self, i: int) -> str:
        token = self.v.token.get(i)
        if token is None:
            return ""
        lead = " " if self.gap else ""
        if i in self.special:
            out, self.gap = self.utf8.decode(b"", True) + lead + token, True
            self.utf8.reset()
            return out
        ends = bool(self.v.end) and token.endswith(self.v.end)
        body = token.removesuffix(self.v.end) if ends else token
        out, self.gap = lead + self.utf8.decode(bytes([self.bytes[c] for c in body]), False), ends
        return out

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text; with_ids also the ids and the
    decoded text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [e.digests(t) for t in texts]
            cols = [b.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
            if with_ids:
                ids = [list(e.encode(t)) for t in texts]
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([Joiner(e.v).feed(i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, schema)
