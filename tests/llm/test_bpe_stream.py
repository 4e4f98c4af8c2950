import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwright.llm import bpe_stream as bs

from .cases import empty, frame, rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab the's 're ing  éé\n\t1230▁\U0001d4b3rtion.Ü,'!'ll가가\x1c\x85İßΣς中文字がx 　"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ALPHABET), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|end", "'s"])), max_size=50).map("".join))
def test_ids_and_decoding_are_the_librarys(library, t):
    e = bs.encoder(PATH)
    ids = list(e.encode(t))
    assert ids == library.encode(t, add_special_tokens=False).ids
    assert bs.Joiner(e.v).feed(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["abcdeth", "x", "中文字", "!?'.", "aé́'st", "inthe'", "ab'sre!", "123", "é"])
def test_chunks_without_blanks_go_block_by_block(library, monkeypatch, letters):
    e, rng = bs.encoder(PATH), random.Random(3)
    for block in (29, 64, 4096):
        monkeypatch.setattr(bs, "BLOCK", block)
        for n in (41, 300, 5000):
            t = "".join(rng.choice(letters) for _ in range(n))
            assert list(e.encode(t)) == library.encode(t, add_special_tokens=False).ids


def small() -> bs.Vocabulary:
    return bs.encoder(PATH).v


def test_lookahead_of_lists_with_known_chains():
    size = {t: len(t) for t in ("a", "b", "ab", "aba", "x")}
    assert bs.lookahead([("a", "b")], size) == 1
    # 'ab' stands at the edge, then what stands before it may take it: 2 + 1 symbols back
    assert bs.lookahead([("b", "x"), ("a", "b")], {"a": 1, "b": 1, "x": 1}) == 2
    assert bs.lookahead([("a", "b"), ("b", "x")], {"a": 1, "b": 1, "x": 1}) == 1
    assert bs.lookahead([], {}) == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=200), st.lists(st.integers(0, 10**6), min_size=1, max_size=14), st.lists(st.integers(1, 30), min_size=1, max_size=20))
def test_tokens_emitted_are_final_for_any_list(word, picks, cuts):
    """Random proper merge lists, with their own lookahead: words fed in any parts give the tokens of the whole."""
    tokens, merges = ["a", "b", "c"], []
    for p in picks:
        u, v = tokens[p % len(tokens)], tokens[p // 97 % len(tokens)]
        if u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    v = bs.Vocabulary.__new__(bs.Vocabulary)
    v.end, v.merges, v.rank = "", merges, {m: i for i, m in enumerate(merges)}
    v.made, v.none = [a + b for a, b in merges], len(merges)
    v.lookahead = bs.lookahead(merges, {t: len(t) for t in tokens})
    t, out, at, most = bs.Transducer(v), [], 0, 0
    for k in cuts * 20:
        out += t.feed(word[at : at + k])
        at += k
        most = max(most, len(t.held))
    out += t.feed(word[at:]) + t.finish()
    parts = list(word)
    for a, b in merges:  # merges one after the other, each from the left
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    assert out == parts and most <= 3 * t.wait


def test_memory_of_a_word_is_constant():
    t, held = bs.Transducer(small()), []
    rng = random.Random(1)
    for _ in range(60):
        t.feed("".join(rng.choice("abĠthing") for _ in range(997)))
        held.append(len(t.held))
    assert max(held) < t.wait


def test_improper_lists_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    merges = spec["model"]["merges"]
    merges[0], merges[-1] = merges[-1], merges[0]
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bs.Vocabulary(str(tmp_path / "other.json"))


def test_text_decoder_gives_the_words_back():
    e = bs.encoder(PATH)
    for text in ("Hello, naïve WORLD 42", "中文 \U0001f642 été", "it's <|endoftext|> fine", ""):
        d = bs.TextDecoder(e.v)
        out = "".join(d.feed(i) for i in e.encode(text)) + d.finish()
        want = " ".join(w for w in _readable(e, text))
        assert out.strip() == want
    d = bs.TextDecoder(e.v)
    part = e.v.ids["ä"]  # the first byte of a three-byte character, then the end
    assert d.feed(part) == "" and d.finish() == "�" and bs.TextDecoder(e.v).feed(10**9) == ""


def _readable(e, text):
    letters = bs.byte_letters()
    for m in [*(e.v.special.split(text))]:
        for w in e.split(m):
            yield bytes(letters[c] for c in w).decode()
        if m is not text and "<|endoftext|>" in text and m == e.v.special.split(text)[0]:
            yield "<|endoftext|>"


def test_documents(spark, library):
    got = bs.encode_decode(frame(spark, True), PATH, with_ids=True).collect()
    want = []
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bs.encode_decode(empty(spark), PATH).count() == 0
