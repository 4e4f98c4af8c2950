import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwright.llm import packing, token_counts

from .cases import empty, frame, rows

MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(st.sampled_from("ab the ing  é€\n\t1230<s>▁𝒳rtion.Ü,'!"), max_size=40)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_count_of_every_prefix(sp, t):
    steps = token_counts.counter(MODEL).steps(t)
    assert token_counts.prefix_counts(steps).tolist() == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]


@pytest.mark.parametrize("k", [1, 2, 15, 16, 17, 31, 32, 33, 50])
def test_runs_of_spaces(sp, k):
    for t in (" " * k, " " * k + "x", "a" + " " * k + "\n", "a" + " " * k + "the" + " " * k):
        assert token_counts.prefix_counts(token_counts.counter(MODEL).steps(t)).tolist() == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]


def test_budget(sp):
    t = "the cat sat on the mat and looked at the moon"
    steps = token_counts.counter(MODEL).steps(t)
    for budget in range(12):
        n = token_counts.longest_prefix(steps, budget)
        assert all(len(sp.encode(t[:i])) <= budget for i in range(n + 1)) and (n == len(t) or len(sp.encode(t[: n + 1])) > budget)


def test_caches_are_bounded():
    c = token_counts.PrefixCounter(MODEL)
    c.words.most = c.stems.most = c.follows.most = 50
    texts = [f"word{i} other{i * 7}" for i in range(300)]
    first = [c.steps(t) for t in texts]
    assert [c.steps(t) for t in texts] == first and len(c.words) <= 50 and len(c.words.old) <= 50


def test_counts_of_documents(spark, sp):
    got = token_counts.count_tokens(frame(spark, True), MODEL, with_steps=True).collect()
    want = sorted([(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in rows()], key=repr)
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=repr) == want
    assert all(token_counts.prefix_counts(r.steps)[-1] == r.n_tokens for r in got)
    assert token_counts.count_tokens(empty(spark), MODEL).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab the  \n\té　\xa012'ts!?<|endoftext|>\x85"), max_size=40))
def test_ids_are_the_librarys(t):
    e = packing.encoder(VOCABULARY)
    assert e.engine is not None
    assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(1, 9))
def test_differencing(sizes, k):
    w = packing.differencing(sizes, k)
    assert len(w) == k and sorted(i for x in w for i in x) == list(range(len(sizes)))
    if len(sizes) > 4 * k:
        sums = [sum(sizes[i] for i in x) for x in w]
        assert max(sums) - min(sums) <= max(sizes)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_balance_raises_the_number_of_windows(sizes):
    w = packing.balance(sizes, 64)
    assert all(sum(sizes[i] for i in x) <= 64 for x in w) and sorted(i for x in w for i in x) == list(range(len(sizes)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_fill_and_powers(sizes):
    raised = packing.balance(sizes, 64)
    windows, left = packing.fill(raised, sizes, 64)
    assert len(windows) == sum(sizes) // 64 and all(sum(n for *_, n in w) == 64 for w in windows) and sum(n for *_, n in left) < 64
    small = packing.powers(left)
    assert all((n := sum(x for *_, x in w)) & (n - 1) == 0 for w in small)
    cells = sorted((i, s + j) for w in windows + small for i, s, n in w for j in range(n))
    assert cells == [(i, j) for i, s in enumerate(sizes) for j in range(s)]
    # items of the windows that stay are whole
    heavy = sorted(raised, key=lambda w: -sum(sizes[i] for i in w))[: len(windows)]
    assert all((i, 0, sizes[i]) in w for w, whole in zip(windows, heavy) for i in whole if sizes[i])


def test_windows_depend_on_the_differencing(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(50, 2048, 400)]
    cuts = lambda windows: sum(n < sizes[i] for w in windows for i, _, n in w)
    raised = packing.balance(sizes, 2048)
    least = -(-sum(sizes) // 2048)
    assert least < len(raised) <= 1.06 * least  # the count rises, by little
    ours = cuts(packing.fill(raised, sizes, 2048)[0])
    monkeypatch.setattr(packing, "differencing", lambda sizes, k: [list(range(j, len(sizes), k)) for j in range(k)])
    other = packing.balance(sizes, 2048)
    assert len(other) > 1.2 * len(raised) and cuts(packing.fill(other, sizes, 2048)[0]) > ours


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_padding_is_small_at_any_number_of_partitions(spark, monkeypatch, parts):
    monkeypatch.setattr(packing, "BLOCK_WINDOWS", 16)
    docs = spark.createDataFrame([(i, "word and " * (i * 37 % 90)) for i in range(900)], "doc_id long, text string").repartition(parts)
    out = defaultdict(int)
    for r in packing.pack(docs, VOCABULARY, capacity=64).collect():
        out[r.sequence_id] += r.length
    padded = [64 if n & (n - 1) else n for n in out.values()]
    assert max(out.values()) <= 64 and sum(padded) == sum(out.values())  # nothing is padded
    assert sum(n == 64 for n in out.values()) > 0.9 * len(out) or parts == 40


def test_merges_out_of_order_go_to_the_library(tmp_path):
    import json

    spec = json.load(open(VOCABULARY, encoding="utf-8"))
    merges = spec["model"]["merges"]
    merges[10], merges[900] = merges[900], merges[10]
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    e = packing.Encoder(str(tmp_path / "other.json"))
    assert e.engine is None and e.ids("the other") == e.tokenizer.encode("the other", add_special_tokens=False).ids


def test_packing_of_documents(spark, monkeypatch):
    got = packing.pack(frame(spark, True).repartition(3), VOCABULARY, with_ids=True).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length > 0 and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == packing.CAPACITY or end & (end - 1) == 0
    e = packing.encoder(VOCABULARY)
    for key, text in {r[0]: r[1] for r in rows() if r[0] not in (None, 20)}.items():
        parts = sorted(docs[key], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == e.encode(text or "") and all(r.doc_tokens == len(e.encode(text or "")) // 4 for r in parts)
    assert sum(r.length for r in docs[20]) == 2 * docs[20][0].doc_tokens
    assert packing.pack(empty(spark), VOCABULARY).count() == 0
