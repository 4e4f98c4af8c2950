import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwright.llm import exact_dedup, near_dedup

from .cases import empty, frame, rows

UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def digest(t):
    return hashlib.sha256((t or "").encode().translate(UP)).digest()


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300))
def test_hash_is_minimal_and_perfect(keys):
    keys = sorted({k[:16]: k for k in keys}.values())
    levels, slots = exact_dedup.build_mphf(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    if keys:
        assert exact_dedup.find_slots(levels, keys).tolist() == slots.tolist()


def test_hash_refuses_equal_digests():
    with pytest.raises(ValueError):
        exact_dedup.build_mphf([b"a" * 32, b"a" * 32])


def brute_exact(data):
    groups = defaultdict(list)
    for r in data:
        groups[digest(r[1])].append(r[0])
    out = []
    for d, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = max(real) if real else None
        kept = 0
        for i in ids:
            k = i == keep and not kept
            kept += k
            out.append((i, d, keep, len(ids), k))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_against_brute_force(spark, extra):
    got = exact_dedup.exact_dedup(frame(spark, extra)).collect()
    assert sorted([(r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in got], key=repr) == brute_exact(rows())
    assert any(r.in_history for r in got) and not all(r.in_history for r in got)


def test_exact_with_a_separate_history(spark):
    df = frame(spark)
    old, new = df.filter("doc_id < 8"), df.filter("doc_id >= 8 and doc_id <> 20")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(new, history=old).collect()}
    want = {i: (k, n) for i, _, k, n, _ in brute_exact([r for r in rows() if r[0] is not None and r[0] != 20])}
    assert got == {i: want[i] for i in got} and len(got) == new.count()


def test_exact_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 5)
    got = exact_dedup.exact_dedup(frame(spark)).collect()
    assert sorted([(r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in got], key=repr) == brute_exact(rows())


def test_exact_stage_keeps_one_row_of_each_text(spark):
    df = frame(spark, True)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len({digest(r[1]) for r in rows()}) == len({digest(r.text) for r in got})


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def brute_near(data, n, percent=80):
    sets, ids = [], []
    for r in data:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
        ids.append(r[0])
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if None not in (ids[a], ids[b]) and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(ids[a]), find(ids[b])
                    parent[max(x, y)] = min(x, y)
    return sorted([(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in zip(ids, sets)], key=repr)


@pytest.mark.parametrize("n", [4, 5])
def test_near_against_brute_force(spark, n):
    got = near_dedup.near_duplicates(frame(spark, True), words=n)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_near(rows(), n)


def test_near_group_where_neighbours_differ(spark, monkeypatch):
    """A chain of edits: ends are unlike, neighbours alike; small blocks force comparisons across blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    import random

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    data = []
    for i in range(40):
        w = list(base)
        for j in range(3 * (i // 2)):
            w[(j * 7) % 120] = f"e{j}"
        data.append((i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted([tuple(r) for r in near_dedup.near_duplicates(df, words=4).collect()], key=repr) == brute_near(data, 4)


def test_near_buckets_of_many_components_are_banded_again(spark, monkeypatch):
    """A passage that two thirds of each text consist of: its minima make one band key hold most texts, which are in
    many small groups. The large buckets are banded again, and no link is lost."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", 1)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(70)]
    data = []
    for f in range(70):
        own = [f"f{f}x{i}" for i in range(35)]
        for v in range(2):
            w = passage + own
            w[70 + 5 * v] = f"edit{f}x{v}"
            data.append((len(data), " ".join(w), "en", "s", 1))
    rng.shuffle(data)
    seen = []
    plain = near_dedup._meeting

    def meeting(named, classes, most=None):
        sizes = [r.met for r in named.groupBy("key").count().withColumnRenamed("count", "met").collect()]
        again = plain(named, classes, most)
        seen.append((max(sizes), plain(named, classes, 10**9).count(), again.count()))
        return again

    monkeypatch.setattr(near_dedup, "_meeting", meeting)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted([tuple(r) for r in near_dedup.near_duplicates(df, words=4).collect()], key=repr)
    assert got == brute_near(data, 4) and sum(r[3] for r in got) == 70
    assert seen[0][0] > 64 and seen[0][1] != seen[0][2]  # buckets with most texts, and they were banded again


def test_near_pairs_that_meet_at_a_foreign_hub_only(spark):
    """The smallest document holds the words that give the others their minima: it is the hub of every
    bucket they share, yet unlike them."""
    data = []
    for f in range(3):
        base = [f"w{f}x{i}" for i in range(400)]
        family = [base, base[:-20], base[20:-10]]
        least = set()
        for w in family:
            at = {int(near_dedup.shingles(x, 1)[0]): x for x in w}
            hashes = np.array(list(at), np.uint64)
            least |= {at[int(hashes[np.argmin(hashes * near_dedup._A[k] + near_dedup._B[k])])] for k in range(near_dedup.HASHES)}
        texts = [sorted(least), *family]
        data += [(10 * f + i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_near(data, 1)
    assert [i for i, _, _, kept in sorted(want) if kept] == [0, 1, 10, 11, 20, 21]
    assert sorted([tuple(r) for r in near_dedup.near_duplicates(df, words=1).collect()], key=repr) == want


def test_near_empty_and_stage(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    df = frame(spark, True)
    out = near_dedup.drop_near_copies(df)
    want = sum(k for *_, k in brute_near(rows(), 5))
    assert out.columns == df.columns and out.count() == want


def test_near_stage_links_rows_without_an_id_of_their_own(spark):
    w = [[f"t{k}x{i}" for i in range(100)] for k in range(4)]
    near = lambda k, n: " ".join(w[k][: 100 - n])
    data = [(None, near(0, 0)), (None, near(0, 1)), (None, near(0, 0)), (5, near(1, 0)), (5, near(1, 2)), (5, near(1, 3)), (7, near(2, 0)), (None, near(2, 1)), (7, near(3, 0)), (8, near(3, 4)), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "")[:3]) for r in near_dedup.drop_near_copies(df).collect()]
    assert sorted(got, key=repr) == sorted([(None, "t0x"), (5, "t1x"), (7, "t2x"), (7, "t3x"), (None, ""), (None, "")], key=repr)


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(a[:3000]), np.unique(a[1000:])]
    m = near_dedup.minima(sets)
    sig = near_dedup.pack_bits(m).view(np.uint64)
    x = sig[0] ^ sig[1]
    y = x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))
    equal = near_dedup.HASHES - int(np.bitwise_count(y & np.uint64(near_dedup._NIBBLES)).sum())
    assert abs(near_dedup.estimate(equal) - 0.5) < 0.2
    assert near_dedup.estimate(near_dedup.HASHES) == 1 and near_dedup.estimate(near_dedup.HASHES / 16) == 0


@pytest.mark.parametrize("local", [10**6, 30])
def test_components(spark, local):
    import random

    rng = random.Random(2)
    edges = [(rng.randint(0, 100), rng.randint(0, 100)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_drop_copies_keeps_columns_of_any_name_and_repeated_rows_once(spark):
    from pyspark.sql import functions as F

    data = [(1, "a"), (2, "A"), (3, "b")] + [(None, "hot")] * 40 + [(7, "twice"), (7, "twice"), (9, None), (8, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for c in ("__id", "__digest", "pair_key", "pair_rows", "_pair_rows", "row", "first", "n"):
        df = df.withColumn(c, F.lit(f"mine {c}"))
    got = exact_dedup.drop_copies(df.repartition(3))
    assert got.columns == df.columns
    out = got.collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(2, "A"), (3, "b"), (7, "twice"), (9, None), (None, "hot")], key=repr)
    assert all(r[c] == f"mine {c}" for r in out for c in df.columns[2:])


def test_drop_near_copies_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(60))
    for data in ([(1, text), (2, text + " x"), (3, "other")], [(1, text), (1, text + " x"), (3, "other")]):
        df = spark.createDataFrame(data, "doc_id long, text string")
        for c in ("__gone", "gone_id", "row_key", "__row"):
            df = df.withColumn(c, F.lit("mine"))
        out = near_dedup.drop_near_copies(df).collect()
        assert len(out) == 2 and all(r[c] == "mine" for r in out for c in df.columns[2:])
