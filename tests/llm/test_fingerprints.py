import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tillwright.llm import fingerprints as fp

from .cases import SCHEMA, empty, frame, rows


def brute(data):
    """Order by id (nulls last) and text; the next of the last is the first."""
    ordered = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for i, r in enumerate(ordered):
        t, n = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(t) // 2
        e = t[: len(t) - k] + n[:k]
        a, b, c = fp.digest(t.encode()), fp.digest(e.encode()), fp.digest(n.encode())
        out.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fp.to_text(a), fp.to_text(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    for parts in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = fp.fingerprint_neighbours(frame(spark, True)).collect()
        assert sorted([tuple(r) for r in got], key=repr) == brute(rows())
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_single_row_and_only_nulls(spark):
    for data in ([(1, "only one here", "en", "s", 1)], [(None, "abc def ghi", "en", "s", 1), (None, "x", "en", "s", 1)]):
        got = fp.fingerprint_neighbours(spark.createDataFrame(data, SCHEMA)).collect()
        assert sorted([tuple(r) for r in got], key=repr) == brute(data)
    assert fp.fingerprint_neighbours(empty(spark)).count() == 0


def test_null_and_repeated_ids_are_spread(spark):
    import random

    rng = random.Random(2)
    data = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"{rng.random()} text \u00e9\x00 {i}", "en", "s", 1) for i in range(400)] + [(None, "same", "en", "s", 1)] * 5
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = fp.fingerprint_neighbours(spark.createDataFrame(data, SCHEMA).repartition(4))
        assert max(len(x) for x in df.rdd.glom().collect()) < 120
        assert sorted([tuple(r) for r in df.collect()], key=repr) == brute(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_digest(data):
    """The digest written out byte by byte, from its definition in the module's docstring."""
    counts = [0] * 256
    for at in range(len(data) - 4):
        for salt, (i, j) in enumerate([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]):
            x = (data[at] * 0x9E3779B1 + data[at + i] * 0x85EBCA77 + data[at + j] * 0xC2B2AE3D + salt * 0x27D4EB2F) % 2**32
            x ^= x >> 15
            counts[x * 0x9E3779B1 % 2**32 >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
    import math

    length = min(255, round(8 * math.log2(1 + len(data))))
    return [length, q1 * 16 // max(1, q3), q2 * 16 // max(1, q3)] + [(c > q1) + (c > q2) + (c > q3) for c in counts]


def plain_likeness(a, b):
    steps = {0: 0, 1: 1, 2: 2, 3: 6}
    far = sum(min(abs(x - y), most) for x, y, most in zip(a, b, (48, 12, 12))) + sum(steps[abs(x - y)] for x, y in zip(a[3:], b[3:]))
    return 1 - far / (256 * 6 + 72)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400))
def test_digest_against_plain_version(a, b):
    x, y = fp.digest(a), fp.digest(b)
    assert x.tolist() == plain_digest(a) and y.tolist() == plain_digest(b)
    assert abs(fp.likeness(x, y) - plain_likeness(plain_digest(a), plain_digest(b))) < 1e-12
    packed = "".join(f"{v:02x}" for v in plain_digest(a)[:3]) + "".join(f"{p[0] << 6 | p[1] << 4 | p[2] << 2 | p[3]:02x}" for p in zip(*[iter(plain_digest(a)[3:])] * 4))
    assert fp.to_text(x) == packed


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_difference_is_bounded_and_symmetric(a, b):
    x, y = fp.digest(a), fp.digest(b)
    assert (fp.from_text(fp.to_text(x)) == x).all()
    assert fp.difference(x, x) == 0 and fp.difference(x, y) == fp.difference(y, x) and 0 <= fp.likeness(x, y) <= 1


def test_edits_are_nearer_than_strangers():
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for _ in range(20):
        a, b = [" ".join(word() for _ in range(200)) for _ in range(2)]
        edited = a[: len(a) // 2] + b[: len(a) // 2]
        d = [fp.digest(x.encode()) for x in (a, b, edited)]
        assert fp.likeness(d[0], d[2]) > fp.likeness(d[0], d[1])
