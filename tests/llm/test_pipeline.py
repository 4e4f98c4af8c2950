import os

import pytest

import corpus_pipeline
from tillwright.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert 0 < docs.count() <= before
            before = docs.count()
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert docs.filter("length < 1 or length > 2048").count() == 0


def small(spark, folder, data, labels):
    from .cases import SCHEMA

    spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("case", ["empty", "nulls", "awkward"])
def test_awkward_tables_run_through(spark, tmp_path, case):
    from .cases import rows

    data = {"empty": [], "nulls": [(None, None, None, None, None)] * 3 + [(1, "", None, None, None)] * 2, "awkward": rows()}[case]
    folder = small(spark, tmp_path, data, [(i, i % 2, 0) for i in range(0, 12)] if case == "awkward" else [])
    out = corpus_pipeline.run(spark, folder).collect()
    assert case == "awkward" or not out
    assert all(0 < r.length <= 2048 for r in out)


def test_stages_against_brute_force(spark, tmp_path):
    """Exact dedup, near dedup and mixing of one table, each against a plain version on its own input."""
    import random
    from collections import defaultdict

    from tillwright.llm.mixing import mix

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    data = []
    for g in range(40):
        base = [word() for _ in range(rng.randint(5, 60))]
        for c in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(c % 3):
                t[rng.randrange(len(t))] = word()
            t = " ".join(t)
            data.append((len(data), t.upper() if c == 4 else t, "en", f"s{g % 4}", len(t)))
    folder = small(spark, tmp_path, data, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    best = {}
    for r in data:
        best[r[1].lower()] = max(r[0], best.get(r[1].lower(), -1))
    exact = corpus_pipeline.exact_stage(spark, docs, folder)
    got = sorted(r.doc_id for r in exact.collect())
    assert got == sorted(best.values())

    left = {r[0]: r[1] for r in data if r[0] in got}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in left.items() if (w := t.lower().split())}
    head = {i: i for i in left}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    near = corpus_pipeline.near_stage(spark, exact, folder)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i in left if find(i) == i)

    plan = {r.doc_id: r for r in mix(near).collect()}
    sizes = defaultdict(int)
    for r in near.collect():
        sizes[r.source] += len(r.text.split())
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes))}
    open_, rest, target = dict(weights), sum(sizes.values()), {}
    while open_:
        level = rest / sum(open_.values())
        full = [s for s in open_ if 3 * sizes[s] < level * open_[s]]
        if not full:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            del open_[s]
    words = defaultdict(int)
    for r in corpus_pipeline.mixing_stage(spark, near, folder).collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - target[s]) <= 1 for s in sizes) and all(abs(plan[i].target - target[plan[i].source]) < 1e-6 for i in plan)
