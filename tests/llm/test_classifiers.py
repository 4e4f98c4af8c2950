import random
import zlib

import numpy as np
import pytest

from tillwright.llm import quality, toxicity
from tillwright.llm.labelled import labelled_sample

from .cases import empty, frame


def corpus(spark, n=400):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.6, rng.random() < 0.4
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        if not good:
            words = [w + rng.choice(("***", "$$$")) for w in words]
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(("blockhead", "rubbishy")))
        docs.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("module, folds, held, at", [(quality, 3, 1, 1), (toxicity, 5, 0, 2)])
def test_held_out_accuracy(spark, module, folds, held, at):
    docs, labels, truth = corpus(spark)
    got = module.classify(docs, module.train(docs, labels)).collect()
    want = {r[0]: r[at] for r in truth}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 30 and np.mean([r.predicted == want[r.doc_id] for r in out]) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_are_not_used(spark, module):
    docs, labels, truth = corpus(spark, 150)
    folds, held, name = (3, 1, "quality") if module is quality else (5, 0, "toxic")
    other = spark.createDataFrame([(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == held else (i, q, t) for i, q, t in truth], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in module.classify(docs, module.train(docs, x)).collect()} for x in (labels, other))
    assert a == b and name


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_documents(spark, module):
    docs, labels, _ = corpus(spark, 120)
    model = module.train(docs, labels)
    got = module.classify(frame(spark, True), model).collect()
    assert len(got) == frame(spark).count() and all(0 <= r.score <= 1 for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert module.classify(empty(spark), model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_of_both_kinds(spark, module):
    docs, labels, _ = corpus(spark, 40)
    for some in (labels.filter("false"), labels.filter("quality = 1 and toxic = 0")):
        scores = {round(r.score, 3) for r in module.classify(docs, module.train(docs, some)).collect()}
        assert len(scores) == 1


def test_sample_is_bounded_and_clean(spark):
    docs, labels, _ = corpus(spark, 200)
    more = labels.unionByName(spark.createDataFrame([(0, 0, 0), (0, 1, 1), (None, 1, 1), (1, 7, 7)], "doc_id long, quality int, toxic int"))
    got = labelled_sample(docs.unionByName(docs), more, "quality", 3, 1, 20, ["text"]).collect()
    assert len(got) <= 40 and len({r.doc_id for r in got}) == len(got) and 0 not in {r.doc_id for r in got} and {r.y for r in got} <= {0, 1}


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(2)
    d = quality.WORDS + quality.STATS
    x = rng.random((3, d)).astype(np.float32)
    m = quality.Machine(np.zeros(quality.STATS), np.ones(quality.STATS), 0.3, rng.normal(size=d).astype(np.float32) * 0.01, rng.normal(size=(d, 4)).astype(np.float32) * 0.01)
    for row, got in zip(x.astype(float), m.margin(x)):
        g = m.v @ m.v.T
        want = 0.3 + row @ m.w + (row @ g @ row - (row * row * np.diag(g)).sum()) / 2
        assert got == pytest.approx(want, abs=1e-3)


def test_grams_by_hand():
    a, b = (set(toxicity.present(t).tolist()) for t in ("ABCDE", "abcde"))
    assert a == b and len(a) == 3  # abcd, bcde, abcde
    assert len(toxicity.present(None)) == 0 and len(toxicity.present("abc")) == 0


def test_ratios_and_score_against_plain_version():
    import math

    n0, n1 = np.array([3, 0, 10]), np.array([1, 6, 10])
    want = [math.log((b + 1) / (17 + 3)) - math.log((a + 1) / (13 + 3)) for a, b in zip(n0, n1)]
    assert np.allclose(toxicity.ratios(n0, n1), want)
    text = "Añb cd ÑB🙂"
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    distinct = {low[i : i + n] for n in toxicity.ORDERS for i in range(len(low) - n + 1)}
    assert len(toxicity.present(text)) == len(distinct)  # characters, not bytes
    column = np.full(1 << toxicity.BITS, -1, np.int32)
    buckets = sorted(toxicity.present(text).tolist())
    column[buckets[:5]] = np.arange(5)
    model = toxicity.Linear(column, np.array([0.5, -1.0, 2.0, 0.25, 0.125]), -0.75)
    assert model.score(text * 3) == pytest.approx(1 / (1 + math.exp(0.75 - 1.875)))


def test_keep_good_keeps_columns(spark):
    docs, labels, truth = corpus(spark)
    out = quality.keep_good(docs.withColumnRenamed("lang", "score"), quality.train(docs, labels))
    want = {i for i, q, _ in truth if q}
    got = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "text", "score", "source", "n_chars"] and len(got ^ want) < 40
