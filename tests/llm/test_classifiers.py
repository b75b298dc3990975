"""Toxicity and quality: what they learn, on held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, quality, toxicity
from threadloom.llm.ngrams import Characters

GOOD, BAD = ["bonlen", "tarmic", "solvet", "penora", "hastil", "quimby"], ["grobnak", "vilfesk"]


def _texts(n, seed):
    rng = random.Random(seed)
    out, y = [], []
    for k in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(5, 60))]
        if k % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "en", "ish"]))
        out.append(" ".join(words))
        y.append(int(k % 4 == 0))
    return out, y


@pytest.fixture(scope="module")
def toxic():
    return toxicity.train(*_texts(600, 1))


def test_toxicity_on_new_texts(toxic):
    texts, y = _texts(300, 2)
    s = toxicity.score(texts, *toxic.table())
    assert ((s >= 0.7) == np.array(y)).mean() > 0.97 and ((s >= 0) & (s <= 1)).all()


def test_unseen_misspellings_and_long_texts(toxic):
    clean = "bonlen tarmic solvet " * 400
    s = toxicity.score([clean, clean + "grobnakk vilfeskk", clean + "gropnak grobnaq", "", None], *toxic.table())
    assert s[0] < 0.5 < s[1] and s[2] > s[0] and s[3] == s[4] < 0.5


def test_scores_do_not_depend_on_the_batch(toxic):
    texts, _ = _texts(40, 3)
    one = [toxicity.score([t], *toxic.table())[0] for t in texts]
    assert np.allclose(one, toxicity.score(texts, *toxic.table()))


def test_grams_match_their_definition():
    texts = ["ab c", "", "xyz\tabc", "é"]
    c = Characters(texts, lower=True)
    flat = " " + " ".join(t.replace("\t", " ") for t in texts) + " "
    for n, bucket, counts in c.grams((2, 3, 4), 16):
        want = [n == 2 and not flat[i : i + n].isspace() and flat[i : i + n].count(" ") < 2 and (" " not in flat[i]) or n > 2 and " " not in flat[i + 1 : i + n - 1] and not (flat[i] == " " and flat[i + n - 1] == " ") for i in range(len(flat) - n + 1)]
        assert counts.tolist() == want
        seen = {}
        for i in np.flatnonzero(counts):
            assert seen.setdefault(flat[i : i + n], bucket[i]) == bucket[i]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_labels_of_one_kind_or_none(module):
    for y in ([], [0, 0], [1, 1]):
        m = module.train(["a b"] * len(y), y)
        s = module.score(["a", None], *m.table()) if module is toxicity else m.score(["a", None])
        assert len(s) == 2 and ((s >= 0) & (s <= 1)).all()


def test_dual_coordinate_descent_solves_the_problem():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = (x @ [1, -2, 0.5] + rng.normal(scale=0.3, size=60) > 0).astype(int)
    w, b = quality.dual_coordinate_descent([np.arange(3)] * 60, list(x), y, 3, cost=1.0, passes=2000)
    cap = np.array([60 / (2 * (y == k).sum()) for k in y])

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + cap @ np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ w + b))

    best = primal(w, b)
    for _ in range(500):
        assert best <= primal(w + rng.normal(scale=0.05, size=3), b + rng.normal(scale=0.05)) + 1e-2
    assert quality.platt([-2, -1, 1, 2], [0, 0, 1, 1])[0] > 0


def test_quality_of_repetition_and_noise():
    rng = random.Random(4)
    good = [" ".join(rng.choice(GOOD).capitalize() if rng.random() < 0.1 else rng.choice(GOOD) for _ in range(40)) + "." for _ in range(200)]
    bad = [" ".join(w for w in rng.sample(GOOD, 4) for _ in range(10)) if k % 2 else " ".join(rng.choice(GOOD) + "$$$" for _ in range(40)) for k in range(60)]
    m = quality.train(good + bad, [1] * 200 + [0] * 60)
    s = m.score(["zulma " * 30, "zulma$$$ wert$$$ quad$$$ plom$$$ " * 10, "Zulma wert quad bonlen, tarmic solvet."])
    assert s[0] < 0.3 < 0.6 < s[2] and s[1] < 0.5


def test_quality_of_held_out_rows(spark):
    """Accuracy on rows whose labels were not read, with the production parameters."""
    d = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in common.table(spark, d, "labels").collect()}
    rows = [(r.predicted, y[r.doc_id]) for r in quality.op8(spark, d).where("held_out").collect() if r.doc_id in y]
    assert sum(a == b for a, b in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("op,by,rest,cut", [(toxicity.op5, 3, 1, 0.7), (quality.op8, 5, 0, 0.3)])
def test_queries(spark, sf_dir, op, by, rest, cut):
    import zlib

    rows = op(spark, sf_dir).collect()
    assert len(rows) == common.table(spark, sf_dir, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == rest) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, by, rest in (("toxic", 3, 1), ("quality", 5, 0)):
        import zlib

        texts, _ = toxicity.training_rows(docs, labels, name, common.remainder("doc_id", by) == rest, 100)
        ids = {int(t.split()[1]) for t in texts}
        assert ids == {i for i in range(60) if zlib.crc32(str(i).encode()) % by != rest}
        assert len(toxicity.training_rows(docs, labels, name, common.remainder("doc_id", by) == rest, 4)[0]) == 8


def test_scoring_odd_rows(spark, toxic):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "grobnak " * 3), (3, "bonlen " * 50000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = toxicity.scored(df, toxic).collect()
    assert len(rows) == 5 and {r.doc_id: r.score > 0.5 for r in rows} == {1: False, 2: False, None: True, 3: False}
    assert toxicity.scored(df.limit(0), toxic).count() == 0


def test_an_empty_text_scores_by_the_bias(toxic):
    table, bias = toxic.table()
    assert toxicity.score(["", None, " \t"], table, bias) == pytest.approx([1 / (1 + np.exp(-bias))] * 3) and bias < 0
    assert toxicity.score([""], table, 1.0)[0] == pytest.approx(1 / (1 + np.exp(-1.0)))


def test_toxicity_on_held_out_rows(spark):
    """The query on a table whose held-out labels no choice was made by."""
    d = "/root/testdata/sf0.1"
    got = toxicity.op5(spark, d).join(common.table(spark, d, "labels"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.9 * sum(r.predicted for r in got) and hit >= 0.7 * sum(r.toxic for r in got)


def test_training_rows_have_rules_for_repeats_and_bounds(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)] + [(0, "text 0"), (1, None), (None, "x")], "doc_id long, text string").withColumn("y", F.lit("clash")).withColumn("place", F.lit(1))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(4, 1), (7, 0), (7, 1), (None, 1), (8, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    rows = lambda **kw: toxicity.training_rows(docs, labels, "toxic", F.lit(False), **({"each": 100} | kw))
    texts, y = rows()
    assert sorted(texts) == sorted(["text 0"] + [f"text {k}" for k in range(40)]) and all(int(t.split()[1]) % 2 == v for t, v in zip(texts, y))
    texts, y = rows(each=5)
    assert len(texts) == 10 and sum(y) == 5
    texts, y = rows(chars=30)
    assert all(30 <= sum(len(t) for t, v in zip(texts, y) if v == w) < 40 for w in (0, 1))
    assert rows(each=5) == toxicity.training_rows(docs.repartition(3), labels.repartition(2), "toxic", F.lit(False), 5)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scoring_any_rows(spark, module):
    texts, y = _texts(200, 5)
    model = module.train(texts, y)
    rows = [(1, None), (2, ""), (3, texts[0]), (3, texts[0]), (None, texts[1]), (4, "bonlen " * 60_000), (5, "\ud83d".encode("utf-8", "replace").decode() + "\u0000  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("__text", F.lit(1))
    got = module.scored(df.select("doc_id", "text", "__text"), model, "doc_id", "__text").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[1] == by_id[2] and len(by_id[3]) == 1
    assert module.scored(df.limit(0), model).count() == 0
