"""Multisets against counters, and status from sketches."""

import random
from collections import Counter
from datetime import datetime

import pytest

from threadloom.catalog import Catalog
from threadloom.operators import multisets
from threadloom.plans.embedding import HashedWords
from threadloom.plans.store import IndexStore

from .scans import scanned
from .test_engine import Memory

NOW = datetime(2024, 6, 1)


def test_multisets(spark):
    draw = random.Random(2)
    rows = lambda n: [(draw.choice(["x", "y", None, "é"]), draw.choice([1, None, 2])) for _ in range(n)] + [("hot", 1)] * n
    left, right = rows(200), rows(150)
    a, b = (spark.createDataFrame(r, "in_left string, times int") for r in (left, right))
    ca, cb = Counter(left), Counter(right)
    for f, expected in ((multisets.intersect_all, ca & cb), (multisets.except_all, ca - cb), (multisets.union_most, ca | cb), (multisets.union_distinct, Counter(set(ca) | set(cb)))):
        out = f(a, b)
        assert out.columns == a.columns and Counter(map(tuple, out.collect())) == expected
        assert Counter(map(tuple, f(a, b.limit(0)).collect())) == {multisets.intersect_all: Counter(), multisets.union_distinct: Counter(set(ca))}.get(f, ca)
    with pytest.raises(ValueError):
        multisets.except_all(a, b.select("times"))
    plan = multisets.intersect_all(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 100_003])
def test_many_copies_are_made_in_levels(spark, monkeypatch, n):
    monkeypatch.setattr(multisets, "COPIES", 16 if n > 4097 else 4096)
    from pyspark.sql import functions as F

    assert multisets.repeated(spark.range(1), F.lit(n), ["id"]).count() == n


def test_status_from_sketches_reads_no_passage(spark, tmp_path):
    rows = [(f"s{k:04d}", f"T{k}", f"something about number {k}", 1, k) for k in range(300)]
    memory = Memory(spark, rows)
    catalog = Catalog(spark, IndexStore(spark, f"file://{tmp_path}/index"), [memory], embedder=HashedWords())
    catalog.refresh(NOW)
    memory.rows = [(i, t, s, 2 if k % 3 == 0 else 1, h) for k, (i, t, s, _, h) in enumerate(rows)][50:]
    catalog.refresh(NOW, force=False)
    about, exact = catalog.status(exact=False), catalog.status()
    one, two = about.first(), exact.first()
    assert two.embeddable_sessions == 250 and abs(one.embeddable_sessions - 250) <= 10 and abs(one.embedded_sessions - two.embedded_sessions) <= 10
    assert (one.sessions, one.chunks) == (two.sessions, two.chunks) and 1 <= one.median_tokens <= one.tokens_95
    assert sum(scanned(about)) < 20 and all("/sketch/" in f for f in about.inputFiles()) and any("/chunk/" in f for f in exact.inputFiles())
