"""Joins by time against loops over all pairs."""

import random

import pytest

from threadloom.operators import intervals


def by_hand(left, right, strict=False, within=None):
    out = set()
    for i, key, at in left:
        best = max(((t, j) for j, k, t in right if key is not None and at is not None and k == key and t is not None and (t < at or t == at and not strict)), default=None)
        out.add((i, best[1] if best and (within is None or at - best[0] <= within) else None))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, at long")


def random_rows(draw, n, hot=0.6):
    return [(i, "hot" if draw.random() < hot else draw.choice(["a", "b", "c", None]), draw.choice([None, *range(60)]) if draw.random() < 0.5 else draw.randint(0, 5000)) for i in range(n)]


@pytest.mark.parametrize("strict, within", [(False, None), (True, None), (False, 100)])
@pytest.mark.parametrize("long_key", [intervals.LONG_KEY, 50])
def test_as_of(spark, strict, within, long_key):
    draw = random.Random(7)
    left, right = random_rows(draw, 300), random_rows(draw, 250)
    out = intervals.as_of(table(spark, left), table(spark, right), "key", "at", strict=strict, tie="id", within=within, long_key=long_key, slices=16)
    rows = out.selectExpr("left.id as a", "right.id as b").collect()
    assert len(rows) == 300 and {(r.a, r.b) for r in rows} == by_hand(left, right, strict, within)


def test_a_hot_key_is_cut_into_slices_of_like_size(spark):
    rows = table(spark, [(i, "hot", i * i) for i in range(4000)] + [(i, "cold", i) for i in range(10)])
    sizes = intervals._sliced(rows, 1000, 16).groupBy("key", "slice").count().collect()
    assert max(r["count"] for r in sizes) < 4000 / 16 * 1.5 and sum(r.key == "cold" for r in sizes) == 1


def test_an_empty_side(spark):
    some, none = table(spark, [(1, "a", 5)]), table(spark, [])
    assert [(r.left.id, r.right) for r in intervals.as_of(some, none, "key", "at").collect()] == [(1, None)]
    assert intervals.as_of(none, some, "key", "at").count() == 0
    assert intervals.containing(none, some, "key", "at", ("at", "at"), 10).count() == 0


def spans(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, a long, b long")


@pytest.mark.parametrize("width", [1, 16, 10_000])
def test_overlaps(spark, width):
    draw = random.Random(9)

    def some(n):
        out = []
        for i in range(n):
            a = draw.randint(-500, 500)
            out.append((i, draw.choice(["hot", "hot", "a", None]), a, draw.choice([a, a, a + draw.randint(0, 9), a + draw.randint(0, 900), a - 1, None])))
        return out

    left, right = some(150), some(150)
    expected = {(i, j) for i, k, a, b in left for j, m, c, d in right if k is not None and k == m and None not in (b, d) and a <= b and c <= d and a <= d and c <= b}
    out = intervals.overlaps(spans(spark, left), spans(spark, right), "key", ("a", "b"), ("a", "b"), width)
    rows = out.selectExpr("left.id as a", "right.id as b").collect()
    assert len(rows) == len(expected) and {(r.a, r.b) for r in rows} == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
