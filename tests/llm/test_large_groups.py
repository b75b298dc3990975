"""Large groups of candidates leave links in proportion to their texts."""

import random

import numpy as np

from threadloom.llm import overlap


def _roots(n, links):
    label = np.arange(n)
    a, b = (np.array([x[k] for x in links], int) for k in (0, 1))
    overlap.merge(label, a, b)
    return label.tolist()


def test_links_across_blocks_are_a_forest():
    rng = random.Random(4)
    for n, edits in ((60, 0), (60, 2), (90, 12)):
        base = [[rng.randrange(1 << 40) for _ in range(100)] for _ in range(3)]
        sets = []
        for k in range(n):
            s = list(base[k % 3])
            for _ in range(edits):
                s[rng.randrange(100)] = rng.randrange(1 << 40)
            sets.append(np.unique(np.array(s, np.uint64)))
        asking = [rng.random() < 0.5 for _ in range(n)]
        like = lambda x, y: 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
        pairs = [(x, y) for x in range(n) if asking[x] for y in range(n) if x != y and like(sets[x], sets[y])]
        links = overlap.across(sets, asking)
        assert set(links) <= set(pairs) and _roots(n, links) == _roots(n, pairs)
        assert len(links) == n - len(set(_roots(n, pairs)))


def test_a_blank_text_among_candidates(spark):
    """Its fingerprint of zero may be within three bits of a short text's; it is like no other and breaks no group."""
    for asking in (True, False):
        rows = [(1, 0, 0, 1, "a b c d e f", True), (1, 0, 0, 2, "A b c d e  f", asking), (1, 0, 0, 3, " ", asking), (1, 0, 0, 4, "", True)]
        df = spark.createDataFrame(rows, "root long, i int, j int, node long, text string, asking boolean").coalesce(1)
        assert {frozenset(r) for r in overlap._met(df).collect()} == {frozenset((1, 2))}
