"""The near-duplicate stage takes its candidates from fingerprints, too, and large groups keep few links."""

import numpy as np

from threadloom.llm import components, overlap, simhash


def test_fingerprints_give_candidates(spark, monkeypatch):
    """Without the keys of minima, what fingerprints link is still found, and verified."""
    monkeypatch.setattr(overlap, "candidates", lambda nodes: nodes.selectExpr("node as a", "node as b").where("false"))
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join(base[:399] + ["other"]), "quite another text that nothing is like at all"]
    assert bin(int(np.bitwise_xor(*simhash.fingerprint_texts(texts[:2])))).count("1") <= 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == [0, 2]


def test_links_of_a_large_group_are_contracted(spark):
    edges = spark.range(20000).selectExpr("id % 200 + 200 as a", "id div 200 as b").coalesce(2)
    assert components._contracted(edges).count() <= 2 * 300
    roots = {r.node: r.root for r in components.connected(edges.union(spark.createDataFrame([(1000, 999)], "a long, b long"))).collect()}
    assert roots == {**dict.fromkeys(range(100), 0), **dict.fromkeys(range(200, 400), 0), 999: 999, 1000: 999}
