"""Postings leave their worker in runs that are sorted by term."""

from threadloom.operators import lexical


def test_postings_leave_in_order_of_terms(spark):
    rows = [(f"u{i * 7 % 1000:04}", i % 2, f"common word{i % 7} x{i} common Éa" if i % 5 else "--") for i in range(1000)]
    chunks = lexical.tokenized(spark.createDataFrame(rows, "uri string, ordinal int, text string").coalesce(1))
    got = [(r.term.encode(), r.uri, r.ordinal, r.n_tokens, list(r.positions)) for r in lexical.postings(chunks).collect()]
    assert [g[:3] for g in got] == sorted(g[:3] for g in got)
    want = []
    for r in chunks.collect():
        tokens = r.words.split()
        want += [(t.encode(), r.uri, r.ordinal, len(tokens), [k for k, x in enumerate(tokens) if x == t]) for t in set(tokens)]
    assert got == sorted(want)
