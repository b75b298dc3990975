"""What is dear is computed once: words in a filter, postings where they are made."""

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import lexical
from threadloom.plans.terms import parse


def test_words_are_made_once_below_a_filter(spark):
    df = spark.createDataFrame([(1, "Sometion nthe Éler"), (2, "le x"), (3, ""), (4, None), (5, "of the of the of"), (6, "a a a b")], "i int, text string")
    rows = lexical.tokenized(df)
    for q, want in (('nthe estionr "le"', {1, 2}), ('"of the of"', {5}), ('"a a b"', {6}), ('"le y"', set()), ('"--"', set())):
        hit = rows.where(lexical.matches(F.col("words"), parse(q))).select("i")
        assert {r.i for r in hit.collect()} == want
        assert hit._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") <= 1
    count = lambda q: {r.i: r.n for r in rows.select("i", lexical.frequency(F.col("words"), parse(q)[0]).alias("n")).where("n > 0").collect()}
    assert count('"of the"') == {5: 2} and count('"a a"') == {6: 2} and count("nthe") == {1: 1}
    assert [r.n for r in df.select(text.once(F.col("text"), lambda c: F.length(c)).alias("n")).collect()] == [18, 4, 0, None, 16, 7]


def test_postings_are_written_without_an_exchange(spark, tmp_path):
    rows = [(f"u{i}", 0, f"common word{i % 7} x{i} common" if i % 5 else "--") for i in range(40)]
    chunks = lexical.tokenized(spark.createDataFrame(rows, "uri string, ordinal int, text string").repartition(4))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    lexical.write_index(chunks, str(tmp_path))
    plans = [e.physicalPlanDescription() for e in (store.executionsList().apply(k) for k in range(before, store.executionsList().size()))]
    assert plans and not any("rangepartitioning" in p for p in plans)
    s = spark.read.parquet(f"{tmp_path}/stats").collect()
    assert [(r.n_rows, r.mean_tokens) for r in s] == [(40.0, 32 * 4 / 40)]
    index = spark.read.parquet(f"{tmp_path}/posting")
    assert {r.uri: r.n for r in index.where("term = 'common'").select("uri", F.size("positions").alias("n")).collect()} == {f"u{i}": 2 for i in range(40) if i % 5}
    for f in index.inputFiles():
        terms = [r.term for r in spark.read.parquet(f).collect()]
        assert terms == sorted(terms)
    scores = lambda df: {r.uri: round(r.score, 9) for r in df.collect()}
    assert scores(lexical.indexed_bm25(spark, str(tmp_path), parse("common word3"))) == scores(lexical.bm25(chunks, parse("common word3")))
    lexical.write_index(chunks.limit(0), f"{tmp_path}/none")
    assert [(r.n_rows, r.mean_tokens) for r in spark.read.parquet(f"{tmp_path}/none/stats").collect()] == [(0.0, None)]
