"""The pipeline against the stages' own rules, row by row."""

import inspect

import pytest

import corpus_pipeline as cp
from threadloom.llm import common, decontamination, packing, pii, simhash, toxicity


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    assert [list(inspect.signature(f).parameters) for _, f in cp.STAGES] == [["spark", "docs", "sf_dir"]] * 5
    rows = {r.doc_id: r for r in docs.collect()}

    model = toxicity.fitted(docs, common.table(spark, sf_dir, "labels"))
    clean = common.staged(cp.drop_toxic(spark, docs, sf_dir))
    want = {i for i, s in zip(rows, toxicity.score([r.text for r in rows.values()], *model.table())) if s < toxicity.THRESHOLD}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want

    single = common.staged(cp.drop_near_duplicates(spark, clean, sf_dir))
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(groups.values())

    fresh = common.staged(cp.drop_contaminated(spark, single, sf_dir))
    bad = {r.doc_id for r in decontamination.contaminated(single, common.table(spark, sf_dir, "benchmark")).where("contaminated").collect()}
    assert fresh.columns == columns and {r.doc_id for r in fresh.collect()} == set(groups.values()) - bad

    named = common.staged(cp.replace_personal_data(spark, fresh, sf_dir))
    assert named.columns == columns
    for r in named.collect():
        old = rows[r.doc_id]
        assert (r.text == old.text) == (not pii.find(old.text)) and r.n_chars == len(r.text) and r.lang == old.lang

    packed = cp.pack_sequences(spark, named, sf_dir).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert set(total) == {r.doc_id for r in named.collect()} and max(r.offset + r.length for r in packed) <= packing.MAX_TOKENS
    assert cp.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("n", [0, 8])
def test_odd_rows(spark, sf_dir, n):
    odd = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "z y x w v", "en", "s", 9), (None, "q", "en", None, 1), (2, "a b c", None, "s", 5), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, "  ", "e", "s", 2)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").limit(n)
    counts = []
    for _, f in cp.STAGES:
        docs = common.staged(f(spark, docs, sf_dir))
        counts.append(docs.count())
    assert counts[:4] == ([8, 4, 4, 4] if n else [0] * 4)


CLASHES = ("score", "__id", "__hash", "__bad", "__later", "row", "spans", "found", "text_hash", "fp", "node", "keys", "id_", "hash_", "bad_id", "contaminated", "component", "n", "a.b", "start", "ids", "label", "y")


def test_columns_of_any_name(spark, sf_dir):
    """Columns that an operator might use itself come through every stage as they were."""
    from pyspark.sql import functions as F

    docs = common.table(spark, sf_dir, "documents")
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat(F.lit(f"{k} "), F.col("doc_id")))
    for _, f in cp.STAGES[:-1]:
        columns = docs.columns
        docs = common.staged(f(spark, docs, sf_dir))
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all(r[c] == f"{k} {r.doc_id}" for r in rows for k, c in enumerate(CLASHES))
    assert cp.pack_sequences(spark, docs, sf_dir).count() >= len(rows)


def test_release(spark):
    df = common.staged(spark.range(3))
    assert df.count() == 3
    common.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
