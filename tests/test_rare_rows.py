"""Queries against their SQL on rows that the smallest tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom import registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rare(spark, tmp_path_factory):
    """Sessions of the last hour and of the last day, texts about the least size of a passage."""
    d = str(tmp_path_factory.mktemp("rare"))
    texts = ["Anouble thwh.", "Ly. Th heing.", "x", "  padded but short ", "sixteen letters.", "words of a longer text " * 90]
    rows = [(i, texts[k % len(texts)], "en", f"src{i % 3}", len(texts[k % len(texts)])) for k, i in enumerate([1439, 1438, 1437, 1436, 2879, 21, 22, 23, 24, 26, 27, 28])]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(21, 1, 0), (22, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def same(spark, d, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, d)
    found = con.execute(registry.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    got = sorted(map(tuple, df.collect()))
    assert got and got == sorted(tuple(r[i] for i in at) for r in found.fetchall())
    return got


def test_ages_in_a_list(spark, rare):
    """Below an hour the list's own line says hours; the relative time has minutes."""
    lines = dict(same(spark, rare, "detail_line"))
    assert any("0h ago" in x for x in lines.values())
    assert any(x.endswith("m ago") for x in dict(same(spark, rare, "relative_time")).values())


def test_passages_of_short_texts(spark, rare):
    """A short text's title is a passage of the header, which is none of what was said."""
    uris = {int(u.rpartition("/")[2]) for u, *_ in same(spark, rare, "store_passages")}
    assert uris == {1436, 2879, 21, 26, 27, 28}
