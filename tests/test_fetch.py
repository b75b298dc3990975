"""Late fetch: only row groups and pages of the wanted keys are read."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadloom.catalog import Catalog
from threadloom.config import SearchQuery
from threadloom.operators import fetch
from threadloom.plans.store import IndexStore

from .scans import scanned
from .test_engine import Memory

NOW = datetime(2024, 6, 1)


def test_a_few_keys_read_few_rows(spark, tmp_path):
    rows = spark.range(40_000).select(F.concat(F.lit("doc://"), F.md5(F.col("id").cast("string"))).alias("uri"), (F.col("id") % 3).alias("ordinal"), F.repeat(F.md5(F.rand(1).cast("string")), 8).alias("text"))
    path = f"file://{tmp_path}/text"
    fetch.write_clustered(rows, path, "uri", "ordinal", row_group_bytes=1 << 20)
    stored = spark.read.parquet(path)
    keys = [r.uri for r in rows.where("id % 9973 = 5").select("uri").collect()]
    found = fetch.few(stored, "uri", keys)
    assert len(keys) == 5 and sum(scanned(found)) < 2500
    assert {r.uri for r in found.collect()} == set(keys) and found.count() == 5
    asked = spark.createDataFrame([(k,) for k in keys], "uri string").repartition(2)
    assert sum(scanned(stored.join(F.broadcast(asked), "uri"))) >= 40_000  # as a join, all are read
    assert fetch.few(stored, "uri", []).count() == 0 and sum(scanned(fetch.few(stored, "uri", ["none"]))) == 0
    with pytest.raises(ValueError):
        fetch.few(stored, "uri", ["x"] * (fetch.MOST_KEYS + 1))


def test_a_search_reads_only_the_passages_of_its_hits(spark, tmp_path):
    draw = random.Random(3)
    words = ["apple", "river", "stone", "cloud", "engine", "needle"]
    rows = [(f"s{k:05d}", f"Title {k}", " ".join(draw.choice(words[:5]) for _ in range(60)) + (" needle" if k in (7, 1900) else ""), 1, k) for k in range(2000)]
    catalog = Catalog(spark, IndexStore(spark, f"file://{tmp_path}/index"), [Memory(spark, rows)])
    catalog.refresh(NOW)
    hits = catalog.search(SearchQuery("needle", mode="lexical"), NOW)
    total = catalog.store.table("chunk").count()
    assert {h.title for h in hits.collect()} == {"Title 7", "Title 1900"} and all("<<needle>>" in h.snippets[0].highlighted for h in hits.collect())
    assert total >= 4000 and sum(scanned(hits)) < total / 4
