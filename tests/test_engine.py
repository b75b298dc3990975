"""The catalogue over a store, refreshes, streaming."""

import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom.catalog import Catalog, json_lines
from threadloom.config import AmbiguousError, EngineConfig, NotFoundError, SearchQuery, SessionFilter, TranscriptOptions, UsageError
from threadloom.plans.embedding import HashedWords, model_kind
from threadloom.plans.store import IndexStore
from threadloom.schema import BLOCK
from threadloom.sources.base import SessionSource, as_sessions
from threadloom.streaming import refresh as stream

NOW = datetime(2024, 6, 1)


class Memory(SessionSource):
    """Sessions of (id, title, said, hash, hours ago)."""

    source_id = "memory"

    def __init__(self, spark, rows):
        super().__init__(spark, "memory")
        self.rows = rows

    def sessions(self):
        rows = [(f"session://memory/{i}", "memory", i, t, "/w/" + i, NOW - timedelta(hours=h), NOW - timedelta(hours=h), 2, False, str(k)) for i, t, _, k, h in self.rows]
        return as_sessions(self.spark.createDataFrame(rows, "uri string, source_id string, native_id string, title string, workspace_path string, created_at timestamp_ntz, updated_at timestamp_ntz, message_count int, is_archived boolean, content_hash string"))

    def turns(self):
        tool = tuple({"kind": "tool", "tool_name": "bash", "output": "LONGTOOLTOKEN passed"}.get(f.name) for f in BLOCK.fields)
        text = lambda s: tuple({"kind": "text", "text": s}.get(f.name) for f in BLOCK.fields)
        rows = []
        for i, _, said, _, _ in self.rows:
            rows += [(f"session://memory/{i}", 0, "User", None, None, None, [text(said)]), (f"session://memory/{i}", 1, "Assistant", None, None, None, [tool, text("Here is the answer about " + said)])]
        return self.spark.createDataFrame(rows, f"uri string, turn_index int, role string, timestamp timestamp_ntz, model string, agent string, blocks array<{BLOCK.simpleString()}>")


ROWS = [("aaaa1", "Retry policy", "implement exponential backoff for retries", 1, 5), ("aaaa2", "Colours", "choose a palette of colours for the chart", 1, 50), ("bbbb1", "Parsing", "the parser fails on nested quotes", 1, 500)]


@pytest.fixture()
def catalog(spark, tmp_path):
    c = Catalog(spark, IndexStore(spark, f"file://{tmp_path}/index"), [Memory(spark, list(ROWS))], embedder=HashedWords())
    c.refresh(NOW)
    return c


def test_search_modes(catalog):
    hits = catalog.search(SearchQuery("backoff", mode="lexical"), NOW).collect()
    assert [h.title for h in hits] == ["Retry policy"] and "<<backoff>>" in hits[0].snippets[0].highlighted
    assert catalog.search(SearchQuery("exponential backoff retries"), NOW).first().title == "Retry policy"
    assert catalog.search(SearchQuery("palette of colours", mode="semantic"), NOW).first().title == "Colours"
    assert catalog.search(SearchQuery("LONGTOOLTOKEN", mode="lexical"), NOW).count() == 3
    assert catalog.search(SearchQuery("the of --", mode="lexical"), NOW).count() == 0
    assert catalog.search(SearchQuery("backoff", filter=SessionFilter(workspace_path="/w/bbbb1"), mode="lexical"), NOW).count() == 0


def test_list_get_and_status(catalog):
    assert [r.native_id for r in catalog.list(SessionFilter(sort="title")).collect()] == ["aaaa2", "bbbb1", "aaaa1"]
    turns = catalog.transcript("memory/aaaa1", TranscriptOptions(max_characters=45)).collect()
    assert [t.turn_index for t in turns] == [0] and turns[0].next_turn_index == 1 and turns[0].is_truncated
    assert catalog.transcript("aaaa1").collect()[1].blocks[0].output is None
    s = catalog.status().first()
    assert (s.sessions, s.embeddable_sessions, s.embedded_sessions) == (3, 3, 3)
    assert catalog.source_table().first().available and "uri" in json_lines(catalog.list()).first().value
    with pytest.raises(AmbiguousError):
        catalog.resolve("aaaa")
    with pytest.raises(NotFoundError):
        catalog.resolve("aa")


def test_refresh_only_what_changed(catalog, spark):
    src = catalog.sources[0]
    assert catalog.refresh(NOW).written == 0
    src.rows[0] = ("aaaa1", "Retry policy", "now about jitter instead", 2, 1)
    report = catalog.refresh(NOW)
    assert report.written == 1 and catalog.search(SearchQuery("jitter", mode="lexical"), NOW).count() == 1
    assert catalog.search(SearchQuery("exponential", mode="lexical"), NOW).count() == 0
    del src.rows[2]
    assert catalog.refresh(NOW).sources[0].pruned == 1 and catalog.list().count() == 2
    assert catalog.refresh(NOW, force=True).written == 2


def test_scoped_refresh_keeps_the_cursor(spark, tmp_path):
    c = Catalog(spark, IndexStore(spark, f"file://{tmp_path}/index"), [Memory(spark, list(ROWS))])
    assert c.refresh(NOW, scope=SessionFilter(since=NOW - timedelta(hours=10))).written == 1
    assert "cursor" not in c.store.manifest()["sources"]["memory"]
    assert c.refresh(NOW).written == 2


def test_policy_and_backfill(spark, tmp_path):
    src, store = Memory(spark, list(ROWS)), IndexStore(spark, f"file://{tmp_path}/index")
    off = EngineConfig().with_source(["MEMORY"], ["memory"], enabled=False)
    assert Catalog(spark, store, [src], off).refresh(NOW).sources[0].skipped == "disabled"
    plain = Catalog(spark, store, [src], EngineConfig(not_indexed_by_default=frozenset({"memory"})))
    assert plain.refresh(NOW).sources[0].skipped == "not indexed by default" and plain.refresh(NOW, named=["memory"]).written == 3
    with_vectors = Catalog(spark, store, [src], embedder=HashedWords())
    assert with_vectors.refresh(NOW, backfill=True).written == 3 and with_vectors.refresh(NOW, backfill=True).written == 0
    with pytest.raises(UsageError):
        Catalog(spark, store, [src], embedder=HashedWords(32)).refresh(NOW)
    assert with_vectors.top_up(NOW + timedelta(minutes=1)) is None and with_vectors.top_up(NOW + timedelta(hours=1)).written == 0
    with pytest.raises(UsageError):
        EngineConfig().with_source(["nope"], ["memory"], enabled=False)


def test_refreshes_write_what_changed(catalog, spark, tmp_path):
    """A changed session is a generation of its own; later ones replace it; many are written as one."""
    store, src = catalog.store, catalog.sources[0]
    first = store.manifest()["generation"]
    for k in range(10):
        src.rows[0] = ("aaaa1", f"Retry {k}", f"word{k} about jitter", 10 + k, 1 - k / 20)
        assert catalog.refresh(NOW + timedelta(minutes=k)).written == 1
        state = store.manifest()["sources"]["memory"]
        if k == 0:
            assert state["generations"] == [first, first + 1]
            assert spark.read.parquet(f"file://{tmp_path}/index/gen={first + 1}/session").count() == 1
    assert len(state["generations"]) < 8 and state["sessions"] == 3 == store.table("session").count()
    assert {r.title for r in store.table("session").collect()} == {"Retry 9", "Colours", "Parsing"}
    assert store.statistics()[0] == state["chunks"] == store.table("chunk").count()
    assert store.table("posting").select("uri", "ordinal").distinct().count() == state["chunks"]
    assert catalog.search(SearchQuery("word8", mode="lexical"), NOW).count() == 0 and catalog.search(SearchQuery("word9", mode="lexical"), NOW).count() == 1
    live = catalog.list().count()
    assert store.vacuum() > 0 and catalog.list().count() == live == 3 and store.vacuum() == 0


def test_search_reads_postings_only(catalog):
    """The words of passages are not scanned; phrases come from the index too."""
    from threadloom.operators import lexical
    from threadloom.plans.terms import parse

    store, terms = catalog.store, parse('"choose a palette" parser the_answer LONGTOOL')
    plan = lexical.bm25_places(store.table("posting"), *store.statistics(), terms)._jdf.queryExecution().executedPlan().toString()
    assert "words" not in plan and "PushedFilters: [Or(" in plan
    whole = {(r.uri, r.ordinal): round(r.score, 9) for r in lexical.bm25(store.table("chunk"), terms).collect()}
    assert {(r.uri, r.ordinal): round(r.score, 9) for r in lexical.bm25_places(store.table("posting"), *store.statistics(), terms).collect()} == whole and len(whole) > 3


def test_another_model_drops_all_vectors(spark, tmp_path):
    """Forced for one source only, the vectors of the other must not live on under the new model's name."""
    one, two = Memory(spark, ROWS[:2]), Memory(spark, ROWS[2:])
    two.source_id = "other"
    store = IndexStore(spark, f"file://{tmp_path}/index")
    Catalog(spark, store, [one, two], embedder=HashedWords()).refresh(NOW)
    assert store.table("session_embedding").count() == 3
    small = Catalog(spark, store, [one, two], embedder=HashedWords(32))
    assert small.refresh(NOW, force=True, named=["memory"]).written == 2
    assert store.manifest()["embedding_model"] == HashedWords(32).name
    assert {r.n for r in store.table("chunk_embedding").select(F.size("vector").alias("n")).collect()} == {32}
    assert {r.source_id for r in store.table("session_embedding").collect()} == {"memory"}
    assert small.refresh(NOW, backfill=True).written == 1 and store.table("session_embedding").count() == 3


def test_backfill_takes_only_what_can_be_embedded(spark, tmp_path):
    rows = [*ROWS, ("cccc1", "Tiny", "x", 1, 2)]

    class Short(Memory):
        def turns(self):
            return super().turns().where("uri <> 'session://memory/cccc1' or turn_index = 7")

    store, src = IndexStore(spark, f"file://{tmp_path}/index"), Short(spark, rows)
    assert Catalog(spark, store, [src]).refresh(NOW).written == 4
    with_vectors = Catalog(spark, store, [src], embedder=HashedWords())
    assert with_vectors.refresh(NOW, backfill=True).written == 3 and with_vectors.refresh(NOW, backfill=True).written == 0


def test_unreadable_sessions_hold_the_cursor(spark, tmp_path):
    class Torn(Memory):
        torn = ()

        def unreadable(self):
            return self.spark.createDataFrame([(f"session://memory/{i}",) for i in self.torn], "uri string")

    src, store = Torn(spark, list(ROWS)), IndexStore(spark, f"file://{tmp_path}/index")
    c = Catalog(spark, store, [src])
    src.torn = ("aaaa1",)
    report = c.refresh(NOW).sources[0]
    assert (report.written, report.failed, report.complete) == (2, 1, False) and "cursor" not in store.manifest()["sources"]["memory"]
    src.torn = ()
    report = c.refresh(NOW).sources[0]
    assert (report.written, report.complete) == (1, True) and "cursor" in store.manifest()["sources"]["memory"]
    src.rows[0], src.torn = ("aaaa1", "Newer", "other words", 9, 0), ("aaaa1",)
    assert c.refresh(NOW).sources[0].failed == 1 and {r.title for r in c.list().collect()} == {"Retry policy", "Colours", "Parsing"}


def test_pending_sources_and_kept_centroids(catalog):
    assert catalog.pending() == []
    catalog.sources[0].rows[0] = ("aaaa1", "Newer", "colours of another palette", 5, 1)
    assert catalog.pending() == ["memory"]
    one = catalog._centroids()
    assert catalog._centroids() is one and one.is_cached
    catalog.refresh(NOW)
    assert catalog.pending() == [] and catalog._centroids() is not one and catalog._centroids().count() == 3


def test_files_fall_back_to_the_source(spark, tmp_path):
    class WithFiles(Memory):
        known = [("session://memory/aaaa1", "/a", "edit", 0)]

        def files(self):
            return self.spark.createDataFrame(self.known, "uri string, path string, tool string, turn_index int")

    src, store = WithFiles(spark, list(ROWS)), IndexStore(spark, f"file://{tmp_path}/index")
    c = Catalog(spark, store, [src])
    c.refresh(NOW)
    src.known = [("session://memory/aaaa1", "/later", "edit", 0), ("session://memory/bbbb1", "/b", "edit", 1)]
    assert [r.path for r in c.files("aaaa1").collect()] == ["/a"] and [r.path for r in c.files("bbbb1").collect()] == ["/b"]


def test_tags_of_one_moment_and_many_files(catalog, monkeypatch):
    from threadloom.plans import store as module

    assert catalog.tag("aaaa1", add=["x"], remove=["x"], now=NOW) == (1, 1)
    assert catalog.list(SessionFilter(tags=("x",))).count() == 0
    for k in range(3):
        catalog.tag("aaaa2", add=[f"t{k}"], now=NOW + timedelta(minutes=k))
    monkeypatch.setattr(module, "MAX_TAG_FILES", 2)
    catalog.refresh(NOW + timedelta(hours=1))
    assert catalog.store.manifest()["tags"].startswith("tags-") and catalog.list(SessionFilter(tags=("t0", "t1", "t2"))).count() == 1
    assert catalog.tag("aaaa2", remove=["t1"], now=NOW + timedelta(hours=2)) == (0, 1) and catalog.list(SessionFilter(tags=("t1",))).count() == 0


def test_tags_outlive_the_index(catalog):
    assert catalog.tag("aaaa1", add=[" My Tag ", "my-tag", "x"], now=NOW) == (2, 0)
    assert catalog.tag("aaaa1", add=["X"], now=NOW) == (0, 0)
    assert [r.native_id for r in catalog.list(SessionFilter(tags=("MY-TAG", "x"))).collect()] == ["aaaa1"]
    assert catalog.tag("aaaa1", remove=["X"], now=NOW + timedelta(seconds=1)) == (0, 1)
    catalog.store.clear()
    assert not catalog.store.exists() and catalog.list(SessionFilter(tags=("my-tag",))).count() == 1


def test_resume_line(catalog):
    assert catalog.resume_line("bbbb1").startswith("code --reuse-window /w/bbbb1")
    assert model_kind("intfloat/multilingual-e5-large").pooling == "mean" and model_kind("bge-base").pooling == "cls"


def test_streaming_equals_batch(spark, tmp_path, sf_dir):
    rows = spark.range(100).select(F.concat(F.lit("s"), (F.col("id") % 10).cast("string")).alias("uri"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("updated_at"), F.col("id").cast("string").alias("content_hash"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    q = stream.refresh_available(stream.changes(spark, f"{tmp_path}/in", rows.schema, 1), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    got = {(r.uri, r.content_hash) for r in stream.latest(spark, f"{tmp_path}/out").collect()}
    assert got == {(r.uri, r.content_hash) for r in stream.keep_latest(rows).collect()} and len(got) == 10


def test_windows_over_a_stream(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.write.parquet(f"{tmp_path}/events")
    for k, make in enumerate((lambda s: stream.tumbling(s, "1 hour"), lambda s: stream.sessionized(s, "30 minutes"), stream.distinct_events)):
        s = make(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/events"))
        q = s.writeStream.format("memory").queryName(f"w{k}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    n = e.count()
    assert spark.table("w2").count() == n and 0 < spark.table("w0").agg(F.sum("n")).first()[0] <= n


def test_export_health_and_live_search(catalog):
    md = catalog.markdown("aaaa1")
    assert md.startswith("# Retry policy\n\n```yaml\nuri: session://memory/aaaa1") and "## assistant\n\n**Tool** `bash`\n\n```\nLONGTOOLTOKEN passed\n```" in md
    assert catalog.health(NOW).where("name = 'overall'").first().ok and not catalog.health(NOW + timedelta(days=1)).where("name = 'freshness'").first().ok
    assert [r.uri for r in catalog.search_live(SearchQuery("backoff")).collect()] == ["session://memory/aaaa1"]
    assert catalog.list(mode="live").count() == 3 == catalog.list(mode="index_only").count()


def test_settings():
    from threadloom.config import settings, with_setting

    c = with_setting(with_setting(EngineConfig(), "search.rrf_k", "70"), "chunk.include_reasoning", "no")
    assert settings(c)["search.rrf_k"] == 70 and not c.chunk.include_reasoning and with_setting(c, "disabled_sources", "a, b").disabled_sources == {"a", "b"}
    for name, value in (("odd", "1"), ("search.rrf_k", "x"), ("chunk.include_reasoning", "maybe")):
        with pytest.raises(UsageError):
            with_setting(c, name, value)


def test_top_up_stops_at_its_budget(spark, tmp_path):
    class Slow(Memory):
        def sessions(self):
            wait = F.udf(lambda x: __import__("time").sleep(0.4) or x, "string")
            return super().sessions().repartition(60).withColumn("title", wait("title"))

    c = Catalog(spark, IndexStore(spark, f"file://{tmp_path}/index"), [Slow(spark, [(f"x{i}", "t", "s", 1, 1) for i in range(200)])], EngineConfig(refresh_budget_seconds=1))
    assert c.top_up(NOW) is None and not c.store.exists()
