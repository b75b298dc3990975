"""A store's passages: texts are sent once, read once, and searched only as far as a title needs."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.catalog import Catalog
from threadloom.functions import text
from threadloom.operators import chunking, lexical
from threadloom.plans import store as stores
from threadloom.plans.store import IndexStore
from threadloom.queries import bindings
from threadloom.queries.engine import Documents
from threadloom.schema import BLOCK

from .test_engine import NOW, ROWS, Memory

PARTS = ["uri string", "turn_index int", "role string", "timestamp timestamp_ntz", f"blocks array<{BLOCK.simpleString()}>"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _block(**x):
    return tuple(x.get(f.name) for f in BLOCK.fields)


@pytest.mark.parametrize("slice_", [1, 500, chunking.SLICE_CHARACTERS])
def test_passages_are_cut_where_their_session_is(spark, monkeypatch, slice_):
    monkeypatch.setattr(chunking, "SLICE_CHARACTERS", slice_)
    rng, turns, want = random.Random(7), [], []
    titles = [(f"u{s}", "A title that is long enough" if s % 3 else "short", None, None, None, None) for s in range(12)]
    for s in range(14):  # the last two have no session
        number, known = 0, s < 12
        if known and s % 3:
            want.append((f"u{s}", 0, "System", titles[s][1], True))
            number = 1
        for t in range(rng.randrange(4)):
            blocks, prose = [], []
            for k in range(rng.randrange(5)):
                words = " ".join(rng.choice(["alpha", "beta.", "gamma\n"]) for _ in range(rng.choice([3, 400])))
                blocks.append(_block(kind=("text", "tool", "reasoning")[k % 3], text=words if k % 3 != 1 else None, tool_name="t", output=words if k % 3 == 1 else None))
                if k % 3 == 1:
                    if known:
                        want.append((f"u{s}", number, "Tool", "[t]\n" + words[:4000], False))
                    number += 1
                else:
                    prose.append(words.strip(" "))
            turns.append((f"u{s}", t, "User", None, blocks or None))
            for p in chunking.split("\n\n".join(prose)):
                if known:
                    want.append((f"u{s}", number, "User", p, True))
                number += 1
    rng.shuffle(turns)
    sessions = spark.createDataFrame(titles, "uri string, title string, preview string, workspace_path string, repository string, created_at timestamp_ntz")
    made = lexical.tokenized(chunking.chunks(sessions, spark.createDataFrame(turns, ", ".join(PARTS)).repartition(5)))
    got = [(r.uri, r.ordinal, r.role, r.text, r.is_embeddable) for r in made.collect()]
    assert sorted(got) == sorted(want)
    assert _plan(made.select("uri", "ordinal", "words", "n_tokens")).count("hashpartitioning(uri") == 1 and "Window" not in _plan(made)


def test_many_sessions_are_told_apart_where_their_turns_meet(spark, tmp_path, monkeypatch):
    tables = []
    for few in (0, stores.FEW_SESSIONS):
        monkeypatch.setattr(stores, "FEW_SESSIONS", few)
        source = Memory(spark, list(ROWS))
        catalog = Catalog(spark, IndexStore(spark, f"file://{tmp_path}/{few}"), [source])
        catalog.refresh(NOW)
        source.rows[0] = ("aaaa1", "Retry policy", "now about jitter instead", 2, 1)
        assert catalog.refresh(NOW).written == 1
        tables.append(sorted(map(str, catalog.store.table("chunk").drop("timestamp").collect())))
    assert tables[0] == tables[1] and len(tables[0]) == 10


def test_words_and_their_number_are_made_once(spark):
    rows = lexical.tokenized(spark.createDataFrame([("Éa b--c",), (None,), ("",)], "text string"))
    assert [(r.words, r.n_tokens) for r in rows.collect()] == [(" ea  b  c ", 3), ("", 0), ("", 0)]
    assert _plan(rows.select("words", "n_tokens")).count("regexp_replace(") == 1


def test_titles_read_the_start_of_a_text(spark):
    odd = ["", " \n ", "a" * 90, " " * 500 + "one. two", ("x" + " \n" * 40) * 300, "word " * 400, "Stop here, please. And on " * 30, "é " * 250, "b" * 80 + "\n" * 9000 + "c"]
    df = spark.createDataFrame([(t,) for t in odd] + [(None,)], "t string")
    for n in (8, 80, 200):
        for r in df.select(text.begun(F.col("t"), n).alias("start"), text.flatten("t").alias("flat"), text.preview(F.col("t"), n).alias("shown"), text.truncate(text.flatten("t"), n).alias("want")).collect():
            assert r.flat.startswith(r.start) and (r.start == r.flat or len(r.start) > n) and r.shown == r.want
    assert max(len(r.s) for r in df.select(text.begun(F.col("t"), 80).alias("s")).collect() if "word" in r.s) <= 160
    assert df.select(text.preview(F.col("t"), 0).alias("s")).collect()[5].s == ("word " * 400).strip()


def test_texts_are_not_sent_to_labels(spark, sf_dir):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = bindings.sessions(spark, sf_dir, dealt=False).drop("text")._jdf.queryExecution().optimizedPlan().toString().split("\n")
        below = lines[next(k for k, x in enumerate(lines) if "Join LeftOuter" in x) + 1]
        assert "md5(" in below and " text#" not in below.replace("cast(text#", "").replace("coalesce(text#", "")
        source = Documents(spark, sf_dir)
        for part in (source.turns(), source.ids()):
            assert "labels.parquet" not in _plan(part) and "Join" not in _plan(part)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
