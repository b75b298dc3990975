"""Parsers and operators by literal cases, invariants, and SQLite's own full-text index."""

import random
import re
import sqlite3
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.config import ChunkPolicy, SearchConfig, SessionFilter, TranscriptOptions, UsageError, clamp_search
from threadloom.functions import paths, text
from threadloom.functions.vectors import centroids, cosine, dot, normalize
from threadloom.operators import chunking, fusion, lexical, semantic, snippets, transcripts
from threadloom.plans import inputs
from threadloom.plans.terms import QueryTerm, parse, words

NOW = datetime(2026, 3, 31, 12)
KNOWN = ["opencode", "copilot-cli", "copilot-vscode"]


def test_terms():
    assert parse("hello world") == [QueryTerm(("hello",), True), QueryTerm(("world",), True)]
    assert parse("re") == [QueryTerm(("re",), False)] and parse("a the x") == [] and parse("") == []
    assert parse('"two words" "open end') == [QueryTerm(("two", "words"), False), QueryTerm(("open", "end"), False)]
    assert parse("foo_bar/b.c")[0] == QueryTerm(("foo", "bar", "b", "c"), True) and parse("--")[0].tokens == ()
    assert not parse('"single"')[0].prefix and parse('"single"', quoted_is_exact=False)[0].prefix
    assert len(parse(" ".join(f"word{i}" for i in range(40)))) == 24
    assert parse("Café")[0].tokens == ("cafe",)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_hostile_queries_parse(q):
    assert all(w for w, _ in words(q)) and len(parse(q)) <= 24
    inputs.without_facets(q)


def test_times():
    t = inputs.time_bound
    assert t("7d", True, NOW) == datetime(2026, 3, 24, 12) and t("1.5h", True, NOW) == datetime(2026, 3, 31, 10, 30) and t("30m", True, NOW) == datetime(2026, 3, 31, 11, 30)
    assert t("month", True, NOW) == datetime(2026, 2, 28, 12) and t("year", True, NOW) == datetime(2025, 3, 31, 12) and t(" Week ", True, NOW) == datetime(2026, 3, 24, 12)
    assert t("2026-01-31", True, NOW) == datetime(2026, 1, 31) and t("2026-01-31", False, NOW).microsecond == 999999 and t(None, True, NOW) is None
    for bad in ("soon", "999999999999d", "-1d", "d"):
        with pytest.raises(UsageError):
            t(bad, True, NOW)


def test_names_and_ranges():
    assert inputs.sources([], KNOWN) == KNOWN and inputs.sources(["COPILOT,opencode"], KNOWN) == KNOWN and inputs.sources(["vscode"], KNOWN) == ["copilot-vscode"]
    assert inputs.sort_name("newest") == "updated" and inputs.mode_name("keyword") == "lexical" and inputs.mode_name("odd") == "hybrid"
    assert [inputs.turn_range(x) for x in ("3", "3-7", "3-", "-7")] == [(3, 3), (3, 7), (3, None), (None, 7)]
    for f, x in ((inputs.sort_name, "odd"), (inputs.turn_range, "-"), (inputs.turn_range, "7-3")):
        with pytest.raises(UsageError):
            f(x)
    assert clamp_search(0, 99) == (1, 10)


def test_facets():
    q = inputs.browse('provider:copilot -provider:vscode since:7d "a b: c" tag:#x repo:"my repo" http://x sort:size group:week', KNOWN, NOW)
    assert q.providers == ("copilot-cli",) and q.text == '"a b: c" http://x' and q.tags == ("x",) and q.repository == "my repo" and (q.sort, q.group) == ("size", "week")
    assert inputs.browse("provider:none", KNOWN, NOW).providers == () and inputs.browse("plain", KNOWN, NOW).providers is None
    assert inputs.without_facets("a since:7d tag:x b", "since") == "a tag:x b" and inputs.without_facets("a since:7d b") == "a b"
    for bad in ("since:", "sort:odd", "since:1d until:7d", "provider:odd"):
        with pytest.raises(UsageError):
            inputs.browse(bad, KNOWN, NOW)
    f = inputs.merged(SessionFilter(source_ids=("opencode",), agent="x"), inputs.browse("provider:none agent:y", KNOWN, NOW))
    assert f.source_ids == () and f.agent == "y"


def _one(spark, c, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(c.alias("x")).first().x


def test_text_functions(spark):
    x = F.col("x")
    assert _one(spark, text.flatten(x), x=" a\n\t b\u00a0 c ") == "a b c"
    assert _one(spark, text.truncate(x, 10), x="abcdefgh ijkl") == "abcdefgh…" and _one(spark, text.truncate(x, 10), x="abcdefghijkl") == "abcdefghij…" and _one(spark, text.truncate(x, 10), x="short") == "short"
    assert _one(spark, text.derive_title(x), x="Fix it now please. And more") == "Fix it now please." and _one(spark, text.derive_title(x), x="Hi. there") == "Hi. there" and _one(spark, text.derive_title(x), x="  ") == "(untitled session)"
    assert _one(spark, text.words(x), x="Café, foo_bar!") == " cafe  foo  bar " and _one(spark, text.word_count(text.words(x)), x="--") == 0
    assert _one(spark, text.highlight(x, ["the", "there"]), x="There the") == "<<There>> <<the>>"
    assert _one(spark, text.tag_name(x), x=" My  Tag ") == "my-tag" and _one(spark, text.role_name(x), x="robot") == "Assistant"
    assert _one(spark, paths.file_uri_path(x), x="file:///c%3A/a%20b+c/") == "c:/a b+c"
    assert _one(spark, paths.is_under(x, "/a/b"), x="/a/bc") is False and _one(spark, paths.is_under(x, "/a/b/"), x="\\a\\b\\c") is True and _one(spark, paths.is_under(x, ""), x="") is True
    assert _one(spark, paths.quoted(x), x='a "b"') == '"a \\"b\\""' and _one(spark, paths.after_dot(x), x="a.b") == "b"


def test_terms_that_overlap_themselves(spark):
    w = text.words(F.col("x"))
    count = lambda q, x: _one(spark, lexical.frequency(w, q), x=x)
    assert count(QueryTerm(("of", "of"), False), "of of of") == 2 and count(QueryTerm(("a", "b"), False), "a b a b c") == 2
    assert count(QueryTerm(("a", "aa"), True), "a aab aac") == 1 and count(QueryTerm(("ti",), True), "tick tock ti") == 2 and count(QueryTerm((), False), "x") == 0


def test_ranking_equals_sqlite(spark):
    rng = random.Random(1)
    vocabulary = ["retry", "retries", "back", "backoff", "queue", "café", "of", "the", "parser", "éclair"]
    docs = [(f"d{i:02}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(docs)])
    df = lexical.tokenized(spark.createDataFrame(docs, "uri string, text string").withColumn("ordinal", F.lit(0)))
    for query, match in (("retr backoff", '"retr"* OR "backoff"*'), ('"of the" cafe', '"of the" OR "cafe"*'), ("eclair queue parser", '"eclair"* OR "queue"* OR "parser"*')):
        want = {docs[r][0]: -s for r, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
        got = {r.uri: r.score for r in lexical.bm25(df, parse(query)).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    index = lexical.postings(df)
    n, mean = df.agg(F.count(F.lit(1)), F.avg("n_tokens")).first()
    by_index = {r.uri: r.score for r in lexical.bm25_postings(index, n, mean, parse("retr backoff")).collect()}
    assert by_index.keys() == {r.uri for r in lexical.bm25(df, parse("retr backoff")).collect()}
    with pytest.raises(ValueError):
        lexical.bm25_postings(index, n, mean, parse('"of the"'))


def test_excerpts():
    t = parse("retry policy")
    assert snippets.excerpt("the retry policy is here", t) == "the <<retry>> <<policy>> is here" and snippets.excerpt("none", t) is None
    long = " ".join(f"w{i}" for i in range(100)) + ". Retries follow a policy. " + " ".join(f"v{i}" for i in range(100))
    got = snippets.excerpt(long, t)
    assert got.startswith("…") and got.endswith("…") and "<<policy>>" in got and len(re.findall(r"\w+", got)) == 20
    assert snippets.excerpt("a of the b", parse('"of the"')) == "a <<of the>> b"


@given(st.text(alphabet="ab .\n!", min_size=0, max_size=400), st.integers(20, 60), st.integers(0, 15))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text(s, size, overlap):
    p = ChunkPolicy(max_characters=size, overlap=overlap, min_characters=1)
    pieces = chunking.split(s, p)
    assert all(0 < len(x) <= size for x in pieces)
    at = 0
    for x in pieces:
        found = s.find(x, max(0, at - size))
        assert found >= 0
        at = found + len(x)
    assert "".join(s.split()) == "" or pieces and pieces[0][0] == s.strip()[0] and pieces[-1][-1] == s.strip()[-1]


def test_breaks():
    assert chunking.break_at("a" * 70 + "\n\n" + "b" * 28) == 72 and chunking.break_at("a" * 70 + ". " + "b" * 28) == 71
    assert chunking.break_at("a" * 70 + "\n" + "b" * 29) == 71 and chunking.break_at("a" * 70 + " " + "b" * 29) == 71 and chunking.break_at("a" * 100) == 100


def test_chunks_of_a_session(spark):
    from threadloom.schema import BLOCK

    def block(**x):
        return tuple(x.get(f.name) for f in BLOCK.fields)

    s = spark.createDataFrame([("u", "A title long enough", "A preview", None, "org/r", None)], "uri string, title string, preview string, workspace_path string, repository string, created_at timestamp_ntz")
    turns = spark.createDataFrame([("u", 0, "User", None, [block(kind="text", text="Please run the tests"), block(kind="tool", tool_name="bash", title="Run\nit", input_json="{}", output="x" * 5000), block(kind="patch", path="/a")])], f"uri string, turn_index int, role string, timestamp timestamp_ntz, blocks array<{BLOCK.simpleString()}>")
    got = chunking.chunks(s, turns).orderBy("ordinal").collect()
    assert [(r.ordinal, r.role, r.is_embeddable) for r in got] == [(0, "System", True), (1, "Tool", False), (2, "User", True)]
    assert got[0].text == "A title long enough\nA preview\norg/r" and got[1].text == "[bash] Run it\n{}\n" + "x" * 4000 and got[2].text == "Please run the tests\n\n[edit] /a"


@pytest.mark.parametrize("bounded", [True, False])
def test_ranks(spark, bounded):
    rng = random.Random(bounded)
    rows = [(f"s{rng.randrange(40):02}", i, float(rng.randrange(15))) for i in range(300)]
    best = {}
    for u, o, s in rows:
        best[u] = max(best.get(u, (-1, 0)), (s, -o))
    want = {u: k for k, (u, _) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], x[0])), 1)}
    got = fusion.session_ranks(spark.createDataFrame(rows, "uri string, ordinal int, score double"), bounded).collect()
    assert {r.uri: r["rank"] for r in got} == want


def test_fusion_and_boosts(spark):
    lists = {n: spark.createDataFrame(r, "uri string, rank int") for n, r in (("lexical", [("a", 1), ("b", 2)]), ("semantic", [("b", 1), ("c", 2)]))}
    got = {r.uri: r for r in fusion.fused(lists).collect()}
    assert got["b"].score == pytest.approx(1 / 62 + 1 / 61) and got["c"].lexical_score == 0 and got["a"].semantic_rank is None
    assert [r.uri for r in fusion.cut(fusion.fused(lists), 1).collect()] == ["b", "a"]
    s = F.lit(1.0)
    assert _one(spark, fusion.recency(s, F.col("t"), NOW), t=NOW) == pytest.approx(1.15) and _one(spark, fusion.recency(s, F.col("t"), NOW), t=datetime(2026, 3, 1, 12)) == pytest.approx(1.075)
    assert SearchConfig().candidate_cap == 500 and lexical.candidate_cap(1) == 50 and lexical.candidate_cap(50) == 500


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert _one(spark, dot(v(1, 2), v(3, 4)), x=1) == 11 and _one(spark, dot(v(1, 2), v(3)), x=1) == 0 and _one(spark, cosine(v(0, 0), v(1, 1)), x=1) == 0
    assert _one(spark, normalize(v(3, 4)), x=1) == [0.6, 0.8]
    got = centroids(spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0])], "k string, vector array<float>"), "k").collect()
    assert {r.k: [round(x, 6) for x in r.vector] for r in got} == {"a": [0.707107] * 2, "b": [0.0, 0.0]}
    assert semantic.effective_mode("semantic", False, True) == "lexical" and semantic.effective_mode("semantic", True, False) == "none" and semantic.effective_mode("hybrid", True, False) == "lexical"
    assert semantic.check_model("a", "b", True) and not semantic.check_model(None, "b")


@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(1, 120))
@settings(max_examples=25, deadline=None)
def test_budget_equals_a_walk(spark, sizes, budget):
    kept, total, after = [], 0, None
    for i, n in enumerate(sizes):
        if i and (after is not None or total + n > budget):
            after = i if after is None else after
            continue
        if not i or total + n <= budget:
            kept.append(i)
            total += n
    df = spark.createDataFrame([("u", i, n) for i, n in enumerate(sizes)], "uri string, turn_index int, n int").coalesce(1)
    rows = transcripts.page(df, TranscriptOptions(max_characters=budget), F.col("n")).collect()
    assert sorted(r.turn_index for r in rows) == kept and rows[0].next_turn_index == after and rows[0].is_truncated == (after is not None)
