"""Connectors over stores made here with the real layouts."""

import json
import os
import sqlite3
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from threadloom.config import SessionFilter
from threadloom.sources import sqlite_source
from threadloom.sources.copilot_cli import CopilotCli
from threadloom.sources.opencode import OpenCodeSqlite, OpenCodeTree, opencode
from threadloom.sources.vscode import VsCode, replay, response_blocks

from .scans import scanned

T0 = 1_700_000_000_000


@pytest.fixture(scope="module")
def oc(tmp_path_factory):
    root = tmp_path_factory.mktemp("oc")
    con = sqlite3.connect(root / "opencode.db")
    con.executescript(
        """CREATE TABLE project(id text PRIMARY KEY, worktree text, name text);
        CREATE TABLE session(id text PRIMARY KEY, project_id text, parent_id text, slug text, directory text, title text, version text, time_created int, time_updated int, time_archived int, model text, cost real, tokens_input int, tokens_output int);
        CREATE TABLE message(id text PRIMARY KEY, session_id text, time_created int, time_updated int, data text);
        CREATE TABLE part(id text PRIMARY KEY, message_id text, session_id text, time_created int, time_updated int, data text);"""
    )
    con.execute("INSERT INTO project VALUES ('p', '/w/tree', 'Tree')")
    for k in range(3):
        model = [json.dumps({"id": "m-1", "providerID": "x"}), "bare-model", None][k]
        con.execute("INSERT INTO session VALUES (?,?,?,?,?,?,?,?,?,?,?,?,?,?)", (f"s{k}", "p" if k else None, None, f"slug{k}", None if k else "/w/dir", "" if k == 1 else f"Title {k}", f"1.{k}", T0 + k, T0 + 10 * k if k else 0, 5 if k == 2 else None, model, 0.5, 3, 4 * k))
        for m in range(4):
            role = "user" if m % 2 == 0 else "robot"
            con.execute("INSERT INTO message VALUES (?,?,?,?,?)", (f"m{k}{m}", f"s{k}", T0 + m, T0, json.dumps({"role": role, "modelID": "x/m", "time": {"created": T0 + m}})))
            parts = [{"type": "text", "text": f"hello {m}"}, {"type": "step-start"}, {"type": "text", "text": "  "}]
            if m % 2:
                parts += [{"type": "tool", "tool": "bash", "callID": "c", "state": {"status": "completed", "input": {"filePath": "/w/A.py"}, "output": "done", "title": "Run", "time": {"start": 5, "end": 9}}}, {"type": "patch", "files": ["/w/a.py", "/w/b.py"], "patch": "diff"}]
            for n, p in enumerate(parts):
                con.execute("INSERT INTO part VALUES (?,?,?,?,?,?)", (f"q{k}{m}{n}", f"m{k}{m}", f"s{k}", T0 + m, T0, json.dumps(p) if n != 1 or m else "{broken"))
    con.commit()
    con.close()
    return root


def test_opencode_sessions(spark, oc):
    s = {r.native_id: r for r in OpenCodeSqlite(spark, str(oc / "opencode.db")).sessions().collect()}
    assert s["s0"].workspace_path == "/w/dir" and s["s1"].workspace_path == "/w/tree"
    assert s["s1"].title == "slug1" and s["s0"].models == ["m-1"] and s["s1"].models == ["bare-model"] and s["s2"].models == []
    assert s["s0"].updated_at == s["s0"].created_at and s["s2"].is_archived and not s["s1"].is_archived
    assert s["s1"].content_hash == f"{T0 + 10}:4" and s["s0"].total_tokens == 3 and s["s0"].message_count == 4 and s["s0"].branch is None


def test_opencode_turns_and_files(spark, oc):
    src = OpenCodeSqlite(spark, str(oc / "opencode.db"))
    t = [r for r in src.turns().orderBy("uri", "turn_index").collect() if r.uri.endswith("s0")]
    assert [r.role for r in t] == ["User", "Assistant"] * 2 and [r.turn_index for r in t] == [0, 1, 2, 3]
    kinds = [b.kind for b in t[1].blocks]
    assert kinds == ["text", "tool", "patch"] and t[1].blocks[1].duration_ms == 4 and t[1].blocks[2].path == "/w/a.py"
    files = {r.path for r in src.files().collect() if r.uri.endswith("s0")}
    assert files == {"/w/A.py", "/w/b.py"}
    assert src.version() == "1.2" and src.probe().sessions == 3


def test_one_session_reads_its_own_messages_and_parts(spark, oc):
    src = OpenCodeSqlite(spark, str(oc / "opencode.db"))
    one = src.turns_of("s0")
    same = src.turns().where("uri = 'session://opencode/s0'")
    assert [r.asDict(True) for r in one.orderBy("turn_index").collect()] == [r.asDict(True) for r in same.orderBy("turn_index").collect()]
    assert sorted(scanned(one)) == [4, 12]  # of 12 messages and 48 parts
    assert sum(scanned(src.turns_of("nobody"))) == 0 and src.turns_of("nobody").count() == 0
    assert sum(scanned(src._table("session").where("time_updated > 1700000000005 and title like 'Title%'"))) == 1
    assert sum(scanned(src._table("session").where(F.col("id").isin("s1", "s2", "s9")))) == 2


def test_conditions_of_sqlite():
    from pyspark.sql import datasource as ds

    kinds = {"a": "bigint", "b": "string", "d": "binary"}
    of = lambda f: sqlite_source.condition(f, kinds)
    assert of(ds.EqualTo(("a",), 5)) == ('"a" = ?', [5]) and of(ds.EqualTo(("a",), "5")) is None and of(ds.EqualTo(("d",), b"x")) is None
    assert of(ds.LessThan(("b",), "x")) == ('"b" < ? COLLATE BINARY', ["x"]) and of(ds.In(("b",), ("x", "y"))) == ('"b" IN (?, ?)', ["x", "y"])
    assert of(ds.StringStartsWith(("b",), "x%")) == ('substr("b", 1, 2) = ?', ["x%"]) and of(ds.IsNull(("b",))) is None and of(ds.EqualTo(("b", "c"), "x")) is None
    assert of(ds.Not(ds.EqualTo(("b",), "x"))) is None and of(ds.EqualTo(("missing",), 1)) is None


def test_pushed_filters_give_what_spark_would(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE t(a int, b text COLLATE NOCASE, c real, n)")
    con.executemany("INSERT INTO t VALUES (?,?,?,?)", [(1, "x", 1.5, 1), (2, "X", 2, "1"), (5.7, "é", None, None), ("odd", None, "no", "x"), (None, "it's", 1e300, 2.5), (2**60, "10", 0, b"z")])
    con.commit()
    con.close()
    spark_side = [tuple(r) for r in sqlite_source.read_table(spark, str(tmp_path / "x.db"), "t").collect()]
    plain = spark.createDataFrame(spark_side, "a long, b string, c double, n string")
    for cond in ["a = 2", "a >= 2", "a is null", "b = 'x'", "b > 'X'", "b = 'it''s'", "b like 'X%'", "c > 1", "c is not null", "n = '1'", "b in ('x', '10') and a < 100", "b <=> null", "a = 5", "not (b = 'x')"]:
        t = sqlite_source.read_table(spark, str(tmp_path / "x.db"), "t").where(cond)
        assert sorted(map(repr, t.collect())) == sorted(map(repr, plain.where(cond).collect())), cond


def test_store_choice_and_missing_store(spark, oc, tmp_path):
    assert isinstance(opencode(spark, str(oc)), OpenCodeSqlite) and opencode(spark, str(tmp_path)) is None
    assert not OpenCodeSqlite(spark, str(tmp_path / "none.db")).probe().available
    assert sqlite_source.read_table(spark, str(oc / "opencode.db"), "nothing") is None


def test_opencode_tree(spark, tmp_path):
    def put(path, doc):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(doc))

    put("project/p.json", {"id": "p", "worktree": "/w"})
    put("session/p/s1.json", {"id": "s1", "projectID": "p", "title": "T", "time": {"created": T0, "updated": T0 + 1}})
    (tmp_path / "session/p/bad.json").write_text("{")
    put("message/s1/m2.json", {"role": "assistant"})
    put("message/s1/m1.json", {"role": "user"})
    put("part/m1/a.json", {"type": "text", "text": "ask"})
    put("part/m2/a.json", {"type": "text", "text": "answer"})
    src = OpenCodeTree(spark, str(tmp_path))
    assert [(r.native_id, r.workspace_path, r.message_count) for r in src.sessions().collect()] == [("s1", "/w", 2)]
    assert [r.blocks[0].text for r in src.turns().orderBy("turn_index").collect()] == ["ask", "answer"]
    put("message/s2/m3.json", {"role": "user"})
    put("part/m3/a.json", {"type": "text", "text": "other"})
    assert [(r.uri, r.blocks[0].text) for r in src.turns_of("s1").orderBy("turn_index").collect()] == [("session://opencode/s1", "ask"), ("session://opencode/s1", "answer")]
    (tmp_path / "part/m3/a.json").unlink()
    (tmp_path / "message/s2/m3.json").unlink()
    assert src.turns_of("none").count() == 0
    put("part/m2/b.json", {"type": "patch", "files": ["/w/x.py"]})
    put("part/m2/c.json", {"type": "tool", "tool": "edit", "state": {"input": {"filePath": "/w/y.py"}}})
    assert {(r.uri, r.path, r.tool) for r in src.files().collect()} == {("session://opencode/s1", "/w/x.py", "patch"), ("session://opencode/s1", "/w/y.py", "edit")}
    assert [r.uri for r in src.unreadable().collect()] == ["session://opencode/bad"]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole/opencode.db").write_bytes(b"no database" * 2000)
    (tmp_path / "whole/storage").symlink_to(tmp_path)
    assert isinstance(opencode(spark, str(tmp_path / "whole")), OpenCodeTree)


def test_sqlite_reads_what_is_asked_for(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE t(a int, b text, c real, d blob)")
    con.executemany("INSERT INTO t VALUES (?,?,?,?)", [(k, f"v{k}" if k % 3 else None, k / 2, bytes([k % 256])) for k in range(10_000)] + [("odd", b"\xff", "x", None)])
    con.commit()
    con.close()
    t = sqlite_source.read_table(spark, str(tmp_path / "x.db"), "T")
    assert t.count() == 10_001 and t.where("a is null").first().b == "\ufffd" and t.agg(F.sum("c")).first()[0] == sum(range(10_000)) / 2
    some = sqlite_source.read_table(spark, str(tmp_path / "x.db"), "t", where="a < 5 OR b = 'v7'")
    assert sorted(r.a for r in some.collect()) == [0, 1, 2, 3, 4, 7]


@pytest.fixture(scope="module")
def cli(tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    con = sqlite3.connect(root / "session.db")
    con.executescript(
        """CREATE TABLE schema_version(version int); INSERT INTO schema_version VALUES (6);
        CREATE TABLE sessions(id text PRIMARY KEY, cwd text, repository text, branch text, summary text, created_at text, updated_at text);
        CREATE TABLE turns(id integer PRIMARY KEY, session_id text, turn_index int, user_message text, assistant_response text, timestamp text);
        CREATE TABLE session_files(id integer PRIMARY KEY, session_id text, file_path text, tool_name text, turn_index int);
        CREATE VIRTUAL TABLE search_index USING fts5(content, session_id UNINDEXED, source_type UNINDEXED, source_id UNINDEXED);
        INSERT INTO search_index VALUES ('exponential backoff', 'a', 'user_message', 'a:turn:2'), ('backoff backoff', 'a', 'assistant', 'a:turn:0'), ('backoff', 'b', 'user', 'b:turn:0');
        CREATE TABLE assistant_usage_events(id integer PRIMARY KEY, session_id text, turn_index int, agent_id text, model text, input_tokens int, output_tokens int, reasoning_tokens int, total_nano_aiu int);"""
    )
    for k in ("a", "b"):
        con.execute("INSERT INTO sessions VALUES (?,?,?,?,?,?,?)", (k, "/w", "org/r", "main", "Fix the parser. Now.", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00+00:00"))
    con.executemany("INSERT INTO turns(session_id,turn_index,user_message,assistant_response,timestamp) VALUES (?,?,?,?,?)", [("a", 0, "q0", " ", "2024-01-01T00:00:01Z"), ("a", 1, "", None, None), ("a", 2, "q2", "r2", None)])
    con.executemany("INSERT INTO session_files(session_id,file_path,tool_name,turn_index) VALUES (?,?,?,?)", [("a", "x.py", "edit", 1), ("a", "y.py", "edit", 2), ("a", "z.py", "edit", 9)])
    con.executemany("INSERT INTO assistant_usage_events(session_id,turn_index,agent_id,model,input_tokens,output_tokens,total_nano_aiu) VALUES (?,?,?,?,?,?,?)", [("a", 0, "g", "M1", 5, 6, 1_500_000_000), ("a", 2, "g", "m1", 1, 1, 0), ("a", None, None, "m2", 0, 0, 0)])
    con.commit()
    con.close()
    (root / "session-state").mkdir()
    log = [{"type": "tool.execution_start", "data": {"toolCallId": "1", "toolName": "bash", "arguments": {"c": 1}}}, {"type": "tool.execution_start", "data": {"toolCallId": "2", "toolName": "view"}}, "torn", {"type": "tool.execution_complete", "data": {"toolCallId": "1", "success": False, "result": {"content": "x" * 30}}}, {"type": "tool.execution_complete", "data": {"toolCallId": "9"}}]
    (root / "session-state" / "a.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in log))
    return root


def test_cli_sessions_and_turns(spark, cli):
    src = CopilotCli(spark, str(cli / "session.db"))
    s = src.sessions().collect()
    assert [r.native_id for r in s] == ["a"] and s[0].title == "Fix the parser." and s[0].message_count == 3
    assert s[0].models == ["M1", "m2"] and s[0].total_tokens == 13 and s[0].cost == 1.5 and s[0].updated_at == datetime(2024, 1, 2)
    t = src.turns().orderBy("turn_index").collect()
    assert [(r.role, r.blocks[0].text) for r in t] == [("User", "q0"), ("User", "q2"), ("Assistant", "r2")] and t[0].model == "M1"
    assert {r.path: r.turn_index for r in src.files().collect()} == {"x.py": 1, "y.py": 1, "z.py": None}
    assert src.references() is None and src.version() == "6"


def test_cli_native_search(spark, cli):
    src = CopilotCli(spark, str(cli / "session.db"))
    got = src.search_native("backoff").collect()
    assert [r.uri for r in got] == ["session://copilot-cli/a"] and [(p.role, p.turn_index) for p in got[0].passages] == [("Assistant", 0), ("User", 2)]
    assert src.search_native("backoff", SessionFilter(branch="other")).count() == 0


def test_cli_tool_log(spark, cli):
    turn = CopilotCli(spark, str(cli / "session.db")).tool_turns(max_output=10).collect()
    assert len(turn) == 1 and turn[0].turn_index == 3 and turn[0].role == "Tool"
    assert [(b.tool_name, b.status) for b in turn[0].blocks] == [("bash", "error"), ("view", "running")]
    assert turn[0].blocks[0].output == "x" * 10 + "\n… [20 more characters]"


def test_tool_turn_follows_the_page_whatever_the_budget(spark, cli, tmp_path):
    from threadloom.catalog import Catalog
    from threadloom.config import SearchQuery, TranscriptOptions
    from threadloom.plans.store import IndexStore

    catalog = Catalog(spark, IndexStore(spark, f"file://{tmp_path}/index"), [CopilotCli(spark, str(cli / "session.db"))])
    page = lambda **o: [(t.turn_index, t.role, t.total_turns, t.is_truncated) for t in catalog.transcript("a", TranscriptOptions(**o)).collect()]
    said = [(0, "User", 4, False), (1, "User", 4, False), (2, "Assistant", 4, False)]
    assert page(include_tool_output=True) == [*said, (3, "Tool", 4, False)]
    assert page(include_tool_output=True, max_characters=6) == [*said, (3, "Tool", 4, False)]
    assert page(include_tool_output=True, max_characters=3) == [(0, "User", 3, True)]
    assert page(include_tool_output=True, to_turn=1) == [(0, "User", 3, False), (1, "User", 3, False)]
    assert page(include_tool_output=True, from_turn=3) == [(3, "Tool", 4, False)] and page() == [(i, r, 3, False) for i, r, _, _ in said]
    # The store's own passages serve a live search.
    assert [r.uri for r in catalog.search_live(SearchQuery("backoff")).collect()] == ["session://copilot-cli/a"]


def test_replay():
    ops = [{"kind": 0, "v": {"requests": []}}, {"kind": 2, "k": ["requests"], "v": [{"a": 1}]}, {"kind": 1, "k": ["requests", 2, "b"], "v": 5}, {"kind": 7}, {"kind": 1, "k": ["x", "y", 0], "v": "z"}]
    log = "\n".join(json.dumps(o) for o in ops) + '\n{"kind":1,"k":["late"],"v":1'
    assert replay(log) == {"requests": [{"a": 1}, None, {"b": 5}], "x": {"y": ["z"]}}
    assert replay('{"kind":1,"k":["a"],"v":1}') is None and replay("") is None


def test_response_fold():
    parts = [{"value": "a "}, {"kind": "inlineReference", "inlineReference": {"fsPath": "/f"}}, {"kind": "markdownContent", "value": {"value": "b "}}, {"kind": "undoStop"}, {"kind": "thinking", "value": "t"}, {"value": "c"}, {"kind": "textEditGroup", "uri": {"path": "/g"}}]
    blocks, files = response_blocks(parts)
    assert [(b["kind"], b.get("text") or b.get("path")) for b in blocks] == [("text", "a b"), ("reasoning", "t"), ("text", "c"), ("patch", "/g")]
    assert files == [("/f", "reference"), ("/g", "edit")]


def test_vscode(spark, tmp_path):
    ws = tmp_path / "h1"
    (ws / "chatSessions").mkdir(parents=True)
    (ws / "workspace.json").write_text(json.dumps({"folder": "file:///c%3A/my%20code/"}))
    doc = {"version": 3, "creationDate": T0, "requests": [{"timestamp": T0 + 5, "modelId": "copilot/gpt", "agent": {"id": "github.copilot.editsAgent"}, "message": {"text": "Hi there"}, "response": [{"value": "yes"}], "contentReferences": [{"reference": {"scheme": "https", "external": "https://x.y"}}]}, {"modelId": "copilot/GPT", "message": {"text": " "}, "response": []}]}
    (ws / "chatSessions" / "d.json").write_text(json.dumps(doc))
    (ws / "chatSessions" / "l.jsonl").write_text(json.dumps({"kind": 0, "v": doc}) + "\n" + json.dumps({"kind": 1, "k": ["customTitle"], "v": "Named"}))
    (ws / "chatSessions" / "e.json").write_text(json.dumps({"requests": []}))
    src = VsCode(spark, str(tmp_path))
    s = {r.native_id: r for r in src.sessions().collect()}
    assert set(s) == {"d", "l"} and s["l"].title == "Named" and s["d"].title == "Hi there" and s["d"].models == ["gpt"] and s["d"].agent == "editsAgent"
    assert s["d"].workspace_path == "c:/my code" and s["d"].message_count == 2
    assert [(r.role, r.turn_index) for r in src.turns().where("uri like '%/d'").orderBy("turn_index").collect()] == [("User", 0), ("Assistant", 1)]
    assert [(r.role, r.turn_index) for r in src.turns_of("d").orderBy("turn_index").collect()] == [("User", 0), ("Assistant", 1)]
    assert {r.ref_value for r in src.references().collect()} == {"https://x.y"}
    (ws / "chatSessions" / "torn.json").write_text("{")
    assert [r.uri for r in src.unreadable().collect()] == ["session://copilot-vscode/torn"]
    os.utime(ws / "chatSessions" / "l.jsonl", (T0 / 1000 - 90_000, T0 / 1000 - 90_000))
    assert {r.native_id for r in src.changed_since(datetime(2023, 1, 1)).collect()} == {"d", "l"}
    assert {r.native_id for r in src.changed_since(datetime.fromtimestamp(T0 / 1000 - 1, timezone.utc).replace(tzinfo=None)).collect()} == {"d"}
    assert [r.native_id for r in src.list(SessionFilter(model="GPT", limit=1)).collect()] in (["d"], ["l"])


def test_vscode_opens_only_files_that_a_filter_leaves(spark, tmp_path):
    doc = {"creationDate": T0, "lastMessageDate": T0, "requests": [{"message": {"text": "Hi"}, "response": []}]}
    for k in range(6):
        (tmp_path / f"h{k}/chatSessions").mkdir(parents=True)
        if k != 5:
            (tmp_path / f"h{k}/workspace.json").write_text(json.dumps({"folder": f"file:///code/{'a' if k < 2 else 'b'}{k}"}))
        for n in range(4):
            f = tmp_path / f"h{k}/chatSessions/s{k}{n}.json"
            f.write_text(json.dumps(doc) if k < 2 or n else "{torn")
            if n == 3:
                os.utime(f, (T0 / 1000 - 90_000, T0 / 1000 - 90_000))
    src = VsCode(spark, str(tmp_path))
    listed = lambda **o: src.list(SessionFilter(limit=0, **o))
    one = listed(workspace_path="/code/a1")
    assert {r.native_id for r in one.collect()} == {"s10", "s11", "s12", "s13"} and max(scanned(listed(workspace_path="/code/a1"))) <= 8  # four of 24 session files, twice, as a sort samples first
    assert {r.native_id for r in listed(workspace_path="/code").collect()} == {f"s{k}{n}" for k in range(5) for n in range(4) if k < 2 or n}
    assert {r.native_id for r in listed(workspace_path="h5").collect()} == {"s51", "s52", "s53"} and listed(workspace_path="/none").count() == 0
    late = listed(since=datetime(2023, 11, 14), workspace_path="/code/a1")  # the day of T0; a file's own time rules s13 out
    assert {r.native_id for r in late.collect()} == {"s10", "s11", "s12"}
    assert {r.native_id for r in listed().collect()} == {r.native_id for r in src.sessions().collect()}
