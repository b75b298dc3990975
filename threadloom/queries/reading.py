"""Transcripts, passages, usage, refresh, and windows over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ChunkPolicy, TranscriptOptions
from ..functions.text import derive_title
from ..operators import chunking, incremental, rollups, transcripts
from . import query
from .bindings import SESSION, TURN, sessions, sql_flatten, sql_title, table, turns


@query("turn_numbering", f"WITH {TURN} SELECT uri, CAST(row_number() OVER (PARTITION BY uri ORDER BY length(text), turn_index) - 1 AS BIGINT) AS position, CAST(turn_index AS BIGINT) AS turn FROM turns")
def turn_numbering(spark, d):
    t = turns(spark, d).withColumn("turn", F.col("turn_index").cast("bigint")).withColumn("n", F.length("text"))
    return transcripts.numbered(t, "n", "turn").select("uri", F.col("turn_index").cast("bigint").alias("position"), "turn")


_EXCHANGE = f"""{TURN},
exchange AS (
  SELECT conv_id AS session_id, turn_index // 2 AS turn_index, max(CASE WHEN turn_index % 2 = 0 THEN text END) AS user_message,
    max(CASE WHEN turn_index % 2 = 1 AND turn_index % 3 <> 0 THEN text END) AS assistant_response
  FROM turns GROUP BY ALL
)"""


def _exchanges(spark, d):
    t = turns(spark, d)
    i = F.col("turn_index")
    return t.groupBy(F.col("conv_id").alias("session_id"), F.floor(i / 2).cast("int").alias("turn_index")).agg(
        F.max(F.when(i % 2 == 0, F.col("text"))).alias("user_message"), F.max(F.when((i % 2 == 1) & (i % 3 != 0), F.col("text"))).alias("assistant_response"), F.lit(None).cast("timestamp_ntz").alias("timestamp")
    )


@query(
    "exchange_expand",
    f"WITH {_EXCHANGE}, halves AS (SELECT session_id, turn_index, 0 AS half, 'User' AS role, user_message AS text FROM exchange UNION ALL SELECT session_id, turn_index, 1, 'Assistant', assistant_response FROM exchange) SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn_index, half) - 1 AS BIGINT) AS message_index, role, md5(text) AS digest FROM halves WHERE trim(coalesce(text, '')) <> ''",
)
def exchange_expand(spark, d):
    return transcripts.exchanges_to_turns(_exchanges(spark, d)).select("session_id", F.col("message_index").cast("bigint").alias("message_index"), "role", F.md5("text").alias("digest"))


@query(
    "exchange_remap",
    f"WITH {_EXCHANGE} SELECT session_id, turn_index, CAST(coalesce(sum(CASE WHEN trim(coalesce(user_message, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(assistant_response, '')) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS message_index FROM exchange",
)
def exchange_remap(spark, d):
    return transcripts.exchange_map(_exchanges(spark, d))


@query("transcript_range", f"WITH {TURN} SELECT uri, turn_index, total FROM (SELECT uri, turn_index, max(turn_index) OVER (PARTITION BY uri) + 1 AS total FROM turns) WHERE turn_index BETWEEN 1 AND 3")
def transcript_range(spark, d):
    return transcripts.page(turns(spark, d), TranscriptOptions(from_turn=1, to_turn=3), F.length("text")).select("uri", "turn_index", F.col("total_turns").alias("total"))


_BUDGET = f"""WITH {TURN},
sized AS (SELECT uri, turn_index, sum(length(text)) OVER (PARTITION BY uri ORDER BY turn_index ROWS UNBOUNDED PRECEDING) <= 600 OR row_number() OVER (PARTITION BY uri ORDER BY turn_index) = 1 AS fits FROM turns),
cursors AS (SELECT uri, min(CASE WHEN NOT fits THEN turn_index END) AS next_turn FROM sized GROUP BY uri)"""


def _budget(spark, d):
    return transcripts.page(turns(spark, d), TranscriptOptions(max_characters=600), F.length("text"))


@query("transcript_budget", f"{_BUDGET} SELECT uri, turn_index, next_turn IS NOT NULL AS is_truncated FROM sized JOIN cursors USING (uri) WHERE fits")
def transcript_budget(spark, d):
    return _budget(spark, d).select("uri", "turn_index", "is_truncated")


@query("next_cursor", f"{_BUDGET} SELECT uri, next_turn FROM cursors WHERE next_turn IS NOT NULL")
def next_cursor(spark, d):
    return _budget(spark, d).where("is_truncated").select("uri", F.col("next_turn_index").alias("next_turn")).distinct()


@query("first_user_title", f"WITH {TURN}, f AS (SELECT uri, arg_min(text, turn_index) AS text FROM turns WHERE role = 'user' GROUP BY uri), g AS (SELECT uri, {sql_flatten('text')} AS flat FROM f) SELECT uri, {sql_title('flat')} AS title FROM g")
def first_user_title(spark, d):
    return transcripts.first_user_text(turns(spark, d)).select("uri", derive_title(F.col("text")).alias("title"))


@query(
    "markdown_fold_islands",
    f"WITH {TURN}, m AS (SELECT *, sum(CAST(role = 'user' AS INTEGER) + coalesce(CAST(prev = 'user' AS INTEGER), 0)) OVER (PARTITION BY uri ORDER BY turn_index) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY uri ORDER BY turn_index) AS prev FROM turns)) SELECT uri, CAST(min(turn_index) AS INTEGER) AS pos, count(*) AS n_parts, md5(trim(string_agg(text, '' ORDER BY turn_index))) AS digest FROM m GROUP BY uri, run",
)
def markdown_fold_islands(spark, d):
    parts = turns(spark, d).select("uri", F.col("turn_index").alias("pos"), F.col("role").alias("kind"), "text")
    return transcripts.runs_joined(parts, F.col("kind") == "user").select("uri", "pos", "n_parts", F.md5("text").alias("digest"))


@query("markdown_export", f"WITH {TURN} SELECT uri, md5(string_agg('## ' || lower(role) || ' · m' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn_index)) AS digest FROM turns GROUP BY uri")
def markdown_export(spark, d):
    return transcripts.markdown(turns(spark, d).withColumn("model", F.lit("m"))).select("uri", F.md5("markdown").alias("digest"))


@query("files_first_wins", "SELECT uri, path FROM (SELECT CAST(page_id % 20 AS VARCHAR) AS uri, regexp_extract(url, '://([^/]+)', 1) AS path, row_number() OVER (PARTITION BY page_id % 20, lower(regexp_extract(url, '://([^/]+)', 1)) ORDER BY page_id) AS r FROM pages) WHERE r = 1")
def files_first_wins(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 20).cast("string").alias("uri"), F.regexp_extract("url", "://([^/]+)", 1).alias("path"), F.lit("read").alias("tool"), F.col("page_id").alias("turn_index"), F.lit(0).alias("pos"))
    return transcripts.touched_files(rows).select("uri", "path")


@query("refs_vs_files", "SELECT starts_with(lower(u), 'http') AS is_web, count(*) AS n FROM (SELECT CASE WHEN page_id % 3 = 0 THEN '/f/' || page_id ELSE url END AS u FROM pages) GROUP BY 1")
def refs_vs_files(spark, d):
    rows = table(spark, d, "pages").select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/f/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("value"))
    web, files = transcripts.split_references(rows)
    return web.withColumn("is_web", F.lit(True)).union(files.withColumn("is_web", F.lit(False))).groupBy("is_web").agg(F.count(F.lit(1)).alias("n"))


@query("tool_output_options", f"WITH {TURN} SELECT uri, turn_index, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || chr(10) || '… [' || format('{{:,}}', length(text) - 200) || ' more characters]' END AS output FROM turns WHERE role = 'assistant'")
def tool_output_options(spark, d):
    block = F.struct(*[(F.col("text") if n == "output" else F.lit("tool" if n == "kind" else None).cast("string")).alias(n) for n in ("kind", "text", "output", "diff")])
    rows = turns(spark, d).where("role = 'assistant'").withColumn("blocks", F.array(block))
    shown = transcripts.selected_blocks(F.col("blocks"), TranscriptOptions(include_tool_output=True, max_tool_output=200))
    return rows.select("uri", "turn_index", F.get(shown, F.lit(0))["output"].alias("output"))


# Passages.


@query("chunk_header", f"WITH {SESSION} SELECT uri, trim(title || CASE WHEN title <> preview AND trim(preview) <> '' THEN chr(10) || preview ELSE '' END || chr(10) || source_id) AS header FROM session")
def chunk_header(spark, d):
    s = sessions(spark, d)
    return s.select("uri", chunking.header_text(F.col("title"), F.col("preview"), F.col("source_id")).alias("header"))


@query("chunk_tool", f"WITH {TURN} SELECT uri, turn_index, md5('[' || role || '] ' || {sql_flatten('substr(text, 1, 30)')} || chr(10) || substr(text, 1, 2000) || chr(10) || substr(text, 1, 4000)) AS digest FROM turns WHERE trim(text) <> '' AND trim({sql_flatten('substr(text, 1, 30)')}) <> ''")
def chunk_tool(spark, d):
    t = chunking.tool_text(F.col("role"), F.substring("text", 1, 30), F.col("text"), F.col("text"))
    return turns(spark, d).where("trim(text) <> '' and trim(substring(text, 1, 30)) <> ''").select("uri", "turn_index", F.md5(t).alias("digest"))



_FLAT = sql_flatten("text")


@query(
    "chunk_tool_whole",
    f"WITH {TURN} SELECT uri, turn_index, md5('[' || role || ']' || CASE WHEN trim(text) <> '' THEN ' ' || {_FLAT} || chr(10) || substr(text, 1, 2000) || chr(10) || substr(text, 1, 4000) ELSE '' END) AS digest FROM turns",
)
def chunk_tool_whole(spark, d):
    """Every turn, blank ones too, with its whole text as title, input and output."""
    t = chunking.tool_text(F.col("role"), F.col("text"), F.col("text"), F.col("text"))
    return turns(spark, d).select("uri", "turn_index", F.md5(t).alias("digest"))


def _cut_sql(w: str) -> str:
    """Where a full window ``w`` of 1200 characters is cut."""
    stop = rf"regexp_extract(substr({w}, 801), '^(?s:.*)[.!?](?:\s|$)')"
    back = lambda sign: f"strpos(reverse({w}), {sign})"
    return rf"""CASE WHEN {back("chr(10) || chr(10)")} > 0 AND length({w}) - {back("chr(10) || chr(10)")} - 1 >= 800 THEN length({w}) - {back("chr(10) || chr(10)")} + 1
      WHEN length({stop}) > 0 THEN 800 + length({stop}) - CASE WHEN regexp_matches({stop}, '\s$') THEN 1 ELSE 0 END
      WHEN {back("chr(10)")} > 0 AND length({w}) - {back("chr(10)")} >= 800 THEN length({w}) - {back("chr(10)")} + 1
      WHEN {back("' '")} > 0 AND length({w}) - {back("' '")} >= 800 THEN length({w}) - {back("' '")} + 1 ELSE length({w}) END"""


_WALK = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS s FROM documents),
walk AS (
  SELECT doc_id, s, 0 AS pos, CASE WHEN length(s) <= 1200 THEN length(s) ELSE {_cut_sql("left(s, 1200)")} END AS n FROM t WHERE length(s) > 0
  UNION ALL
  SELECT doc_id, s, p, CASE WHEN length(s) - p <= 1200 THEN length(s) - p ELSE {_cut_sql("substr(s, p + 1, 1200)")} END
  FROM (SELECT doc_id, s, pos + greatest(1, n - 150) AS p FROM walk WHERE pos + n < length(s))
)
SELECT doc_id, CAST(pos AS BIGINT) AS first_char, CAST(n AS BIGINT) AS n_chars FROM walk"""


@query("chunk_split", _WALK)
def chunk_split(spark, d):
    """Where pieces begin and how long they are, as the recursion over cuts gives them."""
    from ..config import ChunkPolicy

    def walk(text):
        t, at, p = text.strip(), 0, ChunkPolicy()
        while at < len(t):
            n = len(t) - at if len(t) - at <= p.max_characters else chunking.break_at(t[at : at + p.max_characters])
            yield at, n
            if at + n >= len(t):
                break
            at += max(1, n - p.overlap)

    return chunking.walked(table(spark, d, "documents").select("doc_id", "text"), walk, "first_char bigint, n_chars bigint")


_PIECES = (
    _WALK.rpartition("SELECT doc_id, CAST(pos")[0]
    + r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS piece_no, md5(piece) AS digest
FROM (SELECT doc_id, pos, regexp_replace(regexp_replace(substr(s, pos + 1, n), '^\s+', ''), '\s+$', '') AS piece FROM walk) WHERE length(piece) >= MIN_PIECE"""
)


@query("chunk_pieces", _PIECES.replace("MIN_PIECE", str(ChunkPolicy().min_characters)))
def chunk_pieces(spark, d):
    return chunking.split_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "piece_no", F.md5("piece").alias("digest"))


# Usage: line items stand for usage events.


def _usage(spark, d, model=None):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("turn_index"), (F.col("l_returnflag") if model is None else model).alias("model"), F.col("l_linestatus").alias("agent_id"),
        F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.lit(None).cast("bigint").alias("reasoning_tokens"), F.round(F.col("l_tax") * 1e9).cast("bigint").alias("total_nano"),
    )


_BY_MODEL = "bm AS (SELECT l_orderkey AS session_id, l_returnflag AS model, max(l_linestatus) AS agent, CAST(sum(CAST(l_quantity AS BIGINT) + l_suppkey) AS BIGINT) AS tokens, CAST(sum(CAST(round(l_tax * 1e9) AS BIGINT)) AS BIGINT) AS nano FROM lineitem GROUP BY ALL)"


@query("usage_by_model", f"WITH {_BY_MODEL} SELECT * FROM bm")
def usage_by_model(spark, d):
    return rollups.usage_by_model(_usage(spark, d))


@query("usage_rollup", f"WITH {_BY_MODEL} SELECT session_id, string_agg(lower(model), ',' ORDER BY lower(model)) AS models, arg_min(agent, model) AS agent, CASE WHEN sum(tokens) > 0 THEN CAST(sum(tokens) AS BIGINT) END AS total_tokens, round(CASE WHEN sum(nano) > 0 THEN sum(nano) / 1e9 END, 6) AS cost FROM bm GROUP BY session_id")
def usage_rollup(spark, d):
    out = rollups.usage_by_session(rollups.usage_by_model(_usage(spark, d)))
    return out.select("session_id", F.lower(F.array_join("models", ",")).alias("models"), "agent", "total_tokens", F.round("cost", 6).alias("cost"))


_SPELLED = "CASE WHEN l_linenumber % 2 = 0 THEN 'Model-' ELSE 'model-' END || l_returnflag"


@query(
    "usage_spelling",
    f"WITH names AS (SELECT DISTINCT l_orderkey AS session_id, {_SPELLED} AS model FROM lineitem), first AS (SELECT session_id, lower(model) AS low, min(model) AS model FROM names GROUP BY ALL) SELECT session_id, string_agg(model, ',' ORDER BY model) AS models FROM first GROUP BY session_id",
)
def usage_spelling(spark, d):
    """Models as they are spelled, the first of those that differ in case."""
    spelled = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Model-").otherwise("model-"), F.col("l_returnflag"))
    rows = _usage(spark, d, spelled)
    return rollups.usage_by_session(rollups.usage_by_model(rows)).select("session_id", F.array_join("models", ",").alias("models"))


@query("usage_per_turn", "SELECT l_orderkey AS session_id, l_linenumber AS turn_index, max(l_returnflag) AS model, max(l_linestatus) AS agent FROM lineitem GROUP BY ALL")
def usage_per_turn(spark, d):
    return rollups.usage_by_turn(_usage(spark, d))


@query("session_projects_mapped", "SELECT 'session://opencode/' || o_orderkey AS uri, c_name AS repository, c_name AS workspace_path, o_orderstatus AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey % 5 <> 0")
def session_projects_mapped(spark, d):
    """All orders as a store's sessions, through the source's own mapping; a fifth of the nations' customers are no projects."""
    from ..sources.opencode import map_sessions

    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderstatus").alias("title"))
    projects = table(spark, d, "customer").where("c_nationkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("worktree"))
    return map_sessions(rows, projects).select("uri", "repository", "workspace_path", "title")


@query("session_project_left_join", "SELECT o_orderkey, c_name AS project, o_orderstatus FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def session_project(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    o = table(spark, d, "orders")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_name").alias("project"), "o_orderstatus")


@query("min_turns_decorrelated", f"WITH {TURN} SELECT uri, n FROM (SELECT uri, count(*) AS n FROM turns GROUP BY uri) WHERE n >= 4")
def min_turns(spark, d):
    return turns(spark, d).groupBy("uri").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


@query("roles_counted", f"WITH {TURN} SELECT uri, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role <> 'user') AS others, count(DISTINCT role) AS roles FROM turns GROUP BY uri")
def roles_counted(spark, d):
    r = F.col("role")
    return turns(spark, d).groupBy("uri").agg(F.count_if(r == "user").alias("users"), F.count_if(r != "user").alias("others"), F.countDistinct("role").alias("roles"))


# Refresh: two thirds of the documents are as the index has them.

_INDEXED = "indexed AS (SELECT uri, content_hash FROM session WHERE doc_id % 3 <> 0 UNION ALL SELECT uri, 'old' FROM session WHERE doc_id % 6 = 0)"


def _indexed(s):
    return s.where("doc_id % 3 <> 0").select("uri", "content_hash").union(s.where("doc_id % 6 = 0").select("uri", F.lit("old").alias("content_hash")))


@query("hash_changed_anti", f"WITH {SESSION}, {_INDEXED} SELECT uri FROM session s WHERE NOT EXISTS (SELECT 1 FROM indexed i WHERE i.uri = s.uri AND i.content_hash = s.content_hash)")
def hash_changed(spark, d):
    s = sessions(spark, d)
    return incremental.changed(s, _indexed(s)).select("uri")


@query("prune_anti", f"WITH {SESSION} SELECT uri FROM session WHERE doc_id % 11 = 0")
def prune_anti(spark, d):
    s = sessions(spark, d)
    return incremental.vanished(s.select("uri"), s.where("doc_id % 11 <> 0"))


@query("backfill_needed", f"WITH {TURN} SELECT DISTINCT uri FROM turns WHERE lower(role) <> 'tool' AND length(text) >= 24 AND conv_id % 2 = 1")
def backfill_needed(spark, d):
    from ..operators.semantic import embeddable

    t = turns(spark, d)
    return incremental.without_vectors(t.select("uri").distinct(), t.where(embeddable(F.col("role"), F.col("text"))), t.where("conv_id % 2 = 0"))


@query("generation_merge", f"WITH {SESSION}, {_INDEXED} SELECT uri, content_hash FROM session WHERE doc_id % 3 = 0 UNION ALL SELECT uri, content_hash FROM indexed WHERE uri NOT IN (SELECT uri FROM session WHERE doc_id % 3 = 0 OR doc_id % 11 = 0)")
def generation_merge(spark, d):
    s = sessions(spark, d)
    new = s.where("doc_id % 3 = 0").select("uri", "content_hash")
    return incremental.merged_generation(_indexed(s), new, s.where("doc_id % 11 = 0 and doc_id % 3 <> 0"))


@query("watermark_max", "SELECT event_type AS source_id, epoch_us(max(ts)) AS change_cursor FROM events GROUP BY 1")
def watermark_max(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source_id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("change_cursor"))


@query("changed_since", "SELECT event_id FROM events WHERE event_id > 900")
def changed_since(spark, d):
    return incremental.changed_since(table(spark, d, "events"), 900, "event_id").select("event_id")


@query("latest_version", "SELECT arg_max(event_type, event_id) AS version FROM events WHERE event_type IS NOT NULL")
def latest_version(spark, d):
    return incremental.latest_version(table(spark, d, "events"), "event_type", "event_id")


@query("source_union", "SELECT source_id, count(*) AS n FROM (SELECT 'documents' AS source_id FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'conversations' FROM (SELECT DISTINCT conv_id FROM conversations)) GROUP BY 1")
def source_union(spark, d):
    name = lambda t, df: df.select(F.lit(t).alias("source_id"))
    every = name("documents", table(spark, d, "documents")).unionByName(name("pages", table(spark, d, "pages"))).unionByName(name("conversations", table(spark, d, "conversations").select("conv_id").distinct()))
    return every.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


# Beyond the reference: windows over events, grouping sets.


@query("events_tumbling", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    e = table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.unix_micros("w.start").alias("hour_us"), "event_type", "n", "total")


@query("events_sliding", "SELECT b - k * 1800000000 AS start_us, count(*) AS n FROM (SELECT epoch_us(time_bucket(INTERVAL '30 minutes', ts)) AS b, unnest([0, 1]) AS k FROM events) GROUP BY 1")
def events_sliding(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


@query(
    "events_sessions",
    "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k",
)
def events_sessions(spark, d):
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    return table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("usage_grouping_sets", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def usage_grouping_sets(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("longest_turns", f"WITH {TURN} SELECT role, uri, turn_index FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY length(text) DESC, uri, turn_index) AS r FROM turns) WHERE r <= 3")
def longest_turns(spark, d):
    w = Window.partitionBy("role").orderBy(F.length("text").desc(), "uri", "turn_index")
    return turns(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("role", "uri", "turn_index")
