"""Text, path, time and JSON expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import paths, text
from . import query
from .bindings import NOW, NOW_SQL, SESSION, SQL_TOKENS, sessions, sql_flatten, sql_title, sql_truncate, table, texts, turns

FLAT = sql_flatten("text")


@query("tokenize_counts", f"SELECT doc_id, CAST(len({SQL_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({SQL_TOKENS})) AS BIGINT) AS n_distinct FROM documents")
def tokenize_counts(spark, d):
    t = text.tokens(F.col("text"))
    return texts(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query("flatten_text", f"SELECT doc_id, md5({FLAT}) AS flat FROM documents")
def flatten_text(spark, d):
    return texts(spark, d).select("doc_id", F.md5(text.flatten(F.col("text"))).alias("flat"))


@query("truncate_text", f"SELECT doc_id, {sql_truncate('flat', 60)} AS short FROM (SELECT doc_id, {FLAT} AS flat FROM documents)")
def truncate_text(spark, d):
    return texts(spark, d).select("doc_id", text.truncate(text.flatten(F.col("text")), 60).alias("short"))


@query("preview_text", f"SELECT doc_id, {sql_truncate('flat', 240)} AS preview FROM (SELECT doc_id, {FLAT} AS flat FROM documents)")
def preview_text(spark, d):
    return texts(spark, d).select("doc_id", text.preview(F.col("text"), 240).alias("preview"))


@query("derive_title", f"SELECT doc_id, {sql_title('flat')} AS title FROM (SELECT doc_id, {FLAT} AS flat FROM documents)")
def derive_title(spark, d):
    return texts(spark, d).select("doc_id", text.derive_title(F.col("text")).alias("title"))


@query("output_truncation", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || chr(10) || '… [' || format('{:,}', length(text) - 500) || ' more characters]' END AS shown FROM documents")
def output_truncation(spark, d):
    return texts(spark, d).select("doc_id", text.output_cap(F.col("text"), 500).alias("shown"))


@query("tag_normalise", r"SELECT doc_id, regexp_replace(lower(trim(substr(text, 1, 24))), '\s+', '-', 'g') AS tag FROM documents")
def tag_normalise(spark, d):
    return texts(spark, d).select("doc_id", text.tag_name(F.substring("text", 1, 24)).alias("tag"))


@query("tag_normalise_whole", r"SELECT doc_id, md5(regexp_replace(lower(trim(text)), '\s+', '-', 'g')) AS digest FROM documents")
def tag_normalise_whole(spark, d):
    """Whole texts as tags."""
    return texts(spark, d).select("doc_id", F.md5(text.tag_name(F.col("text"))).alias("digest"))


@query("role_parse", "SELECT conv_id, turn, CASE WHEN lower(role) IN ('user', 'assistant', 'system', 'tool', 'info') THEN upper(role[1]) || lower(role[2:]) ELSE 'Assistant' END AS role_name FROM conversations")
def role_parse(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.role_name(F.col("role")).alias("role_name"))


@query("path_normalise", r"SELECT page_id, rtrim(replace(url, '\', '/'), '/') AS path, starts_with(rtrim(replace(url, '\', '/'), '/') || '/', 'https://') AS is_secure FROM pages")
def path_normalise(spark, d):
    p = paths.normalize_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", p.alias("path"), F.concat(p, F.lit("/")).startswith("https://").alias("is_secure"))


@query("path_is_under", r"WITH p AS (SELECT page_id, rtrim(regexp_replace(replace(url, '\', '/'), '[?#].*$', ''), '/') AS path FROM pages) SELECT page_id, path = regexp_extract(path, '^[a-z]+://[^/]+/[^/]+') OR starts_with(path, regexp_extract(path, '^[a-z]+://[^/]+/[^/]+') || '/') AS below FROM p WHERE regexp_extract(path, '^[a-z]+://[^/]+/[^/]+') <> ''")
def path_is_under(spark, d):
    path = paths.normalize_path(F.regexp_replace("url", "[?#].*$", ""))
    root = F.regexp_extract(path, "^[a-z]+://[^/]+/[^/]+", 0)
    return table(spark, d, "pages").where(root != "").select("page_id", paths.is_under(path, root).alias("below"))


@query("workspace_label", f"WITH {SESSION} SELECT uri, regexp_extract(workspace_path, '([^/\\\\]+)[/\\\\]*$', 1) AS label FROM session")
def workspace_label(spark, d):
    return sessions(spark, d).select("uri", paths.label(F.lit(None).cast("string"), F.col("workspace_path"), F.col("repository")).alias("label"))


@query("uri_round_trip", f"WITH {SESSION} SELECT uri, source_id, native_id, source_id || '/' || substr(native_id, 1, 12) AS short FROM session")
def uri_round_trip(spark, d):
    parts = paths.uri_parts(F.col("uri"))
    return sessions(spark, d).select("uri", parts["source_id"].alias("source_id"), parts["native_id"].alias("native_id"), paths.short_form(parts["source_id"], parts["native_id"]).alias("short"))


_AGE = f"(epoch_ms({NOW_SQL}) // 1000 - epoch_ms(updated_at) // 1000)"


@query(
    "relative_time",
    f"""WITH {SESSION} SELECT uri, CASE WHEN {_AGE} < 60 THEN 'just now' WHEN {_AGE} < 3600 THEN ({_AGE} // 60) || 'm ago' WHEN {_AGE} < 86400 THEN ({_AGE} // 3600) || 'h ago'
    WHEN {_AGE} < 30 * 86400 THEN ({_AGE} // 86400) || 'd ago' WHEN {_AGE} < 365 * 86400 THEN ({_AGE} // (30 * 86400)) || 'mo ago' ELSE strftime(updated_at, '%Y-%m-%d') END AS age FROM session""",
)
def relative_time(spark, d):
    return sessions(spark, d).select("uri", paths.relative_time(F.col("updated_at"), F.lit(NOW).cast("timestamp_ntz")).alias("age"))


@query("json_part_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 3, 5)")
def json_part_filter(spark, d):
    return table(spark, d, "events").withColumn("k", J.long_at(F.col("props"), "$.k")).where(F.col("k").isin(1, 3, 5)).select("event_id", "k")


@query("json_typed_get", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS shown, CAST(NULL AS DOUBLE) AS missing FROM events")
def json_typed_get(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", J.long_at(p, "$.k").alias("k"), J.text_at(p, "$.missing", "$.k").alias("shown"), J.double_at(p, "$.missing").alias("missing"))


@query("model_names", "SELECT event_id, regexp_replace(event_type || '/m.' || user_id, '^[^/]*/', '') AS model, CAST(user_id AS VARCHAR) AS last_part FROM events")
def model_names(spark, d):
    full = F.concat("event_type", F.lit("/m."), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", paths.after_slash(full).alias("model"), paths.after_dot(full).alias("last_part"))


@query("highlight_terms", "SELECT conv_id, turn, regexp_replace(text, '(?i)(tion|the)', '<<\\1>>', 'g') AS marked FROM conversations")
def highlight_terms(spark, d):
    return turns(spark, d).select("conv_id", F.col("turn_index").cast("bigint").alias("turn"), text.highlight(F.col("text"), ["the", "tion", "THE", "x", "'the'"]).alias("marked"))


@query("resume_command", f"""WITH {SESSION} SELECT uri, 'cd "' || replace(workspace_path, '\\', '\\\\') || '" && opencode --session ' || native_id AS line FROM session""")
def resume_command(spark, d):
    from ..operators.transcripts import resume_command as line

    return sessions(spark, d).select("uri", line(F.lit("opencode"), F.col("native_id"), F.col("workspace_path")).alias("line"))


@query("file_uri_decode", "SELECT page_id, rtrim(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/') AS path FROM pages")
def file_uri_decode(spark, d):
    return table(spark, d, "pages").select("page_id", paths.file_uri_path(F.col("url")).alias("path"))
