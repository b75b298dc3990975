"""OpenCode stores: a SQLite file, or the older tree of JSON documents."""

from __future__ import annotations

import os
from datetime import timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import long_at, millis, text_at
from ..functions.paths import session_uri
from ..functions.text import UNTITLED, role_name
from . import sqlite_source
from .base import SessionSource, as_sessions, backfilled, block

SMALLEST_FILE = 8192
#: Folders of parts that are listed one by one.
MOST_FOLDERS = 1000
PARTS = ("text", "reasoning", "tool", "patch")
_SESSION = {
    "id": "string", "project_id": "string", "parent_id": "string", "slug": "string", "directory": "string", "title": "string", "version": "string", "agent": "string", "model": "string",
    "summary_additions": "int", "summary_deletions": "int", "summary_files": "int", "time_created": "bigint", "time_updated": "bigint", "time_archived": "bigint", "cost": "double",
    "tokens_input": "bigint", "tokens_output": "bigint", "tokens_reasoning": "bigint",
}


def model_id(c: Column) -> Column:
    """A model column's id: of an object, a JSON string, or as it stands."""
    is_json = F.try_parse_json(c).isNotNull()
    bare = F.when(c.rlike(r'^\s*"'), F.regexp_replace(c, r'^\s*"|"\s*$', ""))
    return F.when(F.trim(c) == "", None).when(~is_json, c).otherwise(F.coalesce(text_at(c, "$.id", "$.modelID"), bare))


def map_sessions(rows: DataFrame, projects: DataFrame | None, source_id: str = "opencode") -> DataFrame:
    """Sessions of raw rows; columns that a store lacks are null."""
    s = backfilled(rows, _SESSION)
    p = backfilled(projects, {"id": "string", "worktree": "string", "name": "string"}) if projects is not None else s.select(F.col("id"), F.lit(None).cast("string").alias("worktree"), F.lit(None).cast("string").alias("name")).where("false")
    j = s.join(F.broadcast(p.select(F.col("id").alias("project_id"), "worktree", F.col("name").alias("project_name"))) if projects is None else p.select(F.col("id").alias("project_id"), "worktree", F.col("name").alias("project_name")), "project_id", "left")
    created = F.coalesce(F.when(F.col("time_created") > 0, F.col("time_created")), F.lit(0))
    updated = F.coalesce(F.when(F.col("time_updated") > 0, F.col("time_updated")), created)
    at = lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = zero("tokens_input") + zero("tokens_output") + zero("tokens_reasoning")
    models = F.array_compact(F.array(model_id(F.col("model"))))
    return as_sessions(
        j.select(
            session_uri(F.lit(source_id), F.col("id")).alias("uri"), F.lit(source_id).alias("source_id"), F.col("id").alias("native_id"),
            F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(F.coalesce("slug", F.lit(UNTITLED))).alias("title"),
            F.coalesce("directory", "worktree").alias("workspace_path"), F.col("worktree").alias("repository"), "agent", models.alias("models"),
            at(created).alias("created_at"), at(updated).alias("updated_at"), F.when(total > 0, total).alias("total_tokens"), "cost",
            F.col("summary_additions").alias("additions"), F.col("summary_deletions").alias("deletions"), F.col("summary_files").alias("files_changed"),
            (zero("time_archived") > 0).alias("is_archived"), F.col("parent_id").alias("parent_native_id"), F.concat_ws(":", updated.cast("string"), zero("tokens_output").cast("string")).alias("content_hash"),
        )
    )


def part_block(data: Column) -> Column:
    """The content block of a part's JSON; null for blank texts and other kinds."""
    kind, text = text_at(data, "$.type"), text_at(data, "$.text")
    full = F.trim(F.coalesce(text, F.lit(""))) != ""
    start, end = long_at(data, "$.state.time.start"), long_at(data, "$.state.time.end")
    spent = F.when((start > 0) & (end > 0), end - start)
    tool = block(
        kind="tool", tool_name=F.coalesce(text_at(data, "$.tool"), F.lit("tool")), title=text_at(data, "$.state.title"), input_json=text_at(data, "$.state.input"),
        output=text_at(data, "$.state.output"), status=text_at(data, "$.state.status"), duration_ms=spent, call_id=text_at(data, "$.callID"),
    )
    first = F.get(part_files(data), F.lit(0))
    return (
        F.when((kind == "text") & full, block(kind="text", text=text))
        .when((kind == "reasoning") & full, block(kind="reasoning", text=text))
        .when(kind == "tool", tool)
        .when((kind == "patch") & first.isNotNull(), block(kind="patch", path=first, diff=text_at(data, "$.patch")))
    )


def part_files(data: Column) -> Column:
    """Paths that a part names: a patch's files, or a tool's input."""
    listed = F.from_json(F.get_json_object(data, "$.files"), "array<string>")
    named = F.filter(F.transform(listed, lambda f: F.coalesce(F.get_json_object(f, "$.file"), F.when(~f.startswith("{"), f))), lambda f: F.trim(f) != "")
    given = text_at(data, "$.state.input.filePath", "$.state.input.path", "$.state.input.file")
    return F.when(text_at(data, "$.type") == "patch", named).when((text_at(data, "$.type") == "tool") & (F.trim(given) != ""), F.array(given)).otherwise(F.array().cast("array<string>"))


def map_turns(messages: DataFrame, parts: DataFrame, source_id: str = "opencode") -> DataFrame:
    """Turns: messages by time and id, each with its blocks by id; messages without any keep their number."""
    w = Window.partitionBy("session_id").orderBy("time_created", "id")
    data = F.col("data")
    m = messages.select("id", "session_id", (F.row_number().over(w) - 1).cast("int").alias("turn_index"), "time_created", "data")
    wanted = parts.where(text_at(F.col("data"), "$.type").isin(*PARTS)).select("message_id", F.col("id").alias("part_id"), part_block(F.col("data")).alias("b"))
    blocks = wanted.where("b is not null").groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_id", "b"))), lambda x: x["b"]).alias("blocks"))
    j = m.join(blocks, m.id == blocks.message_id, "left")
    return j.select(
        session_uri(F.lit(source_id), F.col("session_id")).alias("uri"), "turn_index", role_name(text_at(data, "$.role")).alias("role"),
        millis(F.coalesce(long_at(data, "$.time.created"), F.col("time_created"))).alias("timestamp"), text_at(data, "$.modelID", "$.model.modelID").alias("model"),
        text_at(data, "$.agent", "$.mode").alias("agent"), F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)).alias("blocks"),
    )


def _of_kinds(*kinds: str) -> str:
    """SQLite's condition for parts of some kinds; rows without valid JSON have none."""
    return f"CASE WHEN json_valid(data) THEN json_extract(data, '$.type') END IN ({', '.join(repr(k) for k in kinds)})"


class OpenCodeSqlite(SessionSource):
    source_id = "opencode"
    capabilities = ("resume", "fork", "tool_calls", "patches", "incremental", "usage", "file_tracking")

    def _table(self, name: str, where: str = "") -> DataFrame | None:
        return sqlite_source.read_table(self.spark, self.location, name, where=where)

    def sessions(self) -> DataFrame:
        counts = self._table("message").groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
        s = map_sessions(self._table("session"), self._table("project"))
        return s.join(counts, s.native_id == counts.session_id, "left").withColumn("message_count", F.coalesce("n", F.lit(0))).select(*s.columns)

    def turns(self) -> DataFrame:
        return map_turns(self._table("message"), self._table("part", _of_kinds(*PARTS)))

    def turns_of(self, native_id: str) -> DataFrame:
        mine = F.col("session_id") == native_id
        return map_turns(self._table("message").where(mine), self._table("part", _of_kinds(*PARTS)).where(mine))

    def changed_since(self, cursor) -> DataFrame:
        """Sessions of rows that SQLite finds newer."""
        if cursor is None:
            return self.sessions()
        ms = int(cursor.replace(tzinfo=timezone.utc).timestamp() * 1000)
        rows = self._table("session", f"max(coalesce(time_updated, 0), coalesce(time_created, 0)) > {ms}")
        counts = self._table("message").groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
        s = map_sessions(rows, self._table("project")).where(F.col("updated_at") > F.lit(cursor))
        return s.join(counts, s.native_id == counts.session_id, "left").withColumn("message_count", F.coalesce("n", F.lit(0))).select(*s.columns)

    def files(self) -> DataFrame:
        from ..operators.transcripts import touched_files

        p = self._table("part", _of_kinds("patch", "tool")).select(session_uri(F.lit(self.source_id), F.col("session_id")).alias("uri"), F.coalesce(text_at(F.col("data"), "$.tool"), F.lit("patch")).alias("tool"), F.explode(part_files(F.col("data"))).alias("path"), F.col("time_created").alias("turn_index"), F.col("id").alias("pos"))
        return touched_files(p)

    def version(self) -> str | None:
        from ..operators.incremental import latest_version

        return latest_version(backfilled(self._table("session"), _SESSION)).first().version


class OpenCodeTree(SessionSource):
    """``storage/{project,session,message,part}/…/<id>.json``; file names order as time does."""

    source_id = "opencode"
    capabilities = OpenCodeSqlite.capabilities

    def _documents(self, kind: str, folders: tuple[str, ...] = ()) -> DataFrame:
        """The documents of a kind, or those in some of its folders, which are the only ones listed."""
        top = os.path.join(self.location, kind)
        paths = [p for p in (os.path.join(top, f) for f in folders) if os.path.isdir(p)] if folders else [top]
        reader = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        files = reader.text(paths or [top], wholetext=True)
        files = files if paths else files.where("false")
        name = F.regexp_extract("_metadata.file_path", r"([^/]+)/([^/]+)\.json$", 2)
        return files.select(F.col("value").alias("data"), name.alias("id"), F.regexp_extract("_metadata.file_path", r"([^/]+)/([^/]+)\.json$", 1).alias("folder")).where(F.try_parse_json("data").isNotNull())

    def sessions(self) -> DataFrame:
        d = F.col("data")
        raw = self._documents("session").select(
            "id", text_at(d, "$.projectID").alias("project_id"), text_at(d, "$.parentID").alias("parent_id"), text_at(d, "$.slug").alias("slug"), text_at(d, "$.directory").alias("directory"), text_at(d, "$.title").alias("title"),
            long_at(d, "$.time.created").alias("time_created"), long_at(d, "$.time.updated").alias("time_updated"), long_at(d, "$.time.archived").alias("time_archived"),
            long_at(d, "$.summary.additions").alias("summary_additions"), long_at(d, "$.summary.deletions").alias("summary_deletions"), long_at(d, "$.summary.files").alias("summary_files"),
        )
        projects = self._documents("project").select("id", text_at(d, "$.worktree").alias("worktree"), text_at(d, "$.name").alias("name"))
        counts = self._documents("message").groupBy(F.col("folder").alias("session_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
        s = map_sessions(raw, projects)
        return s.join(counts, s.native_id == counts.session_id, "left").withColumn("message_count", F.coalesce("n", F.lit(0))).select(*s.columns)

    def turns(self) -> DataFrame:
        messages = self._documents("message").select("id", F.col("folder").alias("session_id"), F.lit(0).cast("bigint").alias("time_created"), "data")
        parts = self._documents("part").select("id", F.col("folder").alias("message_id"), "data")
        return map_turns(messages, parts)

    def turns_of(self, native_id: str) -> DataFrame:
        """Messages are in their session's folder, parts in their message's."""
        messages = self._documents("message", (native_id,)).select("id", F.col("folder").alias("session_id"), F.lit(0).cast("bigint").alias("time_created"), "data")
        ids = tuple(r.id for r in messages.select("id").limit(MOST_FOLDERS + 1).collect())
        parts = self._documents("part", ids if 0 < len(ids) <= MOST_FOLDERS else ()).select("id", F.col("folder").alias("message_id"), "data")
        return map_turns(messages, parts)

    def files(self) -> DataFrame:
        """Paths that parts name; a part belongs to the session of its message."""
        from ..operators.transcripts import touched_files

        messages = self._documents("message").select(F.col("id").alias("message_id"), F.col("folder").alias("session_id"))
        parts = self._documents("part").select(F.col("folder").alias("message_id"), "id", "data").join(messages, "message_id")
        data = F.col("data")
        named = parts.select(session_uri(F.lit(self.source_id), F.col("session_id")).alias("uri"), F.coalesce(text_at(data, "$.tool"), F.lit("patch")).alias("tool"), F.explode(part_files(data)).alias("path"), F.lit(None).cast("bigint").alias("turn_index"), F.concat("message_id", F.lit("/"), "id").alias("pos"))
        return touched_files(named)

    def unreadable(self) -> DataFrame:
        """Sessions whose own document is torn."""
        files = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(os.path.join(self.location, "session"), wholetext=True)
        torn = files.where(F.try_parse_json("value").isNull())
        return torn.select(session_uri(F.lit(self.source_id), F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)).alias("uri"))


def opencode(spark: SparkSession, root: str, prefer_json: bool = False) -> SessionSource | None:
    """The store below a folder: the SQLite file if it holds something that can be read, else the tree, else none."""
    file, tree = os.path.join(root, "opencode.db"), os.path.join(root, "storage")
    has_tree = os.path.isdir(os.path.join(tree, "session"))
    if prefer_json and has_tree:
        return OpenCodeTree(spark, tree)
    if os.path.exists(file) and os.path.getsize(file) > SMALLEST_FILE:
        store = OpenCodeSqlite(spark, file)
        if not has_tree or store.probe().available:
            return store
    return OpenCodeTree(spark, tree) if has_tree else None
