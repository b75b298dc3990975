"""Copilot CLI stores: a SQLite file of exchanges, and logs of tool calls beside it."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SessionFilter
from ..functions.json import instant, text_at
from ..functions.paths import session_uri
from ..functions.text import derive_title, output_cap, preview
from ..operators import rollups, transcripts
from . import sqlite_source
from .base import SessionSource, as_sessions, backfilled, block

LARGEST_LOG = 32 << 20


def tool_calls(lines: DataFrame, max_output: int = 0) -> DataFrame:
    """``session_id, call_id, pos, tool_name, input_json, output, status`` of event lines (``session_id, pos, value``).

    Calls stand in the order of their first start; the last start and the last completion count; a completion without
    start is left out, as are lines that are no JSON.
    """
    v = F.col("value")
    kind, call = text_at(v, "$.type"), text_at(v, "$.data.toolCallId")
    output = text_at(v, "$.data.result.content", "$.data.result")
    e = lines.where(F.try_parse_json("value").isNotNull()).select("session_id", "pos", kind.alias("kind"), call.alias("call_id"), F.coalesce(text_at(v, "$.data.toolName"), F.lit("tool")).alias("tool"), text_at(v, "$.data.arguments").alias("args"), F.coalesce(text_at(v, "$.data.success").try_cast("boolean"), F.lit(True)).alias("success"), output.alias("output")).where("call_id is not null")
    started, ended = F.col("kind") == "tool.execution_start", F.col("kind") == "tool.execution_complete"
    last = lambda of, *c: F.max_by(F.struct(*c), F.when(of, F.col("pos")))
    g = e.groupBy("session_id", "call_id").agg(F.min(F.when(started, F.col("pos"))).alias("pos"), last(started, "tool", "args").alias("s"), F.max(F.when(ended, F.col("pos"))).alias("done"), last(ended, "success", "output").alias("c"))
    status = F.when(F.col("done").isNull(), "running").when(F.col("c.success"), "completed").otherwise("error")
    shown = F.when(F.col("done").isNotNull(), F.col("c.output"))
    return g.where("pos is not null").select("session_id", "call_id", "pos", F.col("s.tool").alias("tool_name"), F.col("s.args").alias("input_json"), (output_cap(shown, max_output) if max_output else shown).alias("output"), status.alias("status"))


def tool_turn(calls: DataFrame, totals: DataFrame) -> DataFrame:
    """One turn of all tool calls of each session, after its last turn; ``totals`` has ``session_id, total_turns``."""
    one = block(kind="tool", tool_name=F.col("tool_name"), input_json=F.col("input_json"), output=F.col("output"), status=F.col("status"), call_id=F.col("call_id"))
    blocks = calls.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "call_id", one.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return blocks.join(totals, "session_id").select("session_id", F.col("total_turns").cast("int").alias("turn_index"), F.lit("Tool").alias("role"), "blocks")


class CopilotCli(SessionSource):
    source_id = "copilot-cli"
    capabilities = ("resume", "tool_calls", "incremental", "native_search", "usage", "file_tracking")

    def __init__(self, spark, location: str, min_turns: int = 1):
        super().__init__(spark, location)
        self.min_turns = min_turns

    def _table(self, name: str) -> DataFrame | None:
        return sqlite_source.read_table(self.spark, self.location, name)

    def _uri(self):
        return session_uri(F.lit(self.source_id), F.col("session_id"))

    def sessions(self) -> DataFrame:
        s = backfilled(self._table("sessions"), {c: "string" for c in ("id", "cwd", "repository", "branch", "summary", "created_at", "updated_at")})
        exchanges = self._table("turns")
        n = exchanges.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("exchanges"))
        messages = transcripts.exchanges_to_turns(exchanges).groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("messages"))
        j = s.join(n, "id", "left").join(messages, "id", "left").where(F.coalesce("exchanges", F.lit(0)) >= self.min_turns)
        usage = self._table("assistant_usage_events")
        if usage is not None:
            u = rollups.usage_by_session(rollups.usage_by_model(usage.withColumnRenamed("total_nano_aiu", "total_nano")))
            j = j.join(u.withColumnRenamed("session_id", "id"), "id", "left")
        else:
            j = j.select("*", F.array().cast("array<string>").alias("models"), *[F.lit(None).cast(t).alias(c) for c, t in (("agent", "string"), ("total_tokens", "bigint"), ("cost", "double"))])
        updated = F.coalesce(instant(F.col("updated_at")), instant(F.col("created_at")), F.lit("1970-01-01").cast("timestamp_ntz"))
        return as_sessions(
            j.select(
                session_uri(F.lit(self.source_id), F.col("id")).alias("uri"), F.lit(self.source_id).alias("source_id"), F.col("id").alias("native_id"),
                derive_title(F.col("summary")).alias("title"), preview(F.col("summary"), 200).alias("preview"), F.col("cwd").alias("workspace_path"), "repository", "branch", "agent",
                F.coalesce("models", F.array().cast("array<string>")).alias("models"), F.coalesce(instant(F.col("created_at")), updated).alias("created_at"), updated.alias("updated_at"),
                F.coalesce("messages", F.lit(0)).alias("message_count"), "total_tokens", "cost", F.lit(False).alias("is_archived"),
                F.concat_ws(":", F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.coalesce("exchanges", F.lit(0)).cast("string")).alias("content_hash"),
            )
        )

    def turns(self) -> DataFrame:
        return self._turns(lambda rows: rows)

    def turns_of(self, native_id: str) -> DataFrame:
        return self._turns(lambda rows: rows.where(F.col("session_id") == native_id))

    def _turns(self, chosen) -> DataFrame:
        m = transcripts.exchanges_to_turns(chosen(self._table("turns")))
        out = m.select("session_id", F.col("turn_index").alias("exchange"), F.col("message_index").cast("int").alias("turn_index"), "role", instant(F.col("timestamp")).alias("timestamp"), F.array(block(kind="text", text=F.col("text"))).alias("blocks"))
        usage = self._table("assistant_usage_events")
        if usage is None:
            out = out.withColumn("model", F.lit(None).cast("string")).withColumn("agent", F.lit(None).cast("string"))
        else:
            u = rollups.usage_by_turn(chosen(usage)).withColumnRenamed("turn_index", "exchange")
            out = out.join(u, ["session_id", "exchange"], "left")
        return out.select(self._uri().alias("uri"), "turn_index", "role", "timestamp", "model", "agent", "blocks")

    def _remapped(self, name: str, wanted: dict[str, str]) -> DataFrame | None:
        rows = self._table(name)
        if rows is None:
            return None
        places = transcripts.exchange_map(self._table("turns").select("session_id", "turn_index", "user_message", "assistant_response"))
        return transcripts.remapped(backfilled(rows, {"session_id": "string", "turn_index": "bigint"} | wanted), places).withColumn("uri", self._uri())

    def files(self) -> DataFrame | None:
        rows = self._remapped("session_files", {"file_path": "string", "tool_name": "string"})
        return rows and rows.select("uri", F.col("file_path").alias("path"), F.col("tool_name").alias("tool"), "turn_index")

    def references(self) -> DataFrame | None:
        rows = self._remapped("session_refs", {"ref_type": "string", "ref_value": "string"})
        return rows and rows.select("uri", "ref_type", "ref_value", "turn_index")

    def tool_turns(self, max_output: int = 0) -> DataFrame | None:
        """Turns of the logs in ``session-state`` beside the file; logs beyond the limit are left out."""
        return self._tool_turns("*", lambda rows: rows, max_output)

    def tool_turns_of(self, native_id: str) -> DataFrame | None:
        """The turn of one session's log, the only one that is opened."""
        return self._tool_turns(re.sub(r"([\\*?\[\]{}])", r"\\\1", native_id), lambda rows: rows.where(F.col("session_id") == native_id), 0)

    def _tool_turns(self, name: str, chosen, max_output: int) -> DataFrame | None:
        folder = os.path.join(os.path.dirname(self.location), "session-state")
        if not os.path.isdir(folder):
            return None
        lines = self.spark.read.option("pathGlobFilter", f"{name}.jsonl").text(folder, wholetext=True).where(F.col("_metadata.file_size") <= LARGEST_LOG)
        each = lines.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("session_id"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
        totals = transcripts.exchanges_to_turns(chosen(self._table("turns"))).groupBy("session_id").agg(F.count(F.lit(1)).alias("total_turns"))
        turns = tool_turn(tool_calls(each, max_output), totals)
        return turns.select(self._uri().alias("uri"), "turn_index", "role", F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("agent"), "blocks")

    def search_native(self, text: str, f: SessionFilter = SessionFilter(), top: int = 20, snippets: int = 3) -> DataFrame:
        """Search of the store's own table of passages: a session scores as its best passage.

        ``uri, score, passages``; passages have role and turn.  The filter holds; without the table nothing is found.
        """
        from ..operators import lexical
        from ..operators.filters import filtered
        from ..plans.terms import parse

        rows = self._table("search_index")
        if rows is None:
            return self.sessions().select("uri", F.lit(0.0).alias("score")).where("false")
        c = backfilled(rows, {"content": "string", "session_id": "string", "source_type": "string", "source_id": "string"})
        turn = F.regexp_extract("source_id", r":turn:(\d+)$", 1).try_cast("int")
        role = F.when(F.col("source_type").contains("user"), "User").otherwise("Assistant")
        chunk = lexical.tokenized(c.select(self._uri().alias("uri"), F.row_number().over(Window.partitionBy("session_id").orderBy("source_id", "content")).alias("ordinal"), F.col("content").alias("text"), role.alias("role"), turn.alias("turn_index")))
        found = lexical.top_passages(lexical.bm25(chunk, parse(text), filtered(self.sessions(), f)), max(5 * top, 50))
        shown = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ordinal", "role", "turn_index", "text"))), 1, max(snippets, 1))
        best = found.join(chunk.select("uri", "ordinal", "role", "turn_index", "text"), ["uri", "ordinal"]).groupBy("uri").agg(F.max("score").alias("score"), shown.alias("passages"))
        return best.orderBy(F.desc("score"), "uri").limit(top)

    def version(self) -> str | None:
        v = self._table("schema_version")
        return None if v is None else str(v.agg(F.max("version").alias("v")).first().v)
