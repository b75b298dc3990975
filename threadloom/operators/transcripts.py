"""Reading transcripts: numbering, ranges, budgets, blocks, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TranscriptOptions
from ..functions.paths import quoted
from ..functions.text import output_cap, role_name


def exchanges_to_turns(rows: DataFrame) -> DataFrame:
    """Exchanges (``session_id, turn_index, user_message, assistant_response, timestamp``) as one or two messages.

    Blank halves are dropped; ``message_index`` counts those that stay.
    """
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.lit("User").alias("role"), F.col("user_message").alias("text")), F.struct(F.lit(1).alias("half"), F.lit("Assistant").alias("role"), F.col("assistant_response").alias("text"))))
    said = rows.select("session_id", "turn_index", "timestamp", halves.alias("h")).select("session_id", "turn_index", "timestamp", "h.half", "h.role", "h.text").where("trim(coalesce(text, '')) <> ''")
    w = Window.partitionBy("session_id").orderBy("turn_index", "half")
    return said.withColumn("message_index", F.row_number().over(w) - 1).drop("half")


def exchange_map(rows: DataFrame) -> DataFrame:
    """``session_id, turn_index, message_index``: an exchange's first message, or the next one's where it has none."""
    full = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 1).otherwise(0)
    n = full(F.col("user_message")) + full(F.col("assistant_response"))
    w = Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("session_id", "turn_index", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("int").alias("message_index"))


def remapped(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with ``turn_index`` of exchanges as that of messages; null where the exchange is unknown."""
    return rows.join(places, ["session_id", "turn_index"], "left").drop("turn_index").withColumnRenamed("message_index", "turn_index")


def numbered(messages: DataFrame, *order: str) -> DataFrame:
    """Messages with ``turn_index`` from 0 in the given order."""
    return messages.withColumn("turn_index", F.row_number().over(Window.partitionBy("uri").orderBy(*order)) - 1)


def block_size(b: Column) -> Column:
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return n(b["text"]) + n(b["output"]) + n(b["input_json"]) + n(b["tool_name"]) + n(b["diff"]) + n(b["path"])


def selected_blocks(blocks: Column, o: TranscriptOptions) -> Column:
    """Blocks as the options want them: reasoning and diffs only if asked for, tool output capped."""
    kept = F.filter(blocks, lambda b: (b["kind"] != "reasoning") | F.lit(o.include_reasoning))

    def shown(b: Column) -> Column:
        out = output_cap(b["output"], o.max_tool_output) if o.include_tool_output and o.max_tool_output else b["output"] if o.include_tool_output else F.lit(None).cast("string")
        return b.withField("output", out).withField("diff", b["diff"] if o.include_diffs else F.lit(None).cast("string"))

    return F.transform(kept, shown)


def page(turns: DataFrame, o: TranscriptOptions, size: Column) -> DataFrame:
    """Turns in range and within the budget, with ``total_turns``, ``next_turn_index`` and ``is_truncated``.

    The first turn in range is always there; after the first that does not fit, none is.
    """
    every = turns.withColumn("total_turns", F.max("turn_index").over(Window.partitionBy("uri")) + 1)
    if o.from_turn is not None:
        every = every.where(F.col("turn_index") >= o.from_turn)
    if o.to_turn is not None:
        every = every.where(F.col("turn_index") <= o.to_turn)
    if o.max_characters <= 0:
        return every.withColumn("next_turn_index", F.lit(None).cast("int")).withColumn("is_truncated", F.lit(False))
    w = Window.partitionBy("uri").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.sum(size).over(w) <= o.max_characters) | (F.row_number().over(Window.partitionBy("uri").orderBy("turn_index")) == 1)
    marked = every.withColumn("__fits", fits)
    after = F.min(F.when(~F.col("__fits"), F.col("turn_index"))).over(Window.partitionBy("uri"))
    return marked.withColumn("next_turn_index", after).withColumn("is_truncated", F.col("next_turn_index").isNotNull()).where("__fits").drop("__fits")


def first_user_text(turns: DataFrame) -> DataFrame:
    """``uri, text`` of each session's first turn of a user."""
    return turns.where(F.lower("role") == "user").groupBy("uri").agg(F.min_by("text", "turn_index").alias("text"))


def runs_joined(parts: DataFrame, breaks: Column, text: str = "text") -> DataFrame:
    """Adjacent parts as one block: ``uri, run, kind, pos, text``; a part for which ``breaks`` holds stands alone.

    ``parts`` has ``uri, pos, kind``.  A run ends where a part breaks it and begins anew after.
    """
    w = Window.partitionBy("uri").orderBy("pos")
    here = breaks.cast("int")
    run = F.sum(here + F.coalesce(F.lag(here).over(w), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = parts.withColumn("run", run)
    return marked.groupBy("uri", "run").agg(
        F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"), F.count(F.lit(1)).alias("n_parts"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("t")))), lambda x: x["t"]), "")).alias("text"),
    )


def touched_files(rows: DataFrame) -> DataFrame:
    """``uri, path, tool, turn_index``: the first mention of each path, whatever its case."""
    w = Window.partitionBy("uri", F.lower("path")).orderBy("turn_index", "pos")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("uri", "path", "tool", "turn_index")


def split_references(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to the web, and files."""
    web = F.lower("value").startswith("http://") | F.lower("value").startswith("https://")
    return rows.where(web), rows.where(~web)


def markdown(turns: DataFrame) -> DataFrame:
    """``uri, markdown``: a transcript's turns under headings, in order."""
    head = F.concat(F.lit("## "), F.lower(role_name(F.col("role"))), F.coalesce(F.concat(F.lit(" · "), F.col("model")), F.lit("")), F.lit("\n\n"), F.col("text"))
    return turns.groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", head.alias("h")))), lambda x: x["h"]), "\n\n").alias("markdown"))


def resume_command(source: Column, native_id: Column, cwd: Column, fork: bool = False, model: str | None = None) -> Column:
    """The line that would take a session up again; nothing is run."""
    program = F.when(source == "opencode", F.lit("opencode --session ")).when(source == "copilot-cli", F.lit("copilot --resume ")).otherwise(F.lit("code --reuse-window "))
    target = F.when(source.isin("opencode", "copilot-cli"), native_id).otherwise(F.coalesce(cwd, F.lit(".")))
    line = F.concat(program, quoted(target))
    if fork:
        line = F.when(source == "opencode", F.concat(line, F.lit(" --fork"))).otherwise(line)
    if model:
        line = F.concat(line, F.lit(" --model "), quoted(F.lit(model)))
    return F.when(cwd.isNotNull() & source.isin("opencode", "copilot-cli"), F.concat(F.lit("cd "), quoted(cwd), F.lit(" && "), line)).otherwise(line)


def with_tool_turn(paged: DataFrame, tools: DataFrame, o: TranscriptOptions) -> DataFrame:
    """Pages with their sessions' tool turns, which a store keeps apart: each follows the last turn, whatever the budget.

    There is none where the page was cut, or ends before it, or begins beyond it.  It counts among the turns, and has the
    time of the last turn shown.
    """
    if o.from_turn is not None:
        tools = tools.where(F.col("turn_index") >= o.from_turn)
    if o.to_turn is not None:
        tools = tools.where(F.col("turn_index") <= o.to_turn)
    ends = paged.groupBy("uri").agg(F.bool_or("is_truncated").alias("__cut"), F.max_by("timestamp", "turn_index").alias("__at"))
    more = tools.join(ends, "uri", "left").where(~F.coalesce("__cut", F.lit(False))).withColumn("timestamp", F.col("__at")).drop("__cut", "__at")
    more = more.withColumns({"total_turns": F.col("turn_index") + 1, "next_turn_index": F.lit(None).cast("int"), "is_truncated": F.lit(False)})
    counted = paged.join(more.select("uri", F.lit(1).alias("__more")), "uri", "left")
    counted = counted.withColumn("total_turns", F.col("total_turns") + F.coalesce("__more", F.lit(0))).drop("__more")
    return counted.unionByName(more.select(*counted.columns))
