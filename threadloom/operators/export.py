"""Transcripts as Markdown documents and sessions as lines, one string each, made in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import label, relative_time
from ..functions.text import role_name

STAMP = "yyyy-MM-dd'T'HH:mm:ss"


def _full(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _if(c: Column, *parts: Column | str) -> Column:
    """The parts as one text where ``c`` holds something, else empty."""
    return F.when(_full(c), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def block_markdown(b: Column) -> Column:
    """One content block; a paragraph each, quotes for reasoning, fences for output and diffs."""
    kind = b["kind"]
    quoted = F.concat(F.lit("> [!NOTE] Reasoning\n> "), F.regexp_replace(F.regexp_replace(b["text"], r"[ \t\r]*\n", "\n"), "\n", "\n> "))
    fenced = lambda c, name: _if(c, f"\n\n```{name}\n", F.rtrim(c), "\n```")
    tool = F.concat(F.lit("**Tool** `"), F.coalesce(b["tool_name"], F.lit("tool")), F.lit("`"), _if(b["title"], " — ", b["title"]), fenced(b["output"], ""))
    patch = F.concat(F.lit("**Edit** `"), b["path"], F.lit("`"), fenced(b["diff"], "diff"))
    return F.when(kind == "text", b["text"]).when(kind == "reasoning", quoted).when(kind == "tool", tool).when(kind == "patch", patch)


def turn_markdown(t: DataFrame) -> DataFrame:
    """``uri, turn_index, part``: a heading of role, model and time, and the blocks."""
    head = F.concat(F.lit("## "), F.lower(role_name(F.col("role"))), _if(F.col("model"), " · ", F.col("model")), F.coalesce(F.concat(F.lit(" · "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), F.lit("")))
    blocks = F.array_compact(F.transform("blocks", block_markdown))
    return t.select("uri", "turn_index", F.array_join(F.concat(F.array(head), blocks), "\n\n").alias("part"))


def documents(sessions: DataFrame, turns: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``uri, markdown`` of whole sessions: title, traits as a YAML block, turns in order, files touched."""
    body = turn_markdown(turns).groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "part"))), lambda x: x["part"]), "\n\n").alias("body"))
    traits = F.concat(
        F.lit("```yaml\nuri: "), F.col("uri"), F.lit("\nsource: "), F.col("source_id"), F.lit("\ncreated: "), F.coalesce(F.date_format("created_at", STAMP), F.lit("")), F.lit("\nupdated: "), F.coalesce(F.date_format("updated_at", STAMP), F.lit("")),
        _if(F.col("workspace_path"), "\nworkspace: ", F.col("workspace_path")), _if(F.col("branch"), "\nbranch: ", F.col("branch")), _if(F.col("agent"), "\nagent: ", F.col("agent")),
        F.when(F.size("models") > 0, F.concat(F.lit("\nmodels: ["), F.array_join("models", ", "), F.lit("]"))).otherwise(""), F.lit("\n```"),
    )
    j = sessions.join(body, "uri", "left")
    tail = F.lit(None).cast("string")
    if files is not None:
        listed = files.groupBy("uri").agg(F.array_sort(F.collect_set("path")).alias("paths"))
        j = j.join(listed, "uri", "left")
        tail = F.when(F.size("paths") > 0, F.concat(F.lit("## Files touched\n\n"), F.array_join(F.transform("paths", lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n")))
    return j.select("uri", F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), traits, F.col("body"), tail), F.lit("\n")).alias("markdown"))


def detail_line(now: Column, age: Column | None = None) -> Column:
    """What stands below a session's title in a list: place, ``age`` (by default the relative time), agent, models, size."""
    n = F.col("message_count")
    return F.concat_ws(
        "  ·  ", label(F.lit(None).cast("string"), F.col("workspace_path"), F.col("repository")), F.nullif(F.col("branch"), F.lit("")), relative_time(F.col("updated_at"), now) if age is None else age,
        F.nullif(F.col("agent"), F.lit("")), F.nullif(F.array_join("models", ", "), F.lit("")), F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " message").otherwise(" messages"))),
    )
