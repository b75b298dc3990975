"""Passages: a header, tool calls, and prose in overlapping windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ChunkPolicy
from ..functions.text import flatten

#: Characters of texts whose pieces a Python worker holds at once.
SLICE_CHARACTERS = 1 << 20

_SENTENCE = re.compile(r"[.!?](?=\s|\Z)")


def break_at(window: str) -> int:
    """Where to cut a full window: a paragraph, sentence, line or word that ends in its last third, else its end."""
    floor = len(window) * 2 // 3
    at = window.rfind("\n\n")
    if at >= floor:
        return at + 2
    ends = [m.end() for m in _SENTENCE.finditer(window, floor)]
    if ends:
        return ends[-1]
    for sign in ("\n", " "):
        at = window.rfind(sign)
        if at >= floor:
            return at + 1
    return len(window)


def split(text: str | None, policy: ChunkPolicy = ChunkPolicy()) -> list[str]:
    """Overlapping pieces of a text; pieces shorter than the least are left out."""
    text = (text or "").strip()
    out, at = [], 0
    while at < len(text):
        if len(text) - at <= policy.max_characters:
            out.append(text[at:].strip())
            break
        n = break_at(text[at : at + policy.max_characters])
        out.append(text[at : at + n].strip())
        at += max(1, n - policy.overlap)
    return [p for p in out if len(p) >= policy.min_characters]


def walked(rows: DataFrame, walk, fields: str, text: str = "text") -> DataFrame:
    """The other columns of ``rows`` and what ``walk`` yields of each ``text``: tuples of ``fields``, a schema as DDL.

    Each cut depends on the one before, so texts are walked whole, one at a time.  An Arrow batch stays in Arrow and its results
    leave in slices of ``SLICE_CHARACTERS``, so that a worker holds one text and one slice as Python objects, however many rows come.
    """
    kept = [c for c in rows.columns if c != text]
    taken = rows.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in kept]).alias("row"), text)
    made = T.StructType.fromDDL(fields)
    names = made.fieldNames()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in made.fields]
        for batch in batches:
            at, out, held = [], [], 0

            def slice_():
                columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["row", *names])

            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py() or ""
                for o in walk(t):
                    at.append(i)
                    out.append(o)
                held += len(t) + 1
                if held >= SLICE_CHARACTERS:
                    yield slice_()
                    at, out, held = [], [], 0
            yield slice_()

    schema = T.StructType([taken.schema["row"], *made.fields])
    return taken.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in kept], *names)


def split_texts(rows: DataFrame, text: str = "text", policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """A row for each piece: ``piece_no`` from 0 and ``piece`` in place of ``text``."""
    return walked(rows, lambda t: enumerate(split(t, policy)), "piece_no int, piece string", text)


def header_text(title: Column, preview: Column, label: Column) -> Column:
    """Title, preview if it differs, and workspace, on lines."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.trim(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.when(~blank(preview) & (F.coalesce(title, F.lit("")) != preview), preview), F.when(~blank(label), label)))


def tool_text(name: Column, title: Column, input_json: Column, output: Column, policy: ChunkPolicy = ChunkPolicy()) -> Column:
    """``[name] title``, then input and output, each capped."""
    n = policy.tool_output_characters
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    head = F.concat(F.lit("["), F.coalesce(name, F.lit("")), F.lit("]"), F.when(full(title), F.concat(F.lit(" "), flatten(title))).otherwise(""))
    return F.concat_ws("\n", head, F.when(full(input_json), F.substring(input_json, 1, n // 2)), F.when(full(output), F.substring(output, 1, n)))


def said(blocks: Column, policy: ChunkPolicy = ChunkPolicy()) -> Column:
    """A turn's prose: its blocks in order, blank ones left out."""

    def one(b: Column) -> Column:
        kind = b["kind"]
        out = F.when(kind == "text", b["text"]).when((kind == "reasoning") & F.lit(policy.include_reasoning), b["text"])
        out = out.when(kind == "patch", F.concat(F.lit("[edit] "), b["path"]))
        if not policy.include_tool_output:
            out = out.when(kind == "tool", F.concat(F.lit("["), b["tool_name"], F.lit("] "), F.coalesce(b["title"], F.lit(""))))
        return F.trim(out)

    return F.array_join(F.filter(F.transform(blocks, one), lambda t: t != ""), "\n\n")


def tool_texts(blocks: Column, policy: ChunkPolicy = ChunkPolicy()) -> Column:
    """The texts of a turn's tool calls in order."""
    if not policy.include_tool_output:
        return F.array().cast("array<string>")
    calls = F.filter(blocks, lambda b: b["kind"] == "tool")
    return F.transform(calls, lambda b: tool_text(b["tool_name"], b["title"], b["input_json"], b["output"], policy))


def chunks(sessions: DataFrame, turns: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """All passages of ``sessions`` with their ``ordinal``: the header, then turns in order, of each its tool calls before its prose.

    ``turns`` has a row for each turn; those of other sessions are left out.  A text goes through one exchange, to where its session's
    others are; there sessions pass by one after another in order, so that a worker cuts and numbers them holding one turn and one slice.
    """
    head = header_text(F.col("title"), F.col("preview"), F.coalesce(F.regexp_extract("workspace_path", r"([^/\\]+)[/\\]*$", 1), "repository"))
    none = F.array().cast("array<string>")
    heads = sessions.select(
        "uri", F.lit(-1).alias("turn"), F.lit(0).alias("turn_index"), F.lit("System").alias("role"), F.col("created_at").alias("timestamp"), none.alias("tools"),
        F.when(F.length(head) >= policy.min_characters, head).alias("text"),
    )
    body = turns.select("uri", F.col("turn_index").alias("turn"), "turn_index", "role", "timestamp", tool_texts(F.col("blocks"), policy).alias("tools"), said(F.col("blocks"), policy).alias("text"))
    every = heads.unionByName(body).repartition("uri").sortWithinPartitions("uri", "turn")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        uri, known, ordinal = None, False, 0
        for batch in batches:
            uris, places, tools, texts = (batch.column(k) for k in (0, 1, 5, 6))
            at, numbers, calls, out, held = [], [], [], [], 0

            def slice_():
                rows = pa.array(at, pa.int64())
                role = pc.if_else(pa.array(calls, pa.bool_()), "Tool", batch.column(3).take(rows))
                columns = [uris.take(rows), pa.array(numbers, pa.int32()), batch.column(2).take(rows), role, batch.column(4).take(rows), pa.array(out, pa.string()), pc.invert(pa.array(calls, pa.bool_()))]
                return pa.RecordBatch.from_arrays(columns, names=["uri", "ordinal", "turn_index", "role", "timestamp", "text", "is_embeddable"])

            for i in range(batch.num_rows):
                header = places[i].as_py() < 0
                if uris[i].as_py() != uri:
                    uri, known, ordinal = uris[i].as_py(), header, 0
                if not known:
                    continue
                text = texts[i].as_py()
                pieces = ([text] if text else []) if header else split(text, policy)
                found = [(True, t) for t in tools[i].as_py() or ()] + [(False, t) for t in pieces]
                for call, t in found:
                    at.append(i)
                    numbers.append(ordinal)
                    calls.append(call)
                    out.append(t)
                    held += len(t)
                    ordinal += 1
                if held >= SLICE_CHARACTERS:
                    yield slice_()
                    at, numbers, calls, out, held = [], [], [], [], 0
            yield slice_()

    types = {f.name: f.dataType.simpleString() for f in every.schema}
    schema = f"uri string, ordinal int, turn_index {types['turn_index']}, role string, timestamp {types['timestamp']}, text string, is_embeddable boolean"
    return every.mapInArrow(run, schema)
