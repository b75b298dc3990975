"""Excerpts of matching passages, made for the few that are shown."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, fold_text, preview
from ..plans.terms import QueryTerm

OPEN, CLOSE, GAP, TOKENS = "<<", ">>", "…", 20
PREVIEW = 240
_RUN = re.compile(TOKEN.replace(r"\p{L}\p{N}", r"^\W_"))


def excerpt(text: str, terms: list[QueryTerm], size: int = TOKENS, open_: str = OPEN, close: str = CLOSE) -> str | None:
    """The ``size`` tokens that hold the most distinct terms, those marked; None without any.

    Of equally good windows one that begins the text or a sentence is taken, else the first.
    """
    runs = [(m.start(), m.end(), fold_text(m.group())) for m in _RUN.finditer(text)]
    found: list[tuple[int, int, int]] = []
    for k, term in enumerate(terms):
        n = len(term.tokens)
        for i in range(len(runs) - n + 1 if n else 0):
            *head, last = (r[2] for r in runs[i : i + n])
            if tuple(head) == term.tokens[:-1] and (last.startswith(term.tokens[-1]) if term.prefix else last == term.tokens[-1]):
                found.append((i, i + n, k))
    if not found:
        return None
    best, first = None, 0
    starts = {0} | {max(0, min(a, len(runs) - size)) for a, _, _ in found} | {max(0, b - size) for _, b, _ in found}
    sentence = {0} | {i for i in range(1, len(runs)) if re.search(r"[.!?:\n]\s*$", text[runs[i - 1][1] : runs[i][0]])}
    starts |= {s for s in sentence if any(s <= a < s + size for a, _, _ in found)}
    for s in sorted(starts):
        inside = [f for f in found if f[0] >= s and f[1] <= s + size]
        rank = (len({f[2] for f in inside}), len(inside), s in sentence)
        if best is None or rank > best:
            best, first = rank, s
    last = min(len(runs), first + size)
    a = 0 if first == 0 else runs[first][0]
    b = len(text) if last == len(runs) else runs[last - 1][1]
    out, at, done = [GAP] if first else [], a, -1
    for i, j, _ in sorted(found, key=lambda f: (f[0], -f[1])):
        if i < first or j > last or i < done:
            continue
        out += (text[at : runs[i][0]], open_, text[runs[i][0] : runs[j - 1][1]], close)
        at, done = runs[j - 1][1], j
    out.append(text[at:b])
    return "".join(out) + (GAP if last < len(runs) else "")


def with_excerpts(passages: DataFrame, terms: list[QueryTerm], size: int = TOKENS) -> DataFrame:
    """Passages with ``highlighted`` and the plain ``excerpt``; those without a term get a preview."""

    @F.pandas_udf("highlighted string, excerpt string")
    def make(texts):
        import pandas as pd

        marked = [excerpt(t or "", terms, size) for t in texts]
        plain = [excerpt(t or "", terms, size, "", "") for t in texts]
        return pd.DataFrame({"highlighted": marked, "excerpt": plain})

    short = preview(F.col("text"), PREVIEW)
    out = passages.withColumn("__x", make("text"))
    return out.withColumn("highlighted", F.col("__x.highlighted")).withColumn("excerpt", F.coalesce("__x.excerpt", short)).drop("__x")


def collected(chosen: DataFrame, chunks: DataFrame, terms: list[QueryTerm], per_session: int) -> DataFrame:
    """``uri, snippets`` of ranked sessions: their first passages in order; text is fetched for these only."""
    if per_session <= 0:
        return chosen.select("uri").distinct().withColumn("snippets", F.array().cast("array<struct<place:int,role:string,turn_index:int,text:string,highlighted:string>>"))
    few = chosen.where(F.col("place") <= per_session)
    rows = with_excerpts(chunks.join(F.broadcast(few), ["uri", "ordinal"]), terms)
    return rows.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("place", "role", "turn_index", F.col("excerpt").alias("text"), "highlighted"))).alias("snippets"))
