"""Session filters as one predicate and semi joins; resolving identifiers; browse orders and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AmbiguousError, NotFoundError, SessionFilter, UsageError
from ..functions.paths import group_key, is_under
from ..functions.text import contains_ci, same_ci

ID_PREFIX_FROM = 4
AMBIGUOUS_SHOWN = 6


def predicate(f: SessionFilter) -> Column:
    """All of a filter but its tags, in an order that lets the scan see the cheap parts."""
    out = F.lit(True)
    if f.disabled_sources:
        out &= ~F.lower("source_id").isin([s.lower() for s in f.disabled_sources])
    if f.source_ids:
        out &= F.lower("source_id").isin([s.lower() for s in f.source_ids])
    if not f.include_archived:
        out &= ~F.coalesce("is_archived", F.lit(False))
    if f.since is not None:
        out &= F.col("updated_at") >= F.lit(f.since)
    if f.until is not None:
        out &= F.col("updated_at") <= F.lit(f.until)
    if f.workspace_path:
        out &= is_under(F.col("workspace_path"), f.workspace_path, ignore_case=True)
    if f.repository:
        out &= contains_ci(F.col("repository"), f.repository) | contains_ci(F.col("workspace_path"), f.repository)
    if f.branch:
        out &= F.coalesce(same_ci(F.col("branch"), f.branch), F.lit(False))
    if f.agent:
        out &= contains_ci(F.col("agent"), f.agent)
    if f.model:
        out &= F.coalesce(F.exists("models", lambda m: F.lower(m).contains(f.model.lower())), F.lit(False))
    if f.min_messages is not None:
        out &= F.coalesce("message_count", F.lit(0)) >= f.min_messages
    return out


def filtered(sessions: DataFrame, f: SessionFilter, tags: DataFrame | None = None) -> DataFrame:
    """Sessions that a filter admits; each tag is a semi join of its own, so that all must hold."""
    out = sessions.where(predicate(f))
    for t in f.tags:
        if tags is None:
            raise UsageError("a filter by tags needs the tag table")
        out = out.join(tags.where(same_ci(F.col("tag"), t)).select("uri"), "uri", "left_semi")
    return out


def ordered(sessions: DataFrame, sort: str = "updated", limit: int = 0) -> DataFrame:
    """A browse order, ties by URI; a limit of 0 is none.  A limit right above a sort keeps the top of each task only."""
    by = {
        "updated": [F.desc_nulls_last("updated_at")],
        "created": [F.desc_nulls_last("created_at")],
        "oldest": [F.asc_nulls_last("updated_at")],
        "size": [F.coalesce("message_count", F.lit(0)).desc()],
        "provider": [F.lower("source_id").asc(), F.desc_nulls_last("updated_at")],
        "title": [F.lower("title").asc()],
    }
    if sort not in by:
        raise UsageError(f"unknown sort {sort!r}")
    out = sessions.orderBy(*by[sort], F.col("uri").asc())
    return out.limit(limit) if limit else out


def with_tags(sessions: DataFrame, tags: DataFrame) -> DataFrame:
    """Sessions with the sorted list of their tags."""
    lists = tags.groupBy("uri").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return sessions.join(lists, "uri", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def grouped(sessions: DataFrame, kind: str) -> DataFrame:
    """``group_name, n`` of the headers of a grouping."""
    return sessions.groupBy(group_key(kind, F.col("source_id"), F.col("updated_at")).alias("group_name")).agg(F.count(F.lit(1)).alias("n"))


def regrouped(sessions: DataFrame, sort: str, kind: str) -> DataFrame:
    """Sessions under headers: providers rising, times falling, in each header the given order."""
    key = group_key(kind, F.col("source_id"), F.col("updated_at"))
    marked = sessions.withColumn("group_name", key)
    head = F.col("group_name").asc() if kind in ("provider", "none") else F.col("group_name").desc()
    order = {
        "newest": [F.desc_nulls_last("updated_at")], "oldest": [F.asc_nulls_last("updated_at")], "provider": [F.lower("source_id").asc()],
        "title": [F.lower("title").asc()], "size": [F.coalesce("message_count", F.lit(0)).desc()],
        "relevance": [F.desc_nulls_last("score")] if "score" in sessions.columns else [F.desc_nulls_last("updated_at")],
    }[sort]
    return marked.orderBy(head, *order, F.col("uri").asc())


def candidates_by_id(sessions: DataFrame, wanted: str, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Sessions an identifier may mean: ``source/id`` or a URI exactly, else an id, else what begins with it."""
    seen = sessions.where(~F.lower("source_id").isin([d.lower() for d in disabled])) if disabled else sessions
    bare = wanted.split("://", 1)[-1]
    source, slash, native = bare.partition("/")
    if slash and source and native:
        return seen.where((F.lower("source_id") == source.lower()) & (F.col("native_id") == native)).orderBy("uri").limit(2)
    begins = F.lower(F.substring("native_id", 1, len(wanted))) == wanted.lower()
    hit = (F.col("native_id") == wanted) | (begins if len(wanted) >= ID_PREFIX_FROM else F.lit(False))
    return seen.where(hit).orderBy((F.col("native_id") == wanted).desc(), "uri").limit(AMBIGUOUS_SHOWN)


def resolve(sessions: DataFrame, wanted: str, disabled: tuple[str, ...] = ()) -> str:
    """The URI an identifier means; at most six rows come to the driver."""
    rows = candidates_by_id(sessions, wanted, disabled).select("uri", "native_id").collect()
    exact = [r.uri for r in rows if r.native_id == wanted]
    found = exact if len(exact) == 1 else [r.uri for r in rows]
    if not found:
        raise NotFoundError(f"no session {wanted!r}")
    if len(found) > 1:
        raise AmbiguousError(f"{wanted!r} may be {', '.join(found)}")
    return found[0]
