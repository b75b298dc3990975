"""Paths, URIs, labels and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "session"


def normalize_path(c: Column) -> Column:
    """Forward slashes, none at the end; blank is empty."""
    return F.regexp_replace(F.translate(F.coalesce(F.when(F.trim(c) != "", c), F.lit("")), "\\", "/"), "/+$", "")


def is_under(path: Column, root: str | Column, ignore_case: bool = False) -> Column:
    """Whether ``path`` is ``root`` or below; every path is under an empty root."""
    p, r = normalize_path(path), normalize_path(F.lit(root) if isinstance(root, str) else root)
    if ignore_case:
        p, r = F.lower(p), F.lower(r)
    return (r == "") | ((p != "") & ((p == r) | p.startswith(F.concat(r, F.lit("/")))))


def leaf(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+)[/\\]*$", 1)


def label(display: Column, path: Column, repository: Column) -> Column:
    """What a workspace is called: its name, else its folder, else its repository."""
    return F.coalesce(F.nullif(F.trim(display), F.lit("")), F.nullif(leaf(path), F.lit("")), F.nullif(repository, F.lit("")), F.lit("(unknown)"))


def session_uri(source: Column, native_id: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://"), source, F.lit("/"), native_id)


def uri_parts(c: Column) -> Column:
    """(source, native id) of a URI of any scheme; null if either half is missing."""
    source, native = F.regexp_extract(c, r"(?i)^[a-z]+://([^/]+)/(.+)$", 1), F.regexp_extract(c, r"(?i)^[a-z]+://([^/]+)/(.+)$", 2)
    return F.when(source != "", F.struct(source.alias("source_id"), native.alias("native_id")))


def short_form(source: Column, native_id: Column) -> Column:
    return F.concat(source, F.lit("/"), F.substring(native_id, 1, 12))


def relative_time(value: Column, now: Column) -> Column:
    """How long ago, in whole units; a date beyond a year."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(value.cast("timestamp"))
    whole = lambda n: F.floor(s / n).cast("string")
    return (
        F.when(s < 60, F.lit("just now"))
        .when(s < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(s < 86400, F.concat(whole(3600), F.lit("h ago")))
        .when(s < 30 * 86400, F.concat(whole(86400), F.lit("d ago")))
        .when(s < 365 * 86400, F.concat(whole(30 * 86400), F.lit("mo ago")))
        .otherwise(F.date_format(value, "yyyy-MM-dd"))
    )


def coarse_age(value: Column, now: Column) -> Column:
    """How long ago, in whole hours, days or months, never finer or as a date."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(value.cast("timestamp"))
    whole = lambda n: F.floor(s / n).cast("string")
    return F.when(s < 86400, F.concat(whole(3600), F.lit("h ago"))).when(s < 30 * 86400, F.concat(whole(86400), F.lit("d ago"))).otherwise(F.concat(whole(30 * 86400), F.lit("mo ago")))


def group_key(kind: str, source: Column, at: Column) -> Column:
    """The header a session stands under: provider, day, week (from Monday) or month."""
    if kind == "provider":
        return F.lower(source)
    if kind == "day":
        return F.date_format(at, "yyyy-MM-dd")
    if kind == "week":
        return F.concat(F.lit("Week of "), F.date_format(F.date_trunc("week", at), "yyyy-MM-dd"))
    if kind == "month":
        return F.date_format(at, "yyyy-MM")
    return F.lit("")


def file_uri_path(c: Column) -> Column:
    """The path of a ``file:`` URI, percent-decoded, without slashes at the end or before a drive."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), r"^/(?=[A-Za-z]:)", ""), "/+$", "")


def after_slash(c: Column) -> Column:
    """A model's name without its provider."""
    return F.regexp_replace(c, "^[^/]*/(?=.)", "")


def after_dot(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"([^.]+)$", 1), F.lit("")), c)


def quoted(c: Column) -> Column:
    """An argument of a command line, in double quotes where it needs them."""
    needs = (c == "") | c.rlike(r"[\s\"'$`\\&|;<>()*?!#~]")
    return F.when(needs, F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\$`])', r"\\$1"), F.lit('"'))).otherwise(c)
