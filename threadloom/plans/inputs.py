"""What users type: times, names, ranges, facets."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from ..config import SessionFilter, UsageError

SORTS = {"recent": "updated", "newest": "updated", "updated": "updated", "created": "created", "oldest": "oldest", "size": "size", "title": "title", "provider": "provider", "source": "provider"}
MODES = {"lexical": "lexical", "keyword": "lexical", "semantic": "semantic", "vector": "semantic", "hybrid": "hybrid"}
BROWSE_SORTS = {"relevance": "relevance", "newest": "newest", "recent": "newest", "updated": "newest", "oldest": "oldest", "provider": "provider", "source": "provider", "title": "title", "size": "size"}
GROUPS = {"none": "none", "provider": "provider", "source": "provider", "day": "day", "week": "week", "month": "month"}
#: Names that stand for several sources, or for one with a longer name.
ALIASES = {"copilot": ("copilot-cli", "copilot-vscode"), "vscode": ("copilot-vscode",)}
FIELDS = ("provider", "source", "-provider", "-source", "since", "until", "last", "sort", "group", "repo", "agent", "model", "tag")


def sort_name(value: str | None) -> str:
    if not value:
        return "updated"
    try:
        return SORTS[value.lower()]
    except KeyError:
        raise UsageError(f"unknown sort {value!r}: use {', '.join(sorted(SORTS))}") from None


def mode_name(value: str | None) -> str:
    return MODES.get((value or "").lower(), "hybrid")


def _months_back(at: datetime, n: int) -> datetime:
    month = at.year * 12 + at.month - 1 - n
    year, month = divmod(month, 12)
    for day in range(at.day, 0, -1):
        try:
            return at.replace(year=year, month=month + 1, day=day)
        except ValueError:
            if day <= 28:
                raise
    raise ValueError


#: What a time before now may be called: calendar steps as (months, days), and units of an amount in seconds.
STEPS = {"day": (0, 1), "week": (0, 7), "month": (1, 0), "year": (12, 0)}
UNITS = {"m": 60, "h": 3_600, "d": 86_400, "w": 604_800}
_AMOUNT = re.compile(r"(?P<count>\d[\d.]*(?:e[+-]?\d+)?)(?P<unit>[" + "".join(UNITS) + "])")


def _seconds(amount: str) -> float | None:
    m = _AMOUNT.fullmatch(amount)
    n = float(m["count"]) * UNITS[m["unit"]] if m else math.nan
    return n if math.isfinite(n) else None


def _instant(written: str, now: datetime, end_of_day: bool) -> datetime:
    if (step := STEPS.get(written.lower())) is not None:
        return _months_back(now - timedelta(days=step[1]), step[0])
    if (ago := _seconds(written.lower())) is not None:
        return now - timedelta(seconds=ago)
    at = datetime.fromisoformat(written)
    bare = re.fullmatch(r"\d{4}(?:-\d\d){2}", written)
    return at.replace(hour=23, minute=59, second=59, microsecond=999_999) if bare and end_of_day else at


def time_bound(value: str | None, lower: bool, now: datetime) -> datetime | None:
    """A time before ``now`` (``7d``, ``month``) or a date; an upper bound of a bare date is that day's last instant."""
    written = (value or "").strip()
    try:
        return _instant(written, now, not lower) if written else None
    except (ValueError, OverflowError):
        raise UsageError(f"{value!r} is neither a date nor a duration: try 2026-01-31, 7d, 12h, 30m, week or month") from None


def sources(names: list[str], known: list[str]) -> list[str]:
    """Known sources that names, comma-separated names and aliases stand for, in the order of ``known``; none given: all."""
    wanted: set[str] = set()
    by_name = {k.lower(): k for k in known}
    given = [n.strip().lower() for name in names for n in name.split(",") if n.strip()]
    for n in given:
        if n == "all":
            wanted |= set(known)
        elif n in by_name:
            wanted.add(by_name[n])
        elif n in ALIASES and any(a in by_name for a in ALIASES[n]):
            wanted |= {by_name[a] for a in ALIASES[n] if a in by_name}
        else:
            raise UsageError(f"unknown source {n!r}: use {', '.join(known)}")
    return [k for k in known if k in wanted] if given else list(known)


def turn_range(value: str) -> tuple[int | None, int | None]:
    """``a-b``, ``a-``, ``-b`` or ``n``."""
    m = re.fullmatch(r"\s*(?:(\d+)|(\d*)\s*-\s*(\d*))\s*", value)
    if not m or (m.group(1) is None and not (m.group(2) or m.group(3))):
        raise UsageError(f"{value!r} is no range of turns: use 3, 3-7, 3- or -7")
    if m.group(1) is not None:
        return int(m.group(1)), int(m.group(1))
    low, high = (int(x) if x else None for x in m.group(2, 3))
    if low is not None and high is not None and low > high:
        raise UsageError(f"{value!r} ends before it begins")
    return low, high


@dataclass(frozen=True)
class BrowseQuery:
    text: str = ""
    #: None: as chosen elsewhere; empty: none at all.
    providers: tuple[str, ...] | None = None
    since: datetime | None = None
    until: datetime | None = None
    sort: str | None = None
    group: str | None = None
    repository: str | None = None
    agent: str | None = None
    model: str | None = None
    tags: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Part:
    """A blank-separated part of a query: as typed, and what it says of a field (none: it is search text)."""

    typed: str
    field: str = ""
    keep: bool = True
    value: str = ""


_PART = re.compile(r'(?:\\"|"(?:\\"|[^"])*(?:"|$)|[^\s"])+')
#: What a field is about; ``-`` before it may turn it round if it is about sources.
_ABOUT = {"provider": "providers", "source": "providers", "last": "since", "repo": "repository", "tag": "tags"} | {f: f for f in ("since", "until", "sort", "group", "agent", "model")}


def parts(text: str) -> list[Part]:
    """A query cut at blanks outside of quotes."""
    out = []
    for typed in _PART.findall(text):
        name, _, value = typed.partition(":")
        known = len(name) < len(typed) and name.lower() in FIELDS
        out.append(Part(typed, name.lower().removeprefix("-"), name[0] != "-", value.strip('"')) if known else Part(typed))
    return out


def _chosen_sources(said: list[Part], known: list[str], now: datetime) -> tuple[str, ...]:
    asked = {keep: [p.value for p in said if p.keep is keep] for keep in (True, False)}
    if any(v.lower() == "none" for v in asked[True]):
        return ()
    left_out = frozenset(sources(asked[False], known) if asked[False] else ())
    return tuple(s for s in sources(asked[True], known) if s not in left_out)


def _word_of(words: dict[str, str]):
    def read(said: list[Part], known: list[str], now: datetime) -> str:
        for p in said:
            if p.value.lower() not in words:
                raise UsageError(f"{p.field} {p.value!r} is unknown: use {', '.join(sorted(set(words.values())))}")
        return words[said[-1].value.lower()]

    return read


#: How what was said of a matter becomes an attribute of the query.  Of single values the last one counts.
_READ = {
    "providers": _chosen_sources,
    "since": lambda said, known, now: [time_bound(p.value, True, now) for p in said][-1],
    "until": lambda said, known, now: [time_bound(p.value, False, now) for p in said][-1],
    "sort": _word_of(BROWSE_SORTS),
    "group": _word_of(GROUPS),
    "tags": lambda said, known, now: tuple(p.value.lstrip("#") for p in said),
}


def browse(text: str, known: list[str], now: datetime) -> BrowseQuery:
    """A browser's query: facets by name, all else search text."""
    said: dict[str, list[Part]] = {}
    for p in (found := parts(text)):
        if p.field and not p.value:
            raise UsageError(f"nothing follows {p.typed!r}: give a value, as in {p.field}:x")
        said.setdefault(_ABOUT.get(p.field, "text"), []).append(p)
    plain = lambda some, known, now: some[-1].value
    got = {about: _READ.get(about, plain)(some, known, now) for about, some in said.items() if about != "text"}
    if got.get("since") and got.get("until") and got["until"] < got["since"]:
        raise UsageError("the time ends before it begins: no session can be since one and until the other")
    return BrowseQuery(text=" ".join(p.typed for p in found if not p.field), **got)


def without_facets(text: str, *fields: str) -> str:
    """The text without the named facets (a leading ``-`` names the negated ones), or without any."""
    gone = set(fields or FIELDS)
    return " ".join(p.typed for p in parts(text) if (p.field if p.keep else "-" + p.field) not in gone)


def merged(base: SessionFilter, typed: BrowseQuery) -> SessionFilter:
    """Typed facets win over a panel's choices."""
    return replace(
        base,
        source_ids=base.source_ids if typed.providers is None else typed.providers,
        since=typed.since or base.since, until=typed.until or base.until, repository=typed.repository or base.repository,
        agent=typed.agent or base.agent, model=typed.model or base.model, tags=typed.tags or base.tags,
    )
