"""Defaults of the engine.  The numbers are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from datetime import datetime


class EngineError(Exception):
    """Base of the engine's errors; ``exit_code`` is what a command line would return."""

    exit_code = 1


class UsageError(EngineError):
    exit_code = 2


class NotFoundError(EngineError):
    exit_code = 3


class AmbiguousError(EngineError):
    exit_code = 4


class SourceError(EngineError):
    exit_code = 5


@dataclass(frozen=True)
class ChunkPolicy:
    max_characters: int = 1200
    overlap: int = 150
    min_characters: int = 16
    include_tool_output: bool = True
    tool_output_characters: int = 4000
    include_reasoning: bool = True


@dataclass(frozen=True)
class SearchConfig:
    rrf_k: int = 60
    lexical_weight: float = 1.0
    semantic_weight: float = 1.0
    recency_boost: float = 0.15
    recency_half_life_days: float = 30.0
    workspace_boost: float = 0.10
    candidate_factor: int = 20
    candidate_floor: int = 50
    candidate_cap: int = 500
    session_shortlist: int = 50
    chunks_per_session: int = 8
    embeddings: bool = True


@dataclass(frozen=True)
class SessionFilter:
    """Conditions on sessions; those left out hold always."""

    source_ids: tuple[str, ...] = ()
    disabled_sources: tuple[str, ...] = ()
    workspace_path: str | None = None
    repository: str | None = None
    branch: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    agent: str | None = None
    model: str | None = None
    tags: tuple[str, ...] = ()
    min_messages: int | None = None
    include_archived: bool = False
    limit: int = 25
    sort: str = "updated"


@dataclass(frozen=True)
class SearchQuery:
    text: str
    filter: SessionFilter = field(default_factory=SessionFilter)
    top: int = 20
    snippets: int = 3
    mode: str = "hybrid"
    deep: bool = False


@dataclass(frozen=True)
class TranscriptOptions:
    include_tool_output: bool = False
    include_reasoning: bool = False
    include_diffs: bool = False
    from_turn: int | None = None
    to_turn: int | None = None
    max_characters: int = 0
    max_tool_output: int = 2000


@dataclass(frozen=True)
class EngineConfig:
    chunk: ChunkPolicy = field(default_factory=ChunkPolicy)
    search: SearchConfig = field(default_factory=SearchConfig)
    disabled_sources: frozenset[str] = frozenset()
    not_indexed_by_default: frozenset[str] = frozenset()
    refresh_cooldown_seconds: int = 300
    refresh_budget_seconds: int = 5

    def with_source(self, names: list[str], known: list[str], enabled: bool | None = None, indexed: bool | None = None) -> "EngineConfig":
        """Switches sources, or only their default indexing.  Every name is checked before anything changes."""
        by_name = {k.lower(): k for k in known}
        unknown = [n for n in names if n.lower() not in by_name]
        if unknown:
            raise UsageError(f"unknown sources: {', '.join(unknown)}")
        ids = {by_name[n.lower()] for n in names}
        out = self
        if enabled is not None:
            out = replace(out, disabled_sources=out.disabled_sources - ids if enabled else out.disabled_sources | ids)
        if indexed is not None:
            out = replace(out, not_indexed_by_default=out.not_indexed_by_default - ids if indexed else out.not_indexed_by_default | ids)
        return out


def clamp_search(top: int, snippets: int) -> tuple[int, int]:
    return min(max(top, 1), 50), min(max(snippets, 0), 10)


def clamp_list(limit: int) -> int:
    return min(max(limit, 1), 200)


def clamp_characters(n: int) -> int:
    return min(max(n, 1000), 200_000)


def settings(config: EngineConfig) -> dict[str, object]:
    """All settings by dotted name."""
    out: dict[str, object] = {}

    def walk(prefix: str, node) -> None:
        for f in fields(node):
            v = getattr(node, f.name)
            if is_dataclass(v):
                walk(f"{prefix}{f.name}.", v)
            else:
                out[prefix + f.name] = v

    walk("", config)
    return out


def with_setting(config: EngineConfig, name: str, value: str) -> EngineConfig:
    """A config with one setting read from text in the type that it has."""
    known = settings(config)
    if name not in known:
        raise UsageError(f"unknown setting {name!r}")
    old = known[name]
    try:
        if isinstance(old, bool):
            new = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}[value.strip().lower()]
        elif isinstance(old, frozenset):
            new = frozenset(v.strip() for v in value.split(",") if v.strip())
        else:
            new = type(old)(value)
    except (KeyError, ValueError):
        raise UsageError(f"{value!r} does not fit {name}") from None
    first, _, rest = name.partition(".")
    return replace(config, **{first: replace(getattr(config, first), **{rest: new})}) if rest else replace(config, **{name: new})
