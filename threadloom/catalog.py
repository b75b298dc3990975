"""The engine's verbs: search, list, get, files, tags, status, refresh, resume."""

from __future__ import annotations

import threading
import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, EngineError, NotFoundError, SearchQuery, SessionFilter, TranscriptOptions, UsageError, clamp_search
from .operators import export, fetch, filters, fusion, lexical, rollups, semantic, snippets, transcripts
from .plans.embedding import Embedder
from .plans.store import IndexStore
from .plans.terms import parse
from .shipping import ship
from .sources.base import SessionSource


class Catalog:
    """Sources and their index.  ``now`` is always given, so that results don't depend on the clock."""

    def __init__(self, spark: SparkSession, store: IndexStore, sources: list[SessionSource], config: EngineConfig = EngineConfig(), embedder: Embedder | None = None):
        ship(spark)
        self.spark, self.store, self.sources, self.config, self.embedder = spark, store, sources, config, embedder
        self._kept: tuple[int, DataFrame | None] | None = None

    def _enabled(self) -> list[SessionSource]:
        return [s for s in self.sources if s.source_id not in self.config.disabled_sources]

    def _filter(self, f: SessionFilter) -> SessionFilter:
        return replace(f, disabled_sources=tuple(sorted(set(f.disabled_sources) | self.config.disabled_sources)))

    def live_sessions(self) -> DataFrame:
        """All enabled sources as one; one that can't be read is left out."""
        return self._live(lambda s: s.sessions())

    def _live(self, of) -> DataFrame:
        out = None
        for s in self._enabled():
            if s.available():
                out = of(s) if out is None else out.unionByName(of(s))
        if out is None:
            raise NotFoundError("no source is available")
        return out

    def _sessions(self) -> DataFrame:
        return self.store.table("session") if self.store.exists() else self.live_sessions()

    def list(self, f: SessionFilter = SessionFilter(), mode: str = "indexed") -> DataFrame:
        """Sessions by a filter: from the index, or the sources where there is none; ``index_only``; or ``live``."""
        if mode == "index_only" and not self.store.exists():
            raise NotFoundError("there is no index: refresh first")
        tags = self.store.tags()
        if mode == "live" or not self.store.exists():
            # Each source filters and cuts by itself, then all are cut together.
            best = lambda s: filters.ordered(filters.filtered(s.sessions_for(self._filter(f)), self._filter(f), tags), f.sort, f.limit)
            rows = filters.ordered(self._live(best), f.sort, f.limit)
        else:
            rows = filters.ordered(filters.filtered(self._sessions(), self._filter(f), tags), f.sort, f.limit)
        return filters.ordered(filters.with_tags(rows, tags), f.sort)

    def search(self, q: SearchQuery, now: datetime, workspace: str | None = None) -> DataFrame:
        """Sessions by relevance with their snippets: candidates, ranks, fusion, boosts, then text for those shown.

        Candidates of the lexical list (at most the configured cap) and the hits are computed at once, as texts are asked for by name.
        """
        if not self.store.exists():
            raise NotFoundError("there is no index to search: refresh first")
        top, per_session = clamp_search(q.top, q.snippets)
        c = self.config.search
        sessions, chunk = self.store.table("session"), self.store.table("chunk")
        vectors, centroid = self.store.table("chunk_embedding"), self._centroids()
        has_model = self.embedder is not None and vectors is not None
        if q.mode in ("hybrid", "semantic"):
            self.store.require_model(self.embedder)
        mode = semantic.effective_mode(q.mode, c.embeddings, has_model)
        admitted = filters.filtered(sessions, self._filter(q.filter), self.store.tags()).select("uri")
        terms, lists, ranks = parse(q.text), {}, {}
        if mode in ("lexical", "hybrid") and terms:
            posting = self.store.table("posting")
            found = lexical.bm25_places(posting, *self.store.statistics(), terms, admitted) if posting is not None else lexical.bm25(chunk, terms, admitted)
            lists["lexical"] = fetch.local(lexical.top_passages(found, lexical.candidate_cap(top, c)))
        if mode in ("semantic", "hybrid"):
            v = semantic.query_vector(self.embedder.vectors([q.text], query=True)[0])
            lists["semantic"] = semantic.search(vectors, centroid, v, admitted, q.deep, c).select("uri", "ordinal", "score")
        if not lists:
            return sessions.select("uri", "title").where("false")
        for name, rows in lists.items():
            ranks[name] = fusion.session_ranks(rows, bounded=name == "lexical" or not q.deep)
        best = fusion.cut(fusion.fused(ranks, c), top)
        named = best.join(sessions.select("uri", "title", "source_id", "updated_at", "workspace_path"), "uri")
        hits = fetch.local(fusion.boosted(named, now, workspace, c).orderBy(F.desc("score"), "uri").limit(top))
        uris = [r.uri for r in hits.select("uri").collect()]
        # Texts last, and of the sessions shown only: their names reach the scan.
        shown = fetch.few(fusion.chosen_passages(lists, c), "uri", uris)
        texts = fetch.few(chunk, "uri", uris).select("uri", "ordinal", "role", "turn_index", "text")
        excerpts = snippets.collected(shown, texts, terms, per_session)
        return hits.join(excerpts, "uri", "left").orderBy(F.desc("score"), "uri")

    def _centroids(self) -> DataFrame | None:
        """The sessions' vectors, kept in memory until another generation is live."""
        m = self.store.manifest()
        if self._kept is None or self._kept[0] != m["generation"]:
            if self._kept is not None and self._kept[1] is not None:
                self._kept[1].unpersist()
            rows = self.store.table("session_embedding", m)
            self._kept = m["generation"], rows if rows is None else rows.persist()
        return self._kept[1]

    def pending(self) -> list[str]:
        """Sources that have changes the index lacks: those never indexed whole, or with a newer cursor; unavailable ones are left out."""
        states, out = self.store.manifest()["sources"], []
        for s in self._enabled():
            if s.available():
                known, now = states.get(s.source_id, {}).get("cursor"), s.change_cursor()
                if known is None or now is not None and now > datetime.fromisoformat(known):
                    out.append(s.source_id)
        return out

    def search_live(self, q: SearchQuery, limit: int = 400) -> DataFrame:
        """Search of the sources themselves: each source's ranks are fused, as their scores don't compare."""
        from .plans.terms import words

        top, per_session = clamp_search(q.top, q.snippets)
        terms, parts = [w for w, _ in words(q.text)], None
        for s in self._enabled():
            if not s.available():
                continue
            if "native_search" in s.capabilities:
                # The store's own table of passages serves, where scanning all it holds would be slower.
                scores = s.search_native(q.text, self._filter(q.filter), max(top, 1), per_session).select("uri", "score")
                one = self._reciprocal(scores)
                parts = one if parts is None else parts.unionByName(one)
                continue
            said = s.turns().select("uri", "turn_index", F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] == "text"), lambda b: b["text"]), "\n\n").alias("text"))
            scores, _ = lexical.live_scan(said, terms, filters.filtered(s.sessions(), self._filter(q.filter), self.store.tags()), limit, per_session)
            one = self._reciprocal(scores)
            parts = one if parts is None else parts.unionByName(one)
        if parts is None:
            raise NotFoundError("no source is available")
        return parts.orderBy(F.desc("score"), "uri").limit(top)

    def _reciprocal(self, scores: DataFrame) -> DataFrame:
        ranks = fusion.session_ranks(scores.select("uri", F.lit(0).alias("ordinal"), "score"))
        return ranks.select("uri", (F.lit(1.0) / (self.config.search.rrf_k + F.col("rank"))).alias("score"))

    def markdown(self, wanted: str, o: TranscriptOptions = TranscriptOptions(include_tool_output=True, include_reasoning=True, include_diffs=True)) -> str:
        """A session as a Markdown document."""
        uri = self.resolve(wanted)
        session = self.live_sessions().where(F.col("uri") == uri)
        files = None
        for s in self._enabled():
            if uri.split("://", 1)[1].startswith(s.source_id + "/") and (f := s.files()) is not None:
                files = f.where(F.col("uri") == uri)
        return export.documents(session, self.transcript(wanted, o), files).first().markdown

    def health(self, now: datetime) -> DataFrame:
        """``name, ok, detail`` of sources, index, freshness and the model, and of all together."""
        m = self.store.manifest()
        rows = [(f"source {p.source_id}", p.available, p.detail) for p in (s.probe() for s in self.sources)]
        rows.append(("index", bool(m["sources"]), f"generation {m['generation']}"))
        rows.append(("freshness", not self.store.stale(now, self.config), f"last refresh {m['last_refresh']}"))
        same = self.embedder is None or m["embedding_model"] in (None, self.embedder.name)
        rows.append(("model", same, str(m["embedding_model"])))
        return rollups.health([self.spark.createDataFrame(rows, "name string, ok boolean, detail string")])

    def resolve(self, wanted: str) -> str:
        return filters.resolve(self._sessions(), wanted, tuple(self.config.disabled_sources))

    def transcript(self, wanted: str, o: TranscriptOptions = TranscriptOptions()) -> DataFrame:
        """A page of a session's turns, always from its source."""
        uri = self.resolve(wanted)
        source = next((s for s in self._enabled() if uri.split("://", 1)[1].startswith(s.source_id + "/")), None)
        if source is None:
            raise NotFoundError(f"no source for {uri}")
        native_id = uri.split("://", 1)[1].split("/", 1)[1]
        shown = lambda rows: rows.withColumn("blocks", transcripts.selected_blocks(F.col("blocks"), o))
        size = F.aggregate("blocks", F.lit(0), lambda s, b: s + transcripts.block_size(b))
        paged = transcripts.page(shown(source.turns_of(native_id)), o, size)
        tools = source.tool_turns_of(native_id) if o.include_tool_output else None
        return (paged if tools is None else transcripts.with_tool_turn(paged, shown(tools), o)).orderBy("turn_index")

    def files(self, wanted: str) -> DataFrame:
        uri = self.resolve(wanted)
        stored = self.store.table("session_file")
        if stored is not None and not (mine := stored.where(F.col("uri") == uri)).isEmpty():
            return mine
        for s in self._enabled():
            if uri.split("://", 1)[1].startswith(s.source_id + "/") and (f := s.files()) is not None:
                return f.where(F.col("uri") == uri)
        raise NotFoundError(f"no files are known of {uri}")

    def refresh(self, now: datetime, **options):
        return self.store.refresh(self.sources, now, self.config, self.embedder, **options)

    def top_up(self, now: datetime):
        """A refresh without vectors if the last is long past; None if it isn't, or if it took longer than its budget.

        Jobs that run over the budget are cancelled; the index stays as it was.
        """
        if not self.store.stale(now, self.config):
            return None
        tag, context = f"top-up {uuid.uuid4().hex}", self.spark.sparkContext
        done, late = threading.Event(), threading.Event()

        def stop() -> None:
            if not done.wait(self.config.refresh_budget_seconds):
                late.set()
                while not done.wait(0.2):  # a job may be between two at any time
                    context.cancelJobsWithTag(tag)

        watch = threading.Thread(target=stop, daemon=True)
        context.addJobTag(tag)
        watch.start()
        try:
            return self.store.refresh(self.sources, now, self.config, None)
        except EngineError:
            if late.is_set():
                return None
            raise
        finally:
            done.set()
            watch.join()
            context.removeJobTag(tag)

    def status(self, exact: bool = True) -> DataFrame:
        """``source_id, sessions, chunks, embeddable_sessions, embedded_sessions``.

        If not ``exact``, the last two are estimates from the generations' sketches (with quantiles of passages' tokens), and no passage is read.
        """
        m = self.store.manifest()
        rows = [(s, int(x.get("sessions", 0)), int(x.get("chunks", 0))) for s, x in sorted(m["sources"].items())]
        counts = self.spark.createDataFrame(rows, "source_id string, sessions bigint, chunks bigint")
        if not exact and (estimated := self.store.sketched(m)) is not None:
            return counts.join(estimated, "source_id", "left")
        chunk, vectors = self.store.table("chunk", m), self.store.table("session_embedding", m)
        if chunk is None:
            return counts.select("*", F.lit(0).cast("bigint").alias("embeddable_sessions"), F.lit(0).cast("bigint").alias("embedded_sessions"))
        have = vectors if vectors is not None else chunk.where("false")
        return counts.join(rollups.coverage(chunk, have.select("uri")), "source_id", "left")

    def source_table(self) -> DataFrame:
        probes = [s.probe() for s in self.sources]
        return self.spark.createDataFrame([(p.source_id, p.available, p.sessions, p.version, p.detail, list(p.capabilities)) for p in probes], "source_id string, available boolean, sessions bigint, version string, detail string, capabilities array<string>")

    def tag(self, wanted: str, add: list[str] = (), remove: list[str] = (), now: datetime | None = None) -> tuple[int, int]:
        """Adds and removes tags of a session; returns how many of each."""
        if now is None:
            raise UsageError("a change of tags needs the time")
        uri = self.resolve(wanted)
        rows = lambda names: self.spark.createDataFrame([(uri, n) for n in names], "uri string, tag string")
        return self.store.add_tags(rows(add), now) if add else 0, self.store.remove_tags(rows(remove), now) if remove else 0

    def resume_line(self, wanted: str, fork: bool = False, model: str | None = None) -> str:
        uri = self.resolve(wanted)
        row = self._sessions().where(F.col("uri") == uri).select(transcripts.resume_command(F.col("source_id"), F.col("native_id"), F.col("workspace_path"), fork, model).alias("line")).first()
        return row.line


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON, one to a line."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
