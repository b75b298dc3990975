"""The index: immutable generations of Parquet, a manifest that names the live ones, tags outside.

``<root>/gen=<n>/<table>/source_id=<s>/…`` and ``<root>/manifest.json``.  A refresh writes a generation that holds what changed,
with the URIs that it replaces or drops (``gone``), and then swaps the manifest by renaming it, so readers keep what they
opened and a failed refresh leaves the old one live.  A source's rows are those of its generations, less what later ones
have gone; after ``MAX_DELTAS`` of them the source is written anew as one.  Files are reached through Hadoop's file systems,
so that a root may be in any store Spark can write.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkPolicy, EngineConfig, EngineError, SessionFilter, UsageError
from ..functions.vectors import centroids
from ..operators import chunking, fetch, incremental, lexical, sketches
from ..operators.filters import predicate
from ..operators.semantic import check_model, embeddable
from ..sources.base import SessionSource
from . import scratch
from .embedding import Embedder

SCHEMA_VERSION = 2
TABLES = ("session", "chunk", "posting", "chunk_embedding", "session_embedding", "session_file")
VECTORS = ("chunk_embedding", "session_embedding")
#: Generations of a source, and files of the log of tags, before they are written as one.
MAX_DELTAS = 8
MAX_TAG_FILES = 64
#: Sessions whose URIs are broadcast to find their turns.
FEW_SESSIONS = 1 << 19


@dataclass
class SourceReport:
    source_id: str
    skipped: str | None = None
    written: int = 0
    unchanged: int = 0
    pruned: int = 0
    #: Sessions that could not be read.  They keep what the index has of them, and the cursor stays.
    failed: int = 0
    complete: bool = True


@dataclass
class RefreshReport:
    sources: list[SourceReport] = field(default_factory=list)
    generation: int = 0

    @property
    def written(self) -> int:
        return sum(s.written for s in self.sources)


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Files.

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        fs, p = self._fs(), self._path("manifest.json")
        if not fs.exists(p):
            return {"schema_version": SCHEMA_VERSION, "generation": 0, "embedding_model": None, "last_refresh": None, "sources": {}}
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        m = json.loads(text)
        if m["schema_version"] != SCHEMA_VERSION:
            return {"schema_version": SCHEMA_VERSION, "generation": m["generation"], "embedding_model": None, "last_refresh": None, "sources": {}}
        return m

    def _swap(self, manifest: dict) -> None:
        fs, new, old = self._fs(), self._path(f".manifest-{manifest['generation']}.json"), self._path("manifest.json")
        out = fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(manifest, indent=1), "utf-8"))
        finally:
            out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, old, options)

    def exists(self) -> bool:
        return bool(self.manifest()["sources"])

    def clear(self) -> None:
        """Drops all generations; tags stay."""
        fs, m = self._fs(), self.manifest()
        self._swap({"schema_version": SCHEMA_VERSION, "generation": m["generation"], "embedding_model": None, "last_refresh": None, "sources": {}, "tags": m.get("tags", "tags")})
        for status in fs.globStatus(self._path("gen=*")) or []:
            fs.delete(status.getPath(), True)

    # Tables.

    def table(self, name: str, manifest: dict | None = None) -> DataFrame | None:
        """The live rows of a table; None if no source has any."""
        m, parts = manifest or self.manifest(), None
        for source_id, state in sorted(m["sources"].items()):
            one = self._source_table(name, source_id, state)
            if one is not None:
                one = one.withColumn("source_id", F.lit(source_id))
                parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
        return parts

    def _written(self, name: str, source_id: str, generation: int) -> DataFrame | None:
        where = (f"gen={generation}", name, f"source_id={source_id}")
        return self.spark.read.parquet("/".join((self.root, *where))) if self._fs().exists(self._path(*where)) else None

    def _source_table(self, name: str, source_id: str, state: dict) -> DataFrame | None:
        """A source's live rows: of each generation those that no later one has gone."""
        all_, dead = None, None
        for g in reversed(state.get("generations", ())):
            # Vectors of another model are not there any more.
            rows = None if name in VECTORS and g < state.get("vectors_from", 0) else self._written(name, source_id, g)
            if rows is not None:
                rows = rows if dead is None else rows.join(dead, "uri", "left_anti")
                all_ = rows if all_ is None else all_.unionByName(rows, allowMissingColumns=True)
            gone = self._written("gone", source_id, g)
            if gone is not None:
                dead = gone if dead is None else dead.union(gone)
        return all_

    def sketched(self, manifest: dict | None = None) -> DataFrame | None:
        """By source, from what the generations' sketches say: estimated sessions with something to embed and with a vector,
        and the median and 95th percentile of passages' tokens.  No passage is read.

        Sessions that were replaced or dropped are taken off; the lengths of their passages still count until the source is written whole.
        """
        m, parts = manifest or self.manifest(), None
        for source_id, state in sorted(m["sources"].items()):
            for g in state.get("generations", ()):
                one = self._written("sketch", source_id, g)
                if one is None:
                    return None
                old_model = g < state.get("vectors_from", 0)
                one = one.withColumns({"source_id": F.lit(source_id), "generation": F.lit(g), "embedded": F.col("nothing") if old_model else F.col("embedded")})
                parts = one if parts is None else parts.unionByName(one)
        if parts is None:
            return None
        each = F.array_sort(F.collect_list(F.struct("generation", "embeddable", "embedded", "gone")))
        rows = parts.groupBy("source_id").agg(each.alias("g"), F.first("nothing").alias("nothing"), sketches.merged_distribution(F.col("tokens")).alias("tokens"))
        count = lambda name: F.round(sketches.estimate(sketches.live(F.transform("g", lambda x: F.struct(x[name].alias("has"), x["gone"].alias("gone"))), F.col("nothing")))).cast("bigint")
        return rows.select(
            "source_id", count("embeddable").alias("embeddable_sessions"), count("embedded").alias("embedded_sessions"),
            sketches.quantile(F.col("tokens"), 0.5).alias("median_tokens"), sketches.quantile(F.col("tokens"), 0.95).alias("tokens_95"),
        )

    def statistics(self, manifest: dict | None = None) -> tuple[float, float]:
        """Passages of the index and their mean number of tokens."""
        states = (manifest or self.manifest())["sources"].values()
        n, tokens = (sum(s.get(x, 0) for s in states) for x in ("chunks", "tokens"))
        return float(n), tokens / n if n else 1.0

    def vacuum(self) -> int:
        """Deletes generations and logs of tags that the manifest names no more; returns how many.  Readers must be done with them."""
        fs, m = self._fs(), self.manifest()
        live = {f"gen={g}" for s in m["sources"].values() for g in s.get("generations", ())} | {m.get("tags", "tags")}
        dead = [x.getPath() for pattern in ("gen=*", "tags*") for x in fs.globStatus(self._path(pattern)) or [] if x.getPath().getName() not in live]
        return sum(bool(fs.delete(p, True)) for p in dead)

    def tags(self) -> DataFrame:
        fs = self._fs()
        folder = self.manifest().get("tags", "tags")
        if not fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], "uri string, tag string, origin string, created_at timestamp_ntz, deleted boolean, version bigint").select("uri", "tag", "origin", "created_at")
        log = self.spark.read.parquet(f"{self.root}/{folder}")
        latest = log.groupBy("uri", "tag").agg(F.max_by(F.struct("origin", "created_at", "deleted"), "version").alias("x"))
        return latest.where("not x.deleted").select("uri", "tag", "x.origin", "x.created_at")

    def _log_tags(self, rows: DataFrame, deleted: bool, now: datetime) -> int:
        n = rows.count()
        if n:
            # Of an addition and a removal at one time the removal is the later.
            version = 2 * int(now.timestamp() * 1e6) + deleted
            rows.select("uri", "tag", F.lit("manual").alias("origin"), F.lit(now).cast("timestamp_ntz").alias("created_at"), F.lit(deleted).alias("deleted"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{self.root}/{self.manifest().get('tags', 'tags')}")
        return n

    def _compacted_tags(self, manifest: dict) -> dict:
        """The manifest with a log of tags of few files: the newest row of each tag, written anew if there are too many."""
        folder = manifest.get("tags", "tags")
        found = self._fs().globStatus(self._path(folder, "part-*")) or []
        if len(found) <= MAX_TAG_FILES:
            return manifest
        new = f"tags-{manifest['generation']}"
        log = self.spark.read.parquet(f"{self.root}/{folder}")
        newest = log.groupBy("uri", "tag").agg(F.max_by(F.struct("origin", "created_at", "deleted", "version"), "version").alias("x"))
        newest.select("uri", "tag", "x.*").write.mode("overwrite").parquet(f"{self.root}/{new}")
        return dict(manifest, tags=new)

    def add_tags(self, wanted: DataFrame, now: datetime) -> int:
        """Adds (``uri, tag``) rows; returns how many are new."""
        return self._log_tags(incremental.tags_added(self.tags(), wanted), False, now)

    def remove_tags(self, gone: DataFrame, now: datetime) -> int:
        have = self.tags()
        left = incremental.tags_removed(have, gone)
        return self._log_tags(have.join(left.select("uri", "tag"), ["uri", "tag"], "left_anti"), True, now)

    # Refresh.

    def refresh(
        self, sources: list[SessionSource], now: datetime, config: EngineConfig = EngineConfig(), embedder: Embedder | None = None, named: list[str] | None = None,
        scope: SessionFilter | None = None, force: bool = False, backfill: bool = False, prune: bool = True,
    ) -> RefreshReport:
        """Brings the index up to its sources.

        A source's cursor is taken before its listing and kept only if the listing was whole and unscoped.  Sessions
        whose hash the index has are left alone, unless forced; a backfill also writes those that have something to embed
        and no vector.  A session that can't be read is left as the index has it.  A forced change of the model drops the
        vectors of every source, named or not.  The time of the refresh is noted even if one fails.
        """
        m = self.manifest()
        report = RefreshReport(generation=m["generation"] + 1)
        new = dict(m, generation=report.generation, sources={k: dict(s) for k, s in m["sources"].items()}, last_refresh=now.isoformat())
        if embedder is not None and check_model(m["embedding_model"], embedder.name, force):
            for s in new["sources"].values():
                s["vectors_from"] = report.generation
        if embedder is not None:
            new["embedding_model"] = embedder.name
        try:
            for source in sources:
                state, why = new["sources"].get(source.source_id, {}), self._left_out(source.source_id, config, named)
                one = SourceReport(source.source_id, skipped=why)
                report.sources.append(one)
                if why is None:
                    new["sources"][source.source_id] = self._refresh_source(source, state, one, new, config.chunk, embedder, scope, force, backfill, prune)
        except Exception as e:
            self._swap(dict(m, last_refresh=now.isoformat()))
            if isinstance(e, EngineError):
                raise
            raise EngineError(f"the refresh failed: {e}") from e
        self._swap(self._compacted_tags(new))
        return report

    @staticmethod
    def _left_out(source_id: str, config: EngineConfig, named: list[str] | None) -> str | None:
        """Why a source is not indexed: exclusion beats being named, being named beats the default."""
        if source_id in config.disabled_sources:
            return "disabled"
        if named is not None:
            return None if source_id.lower() in (n.lower() for n in named) else "not named"
        return "not indexed by default" if source_id in config.not_indexed_by_default else None

    def _refresh_source(self, source, state, report, manifest, policy: ChunkPolicy, embedder, scope, force, backfill, prune) -> dict:
        cursor = source.change_cursor()
        old = {t: self._source_table(t, source.source_id, state) for t in TABLES}
        everything = source.sessions()
        known = state.get("cursor")
        live = everything if force or backfill or known is None else source.changed_since(datetime.fromisoformat(known))
        if scope is not None:
            live = live.where(predicate(scope))
        bad = source.unreadable()
        if bad is not None:
            bad = bad.select("uri").distinct().persist()
            report.failed = bad.count()
            report.complete = not report.failed
            live = live.join(bad, "uri", "left_anti")
        if old["session"] is None:
            todo = live
        else:
            todo = incremental.changed(live, old["session"], force)
            if backfill:
                bare = old["chunk"].where(embeddable(F.col("role"), F.col("text"))) if old["chunk"] is not None else live.where("false")
                have = old["session_embedding"] if old["session_embedding"] is not None else live.where("false")
                wanted = todo.select("uri").union(incremental.without_vectors(live, bare, have).select("uri")).distinct()
                todo = live.join(wanted, "uri", "left_semi")
        gone = incremental.vanished(old["session"].select("uri"), source.ids()) if prune and old["session"] is not None else None
        if gone is not None and bad is not None:
            gone = gone.join(bad, "uri", "left_anti")
        todo = todo.persist()
        try:
            report.written = todo.count()
            report.pruned = gone.count() if gone is not None else 0
            report.unchanged = (old["session"].count() if old["session"] is not None else 0) - report.pruned
            kept = dict(state, last_indexed=manifest["last_refresh"])
            kept.setdefault("generations", [])
            if report.written or report.pruned:
                whole = len(kept["generations"]) >= MAX_DELTAS
                self._write(source, todo, report.written, gone, old, manifest["generation"], policy, embedder, whole)
                kept["generations"] = ([] if whole else kept["generations"]) + [manifest["generation"]]
                kept["sessions"] = self._source_table("session", source.source_id, kept).count()
                chunk = self._source_table("chunk", source.source_id, kept)
                n = chunk.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).first() if chunk is not None else None
                kept["chunks"], kept["tokens"] = (n.n, n.tokens or 0) if n else (0, 0)
            if report.complete and scope is None and cursor is not None:
                kept["cursor"] = cursor.isoformat()
            return kept
        finally:
            todo.unpersist()
            if bad is not None:
                bad.unpersist()

    def _write(self, source, todo, n_todo, gone, old, generation, policy, embedder, whole: bool) -> None:
        """A generation of what changed, or of the ``whole`` source."""
        turns = source.turns()
        if n_todo <= FEW_SESSIONS:
            # More are told apart where their turns meet, so that texts are not sent for a join.
            turns = turns.join(F.broadcast(todo.select("uri")), "uri", "left_semi")
        # Cut once: passages, postings and vectors all come from what is written here.
        chunk, loose = fetch.written(lexical.tokenized(chunking.chunks(todo, turns, policy)))
        new = {"session": todo.drop("source_id"), "chunk": chunk, "posting": lexical.postings(chunk)}
        files = source.files()
        if files is not None:
            new["session_file"] = files.join(todo.select("uri"), "uri", "left_semi").dropDuplicates(["uri", "path"])
        if embedder is not None:
            vectors = embedder.embed(chunk.where(embeddable(F.col("role"), F.col("text")) & F.col("is_embeddable")).select("uri", "ordinal", "text"))
            new["chunk_embedding"] = vectors
            new["session_embedding"] = centroids(vectors, "uri")
        touched = todo.select("uri").union(gone if gone is not None else todo.select("uri").where("false")).distinct()
        where = lambda name: f"{self.root}/gen={generation}/{name}/source_id={source.source_id}"
        for name in TABLES:
            rows = new.get(name)
            if whole and old[name] is not None:
                left = old[name].join(touched, "uri", "left_anti")
                rows = left if rows is None else left.unionByName(rows, allowMissingColumns=True)
            if rows is not None:
                if name == "posting":
                    lexical.write_by_term(rows, where(name))
                elif name == "chunk":
                    fetch.write_clustered(rows, where(name), "uri", "ordinal")
                else:
                    rows.write.mode("overwrite").parquet(where(name))
        scratch.delete(self.spark, loose)
        if not whole and old["session"] is not None:
            touched.write.mode("overwrite").parquet(where("gone"))
        chunk, vectors, gone_ = (self._written(n, source.source_id, generation) for n in ("chunk", "session_embedding", "gone"))
        can = embeddable(F.col("role"), F.col("text"))
        sketches.summary(chunk, vectors, gone_, can).coalesce(1).write.mode("overwrite").parquet(where("sketch"))

    def stale(self, now: datetime, config: EngineConfig) -> bool:
        """Whether a search should top the index up first: the cooldown has passed."""
        last = self.manifest()["last_refresh"]
        return last is None or (now - datetime.fromisoformat(last)).total_seconds() >= config.refresh_cooldown_seconds

    def require_model(self, embedder: Embedder | None) -> None:
        stored = self.manifest()["embedding_model"]
        if embedder is not None and stored and stored != embedder.name:
            raise UsageError(f"the index has vectors of {stored!r}, not of {embedder.name!r}")
