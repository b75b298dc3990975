"""VS Code chat sessions: JSON documents and logs of changes to one."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SessionFilter
from ..functions.json import long_at, millis, text_at
from ..functions.paths import after_dot, after_slash, file_uri_path, is_under, session_uri
from ..functions.text import derive_title, preview
from ..schema import BLOCK
from .base import SessionSource, as_sessions

LARGEST_FILE = 64 << 20


def _child(node, key):
    if isinstance(node, dict):
        return node.get(key) if isinstance(key, str) else None
    if isinstance(node, list) and isinstance(key, int) and not isinstance(key, bool) and 0 <= key < len(node):
        return node[key]
    return None


def _put(node, key, value) -> None:
    if isinstance(node, dict) and isinstance(key, str):
        node[key] = value
    elif isinstance(node, list) and isinstance(key, int) and not isinstance(key, bool) and key >= 0:
        node.extend([None] * (key + 1 - len(node)))
        node[key] = value


def replay(log: str) -> dict | None:
    """The document that a log of changes leaves: snapshots, values set, items appended, up to the first torn line."""
    state = None
    for line in log.splitlines():
        if not line.strip():
            continue
        try:
            op = json.loads(line)
        except ValueError:
            break
        if not isinstance(op, dict):
            continue
        kind, path, value = op.get("kind"), op.get("k"), op.get("v")
        if kind == 0:
            state = value if isinstance(value, dict) else None
        elif kind in (1, 2) and state is not None and isinstance(path, list) and path:
            node = state
            for key, following in zip(path, path[1:]):
                below = _child(node, key)
                if below is None:
                    below = [] if isinstance(following, int) and not isinstance(following, bool) else {}
                    _put(node, key, below)
                node = below
            if kind == 1:
                _put(node, path[-1], value)
            elif isinstance(value, list):
                held = _child(node, path[-1])
                if isinstance(held, list):
                    held.extend(value)
                else:
                    _put(node, path[-1], list(value))
    return state


def _text(v) -> str | None:
    if isinstance(v, dict):
        v = v.get("value", v.get("text"))
    return v if isinstance(v, str) else None


def _path(v) -> str | None:
    """The path of a URI as text or in parts."""
    if isinstance(v, str):
        return v or None
    if isinstance(v, dict):
        p = v.get("fsPath") or v.get("path")
        if p and v.get("scheme") in (None, "file"):
            return p
        return f"{v['scheme']}://{v.get('authority', '')}{p}" if p else v.get("external")
    return None


def response_blocks(parts) -> tuple[list[dict], list[tuple[str, str]]]:
    """Blocks of a response, and (path, tool) of files it names.

    Neighbouring pieces of text are one block; parts that show nothing don't part them.
    """
    blocks, files, said = [], [], []

    def flush():
        text = "".join(said).strip()
        said.clear()
        if text:
            blocks.append({"kind": "text", "text": text})

    for p in parts if isinstance(parts, list) else []:
        if not isinstance(p, dict):
            continue
        kind = p.get("kind")
        if kind in (None, "markdownContent"):
            said.append(_text(p.get("value")) or "")
        elif kind == "thinking":
            text = _text(p.get("value")) or _text(p.get("text"))
            if text and text.strip():
                flush()
                blocks.append({"kind": "reasoning", "text": text})
        elif kind in ("toolInvocation", "toolInvocationSerialized"):
            flush()
            extra = p.get("toolSpecificData") if isinstance(p.get("toolSpecificData"), dict) else {}
            name = p.get("toolId") or "tool"
            if extra and _path(extra.get("uri")):
                files.append((_path(extra["uri"]), name))
            done = p.get("isComplete")
            blocks.append({"kind": "tool", "tool_name": name, "title": _text(p.get("invocationMessage")) or _text(p.get("pastTenseMessage")), "output": _text(p.get("resultDetails")) or (json.dumps(extra) if extra else None), "status": None if done is None else "completed" if done else "running", "call_id": p.get("toolCallId")})
        elif kind == "textEditGroup":
            if path := _path(p.get("uri")):
                files.append((path, "edit"))
                flush()
                blocks.append({"kind": "patch", "path": path})
        elif kind == "inlineReference":
            ref = p.get("inlineReference")
            path = _path(ref.get("uri")) if isinstance(ref, dict) and ref.get("uri") else _path(ref)
            if path:
                files.append((path, "reference"))
    flush()
    return blocks, files


def turns_of(document: dict) -> list[dict]:
    """Turns of a document: prompts and answers that hold something, numbered as they come."""
    out = []
    for r in document.get("requests") or []:
        if not isinstance(r, dict):
            continue
        message = r.get("message")
        prompt = _text(message)
        blocks, files = response_blocks(r.get("response"))
        for role, found in (("User", [{"kind": "text", "text": prompt}] if prompt and prompt.strip() else []), ("Assistant", blocks)):
            if found:
                named = [{"path": p, "tool": t} for p, t in files] if role == "Assistant" else []
                out.append({"turn_index": len(out), "role": role, "at": r.get("timestamp"), "model": r.get("modelId"), "agent": (r.get("agent") or {}).get("id") if isinstance(r.get("agent"), dict) else None, "blocks": found, "files": named})
    return out


#: Folders that are listed one by one; beyond, all are.
MOST_FOLDERS = 1000
_FIELDS = [f.name for f in BLOCK.fields]


class VsCode(SessionSource):
    """``<root>/<hash>/chatSessions/<id>.json`` or ``.jsonl``, and ``<root>/<hash>/workspace.json``."""

    source_id = "copilot-vscode"
    capabilities = ("tool_calls", "patches", "incremental", "file_tracking")

    def __init__(self, spark, location: str, include_empty: bool = False):
        super().__init__(spark, location)
        self.include_empty = include_empty

    def _files(self, since: datetime | None = None, name: str = "*", folders: list[str] | None = None) -> DataFrame:
        """``native_id, hash, modified, document``: each session file as one JSON document, null where it can't be read.

        Files that were not modified ``since`` a time, or are not of a session's ``name`` or in one of the ``folders``, are left out before they are opened.

        A log is walked in order, so each file is handled whole, in Arrow batches; files beyond the limit are left out.
        """
        files = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{name}.json*").text(self.location if folders is None else [os.path.join(self.location, x) for x in folders], wholetext=True)
        name = r"/([^/]+)/chatSessions/([^/]+)\.(jsonl?)$"
        path = F.col("_metadata.file_path")
        raw = files.where((F.col("_metadata.file_size") > 0) & (F.col("_metadata.file_size") <= LARGEST_FILE) & path.rlike(name))
        if since is not None:
            raw = raw.where(F.col("_metadata.file_modification_time") >= F.lit(since.replace(tzinfo=timezone.utc)))

        @F.pandas_udf("string")
        def whole(text, ending):
            def one(t, e):
                try:
                    doc = replay(t) if e == "jsonl" else json.loads(t)
                except ValueError:
                    doc = None
                return json.dumps(doc) if isinstance(doc, dict) else None

            return text.combine(ending, one)

        return raw.select(F.regexp_extract(path, name, 2).alias("native_id"), F.regexp_extract(path, name, 1).alias("hash"), F.col("_metadata.file_modification_time").alias("modified"), whole("value", F.regexp_extract(path, name, 3)).alias("document"))

    def documents(self, since: datetime | None = None, folders: list[str] | None = None) -> DataFrame:
        """``native_id, hash, modified, document``: each session file as one JSON document, those that hold none left out."""
        return self._files(since, folders=folders).where("document is not null")

    def sessions_for(self, f: SessionFilter) -> DataFrame:
        """First files by their times and folders by their workspaces, then what is left is opened."""
        if f.workspace_path is None and f.since is None:
            return self.sessions()
        folders = None
        if f.workspace_path is not None:
            # Folders with sessions, named by their workspace or else by themselves; no session is opened for that.
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(self.location)
            held = listed.select(F.regexp_extract("path", r"/([^/]+)/chatSessions/[^/]+\.jsonl?$", 1).alias("hash")).where("hash <> ''").distinct()
            named = held.join(self.workspaces(), "hash", "left").withColumn("workspace_path", F.coalesce("workspace_path", "hash"))
            admitted = named.where(is_under(F.col("workspace_path"), f.workspace_path, ignore_case=True)).select("hash").distinct()
            folders = [r.hash for r in admitted.limit(MOST_FOLDERS + 1).collect()]
            if not folders:
                return self.sessions().where("false")
            folders = folders if len(folders) <= MOST_FOLDERS else None
        return self._sessions(self.documents(f.since and f.since - timedelta(seconds=2), folders))

    def changed_since(self, cursor) -> DataFrame:
        """Newer sessions.  A session is no newer than its file, whose time may be a few seconds coarse."""
        if cursor is None:
            return self.sessions()
        return self._sessions(self.documents(cursor - timedelta(seconds=2))).where(F.col("updated_at") > F.lit(cursor))

    def unreadable(self) -> DataFrame:
        return self._files().where("document is null").select(session_uri(F.lit(self.source_id), F.col("native_id")).alias("uri"))

    def workspaces(self) -> DataFrame:
        files = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.json").text(self.location, wholetext=True)
        folder = file_uri_path(text_at(F.col("value"), "$.folder", "$.workspace"))
        return files.select(F.regexp_extract("_metadata.file_path", r"/([^/]+)/workspace\.json$", 1).alias("hash"), F.regexp_replace(folder, r"/[^/]+\.code-workspace$", "").alias("workspace_path"))

    def sessions(self) -> DataFrame:
        return self._sessions(self.documents())

    def _sessions(self, documents: DataFrame) -> DataFrame:
        d = F.col("document")
        requests = F.from_json(F.get_json_object(d, "$.requests"), "array<string>")
        n = F.coalesce(F.size(requests), F.lit(0))
        prompt = F.coalesce(F.get_json_object(F.get(requests, F.lit(0)), "$.message.text"), F.get_json_object(F.get(requests, F.lit(0)), "$.message"))
        models = F.filter(F.transform(requests, lambda r: after_slash(F.get_json_object(r, "$.modelId"))), lambda m: F.trim(m) != "")
        # The first of names that differ in case only.
        first = F.filter(models, lambda m, i: F.array_position(F.transform(models, lambda x: F.lower(x)), F.lower(m)) == i + 1)
        chosen = after_slash(text_at(d, "$.inputState.selectedModel.metadata.id", "$.inputState.selectedModel.identifier"))
        agents = F.filter(F.transform(requests, lambda r: after_dot(F.get_json_object(r, "$.agent.id"))), lambda a: a.isNotNull())
        last = F.array_max(F.transform(requests, lambda r: F.get_json_object(r, "$.timestamp").try_cast("bigint")))
        modified = F.unix_millis("modified")
        j = documents.join(self.workspaces(), "hash", "left").where((n > 0) | F.lit(self.include_empty))
        at = lambda *c: F.coalesce(*[millis(x) for x in c])
        custom = text_at(d, "$.customTitle")
        return as_sessions(
            j.select(
                session_uri(F.lit(self.source_id), F.col("native_id")).alias("uri"), F.lit(self.source_id).alias("source_id"), "native_id",
                F.when(F.trim(custom) != "", custom).otherwise(derive_title(prompt)).alias("title"), preview(prompt, 200).alias("preview"), F.coalesce("workspace_path", "hash").alias("workspace_path"),
                F.coalesce(F.get(agents, F.lit(0)), text_at(d, "$.inputState.mode.id")).alias("agent"), F.when(F.size(first) > 0, first).otherwise(F.array_compact(F.array(chosen))).alias("models"),
                at(long_at(d, "$.creationDate"), modified).alias("created_at"), at(long_at(d, "$.lastMessageDate"), last, modified).alias("updated_at"),
                F.size(F.filter(requests, lambda r: r.isNotNull())).alias("message_count"), F.lit(False).alias("is_archived"), F.concat_ws(":", modified.cast("string"), n.cast("string")).alias("content_hash"),
            )
        )

    def _walked(self, documents: DataFrame | None = None) -> DataFrame:
        kind = f"array<struct<turn_index:int,role:string,at:bigint,model:string,agent:string,blocks:{BLOCK.simpleString()},files:array<struct<path:string,tool:string>>>>".replace(BLOCK.simpleString(), f"array<{BLOCK.simpleString()}>")

        @F.pandas_udf(kind)
        def walk(documents):
            def one(text):
                out = turns_of(json.loads(text))
                for t in out:
                    t["at"] = int(t["at"]) if isinstance(t["at"], (int, float)) else None
                    t["blocks"] = [{f: b.get(f) for f in _FIELDS} for b in t["blocks"]]
                return out

            return documents.map(one)

        rows = self.documents() if documents is None else documents
        return rows.select(session_uri(F.lit(self.source_id), F.col("native_id")).alias("uri"), F.inline(walk("document")))

    def turns(self) -> DataFrame:
        return self._turns(self._walked())

    def turns_of(self, native_id: str) -> DataFrame:
        """Only files of the session's name are opened."""
        mine = self._files(name=re.sub(r"([\\*?\[\]{}])", r"\\\1", native_id)).where(F.col("native_id") == native_id)
        return self._turns(self._walked(mine.where("document is not null")))

    @staticmethod
    def _turns(walked: DataFrame) -> DataFrame:
        return walked.select("uri", "turn_index", "role", millis(F.col("at")).alias("timestamp"), after_slash(F.col("model")).alias("model"), after_dot(F.col("agent")).alias("agent"), "blocks")

    def files(self) -> DataFrame:
        from ..operators.transcripts import touched_files

        return touched_files(self._walked().select("uri", "turn_index", F.posexplode("files").alias("pos", "f")).select("uri", "turn_index", "pos", "f.path", "f.tool"))

    def references(self) -> DataFrame:
        """Content references of requests that point to the web."""
        d = F.from_json(F.get_json_object("document", "$.requests"), "array<string>")
        each = self.documents().select(session_uri(F.lit(self.source_id), F.col("native_id")).alias("uri"), F.posexplode(d).alias("turn_index", "r"))
        refs = each.select("uri", "turn_index", F.explode(F.from_json(F.get_json_object("r", "$.contentReferences"), "array<string>")).alias("c"))
        value = F.coalesce(text_at(F.col("c"), "$.reference.external"), text_at(F.col("c"), "$.reference"), text_at(F.col("c"), "$.uri"))
        return refs.select("uri", F.lit("url").alias("ref_type"), value.alias("ref_value"), "turn_index").where(F.lower("ref_value").startswith("http"))


def is_session_file(path: str) -> bool:
    return re.search(r"/chatSessions/[^/]+\.jsonl?$", path) is not None
