"""WARC archives: monolithic gzip files normalised to one gzip member per record, with an offset index.

A monolithic archive is one gzip stream over all its records, so that nothing in it can be reached without
inflating all before.  ``normalise`` inflates such a stream once, from front to back with bounded buffers, takes the
records from it by their Content-Length, writes each as its own gzip member and notes offset and length of the
member in a sidecar index, so that a record can be read alone later.

Files are written under a name of the attempt and renamed when whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PIECE = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date: archives of the same pages are the same bytes.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record of an HTTP response; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated:
    """The inflated bytes of a gzip stream of any number of members, read forwards."""

    def __init__(self, f):
        self.f, self.left, self.raw = f, bytearray(), b""
        self.z, self.fresh = zlib.decompressobj(31), True

    def _more(self) -> bool:
        while True:
            raw = self.raw or self.f.read(PIECE)
            self.raw = b""
            if not raw:
                if not self.fresh and not self.z.eof:
                    raise EOFError("the gzip stream is torn")
                return False
            if self.z.eof:
                raw = raw.lstrip(b"\0")
                if not raw:
                    continue
                self.z = zlib.decompressobj(31)
            self.fresh = False
            got = self.z.decompress(raw, PIECE)
            self.raw = self.z.unconsumed_tail or self.z.unused_data
            if got:
                self.left += got
                return True

    def line(self) -> bytes:
        at = self.left.find(b"\n")
        while at < 0:
            was = len(self.left)
            if not self._more():
                break
            at = self.left.find(b"\n", was)
        end = at + 1 if at >= 0 else len(self.left)
        out = bytes(self.left[:end])
        del self.left[:end]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.left) < n:
            if not self._more():
                raise EOFError("a record is cut short")
        out = bytes(self.left[:n])
        del self.left[:n]
        return out


def records(f) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, header bytes, block) of each record of a gzip stream, one member or many."""
    src = Inflated(f)
    while True:
        line = src.line()
        while line and not line.strip():
            line = src.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head, fields = [line], {}
        while (line := src.line()).strip():
            head.append(line)
            if line[:1] in b" \t" and fields:
                fields[name] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        yield fields, b"".join(head) + b"\r\n", src.exactly(int(fields["content-length"]))


def normalise(source, out, index) -> tuple[int, int]:
    """Rewrites the records of ``source``, each as its own member, to ``out``, and a JSON line each to ``index``.

    Returns records and bytes written.
    """
    at = n = 0
    for fields, head, block in records(source):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
        out.write(member)
        index.write((json.dumps({"id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"), "offset": at, "length": len(member)}) + "\n").encode())
        at += len(member)
        n += 1
    return n, at


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, revisit``: which record of equal payloads has the payload.

    Payloads are equal if their SHA-1 and their sizes are, as archives compare them.  Of equal ones of at least ``least`` bytes the page with the largest id is the response; tied rows
    are responses both.  A null id is smaller than any; a null html is empty.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    rows = rows.withColumn("size", F.length("payload"))
    groups = rows.groupBy("sha", "size").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "size", "top")
    joined = rows.join(groups, ["sha", "size"], "left")
    again = (F.length("payload") >= least) & F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    revisit = F.coalesce(again, F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))


MANIFEST = "archive string, index string, n_records long, n_bytes long, n_inflated long"


def write(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Writes the records of ``page_id, url, html`` rows below ``path``; returns a row per archive.

    Each task writes one monolithic archive, as crawlers do that compress a whole file, normalises it, and removes
    it.  Repeated rows are records of their own; other columns are not read; an empty table writes nothing.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = common.open_fs(path)
        fs.create_dir(root, recursive=True)
        # Names of this attempt: the manifest has those of attempts that ended well, and no file is renamed.
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        whole, parts, side = (f"{root}/{x}" for x in (f".{name}.gz", f"{name}.warc.gz", f"{name}.idx"))
        z, out, inflated = zlib.compressobj(1, zlib.DEFLATED, 31), None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, refers_to, revisit = (c[k].as_py() for c in batch.columns)
                if out is None:
                    out = fs.open_output_stream(whole, compression=None)
                raw = record(page_id, url, payload, payload_digest(payload), refers_to, revisit)
                inflated += len(raw)
                out.write(z.compress(raw))
        if out is None:
            return
        out.write(z.flush())
        out.close()
        with fs.open_input_stream(whole, compression=None) as src, fs.open_output_stream(parts, compression=None) as dst, fs.open_output_stream(side, compression=None) as idx:
            n, size = normalise(src, dst, idx)
        fs.delete_file(whole)
        row = {"archive": [f"{path}/{name}.warc.gz"], "index": [f"{path}/{name}.idx"], "n_records": [n], "n_bytes": [size], "n_inflated": [inflated]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("archive", pa.string()), ("index", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("n_inflated", pa.int64())]))

    return common.staged(planned(pages, least).mapInArrow(run, MANIFEST))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Records of archives by their indexes: each member is fetched and inflated alone.

    ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload`` (null for a revisit).
    """
    count = max(1, manifest.count())
    files = manifest.select("archive", "index").withColumn("k", F.row_number().over(_by_name())).repartitionById(count, (F.col("k") - 1).cast("int"))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

        def number(urn):
            tail = (urn or "").strip("<>").rpartition(":")[2]
            return int(tail) if tail.lstrip("-").isdigit() else None

        for batch in batches:
            for row in batch.to_pylist():
                fs, archive = common.open_fs(row["archive"])
                _, index = common.open_fs(row["index"])
                with fs.open_input_stream(index, compression=None) as f:
                    places = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(archive) as f:
                    found, held = [], 0
                    for p in places:
                        f.seek(p["offset"])
                        fields, _, block = next(records(io.BytesIO(f.read(p["length"]))))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and (len(payload) != size or payload_digest(payload) != fields["warc-payload-digest"].partition(":")[2]):
                            raise ValueError(f"a payload differs from its digest in {row['archive']} at {p['offset']}")
                        found.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], number(fields.get("warc-refers-to")), fields["warc-payload-digest"].partition(":")[2], size, None if revisit else payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)
                            found, held = [], 0
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)

    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _by_name():
    from pyspark.sql import Window

    return Window.orderBy("archive")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages and returns what the archives hold."""
    manifest = write(common.table(spark, sf_dir, "pages"), common.shared_dir(spark) + "/warc")
    return read(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
