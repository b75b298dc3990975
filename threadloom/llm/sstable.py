"""Sorted-string-table shards of token ids, keyed by document id.

A file, all integers little-endian:

* blocks, each ``zlib`` of: entries, then the restart offsets (uint32 each), then their number (uint32).  An
  entry is ``shared, unshared, value length`` (varints), the key's unshared bytes, the value.  Every 16th
  entry is a restart: it shares nothing, so a block can be searched by bisection.
* the block index: per block ``last key length (uint16), last key, offset (uint64), size (uint32)``.
* the Bloom filter: ``number of hashes (uint8), bits (uint64)``, then the bits.
* a footer of fixed size: index offset, index size, filter offset, filter size, entries, tokens (uint64
  each), the smallest and the largest key's offsets are in the index; then 8 magic bytes.

A key is the id as a big-endian number with its sign bit flipped (byte order is number order) and a rank
(uint32) among rows of one id; a null id is the empty string before the rank, first of all.  A value is the width of an id in bytes (2 or
4), then the ids.

Each attempt of a task writes one key range to a file with a name of its own, and the manifest has the files of attempts
that ended well.  So nothing is renamed, which not every store can do over a file that is there, and what a lost
or repeated attempt leaves is never read.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

MAGIC = b"TLSST\x00\x01\n"
FOOTER = struct.Struct("<6Q8s")
RESTART = 16
BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7
END_ID = 1
#: Bytes of text for each file.
SHARD_BYTES = 64 << 20

MANIFEST = "part long, path string, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None, rank: int = 0) -> bytes:
    """Key bytes whose order is the order of ids, null first."""
    head = b"" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))
    return head + struct.pack(">I", rank)


def id_of(key: bytes) -> int | None:
    return None if len(key) == 4 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _probes(key: bytes, bits: int, hashes: int) -> Iterator[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    step = (h >> 33) | 1
    for i in range(hashes):
        yield (h + i * step) % bits


class Writer:
    """Writes sorted entries to a binary file."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers."""
        import numpy as np

        a = np.frombuffer(ids, "<u4")
        value = b"\x02" + a.astype("<u2").tobytes() if not len(a) or int(a.max()) < 1 << 16 else b"\x04" + ids
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = _shared(self.last, key)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.n, self.last = self.n + 1, key
        self.keys.append(key)
        self.tokens += len(a)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.n:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = zlib.compress(body, 1)
        self.index.append((self.last, self.at, len(packed)))
        self._put(packed)
        self._new_block()

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index))
        bloom_at = self.at
        bits = max(64, BLOOM_BITS * len(self.keys))
        field = bytearray(-(-bits // 8))
        for k in self.keys:
            for i in _probes(_prefix(k), bits, BLOOM_HASHES):
                field[i >> 3] |= 1 << (i & 7)
        self._put(struct.pack("<BQ", BLOOM_HASHES, bits) + bytes(field))
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, len(self.keys), self.tokens, MAGIC))


def _prefix(key: bytes) -> bytes:
    """The key without its rank: what the Bloom filter holds and a lookup asks for."""
    return key[:-4]


class Reader:
    """Reads a file that offers ``seek`` and ``read``."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - FOOTER.size)
        self.index_at, index_n, bloom_at, bloom_n, self.entries, self.tokens, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string-table shard, or a torn one")
        f.seek(self.index_at)
        raw, at = f.read(index_n), 0
        self.lasts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.lasts.append(raw[at + 2 : at + 2 + n])
            self.places.append(struct.unpack_from("<QI", raw, at + 2 + n))
            at += 2 + n + 12
        f.seek(bloom_at)
        raw = f.read(bloom_n)
        self.hashes, self.bits = struct.unpack_from("<BQ", raw, 0)
        self.field = raw[9:]

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.field[i >> 3] >> (i & 7) & 1 for i in _probes(_prefix(key_of(doc_id)), self.bits, self.hashes))

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        at, size = self.places[k]
        self.f.seek(at)
        body = zlib.decompress(self.f.read(size))
        (n,) = struct.unpack_from("<I", body, len(body) - 4)
        end = len(body) - 4 - 4 * n
        return body[:end], list(struct.unpack_from(f"<{n}I", body, end))

    @staticmethod
    def _entry(body: bytes, at: int, before: bytes) -> tuple[bytes, bytes, int]:
        shared, at = _read_varint(body, at)
        unshared, at = _read_varint(body, at)
        size, at = _read_varint(body, at)
        key = before[:shared] + body[at : at + unshared]
        at += unshared
        return key, body[at : at + size], at + size

    @staticmethod
    def ids(value: bytes) -> bytes:
        """A value's ids as little-endian unsigned 32-bit integers."""
        import numpy as np

        return np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes() if value[0] == 2 else value[1:]

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """All (key, ids) in order of keys."""
        for k in range(len(self.places)):
            body, _ = self._block(k)
            at, key = 0, b""
            while at < len(body):
                key, value, at = self._entry(body, at, key)
                yield key, self.ids(value)

    def get(self, doc_id: int | None, rank: int = 0) -> bytes | None:
        """A document's ids by Bloom filter, bisection of the index, then of the block's restarts."""
        if not self.may_hold(doc_id):
            return None
        want = key_of(doc_id, rank)
        k = bisect.bisect_left(self.lasts, want)
        if k == len(self.lasts):
            return None
        body, restarts = self._block(k)
        low, high = 0, len(restarts)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._entry(body, restarts[mid], b"")[0] <= want else (low, mid)
        at, key = restarts[low], b""
        while at < len(body):
            key, value, at = self._entry(body, at, key)
            if key >= want:
                return self.ids(value) if key == want else None
        return None


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes ``doc_id, text`` rows and writes one shard per range of ids below ``path``; returns the manifest.

    Null texts are empty; each text gets ``end_id`` last.  Null ids come first; rows of one id follow one
    another in the order of their texts.  Other columns are not read.  An empty table writes no shard.
    The ranges come from quantiles of the ids alone, a read of one column.  Rows of one id, or without any, are in one range,
    as the order asks; a task writes them as they come and holds none of them.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = common.text_bytes(docs)
    n = max(1, -(-size // shard_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 << 20))))
    cuts: list[int] = []
    if n > 1:
        got = d.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first().q
        cuts = sorted(set(got or []))
    bounds = F.lit(cuts).cast("array<long>")
    part = F.when(F.col("doc_id").isNull() | F.lit(not cuts), 0).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))))
    dealt = d.withColumn("part", part.cast("int")).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("doc_id", "text")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        enc, writer, out = tokens.encoder(vocabulary), None, None
        end = end_id.to_bytes(4, "little")
        last, rank = object(), 0
        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            for lo in range(0, batch.num_rows, 2048):
                got = enc.encode(batch.column(1).slice(lo, 2048))
                for j, ids in enumerate(got):
                    if writer is None:
                        k = TaskContext.get().partitionId()
                        fs, root = common.open_fs(path)
                        fs.create_dir(root, recursive=True)
                        name = f"ids-{k:06d}-{uuid.uuid4().hex}.sst"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        writer = Writer(out)
                    doc = docs_[lo + j]
                    rank = rank + 1 if doc == last else 0
                    last = doc
                    writer.add(key_of(doc, rank), ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [k], "path": [f"{path}/{name}"], "n_docs": [writer.keys.__len__()], "n_tokens": [writer.tokens], "n_bytes": [writer.at]}, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return common.staged(dealt.mapInArrow(run, MANIFEST))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All documents of the shards: ``doc_id, start, n_tokens, ids``.

    ``start`` counts the ids of all documents before a document: those of earlier files by the manifest, a row per
    file, and those before it in its own file.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "path", "n_bytes", before.alias("base"))
    count = max(1, manifest.count())
    files = files.repartitionById(count, F.pmod(F.col("part"), F.lit(count)).cast("int"))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, p = common.open_fs(row["path"])
                with fs.open_input_file(p) as f:
                    reader, start = Reader(f, row["n_bytes"]), row["base"]
                    cols, held = ([], [], [], []), 0
                    for key, ids in reader.scan():
                        for c, v in zip(cols, (id_of(key), start, len(ids) // 4, ids)):
                            c.append(v)
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                            cols, held = ([], [], [], []), 0
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and returns what the shards hold, with the contract's digest."""
    manifest = write(common.table(spark, sf_dir, "documents"), common.shared_dir(spark) + "/sst")
    return read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
