"""Substring deduplication by super-k-mer partitioning.

A window is 50 consecutive words.  Its minimiser is the smallest hash among its runs of ``MINIMISER`` words, so
equal windows have equal minimisers wherever they stand.  Consecutive windows that share a minimiser travel
as one packed string of words to the bucket of that minimiser; there windows are cut from the strings,
sorted, and each group of equal windows gets the smallest doc_id it occurs in.  Every window of a larger
doc_id is then a repeat.

Groups of copies: strings that a task meets again are not sent.  The smallest doc_id of a string within the task
is witness enough that the others' windows are repeats; it alone goes to the bucket, so a passage that a third
of all rows share arrives once per task.  A minimiser that one document alone has is dropped unsorted.

A minimiser that turns up in ever new contexts would fill one bucket with strings.  Such hot minimisers, by a share of
the documents or by the bytes of their bucket, are found first, on one document in 64; their windows go one by one to the bucket of their own digest, again without those that a
task has met.  It changes where windows meet, not which are equal.

Strings go in compressed packets per bucket.  Windows are sorted by 128-bit digests, and equal digests are
compared as strings before they count; of hot minimisers' windows digests of 192 bits stand for the words.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 50
MINIMISER = 4
#: Text bytes a task gathers before it sends packets: bounds its memory and the strings it remembers.
FLUSH_BYTES = 24 << 20
#: Bytes of input per bucket partition.
PARTITION_BYTES = 6 << 20
#: One document in so many is looked at for hot minimisers: those with new strings in more than this share of them, or
#: whose bucket would hold more than so many bytes of strings, however large the corpus is.
HOT_BYTES = 256 << 20
HOT_SAMPLE = 64
HOT_SHARE = 1 / 256
HOT_LEAST = 64
_HEAD = struct.Struct("<qqQIII")  # doc_id, text hash, minimiser, first window, windows, bytes of the string
#: A window alone: doc_id, text hash, place, whether it is known to be a repeat, digest.
_ALONE = struct.Struct("<qqI?24s")
_SEED = 42


def _digest(window: bytes) -> bytes:
    from xxhash import xxh3_128_digest, xxh64_digest

    return xxh3_128_digest(window) + xxh64_digest(window, _SEED)


def word_hashes(words: list[bytes], cache: dict[bytes, int]):
    import numpy as np
    from xxhash import xxh64_intdigest

    new = set(words).difference(cache)
    if new:
        if len(cache) + len(new) > 300_000:
            cache.clear()
            new = set(words)
        for w in new:
            cache[w] = xxh64_intdigest(w)
    return np.array([cache[w] for w in words], np.uint64)


def minimisers(hashes, window: int = WINDOW, size: int = MINIMISER):
    """The minimiser of each window of word hashes."""
    import numpy as np

    size = min(size, window)
    mul = np.uint64(0x9E3779B97F4A7C15)
    n = len(hashes) - size + 1
    grams = hashes[:n].copy()
    for k in range(1, size):
        grams = grams * mul + hashes[k : k + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    width = window - size + 1  # minimum over this many grams, by doubling
    low, have = grams, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def super_kmers(hashes, window: int = WINDOW, size: int = MINIMISER):
    """(first window, windows, minimiser) of the runs of windows that share a minimiser."""
    import numpy as np

    if len(hashes) < window:
        return [], [], []
    low = minimisers(hashes, window, size)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return first.tolist(), np.diff(np.r_[first, len(low)]).tolist(), low[first].tolist()


class Sender:
    """Gathers a task's super-k-mers into packets per bucket partition."""

    def __init__(self, parts: int, window: int, size: int, hot: frozenset[int] = frozenset()):
        self.parts, self.window, self.size, self.hot = parts, window, size, hot
        self.cache: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.strings: dict[bytes, list] = {}
        self.windows: dict[bytes, list] = {}
        self.held = 0

    def add(self, doc_id: int, text_hash: int, words: list[bytes]) -> None:
        if len(words) < self.window:
            return
        flat = b" ".join(words)
        at = [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        strings, grow = self.strings, self.window - 1
        for first, n, low in zip(*super_kmers(word_hashes(words, self.cache), self.window, self.size)):
            if low in self.hot:
                for k in range(first, first + n):
                    self.windows.setdefault(_digest(flat[at[k] : at[k + self.window] - 1]), []).append((doc_id, text_hash, k))
                continue
            s = flat[at[first] : at[first + n + grow] - 1]
            got = strings.get(s)
            if got is None:
                strings[s] = [low, n, (doc_id, text_hash, first)]
            else:
                got.append((doc_id, text_hash, first))
        self.held += len(flat)

    def packets(self):
        """(partition, packet) pairs: strings of their smallest doc_id, and the repeats already known."""
        import zstandard

        out: dict[int, list[bytes]] = {}
        for s, (low, n, *places) in self.strings.items():
            to = out.setdefault(low % self.parts, [])
            least = min(p[0] for p in places) if len(places) > 1 else places[0][0]
            for doc, text_hash, first in places:
                if doc == least:
                    to += (_HEAD.pack(doc, text_hash, low, first, n, len(s)), s)
                else:
                    to.append(_HEAD.pack(doc, text_hash, low, first, n, 0))
        packer = zstandard.ZstdCompressor(level=1)
        for part, bits in out.items():
            yield part, False, packer.compress(b"".join(bits))
        alone: dict[int, list[bytes]] = {}
        for d, places in self.windows.items():
            to, least = alone.setdefault(int.from_bytes(d[:8], "little") % self.parts, []), min(p[0] for p in places)
            to += [_ALONE.pack(doc, text_hash, place, doc != least, d) for doc, text_hash, place in places]
        for part, bits in alone.items():
            yield part, True, packer.compress(b"".join(bits))
        self._reset()


def unpack(packets):
    """Records of packets of strings: the fields of the head, then the string (empty: known to be a repeat)."""
    import zstandard

    reader = zstandard.ZstdDecompressor()
    for packet in packets:
        raw, at = reader.decompress(packet), 0
        while at < len(raw):
            head = _HEAD.unpack_from(raw, at)
            at += _HEAD.size
            yield *head[:5], raw[at : at + head[5]]
            at += head[5]


def _ends(s: bytes):
    """Offsets of the words of a packed string, and past its end."""
    import numpy as np

    return np.concatenate([[0], np.flatnonzero(np.frombuffer(s, np.uint8) == 32) + 1, [len(s) + 1]])


def repeats(records: list[tuple], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(doc_id, text hash, first word, end word) that windows of larger doc_ids cover, for one minimiser's strings."""
    import numpy as np
    from xxhash import xxh3_128_digest

    keys, owner, place = [], [], []
    offsets = []
    for k, (_, _, _, _, n, s) in enumerate(records):
        at = _ends(s)
        offsets.append(at)
        a, b = at[:n].tolist(), (at[window : window + n] - 1).tolist()
        keys += [xxh3_128_digest(s[x:y]) for x, y in zip(a, b)]
        owner += [k] * n
        place += range(n)
    digest = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    owner, place = np.array(owner), np.array(place)
    doc = np.array([r[0] for r in records], np.int64)[owner]
    order = np.lexsort((place, owner, doc, digest[:, 1], digest[:, 0]))
    d = digest[order]
    fresh = np.r_[True, (d[1:] != d[:-1]).any(axis=1)]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    later = np.flatnonzero(doc[order] > doc[order[head]])

    def words(i):
        k, p = owner[i], place[i]
        return records[k][5][offsets[k][p] : offsets[k][p + window] - 1]

    hit = [order[i] for i in later.tolist() if words(order[i]) == words(order[head[i]])]
    out = []
    for i in sorted(hit, key=lambda i: (owner[i], place[i])):
        k, p = int(owner[i]), int(place[i])
        doc_id, text_hash, _, first = records[k][:4]
        a = first + p
        if out and out[-1][4] == k and a <= out[-1][3]:
            out[-1][3] = a + window
        else:
            out.append([doc_id, text_hash, a, a + window, k])
    return [tuple(x[:4]) for x in out]


def lone_repeats(packets, window: int = WINDOW):
    """(doc_id, text hash, first word, end word) arrays of spans of windows that came alone and that a smaller doc_id has."""
    import numpy as np
    import zstandard

    reader = zstandard.ZstdDecompressor()
    kind = np.dtype([("doc", "<i8"), ("text", "<i8"), ("place", "<u4"), ("known", "?"), ("a", "<u8"), ("b", "<u8"), ("c", "<u8")])
    rows = np.concatenate([np.frombuffer(reader.decompress(p), kind) for p in packets])
    rows = rows[np.lexsort((rows["doc"], rows["c"], rows["b"], rows["a"]))]
    fresh = np.r_[True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]) | (rows["c"][1:] != rows["c"][:-1])]
    least = rows["doc"][np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
    rows = rows[rows["known"] | (rows["doc"] > least)]
    doc, text, place = (rows[c] for c in ("doc", "text", "place"))
    order = np.lexsort((place, text, doc))
    doc, text, place = doc[order], text[order], place[order].astype(np.int64)
    # Windows that overlap or touch are one span.
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (place[1:] > place[:-1] + window)]) if len(doc) else np.zeros(0, int)
    last = np.r_[head[1:], len(doc)] - 1
    return doc[head], text[head], place[head].astype(np.int32), (place[last] + window).astype(np.int32)


def hot_minimisers(rows: DataFrame, window: int, size: int, sample: int, share: float = HOT_SHARE, most: int = HOT_BYTES) -> frozenset[int]:
    """Minimisers with new strings in more than a ``share`` of one document in ``sample``, or with ``most`` bytes of strings in all.

    Of the former there are a few for each document by ``1 / share``, of the latter as many as ``most`` goes into all strings.
    """
    some = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(sample)) == 0)

    def run(batches):
        import pyarrow as pa

        cache: dict[bytes, int] = {}
        for batch in batches:
            lows, strings, sizes = [], [], []
            for text in batch.column(2):
                words = text.as_py().encode().split()
                for first, n, low in zip(*super_kmers(word_hashes(words, cache), window, size)) if len(words) >= window else ():
                    lows.append(low)
                    string = b" ".join(words[first : first + n + window - 1])
                    strings.append(_digest(string)[:8])
                    sizes.append(len(string))
            low = [x - (1 << 64) if x >> 63 else x for x in lows]
            yield pa.RecordBatch.from_arrays([pa.array([None] + low, pa.int64()), pa.array([None] + strings, pa.binary()), pa.array([None] + sizes, pa.int64()), pa.array([batch.num_rows] + [0] * len(low), pa.int64())], names=["low", "string", "size", "docs"])

    seen = common.staged(some.mapInArrow(run, "low long, string binary, size long, docs long"))
    docs = seen.agg(F.sum("docs").alias("n")).first().n or 0
    each = seen.where("low is not null").groupBy("low", "string").agg(F.max("size").alias("size"))
    many = each.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).where((F.col("n") > max(HOT_LEAST, share * docs)) | (F.col("size") * sample > most))
    return frozenset(r.low % (1 << 64) for r in many.select("low").collect())


def repeated_spans(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER, partition_bytes: int = PARTITION_BYTES, sample: int = HOT_SAMPLE, most: int = HOT_BYTES) -> DataFrame:
    """``doc_id, text_hash, first, end``: word ranges of ``docs`` to remove, may overlap.

    ``text_hash`` is Spark's xxhash64 of the text.  Rows without doc_id or text have no windows.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-common.text_bytes(docs) // partition_bytes))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    hot = hot_minimisers(rows, window, size, sample, most=most)

    def send(batches):
        import pyarrow as pa

        sender = Sender(parts, window, size, hot)
        schema = pa.schema([("part", pa.int32()), ("alone", pa.bool_()), ("packet", pa.binary())])

        def flush():
            got = list(sender.packets())
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            doc, text_hash = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2)
            for k in range(batch.num_rows):
                sender.add(doc[k], text_hash[k], texts[k].as_py().encode().split())
                if sender.held >= FLUSH_BYTES:
                    yield flush()
        yield flush()

    def count(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

        def batch_of(found):
            cols = list(zip(*found)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        found, groups, lone = [], {}, []
        for batch in batches:
            alone, packets_ = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lone += [p for p, a in zip(packets_, alone) if a]
            for doc, text_hash, low, first, n, s in unpack(p for p, a in zip(packets_, alone) if not a):
                if s:
                    groups.setdefault(low, []).append((doc, text_hash, low, first, n, s))
                else:
                    found.append((doc, text_hash, first, first + n + window - 1))
            if len(found) > 100_000:
                yield batch_of(found)
                found = []
        for records in groups.values():
            if len(records) > 1 and len({r[0] for r in records}) > 1:
                found += repeats(records, window)
                if len(found) > 100_000:
                    yield batch_of(found)
                    found = []
        yield batch_of(found)
        if lone:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in lone_repeats(lone, window)], schema=schema)

    packets = rows.mapInArrow(send, "part int, alone boolean, packet binary").repartitionById(parts, F.col("part"))
    return packets.mapInArrow(count, "doc_id long, text_hash long, first int, end int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER, sample: int = HOT_SAMPLE, most: int = HOT_BYTES) -> DataFrame:
    """``doc_id, text, kept, n_words, n_removed``: ``kept`` is the words that stay, joined by a space.

    Rows without doc_id own no passage and keep all their words; a null text has no words.  Rows that share a
    doc_id don't count as repeats of one another, and repeated rows come back as often as they came.  Other
    columns are not read.
    """
    spans = (
        common.staged(repeated_spans(docs, window, size, sample=sample, most=most))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("first", "end")).alias("spans"))
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "spans")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(spans, (rows.doc_id == spans.__getattr__("__id")) & (F.xxhash64(rows.text) == spans.__getattr__("__hash")), "left").select("doc_id", "text", "spans")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                kept, n_words, n_removed = [], [], []
                for text, cut in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = text.encode().split()
                    n = len(words)
                    if cut:
                        stay = np.ones(n + 1, bool)
                        for s in cut:
                            stay[s["first"] : s["end"]] = False
                        words = [words[i] for i in np.flatnonzero(stay[:n]).tolist()]
                    kept.append(b" ".join(words))
                    n_words.append(n)
                    n_removed.append(n - len(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], schema=schema)

    return joined.mapInArrow(run, "doc_id long, kept binary, n_words long, n_removed long").withColumn("kept", F.col("kept").cast("string"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document, as the contract's digest."""
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
