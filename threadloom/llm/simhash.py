"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are compared within buckets.  Cut a fingerprint into bands: two that differ in at most three bits
agree in all bands but three, so with a key for each choice of so many bands every link is met in some bucket.
Four bands make 4 keys of 16 bits, five 10 keys of 25, six 20 keys of 32; more fingerprints take more bands, so that
buckets stay small, and any number finds the same links.  Within a bucket fingerprints are stored vertically: word ``p`` of a block holds bit ``p`` of its 64
members.  A fingerprint meets 64 members at once; carry-save counters of two bits and a sticky overflow add
the 64 difference planes, and a block is abandoned once all its members are beyond the radius.

Equal fingerprints are one node before anything is compared, so groups of exact copies cost nothing.  A bucket
of more than ``BLOCK`` nodes is compared block against block in tasks of their own.  A task returns a forest of
the links it found, never all pairs; components over all forests follow from alternating stars, whose rounds
are written to the shared folder.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, overlap
from .components import connected, merge

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Distinct fingerprints that a bucket may hold on average before more bands are taken.
BUCKET = 64
#: Nodes of a bucket that one task compares at once.
BLOCK = 8192
#: Sorted rows that a task gathers before it compares the whole groups among them.
TASK_ROWS = 1 << 17
#: Queries against blocks in flight within a task.
CHUNK = 1 << 16


def fingerprint_texts(texts, shingle: int = SHINGLE, seed: int = SEED):
    """Unsigned 64-bit fingerprints of texts; null, empty and blank texts have 0."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        n = len(words)
        if not n:
            continue
        flat = b" ".join(words)
        if n <= shingle:
            out[k] = h(flat, seed)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1].tolist()
        # Whole texts, in slices that bound the bit matrix.
        sums, m = np.zeros(64, np.int64), len(starts)
        stops = ends[shingle - 1 :].tolist()
        for lo in range(0, m, 65536):
            hashes = np.array([h(flat[a:b], seed) for a, b in zip(starts[lo : lo + 65536], stops[lo : lo + 65536])], ">u8")
            sums += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * sums > m).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns (default ``doc_id``) and ``fp``, the fingerprint as a signed 64-bit integer."""
    keep = keep or ("doc_id",)
    rows = docs.select(common.row_of(docs, *keep), "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = fingerprint_texts(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["row", "fp"])

    schema = T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema).select(*common.unpacked(rows, keep), "fp")


def planes(fps):
    """Bit planes of fingerprints: ``[64, blocks]`` words, bit ``j`` of word ``b`` for member ``64 b + j``."""
    import numpy as np

    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8)).reshape(n // 64, 64, 64)
    # [block, member, plane] to [plane, block, member]; member j is bit j of the word.
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(64, n // 64)


def near(queries, members, blocks, masks, radius: int = RADIUS, first=range(64)):
    """Members within ``radius`` of queries, as words of 64.

    ``queries`` are fingerprints, ``blocks`` the block each meets, ``masks`` the lanes that count.  Bits are
    taken in the order ``first``.  Returns, for those with a hit, their positions and hit words.
    """
    import numpy as np

    at = np.arange(len(queries))
    over, one, two = ~masks, np.zeros_like(masks), np.zeros_like(masks)
    q, b = queries, blocks
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k, p in enumerate(first):
        wanted = np.uint64(0) - ((q >> np.uint64(63 - p)) & np.uint64(1))
        diff = members[p][b] ^ wanted
        if radius == 3:
            carry = one & diff
            one ^= diff
            over |= two & carry
            two ^= carry
        else:  # a counter as deep as the radius needs
            over = _count(one, two, over, diff, radius)
        if k % 4 == 3:
            alive = over != full
            if not alive.all():
                at, q, b, over, one, two = at[alive], q[alive], b[alive], over[alive], one[alive], two[alive]
                if not len(at):
                    break
    hit = ~over
    found = hit != 0
    return at[found], hit[found]


def _count(one, two, over, diff, radius):
    """Counters up to 2 bits for radii below 3: overflow as soon as the sum passes the radius."""
    carry = one & diff
    one ^= diff
    over = over | (two & carry)
    two ^= carry
    if radius == 0:
        return over | one | two
    if radius == 1:
        return over | two
    return over | (one & two)


def forest(fps, groups, sides, equal=(), radius: int = RADIUS):
    """Links within groups as a forest of (fingerprint, smaller fingerprint).

    ``groups`` are ascending group numbers, ``sides`` 0 or 1 within them: members of side 0 are compared with all
    of side 1 if the group has any, else with one another.  Bits in which a group agrees, ``equal``, are left out.
    """
    import numpy as np

    n = len(fps)
    word = planes(fps)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    end = np.repeat(starts + sizes, sizes)
    second = np.add.reduceat(sides, starts)
    split = np.repeat(starts + sizes - second, sizes)  # where side 1 begins
    me = np.arange(n)
    low = np.where(np.repeat(second > 0, sizes), split, me + 1)
    ask = (sides == 0) & (low < end)
    q, low, high = me[ask], low[ask], end[ask]
    label = np.arange(n)
    if not len(q):
        return fps[:0], fps[:0]
    first = [p for p in range(64) if p not in equal]
    spans = (high - 1) // 64 - low // 64 + 1
    stops = np.cumsum(spans)
    lo = 0
    while lo < len(q):
        done = stops[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(stops, done + CHUNK, "right")))
        s = spans[lo:hi]
        who = np.repeat(np.arange(lo, hi), s)
        block = low[who] // 64 + (np.arange(len(who)) - np.repeat(np.cumsum(s) - s, s))
        from_ = np.maximum(low[who] - 64 * block, 0).astype(np.uint64)
        to = np.minimum(high[who] - 64 * block, 64)
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks = (ones << from_) & (ones >> (64 - to).astype(np.uint64))
        at, hit = near(fps[q[who]], word, block, masks, radius, first)
        if len(at):
            lanes = np.unpackbits(hit.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            r, c = np.nonzero(lanes)
            merge(label, q[who[at[r]]], 64 * block[at[r]] + c)
        lo = hi
    moved = label != me
    return fps[moved], fps[label[moved]]


def keys(bands: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For each key the ranges of bits it is made of, bit 0 the highest."""
    edges = [64 * i // bands for i in range(bands + 1)]
    return [[(edges[b], edges[b + 1]) for b in chosen] for chosen in itertools.combinations(range(bands), bands - radius)]


def bands_for(count: int, radius: int = RADIUS) -> int:
    """Bands enough for so many fingerprints."""
    bands = radius + 1
    while bands < 2 * radius and count > BUCKET << min(sum(b - a for a, b in k) for k in keys(bands, radius)):
        bands += 1
    return bands


def links(nodes: DataFrame, bands: int | None = None, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``nodes``: distinct ``fp``.  A forest of links ``a, b`` whose components are those of all links."""
    bands = bands or bands_for(nodes.count(), radius)
    if radius >= bands or radius > 3:
        raise ValueError("bands must outnumber the radius, which is at most 3")
    chosen = keys(bands, radius)

    def value(ranges):
        out, shift = F.lit(0).cast("long"), 0
        for a, b in ranges:
            out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col("fp"), 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")), shift))
            shift += b - a
        return out

    made = [F.struct(F.lit(i).cast("byte").alias("band"), value(r).alias("value")) for i, r in enumerate(chosen)]
    rows = nodes.select("fp", F.explode(F.array(*made)).alias("k")).select("k.band", "k.value", "fp")
    shared = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(shared, ["band", "value"])
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # Row of block i goes to the pairs (i, j) and (j, i) with the smaller block first; side 1 is the later block.
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), F.when(mine > j, 1).otherwise(0).cast("byte").alias("side")))
    dealt = rows.select("band", "value", "fp", F.explode(pairs).alias("p")).select("band", "value", "p.i", "p.j", "p.side", "fp")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j", "side", "fp")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def linked(t):
            """Links of whole groups, all of one band."""
            band, value, i, j, side, fp = (t.column(c).to_numpy() for c in ("band", "value", "i", "j", "side", "fp"))
            edges = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                key = np.stack([value[a:b], i[a:b], j[a:b]])
                group = np.cumsum(np.r_[0, (key[:, 1:] != key[:, :-1]).any(axis=0)])
                equal = {p for lo, hi in chosen[band[a]] for p in range(lo, hi)}
                u, v = forest(fp[a:b].view(np.uint64), group, side[a:b].astype(np.int64), equal, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])

        # Sorted rows: what is held is cut where the last group begins, and a group is two blocks at most.
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= TASK_ROWS:
                t = pa.Table.from_batches(held)
                last = np.ones(rows, bool)
                for c in ("band", "value", "i", "j"):
                    x = t.column(c).to_numpy()
                    last &= x == x[-1]
                whole = rows - int(last.sum())
                if whole:
                    yield from linked(t.slice(0, whole))
                    held, rows = t.slice(whole).to_batches(), rows - whole
        if rows:
            yield from linked(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _hashed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_hash``, null texts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def fingerprint_components(docs: DataFrame, bands: int | None = None) -> DataFrame:
    """``doc_id, text_hash, fingerprint, component, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest doc_id of a component, ``component`` a number of its own.  Null, empty and
    blank texts share fingerprint zero and are linked like any other.  A null doc_id is no candidate for the
    smallest of a component unless there is no other.  Repeated rows are returned as often as they come; an
    empty table gives no rows.  Other columns are not read.  ``text_hash`` is Spark's xxhash64 of the text, null as empty.
    """
    marked = common.staged(fingerprints(_hashed(docs), "doc_id", "text_hash"))
    nodes = common.staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected(links(nodes.select("fp"), bands))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written first: a join of two plain exchanges can split the rows of a large component.
    rooted = common.staged(rooted)
    tops = common.staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(tops, "root").select("fp", F.col("root").alias("component"), "component_id")
    return marked.join(named, "fp").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """As ``fingerprint_components``, but what fingerprints link is verified: components are those of texts with a similarity of 0.8 or more (``overlap``)."""
    found = overlap.components(_hashed(docs), "doc_id", "text_hash", prints=fingerprint_texts, near=links)
    return found.select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of similar texts: the smallest doc_id, nulls last, then the smallest text hash."""
    found = common.staged(overlap.components(_hashed(docs), "doc_id", "text_hash", prints=fingerprint_texts, near=links))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = common.staged(found.groupBy("component").agg(F.min(place).alias("best")))
    own = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    # Written first, so that its size is known before the texts would be sent to meet it.
    gone = common.staged(found.join(best, "component").where(~own).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    rows = docs.select(common.row_of(docs), F.col("doc_id").cast("long").alias("id_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash_"))
    kept = rows.join(common.small(gone), F.col("id_").eqNullSafe(F.col("gone_id")) & (F.col("hash_") == F.col("gone_hash")), "left_anti")
    # Rows that repeat in id and text are all the best of their component; of these one stays.
    again = common.staged(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash")))
    if not again.isEmpty():
        again = common.small(again)
        same = F.col("id_").eqNullSafe(F.col("again_id")) & (F.col("hash_") == F.col("again_hash"))
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["id_", "hash_"]))
    return kept.select(*common.unpacked(kept, docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return fingerprint_components(common.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
