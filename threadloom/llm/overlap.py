"""Near-duplicates by the Jaccard similarity of five-word shingles, 0.8 or more, verified on whole texts.

Candidates are linked by their SimHash fingerprints (``simhash.links``) or share one of ``BANDS`` keys, each made of ``ROWS`` minima of permuted shingle hashes: a pair at 0.8 shares
none with probability 3 in a million, a nearer pair still less.  Texts that are equal but for case and white space are
one node.  Buckets give stars, not pairs, and their components are groups of candidates.  A small group is searched
breadth first in one task: a text is compared with those not yet reached, so a group that hangs together takes few rounds.
In a large one every text first meets the group's hub, its smallest node; those alike need not meet one another, and only
the others meet all, in blocks.  So a large group of near copies costs in proportion to its size.

Tasks read their groups in sorted order and hold one at a time, bounded by ``BLOCK`` and ``BLOCK_SHINGLES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected, merge

SEED = 42
SHINGLE = 5
#: Least similarity, as a fraction.
ABOVE, BELOW = 4, 5
BANDS, ROWS = 32, 5
#: Texts and shingles of a group that one task takes from each of two blocks.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 22


def shingles(text: str | None):
    """(hash of the words, ascending distinct hashes of the shingles); a text of fewer words is one shingle, a blank one none."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    flat, n = b" ".join(words), len(words)
    node = h(flat, SEED)
    if n <= SHINGLE:
        return node, np.array([node] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - SHINGLE + 1].tolist()
    return node, np.unique(np.fromiter((h(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, len(starts)))


def keys(hashes):
    """One key for each band, none for a blank text."""
    import numpy as np

    if not len(hashes):
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 1024):
        low = np.minimum(low, (factors[:-1, None] * hashes[None, lo : lo + 1024]).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ (column >> np.uint64(29)) ^ column) * factors[-1]
    return out


def forest(sets) -> list[tuple[int, int]]:
    """Links (index, index) that span the components of all pairs of similar sets; sets are ascending and not empty."""
    import numpy as np

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(len(flat), np.int64)
    rest, out, frontier = np.arange(len(sets)), [], []
    items = flat
    while len(rest):
        if not frontier:
            frontier.append(int(rest[0]))
            items, rest = items[sizes[rest[0]] :], rest[1:]
            continue
        me = frontier.pop()
        mine = flat[at[me] : at[me + 1]]
        flag[mine] = 1
        n = sizes[rest]
        shared = np.add.reduceat(flag[items], np.concatenate([[0], np.cumsum(n)[:-1]]))
        flag[mine] = 0
        near = (ABOVE + BELOW) * shared >= ABOVE * (n + sizes[me])
        if near.any():
            found = rest[near].tolist()
            out.extend((x, me) for x in found)
            frontier.extend(found)
            items, rest = items[~np.repeat(near, n)], rest[~near]
    return out


def across(sets, asking) -> list[tuple[int, int]]:
    """Links (index, index) that span the components of the similar pairs of which one set is ``asking``."""
    import numpy as np

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flag, label, out = np.zeros(len(flat), np.int64), np.arange(len(sets)), []
    for me in np.flatnonzero(asking).tolist():
        rest = np.flatnonzero(label != label[me])  # what is joined already is not asked again
        if not len(rest):
            continue
        mine, n = flat[at[me] : at[me + 1]], sizes[rest]
        flag[mine] = 1
        shared = np.add.reduceat(flag[flat[np.repeat(label != label[me], sizes)]], np.concatenate([[0], np.cumsum(n)[:-1]]))
        flag[mine] = 0
        near = rest[(ABOVE + BELOW) * shared >= ABOVE * (n + sizes[me])]
        # Of the sets found, one for each component that they are of.
        _, first = np.unique(label[near], return_index=True)
        out += [(me, x) for x in near[first].tolist()]
        label[np.isin(label, label[near])] = label[me]
    return out


def _stars(key, node):
    """Links (node, root) of the nodes that keys connect, one for each node but roots, and (key, root), each once."""
    import numpy as np

    names, at = np.unique(node, return_inverse=True)
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    low = np.repeat(at[first], np.diff(np.r_[first, len(key)]))
    label = np.arange(len(names))
    merge(label, at[at != low], low[at != low])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]], key[first], names[label[at[first]]]


def candidates(nodes: DataFrame) -> DataFrame:
    """``nodes``: distinct ``node`` and its ``keys``.  Links ``a, b`` that connect the nodes of each bucket.

    A batch links what its own keys connect, one link for each node, and sends each key with its root alone, so a
    frequent key arrives once for each batch.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batched(keep_links: bool):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                lists = batch.column(0)
                size = np.diff(lists.offsets.to_numpy())
                found = _stars(lists.flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), size))
                a, b = found[:2] if keep_links else found[2:]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        return nodes.select("keys", "node").mapInArrow(run, "a long, b long")

    def across_batches(batches):
        import numpy as np
        import pyarrow as pa

        last = None  # the key that was read last, and its smallest node
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            heads = node[first].copy()
            if last is not None and key[0] == last[0]:
                heads[0] = last[1]
            low = np.repeat(heads, np.diff(np.r_[first, len(key)]))
            last = key[-1], heads[-1]
            names, at = np.unique(np.concatenate([node, low]), return_inverse=True)
            label = np.arange(len(names))
            merge(label, at[: len(node)], at[len(node) :])
            moved = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], names=["a", "b"])

    sent = batched(False).repartition(n, "a").sortWithinPartitions("a", "b")
    return batched(True).union(sent.mapInArrow(across_batches, "a long, b long"))


def _met(dealt: DataFrame) -> DataFrame:
    """Verified links ``a, b`` of the groups ``root, i, j`` of ``node, text, asking`` rows."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("root", "i", "j", "node", "text", "asking").repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def run(batches):
        import pyarrow as pa

        held, out = {}, []

        def close():
            if any(a for _, a in held.values()) and len(held) > 1:
                names, sets = list(held), [s for s, _ in held.values()]
                asking = [a for _, a in held.values()]
                out.extend((names[x], names[y]) for x, y in (forest(sets) if all(asking) else across(sets, asking)))
            held.clear()

        def links():
            got = pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out.clear()
            return got

        now = None
        for batch in batches:
            for root, i, j, node, text, asking in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != now:
                    close()
                    now = root, i, j
                    if len(out) > 50_000:
                        yield links()
                if node not in held and len(made := shingles(text)[1]):  # a blank text is like no other
                    held[node] = made, asking
        close()
        yield links()

    return dealt.mapInArrow(run, "a long, b long")


def links(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``texts``: ``root, n, shingles, node, text``, n texts with so many shingles in all in each group of candidates.

    Verified links ``a, b`` whose components are those of all similar pairs within the groups.
    """
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = texts.withColumn("parts", parts)
    zero = F.lit(0)
    small = _met(rows.where("parts <= 1").select("root", zero.alias("i"), zero.alias("j"), "node", "text", F.lit(True).alias("asking")))
    large = rows.where("parts > 1").select("root", "parts", "node", "text")
    hubs = large.where("node = root").select("root", F.col("text").alias("hub")).dropDuplicates(["root"])

    def meet_hub(batches):
        import numpy as np
        import pyarrow as pa

        root, own = None, None
        for batch in batches:
            like = np.zeros(batch.num_rows, bool)
            for k, (r, hub, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)))):
                if r != root:
                    root, own = r, shingles(hub)[1]
                mine = shingles(text)[1]
                shared = len(np.intersect1d(own, mine, assume_unique=True))
                like[k] = (ABOVE + BELOW) * shared >= ABOVE * (len(own) + len(mine))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(like)], names=["root", "parts", "node", "alike"])

    met = large.join(hubs, "root").select("root", "parts", "node", "hub", "text").mapInArrow(meet_hub, "root long, parts int, node long, alike boolean")
    met = common.staged(met.dropDuplicates(["node"]))
    left = met.where("not alike").groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("left"))
    rows = met.join(left, "root").select("root", "parts", "left", "node", "alike").join(large.select("node", "text"), "node")
    i, j = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("left", "parts"))
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    place = lambda a, b, asking: F.struct(a.alias("i"), b.alias("j"), F.lit(asking).alias("asking"))
    asked = F.transform(F.filter(every("left"), lambda x: F.col("alike") | (x != i)), lambda x: place(x, j, False))
    asks = F.when(F.col("alike"), F.array()).otherwise(F.transform(every("parts"), lambda x: place(i, x, True)))
    dealt = rows.select("root", "node", "text", F.explode(F.concat(asked, asks)).alias("p")).select("root", "p.i", "p.j", "node", "text", "p.asking")
    return small.union(met.where("alike and node <> root").select("node", "root")).union(_met(dealt))


def fingerprint_candidates(nodes: DataFrame, near) -> DataFrame:
    """``nodes``: distinct ``node`` and its ``fp``.  Links ``a, b`` that connect nodes of equal fingerprints, and those that ``near`` links.

    ``near`` is a function of distinct ``fp`` to links of fingerprints; each fingerprint stands for its smallest node.
    """
    heads = common.staged(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")))
    equal = nodes.join(heads.where("n > 1"), "fp").select(F.col("node").alias("a"), F.col("head").alias("b"))
    linked = near(heads.select("fp"))
    ends = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in ("a", "b")]
    met = linked.join(ends[0], "a").join(ends[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return equal.union(met).where("a <> b")


def components(rows: DataFrame, *keep: str, prints, near) -> DataFrame:
    """``keep`` columns, ``fp``, ``component`` and ``component_id`` for each row of ``doc_id, text_hash, text`` and more.

    Candidates are what ``near`` links of the fingerprints that ``prints`` makes of texts, and what shares a key of minima; all are
    verified.  Fingerprints and minima are made by one worker, as two in a row would each keep their memory.

    ``component_id`` is the smallest doc_id of a component, null only where all are.  Blank and null texts are one component.
    """
    taken = rows.select(common.row_of(rows, *keep), "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = [shingles(t.as_py()) for t in batch.column(1)]
            fp = np.array([prints([t.as_py()])[0] for t in batch.column(1)], np.uint64).view(np.int64)
            node = np.array([m[0] for m in made], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([keys(m[1]).view(np.int64) for m in made], pa.list_(pa.int64())), pa.array([len(m[1]) for m in made]), pa.array(fp)], names=["row", "node", "keys", "size", "fp"])

    schema = T.StructType([taken.schema["row"], T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType())])
    marked = common.staged(taken.mapInArrow(run, schema).select(*common.unpacked(taken, keep), "node", "keys", "size", "fp"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = common.staged(marked.groupBy("node").agg(F.min(own).alias("own"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    groups = common.staged(connected(fingerprint_candidates(nodes.select("node", "fp"), near).union(candidates(nodes))))
    members = nodes.select("node", "own", "size").join(groups, "node")
    counts = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    asked = common.staged(members.join(counts, "root").select("root", "n", "shingles", "node", F.col("own.doc_id").alias("id_"), F.col("own.text_hash").alias("hash_")))
    texts = rows.select("doc_id", "text_hash", "text").join(common.small(asked), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")))
    # The candidates' texts are written once; they are read by several joins.
    texts = common.staged(texts.select("root", "n", "shingles", "node", "text"))
    labels = connected(links(texts))
    rooted = common.staged(nodes.join(labels.withColumnRenamed("root", "top"), "node", "left").select("node", "own.doc_id", F.coalesce("top", "node").alias("component")))
    tops = common.staged(rooted.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return marked.select(*keep, "fp", "node").join(rooted.join(tops, "component").select("node", "component", "component_id"), "node").select(*keep, "fp", "component", "component_id")
