"""Approximate nearest neighbours by a hash-prefix forest (LSH forest; Bawa, Condie and Ganesan, 2005).

One index covers the table: in each of ``TREES`` trees every vector has a long string of symbols, each the corner of a
cross-polytope nearest to the vector under a random rotation (Andoni et al., 2015), so that the longer the common prefix
of two strings, the nearer their vectors tend to be.  A tree's sorted array lies in parts by the hash of a prefix; a query
is sent to the parts of its own prefixes only.  There it descends to its longest match by bisection.  Beside its own
prefix of some length a query has others, cheapest first, with symbols whose corners are nearly as near (multi-probe;
Lv et al., 2007).

How far queries ascend is measured, not guessed.  ``fit`` compares a bounded sample of queries with all rows and notes for
each pair the first rung of a ladder on which some tree lets them meet: long prefixes before short ones, and for
each length one prefix, then 2, 3, 4, 6 and so on.  It picks the least number of candidates with which the sample finds ``RECALL`` of
its true neighbours, and the rung on which nearly all of the sample have so many.  All trees ascend together: queries start
on that rung, those with fewer candidates go on to wider ones, however many or few they are, and those for which the
ladder ends are compared with every row.  So the share of rows compared follows the data at every size, with nothing cut off.

Candidates are compared exactly, on original vectors in double precision, in the part that holds their vectors.  Rows with
equal vectors are one member with its smallest ids: of equal distances the smaller ids win, so no others can be among
the nearest.  Members are deduplicated before anything is sent, and the strings of a prefix that many members share
are spread over several parts, so neither copies nor clusters fill one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TREES = 24
#: Symbols of a string, and the most dimensions that a symbol's cross-polytope has.
SYMBOLS = 6
WIDTH = 64
NEAREST = 10
#: Queries that ``fit`` reads, and the share of their true neighbours that they are to find.
SAMPLE = 128
RECALL = 0.95
#: Rungs that queries without enough candidates go up at a time.
RUNGS = 4
#: Strings of a tree in one part; members in one part of vectors; pairs handled at once.
TREE_ROWS = 1 << 19
VECTOR_ROWS = 1 << 16
PAIRS = 1 << 18
#: Rows that a task gathers before it sends, and the share of rows from which a prefix is spread.
FLUSH_ROWS = 1 << 16
HEAVY = 1 / 128
SEED = 11
_MIX = 0x9E3779B97F4A7C15


def usable(column: str = "embedding"):
    """Vectors that are not null, empty or zero, and have finite components only."""
    v = F.col(column)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


@functools.lru_cache(maxsize=4)
def rotations(dim: int, trees: int = TREES, symbols: int = SYMBOLS, seed: int = SEED):
    """Random orthonormal columns ``[trees, symbols, dim, width]``, the same everywhere."""
    import numpy as np

    rng, width = np.random.default_rng([seed, dim]), min(dim, WIDTH)
    return np.linalg.qr(rng.normal(size=(trees, symbols, dim, width)))[0].astype(np.float32)


@dataclass(frozen=True)
class Shape:
    """Strings of vectors with ``dim`` components."""

    dim: int
    trees: int = TREES
    symbols: int = SYMBOLS

    @property
    def corners(self) -> int:
        return 2 * min(self.dim, WIDTH)

    @property
    def bits(self) -> int:
        return max(1, (self.corners - 1).bit_length())

    def shift(self, length: int):
        """What a key is shifted by to leave a prefix of so many symbols."""
        import numpy as np

        return np.uint64(self.bits * (self.symbols - length))

    def ladder(self) -> list[tuple[int, int]]:
        """(length of the prefix, prefixes for each query) from the narrowest rung to the widest."""
        v = self.corners
        most = {length: max(1, v // 16) if length == 1 else 2 * v if length == 2 else v for length in range(1, self.symbols + 1)}
        steps = sorted({n for k in range(10) for n in (1 << k, 3 << k)})
        return [(x, n) for x in range(self.symbols, 0, -1) for n in steps if n <= most[x]]

    def _scores(self, unit, tree: int, symbol: int):
        return unit @ rotations(self.dim, self.trees, self.symbols)[tree, symbol]

    def keys(self, unit, tree: int):
        """The strings of unit vectors as integers in the same order."""
        import numpy as np

        key, rows = np.zeros(len(unit), np.uint64), np.arange(len(unit))
        for s in range(self.symbols):
            y = self._scores(unit, tree, s)
            top = np.abs(y).argmax(axis=1)
            key = key << np.uint64(self.bits) | (2 * top + (y[rows, top] < 0)).astype(np.uint64)
        return key

    def probes(self, unit, tree: int, length: int, count: int):
        """For each vector its ``count`` cheapest prefixes of so many symbols, own first: ``[rows, count]``, fewer if there are no more.

        The price of a corner is the square of what it lacks to the nearest corner; those of a prefix add up.
        """
        import numpy as np

        key, price = np.zeros((len(unit), 1), np.uint64), np.zeros((len(unit), 1), np.float32)
        for s in range(length):
            y = self._scores(unit, tree, s)
            both = np.stack([y, -y], axis=2).reshape(len(unit), -1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :count]
            near = np.take_along_axis(both, order, axis=1)
            # The i-th prefix with the j-th corner has (i + 1) (j + 1) - 1 others that are no dearer.
            i, j = np.nonzero(np.outer(np.arange(key.shape[1]) + 1, np.arange(order.shape[1]) + 1) <= count)
            total = price[:, i] + ((near[:, :1] - near) ** 2)[:, j]
            keep = np.argsort(total, axis=1, kind="stable")[:, :count]
            made = key[:, i] << np.uint64(self.bits) | order.astype(np.uint64)[:, j]
            key, price = np.take_along_axis(made, keep, axis=1), np.take_along_axis(total, keep, axis=1)
        return key


@dataclass(frozen=True)
class Plan:
    """What ``fit`` found: where queries start, the candidates they need, and what the sample says of it."""

    rung: int | None
    enough: int
    rows: int
    recall: float
    share: float
    heavy: tuple[tuple[int, int, int, float], ...] = ()  # tree, length, prefix, share of all rows


def _unit(x):
    import numpy as np

    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column, dim: int):
    """An Arrow array of lists of ``dim`` numbers as a matrix in double precision."""
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _ranges(low, size):
    """All positions of ranges that begin at ``low``."""
    import numpy as np

    return np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _batches(batches, rows: int = FLUSH_ROWS) -> Iterator:
    """Arrow batches joined to tables of about so many rows."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# ---- how far to ascend


@functools.lru_cache(maxsize=1)
def _sampled(shape: Shape, raw: bytes) -> Sampled:
    """A worker's tables of the sample, kept between its tasks."""
    import numpy as np

    return Sampled(shape, np.frombuffer(raw, np.float32).reshape(-1, shape.dim))


class Sampled:
    """The sample's prefixes on every rung, to look rows up by."""

    def __init__(self, shape: Shape, unit):
        import numpy as np

        self.shape, self.size, self.ladder = shape, len(unit), shape.ladder()
        self.tables = {}
        for tree in range(shape.trees):
            for x in range(1, shape.symbols + 1):
                rungs = [(n, r) for r, (length, n) in enumerate(self.ladder) if length == x]
                found = shape.probes(unit, tree, x, max(n for n, _ in rungs))
                place = np.arange(found.shape[1])
                rung = np.array([next(r for n, r in rungs if p < n) for p in place], np.uint8)
                order = np.argsort(found.ravel(), kind="stable")
                self.tables[tree, x] = found.ravel()[order], np.repeat(np.arange(len(unit)), found.shape[1])[order], np.tile(rung, len(unit))[order]

    def rungs(self, unit):
        """The first rung on which each query and row meet, ``[sample, rows]``, and heavy prefixes (tree, length, prefix, rows)."""
        import numpy as np

        best = np.full((self.size, len(unit)), len(self.ladder), np.uint8)
        heavy = []
        for tree in range(self.shape.trees):
            keys = self.shape.keys(unit, tree)
            for x in range(1, self.shape.symbols + 1):
                prefix = keys >> self.shape.shift(x)
                values, n = np.unique(prefix, return_counts=True)
                often = n > max(2, len(unit) * HEAVY / 2)
                heavy += [(tree, x, int(v), int(c)) for v, c in zip(values[often].view(np.int64), n[often])]
                table, owner, rung = self.tables[tree, x]
                low, high = np.searchsorted(table, prefix), np.searchsorted(table, prefix, "right")
                at = _ranges(low, high - low)
                np.minimum.at(best, (owner[at], np.repeat(np.arange(len(unit)), high - low)), rung[at])
        return best, heavy


def fit(rows: DataFrame, queries: DataFrame, dim: int, count: int = NEAREST, recall: float = RECALL, sample: int = SAMPLE, trees: int = TREES) -> Plan:
    """How far queries must ascend, from a sample (those with the smallest hash of their id) and all ``rows``."""
    import numpy as np

    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    ids, asked = np.array([r.vec_id for r in some], np.int64), np.array([r.embedding for r in some], np.float64).reshape(-1, dim)
    shape = Shape(dim, trees)
    last = len(shape.ladder())

    def run(batches):
        import pyarrow as pa

        own = _sampled(shape, _unit(asked).tobytes())
        met, heavy, n = np.zeros((len(ids), last + 1), np.int64), {}, 0
        near = [[] for _ in ids]
        for t in _batches(batches, 8192):
            x, v, member = _matrix(t.column("embedding").chunk(0), dim), t.column("vec_id").to_numpy(), t.column("member").to_numpy()
            n += len(x)
            best, often = own.rungs(_unit(x))
            _, first = np.unique(member, return_index=True)  # copies count once, as in the search
            for i in range(len(ids)):
                met[i] += np.bincount(best[i, first], minlength=last + 1)
                d = np.sqrt(((x - asked[i]) ** 2).sum(axis=1))
                d[v == ids[i]] = np.inf
                top = np.lexsort((v, d))[:count]
                near[i] = sorted(near[i] + [(float(d[k]), int(v[k]), int(best[i, k])) for k in top if d[k] < np.inf])[:count]
            for tree, length, prefix, c in often:
                heavy[tree, length, prefix] = heavy.get((tree, length, prefix), 0) + c
        out = [(0, i, r, 0, int(met[i, r]), 0.0) for i, r in zip(*np.nonzero(met))] + [(1, i, v, r, 0, d) for i, l in enumerate(near) for d, v, r in l]
        out += [(2, *k, c, 0.0) for k, c in heavy.items()] + [(3, 0, 0, 0, n, 0.0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(zip(*out))], names=["kind", "a", "b", "c", "n", "d"])

    seen = common.staged(rows.mapInArrow(run, "kind long, a long, b long, c long, n long, d double"))
    total = seen.where("kind = 3").agg(F.sum("n").alias("n")).first().n or 0
    met = np.zeros((len(ids), last + 1), np.int64)
    for r in seen.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        met[r.a, r.b] = r.n
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    near = seen.where("kind = 1").withColumn("place", place).where(F.col("place") <= count).select("a", "c").collect()
    if not total or not near:
        return Plan(None, 0, total, 1.0, 1.0)
    of, rung = np.array([r.a for r in near]), np.array([r.c for r in near])
    reached = met.cumsum(axis=1)
    reached[:, last] = max(total, count + 1)
    enough = count + 1
    while True:
        stop = (reached >= enough).argmax(axis=1)
        got = (rung <= stop[of]).mean()
        if got >= recall or enough >= total:
            break
        enough = min(total, enough + max(1, enough // 8))
    share = float(np.minimum(reached[np.arange(len(ids)), stop], total).mean() / total)
    start = int(np.sort(stop)[-(-9 * len(stop) // 10) - 1])
    if start >= last:
        return Plan(None, enough, total, 1.0, 1.0)
    length = shape.ladder()[start][0]
    often = seen.where((F.col("kind") == 2) & (F.col("b") == length)).groupBy("a", "c").agg(F.sum("n").alias("n")).where(F.col("n") > total * HEAVY).collect()
    return Plan(start, enough, total, float(got), share, tuple((r.a, length, r.c, r.n / total) for r in often))


# ---- the search


def _routes(shape: Shape, plan: Plan, length: int, parts: int):
    """(part, how many parts) of prefixes of a tree; members of heavy prefixes are spread over several."""
    import numpy as np

    wide = {t: ([], []) for t in range(shape.trees)}
    for t, x, prefix, share in plan.heavy:
        if x == length:
            wide[t][0].append(prefix)
            wide[t][1].append(min(parts, 1 + int(share * parts * 2)))

    def route(tree: int, prefix):
        home = (prefix * np.uint64(_MIX) >> np.uint64(33)) % np.uint64(parts)
        spread = np.ones(len(prefix), np.int64)
        if wide[tree][0]:
            known = np.array(wide[tree][0], np.int64).view(np.uint64)
            order = np.argsort(known)
            at = np.minimum(np.searchsorted(known[order], prefix), len(known) - 1)
            same = known[order][at] == prefix
            spread[same] = np.array(wide[tree][1])[order][at[same]]
        return home.astype(np.int64), spread

    return route


def _blobs(part, *columns):
    """(part, columns as bytes) of rows dealt by part."""
    import numpy as np

    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    columns = [np.ascontiguousarray(c)[order] for c in columns]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(part[a]), [c[a:b].tobytes() for c in columns]


def candidates(rows: DataFrame, queries: DataFrame, shape: Shape, plan: Plan, rung: int, vector_parts: int) -> DataFrame:
    """``part, asked, pairs``: pairs (query, member) that meet on a rung, by the part of their member, with the queries of each."""
    length, count = shape.ladder()[rung]
    parts = max(1, -(-plan.rows // TREE_ROWS))
    route = _routes(shape, plan, length, parts)
    schema = "part int, tree int, keys binary, ids binary, probe boolean"

    def packets(found, tree, probe):
        import pyarrow as pa

        got = list(found)
        if got:
            yield pa.RecordBatch.from_pydict({"part": pa.array([tree * parts + p for p, _ in got], pa.int32()), "tree": pa.array([tree] * len(got), pa.int32()), "keys": pa.array([b[0] for _, b in got], pa.binary()), "ids": pa.array([b[1] for _, b in got], pa.binary()), "probe": pa.array([probe] * len(got))})

    def strings(batches):
        import numpy as np

        for t in _batches(batches):
            member, first = np.unique(t.column("member").to_numpy(), return_index=True)
            unit = _unit(_matrix(t.column("embedding").chunk(0), shape.dim)[first])
            for tree in range(shape.trees):
                keys = shape.keys(unit, tree)
                home, spread = route(tree, keys >> shape.shift(length))
                mine = (member.view(np.uint64) * np.uint64(_MIX) >> np.uint64(40)).astype(np.int64) % spread
                yield from packets(_blobs((home + mine) % parts, keys, member), tree, False)

    def descents(batches):
        import numpy as np

        for t in _batches(batches, 2048):
            ids, unit = t.column("vec_id").to_numpy(), _unit(_matrix(t.column("embedding").chunk(0), shape.dim))
            for tree in range(shape.trees):
                # A prefix is followed by the query's own further symbols: they tell matches that are longer still.
                rest = shape.keys(unit, tree) & ((np.uint64(1) << shape.shift(length)) - np.uint64(1))
                found = shape.probes(unit, tree, length, count)
                home, spread = route(tree, found.ravel())
                keys = (found << shape.shift(length) | rest[:, None]).ravel()
                to = (np.repeat(home, spread) + _ranges(np.zeros(len(spread), np.int64), spread)) % parts
                yield from packets(_blobs(to, np.repeat(keys, spread), np.repeat(np.repeat(ids, found.shape[1]), spread)), tree, True)

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        own: dict = {}
        for batch in batches:
            for tree, keys, ids, probe in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                own.setdefault(tree, ([], []))[probe].append((np.frombuffer(keys, np.uint64), np.frombuffer(ids, np.int64)))
        for there, asking in own.values():
            if not there or not asking:
                continue
            keys, member = (np.concatenate(c) for c in zip(*there))
            order = np.lexsort((member, keys))
            keys, member = keys[order], member[order]
            fresh = np.r_[True, (keys[1:] != keys[:-1]) | (member[1:] != member[:-1])]
            keys, member = keys[fresh], member[fresh]
            probe, query = (np.concatenate(c) for c in zip(*asking))
            # The longest match that has enough members by itself, else the rung's length.
            low = high = None
            for x in range(shape.symbols, length - 1, -1):
                first = probe >> shape.shift(x) << shape.shift(x)
                a = np.searchsorted(keys, first)
                b = np.searchsorted(keys, first | ((np.uint64(1) << shape.shift(x)) - np.uint64(1)), "right")
                if low is None:
                    low, high = a, b
                else:
                    short = high - low < plan.enough
                    low, high = np.where(short, a, low), np.where(short, b, high)
            some = np.flatnonzero(high > low)
            size = (high - low)[some]
            stops, lo = np.cumsum(size), 0
            while lo < len(some):
                hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + PAIRS, "right")))
                found, n = member[_ranges(low[some[lo:hi]], size[lo:hi])], size[lo:hi]
                who = np.repeat(query[some[lo:hi]], n)
                to = (found.view(np.uint64) % np.uint64(vector_parts)).astype(np.int64)
                got = list(_blobs(to, who, found))
                asked = [np.unique(np.frombuffer(b[0], np.int64)) for _, b in got]
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in got], pa.int32()), "asked": pa.array(asked, pa.list_(pa.int64())), "pairs": pa.array([b[0] + b[1] for _, b in got], pa.binary())})
                lo = hi

    both = rows.mapInArrow(strings, schema).union(queries.mapInArrow(descents, schema))
    return both.repartitionById(shape.trees * parts, F.col("part")).mapInArrow(meet, "part int, asked array<long>, pairs binary")


def best(query, distance, first_id, held, own, count: int):
    """(query, id, distance) of the nearest ids of each query.

    A member is given by the range of its ascending ids in ``held``: ``first_id`` and, one place on, its end.
    """
    import numpy as np

    member, q, d = first_id, query, distance
    order = np.lexsort((d, q))
    q, d, member = q[order], d[order], member[order]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    size = np.diff(np.r_[heads, len(q)])
    edge = d[heads + np.minimum(size - 1, count)]  # the member after the nearest: one may be the query
    keep = d <= np.repeat(edge, size)
    q, d, member = q[keep], d[keep], member[keep]
    n = held[1][member + 1] - held[1][member]
    v = held[0][_ranges(held[1][member], n)]
    q, d = np.repeat(q, n), np.repeat(d, n)
    other = v != own[q]
    q, d, v = q[other], d[other], v[other]
    order = np.lexsort((d, v, q))  # an id counts once, at its nearest row
    q, d, v = q[order], d[order], v[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])] if len(q) else np.zeros(0, bool)
    q, d, v = q[once], d[once], v[once]
    order = np.lexsort((v, d, q))
    q, d, v = q[order], d[order], v[order]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)]))
    return own[q[rank < count]], v[rank < count], d[rank < count]


def compared(rows: DataFrame, queries: DataFrame, pairs: DataFrame | None, dim: int, parts: int, count: int) -> DataFrame:
    """``query_id, vec_id, score`` of the best of each part of vectors, and a row with ``n`` pairs compared and no ``vec_id``.

    Without ``pairs`` queries are compared with every row.
    """
    schema, whole = "part int, kind int, ids binary, at binary, vectors binary", pairs is None

    def packet(part, kind, ids, at, vectors):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "kind": pa.array([kind] * len(part), pa.int32()), "ids": pa.array(ids, pa.binary()), "at": pa.array(at, pa.binary()), "vectors": pa.array(vectors, pa.binary())})

    def members(batches):
        import numpy as np

        for t in _batches(batches):
            member, v = t.column("member").to_numpy(), t.column("vec_id").to_numpy()
            x = _matrix(t.column("embedding").chunk(0), dim)
            order = np.lexsort((v, member))
            # Of equal hashes, hence of copies, the first ids suffice; a hash that two vectors share keeps all its rows.
            m, xs = member[order], x[order]
            heads = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
            size = np.diff(np.r_[heads, len(m)])
            rank = np.arange(len(m)) - np.repeat(heads, size)
            same = (xs == np.repeat(xs[heads], size, axis=0)).all(axis=1)
            keep = order[(rank <= count) | ~np.repeat(np.logical_and.reduceat(same, heads), size)]
            to = (member[keep].view(np.uint64) % np.uint64(parts)).astype(np.int64)
            got = list(_blobs(to, v[keep], member[keep], x[keep]))
            yield packet([p for p, _ in got], 0, *zip(*(b for _, b in got)))

    def asking(batches):
        import numpy as np

        for t in _batches(batches):
            x = _matrix(t.column("embedding").chunk(0), dim)
            got = list(_blobs(t.column("part").to_numpy().astype(np.int64), t.column("vec_id").to_numpy(), x))
            yield packet([p for p, _ in got], 1, [b[0] for _, b in got], [b""] * len(got), [b[1] for _, b in got])

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        held, asked, met = ([], [], []), ([], []), []
        for batch in batches:
            for kind, ids, at, vectors in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                if kind == 0:
                    for c, b, t in zip(held, (ids, at, vectors), (np.int64, np.int64, np.float64)):
                        c.append(np.frombuffer(b, t))
                elif kind == 1:
                    asked[0].append(np.frombuffer(ids, np.int64))
                    asked[1].append(np.frombuffer(vectors, np.float64))
                else:
                    met.append(np.frombuffer(ids, np.int64).reshape(2, -1))
        if not held[0] or not asked[0]:
            return
        v, member, x = np.concatenate(held[0]), np.concatenate(held[1]), np.concatenate(held[2]).reshape(-1, dim)
        own, q = np.concatenate(asked[0]), np.concatenate(asked[1]).reshape(-1, dim)
        own, first = np.unique(own, return_index=True)
        q = q[first]
        order = np.lexsort((v, *x.T[::-1], member))
        v, member, x = v[order], member[order], x[order]
        heads = np.flatnonzero(np.r_[True, (member[1:] != member[:-1]) | (x[1:] != x[:-1]).any(axis=1)])
        groups = v, np.r_[heads, len(v)]
        member, x = member[heads], x[heads]
        none = np.zeros(0)

        def distances(who, which):
            out = np.empty(len(who))
            for lo in range(0, len(who), PAIRS // 8):
                out[lo : lo + PAIRS // 8] = np.sqrt(((x[which[lo : lo + PAIRS // 8]] - q[who[lo : lo + PAIRS // 8]]) ** 2).sum(axis=1))
            return out

        found, compared_ = [], np.zeros(len(own), np.int64)
        if whole:
            for i in range(len(own)):
                compared_[i] = len(x)
                found.append(best(np.full(len(x), i), distances(np.full(len(x), i), np.arange(len(x))), np.arange(len(x)), groups, own, count))
        elif met:
            who, what = np.searchsorted(own, np.concatenate([m[0] for m in met])), np.concatenate([m[1] for m in met])
            code = np.unique(who.astype(np.int64) * len(member) + np.searchsorted(member, what))
            who, low = np.divmod(code, len(member))
            high = np.searchsorted(member, member[low], "right")  # nearly always one vector
            n = high - low
            who, which = np.repeat(who, n), _ranges(low, n)
            compared_ += np.bincount(who, minlength=len(own))
            found.append(best(who, distances(who, which), which, groups, own, count))
        a, b, c = (np.concatenate([f[k] for f in found] or [none]) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(np.float64)), pa.array([None] * len(a), pa.int64())], names=["query_id", "vec_id", "score", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([None] * len(own), pa.int64()), pa.array([None] * len(own), pa.float64()), pa.array(compared_)], names=["query_id", "vec_id", "score", "n"])

    if whole:
        wanted = queries.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    else:
        needed = pairs.select("part", F.explode("asked").alias("vec_id")).distinct()
        wanted = needed.join(queries, "vec_id").select("vec_id", "embedding", "part")
    all_ = rows.mapInArrow(members, schema).union(wanted.mapInArrow(asking, schema))
    if pairs is not None:
        all_ = all_.union(pairs.select("part", F.lit(2).alias("kind"), F.col("pairs").alias("ids"), F.lit(b"").alias("at"), F.lit(b"").alias("vectors")))
    return all_.repartitionById(parts, F.col("part")).mapInArrow(compare, "query_id long, vec_id long, score double, n long")


def _search(rows: DataFrame, queries: DataFrame, dim: int, count: int, recall: float, report: list | None) -> DataFrame:
    """``query_id, vec_id, score`` of parts' best, for vectors of ``dim`` components."""
    shape, plan = Shape(dim), fit(rows, queries, dim, count, recall)
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(spread, -(-plan.rows // 2048)), -(-plan.rows // VECTOR_ROWS))
    left, asked, out = queries, queries.count(), []
    for rung in range(plan.rung, len(shape.ladder()), RUNGS) if plan.rung is not None else ():
        pairs = common.staged(candidates(rows, left, shape, plan, rung, parts))
        found = common.staged(compared(rows, left, pairs, dim, parts, count))
        done = found.groupBy("query_id").agg(F.sum("n").alias("n")).where(F.col("n") >= plan.enough)
        if report is not None:
            report.append((*shape.ladder()[rung], asked, found.agg(F.sum("n")).first()[0] or 0, plan))
        out.append(found.where("vec_id is not null").join(done, "query_id", "left_semi"))
        left = common.staged(left.join(done, F.col("vec_id") == F.col("query_id"), "left_anti"))
        asked = left.count()
        if not asked:
            break
    if asked:
        found = compared(rows, left, None, dim, parts, count)
        if report is not None:
            found = common.staged(found)
            report.append((0, 1, asked, found.agg(F.sum("n")).first()[0] or 0, plan))
        out.append(found.where("vec_id is not null"))
    return functools.reduce(DataFrame.union, out).select("query_id", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, count: int = NEAREST, recall: float = RECALL, report: list | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's nearest among ``rows`` with another id, by Euclidean distance.

    Both have ``vec_id, embedding``; vectors of other sizes than the query's take no part, nor do unusable ones (see
    ``usable``) or rows without id.  Ties go to the smaller id; an id with several rows counts once, at its nearest row;
    as a query the first of its rows by their components counts.  A query without candidates gives no rows; other
    columns are not read.  ``report`` gets (length of prefixes, prefixes, queries, pairs compared, plan) of each rung taken;
    length 0 means that queries were compared with every row.
    """
    pick = lambda df: df.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # Minus zero and zero are one number, but not one hash.
    x = pick(rows).withColumn("member", F.xxhash64(F.transform("embedding", lambda v: v + F.lit(0.0))))
    q = common.staged(pick(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    sizes = [r.dim for r in q.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect()]
    found = [_search(x.where(F.size("embedding") == d), q.where(F.size("embedding") == d), d, count, recall, report) for d in sizes]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    all_ = functools.reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return all_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of all rows whose id is divisible by 100."""
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
