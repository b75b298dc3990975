"""Embedding whitening by merged moments.

Entries are held as whole numbers ``floor(scale * c) + offset``, so sums are exact and do not depend on how rows were dealt
or on which task ran again.  Each partition computes the count, the sums (with the count the local mean) and the scatter
about its own mean; two of these merge by Chan's formula, whose difference of means comes from the exact sums.  ``treeReduce``
merges them pairwise, so the driver meets few matrices, each of the dimension's square, however many rows there are.
``eigh`` runs on the driver; a second pass computes the covariance of what the first one whitened and compares it with the
identity.  No row is shuffled.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Levels of the tree.  With p partitions the driver merges about the depth-th root of p states.
DEPTH = 3
#: Whole numbers beyond this take no part: their differences must fit a long.
_LARGEST = 1 << 61

#: count, sums, scatter about the mean
Moments = tuple[int, list, np.ndarray]


def vectors_of(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """An Arrow column of lists as (places, matrix of doubles) for each dimension; null lists are left out, null entries are NaN."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lens = pc.list_value_length(column)
    places = np.flatnonzero(np.asarray(lens.is_valid()))
    sizes = lens.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        out.append((places[at], flat[starts[at][:, None] + np.arange(d)]))
    return out


def fixed(matrix: np.ndarray, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their entries as whole numbers): rows with entries not finite or too large do not."""
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * matrix)
        good = (np.isfinite(matrix) & (np.abs(whole) < _LARGEST)).all(axis=1)
    return good, whole[good].astype(np.int64) + offset


def _split(x: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Exact sums of the columns, whole numbers near the means, and what the means have beyond these."""
    sums = [int(h) * (1 << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
    near = np.array([s // len(x) for s in sums], np.int64)
    return sums, near, np.array([(s - int(m) * len(x)) / len(x) for s, m in zip(sums, near)])


def moments(x: np.ndarray) -> Moments:
    """Moments of rows, whole numbers or doubles."""
    if x.dtype == np.int64:
        sums, near, rest = _split(x)
        centred = (x - near) - rest
    else:
        sums = x.sum(axis=0).tolist()
        centred = x - np.array(sums) / len(x)
    return len(x), sums, centred.T @ centred


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula for two parts."""
    n = a[0] + b[0]
    gap = np.array([(y * a[0] - x * b[0]) / (a[0] * b[0]) for x, y in zip(a[1], b[1])])
    return n, [x + y for x, y in zip(a[1], b[1])], a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _merged_all(a: dict, b: dict) -> dict:
    return a | b | {d: merged(a[d], b[d]) for d in a.keys() & b.keys()}


def _reduced(rows: DataFrame, of, depth: int) -> dict[int, Moments]:
    """Moments by dimension of the matrices that ``of`` finds in the batches of each partition."""

    def run(batches):
        import pyarrow as pa

        state: dict[int, Moments] = {}
        for batch in batches:
            for x in of(batch):
                if len(x):
                    state = _merged_all(state, {x.shape[1]: moments(x)})
        yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(state)], pa.binary())})

    states = rows.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(bytes(r.state)))
    return states.treeReduce(_merged_all, depth) if states.getNumPartitions() else {}


@dataclass
class Whitening:
    """A fitted whitening: ``n`` vectors of exact ``sums``; unit ``components`` as columns by falling ``variances``."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    scale: int
    offset: int

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x - S/n, whole numbers x - S // n, the remainders of S): rows of whole numbers about the means."""
        near = np.array([s // self.n for s in self.sums], np.int64)
        left = np.array([s % self.n for s in self.sums], np.int64)
        whole = x - near
        return whole - left / self.n, whole, left

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x)[0] @ self.components / np.where(self.variances > 0, np.sqrt(self.variances), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        _, whole, left = self.centred(x)
        if not len(x):
            return []
        bound = (int(max(whole.max(), -whole.min())) + 1) * self.n
        if bound * bound * self.dimension < 1 << 63:
            d = whole * self.n - left
            return (d * d).sum(axis=1).tolist()
        d = whole.astype(object) * self.n - left.astype(object)
        return (d * d).sum(axis=1).tolist()

    def matrices(self, column):
        """(places, whole numbers) of the vectors in an Arrow column that take part."""
        for places, matrix in vectors_of(column):
            if matrix.shape[1] == self.dimension:
                good, x = fixed(matrix, self.scale, self.offset)
                yield places[good], x


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, depth: int = DEPTH) -> Whitening | None:
    """The whitening of all vectors of a column; None if there is none.

    Null and empty vectors, and those with entries that are null, not finite or too large for a long, take no part.  Where
    vectors differ in length those of the commonest length do (of the largest, if several are).  A component whose variance is
    no more than rounding leaves has variance 0.
    """
    rows = vectors.select(F.col(common.quoted(column)).alias("v"))
    found = _reduced(rows, lambda batch: (fixed(m, scale, offset)[1] for _, m in vectors_of(batch.column(0))), depth)
    if not found:
        return None
    n, sums, scatter = found[max(found, key=lambda d: (found[d][0], d))]
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, axes = values[::-1], axes[:, ::-1]
    noise = max(values[0], 0) * len(values) * 16 * np.finfo(float).eps
    values = np.where(values > noise, values, 0.0)
    total = float(np.trace(scatter)) / n
    explained = values / total if total > 0 else np.zeros_like(values)
    return Whitening(n, sums, values[:components], axes[:, :components], explained[:components], scale, offset)


def transform(df: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The rows whose vector takes part, with ``whitened`` (array of doubles, null for a component without variance) and
    ``deviation`` (decimal: exact sum over dimensions of (n * x - S)^2; null beyond 38 digits).  Columns of these names are replaced."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for places, x in model.matrices(batch.column(1)):
                z = model.project(x)
                flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)
                digits = pa.array([str(v) if v < 10**38 else None for v in model.deviations(x)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), lists, digits], ["row", "whitened", "deviation"])

    others = [c for c in df.columns if c.lower() not in ("whitened", "deviation")]
    rows = df.select(common.row_of(df, *others), F.col(common.quoted(column)).alias("v"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, whitened array<double>, deviation string")
    return out.select(*common.unpacked(df, others), "whitened", F.col("deviation").cast("decimal(38,0)").alias("deviation"))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding", depth: int = DEPTH) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, by a pass of its own.

    Components without variance are left out; 0 if there is no other.
    """
    live = model.variances > 0
    if not live.any():
        return 0.0
    rows = vectors.select(F.col(common.quoted(column)).alias("v"))
    found = _reduced(rows, lambda batch: (model.project(x)[:, live] for _, x in model.matrices(batch.column(0))), depth)
    n, _, scatter = found[int(live.sum())]
    return float(np.abs(scatter / n - np.eye(len(scatter))).max())


def whitened(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """``transform`` of a table by its own ``fit``, the model, and its ``identity_error``.

    Repeated rows stay, as do null ids and other columns.  Without vectors the table is empty and the model None.
    """
    model = fit(df, column, components)
    if model is None:
        none = df.where(F.lit(False)).withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("decimal(38,0)")})
        return none, None, 0.0
    return transform(df, model, column), model, identity_error(df, model, column)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings, a row for each component.  A deviation that no long holds is null."""
    rows, model, error = whitened(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    share = F.array(*[F.lit(float(x)) for x in (model.explained if model else ())]).cast("array<double>")
    each = rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
