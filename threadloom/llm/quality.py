"""Quality by naive Bayes support vectors (Wang and Manning, 2012).

A text is the set of its n-grams: characters (2 and 3) and word shapes (1 to 4; a shape tells a word's cases, its
ends, its size, and whether it repeats the word before), hashed into buckets.  An indicator is scaled by the
bucket's log-count ratio between the two labels; on these a linear hinge-loss model is fitted by dual
coordinate descent (Hsieh et al., 2008).  Rows have unit length, so long texts count as short ones do.  Platt's
sigmoid, fitted on a fifth of the sample that the weights did not see, turns margins into scores.

Training reads at most ``TRAIN_EACH`` labelled texts of either label, those with the smallest hash of their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ngrams import Characters, mixed
from .toxicity import training_rows

CHARACTER_ORDERS = (2, 3)
SHAPE_ORDERS = (1, 2, 3, 4)
#: Buckets of either family: two families make ``2 ** (BITS + 1)``.
BITS = 15
TRAIN_EACH = 3000
COST = 1.0
PASSES = 12
THRESHOLD = 0.3
STEP = 1 << 20


def indicators(texts: list[str], bits: int = BITS):
    """For each text the sorted distinct buckets of its n-grams."""
    import numpy as np

    lo = 0
    flag = np.zeros(2 << bits, bool)
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") < STEP):
            held += len(texts[hi] or "")
            hi += 1
        chars = Characters(texts[lo:hi], lower=False)
        grams = [(bucket, counts) for _, bucket, counts in chars.grams(CHARACTER_ORDERS, bits)]
        first, past, before = chars.words()
        shapes = chars.shapes(first, past)
        runs = []
        h = shapes.copy()
        for k in range(1, max(SHAPE_ORDERS) + 1):
            if k > 1:
                h = h[: len(shapes) - k + 1] * np.uint32(0x01000193) + shapes[k - 1 :] if len(shapes) >= k else h[:0]
            runs.append((k, mixed(h + np.uint32(101 * k), bits).astype(np.int64) + (1 << bits)))
        for i in range(hi - lo):
            a, b = chars.starts[i], chars.starts[i + 1] + 1
            for k, (bucket, counts) in zip(CHARACTER_ORDERS, grams):
                end = max(a, min(b - k + 1, len(bucket)))
                flag[bucket[a:end][counts[a:end]]] = True
            a, b = before[i], before[i + 1]
            for k, bucket in runs:
                flag[bucket[a : max(a, b - k + 1)]] = True
            found = np.flatnonzero(flag)
            flag[found] = False
            yield found
        lo = hi


def log_count_ratio(rows: list, labels, size: int, alpha: float = 1.0):
    """log of the smoothed shares of the buckets in the two labels."""
    import numpy as np

    p, q = np.full(size, alpha), np.full(size, alpha)
    for r, y in zip(rows, labels):
        (p if y else q)[r] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list, values: list, labels, size: int, cost: float = COST, passes: int = PASSES, seed: int = 3):
    """Weights and bias of the L2-regularised hinge loss; ``labels`` 0 or 1, classes weighted to be even."""
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    n = len(y)
    share = {s: max(1, (y == s).sum()) for s in (1.0, -1.0)}
    cap = np.array([cost * n / (2 * share[s]) for s in y])
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(n)
    norm = np.array([v @ v + 1 for v in values])
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(n):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cap[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def platt(margins, labels) -> tuple[float, float]:
    """(a, b) of ``1 / (1 + exp(-(a m + b)))`` by Newton's method on smoothed targets."""
    import numpy as np

    m, y = np.asarray(margins, float), np.asarray(labels, float)
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * m + b).clip(-30, 30)))
        g = np.array([(p - t) @ m, (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(s * m) @ m + 1e-3, s @ m], [s @ m, s.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Bucket weights (ratio times weight), the ratio itself for lengths, bias and sigmoid."""

    def __init__(self, weights, ratio, bias: float, a: float, b: float, bits: int = BITS):
        self.weights, self.ratio, self.bias, self.a, self.b, self.bits = weights, ratio, bias, a, b, bits

    def margins(self, rows):
        import numpy as np

        square = self.ratio**2
        return np.array([self.weights[r].sum() / max(np.sqrt(square[r].sum()), 1e-12) + self.bias for r in rows])

    def score(self, texts: list[str]):
        import numpy as np

        m = self.margins(indicators(texts, self.bits))
        return 1 / (1 + np.exp(-(self.a * m + self.b).clip(-30, 30)))


def train(texts: list[str], labels: list[int], bits: int = BITS) -> Model:
    import numpy as np

    size = 2 << bits
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, 4.0 if not labels or labels[0] else -4.0, bits)
    rows = [r.astype(np.int32) for r in indicators(texts, bits)]
    fold = np.arange(len(rows)) % 5 == 4
    if min((y[fold] == 0).sum(), (y[fold] == 1).sum(), (y[~fold] == 0).sum(), (y[~fold] == 1).sum()) < 3:
        fold[:] = False
    fit = np.flatnonzero(~fold)
    ratio = log_count_ratio([rows[i] for i in fit], y[fit], size)

    def scaled(r):
        v = ratio[r]
        return v / max(np.sqrt(v @ v), 1e-12)

    w, bias = dual_coordinate_descent([rows[i] for i in fit], [scaled(rows[i]) for i in fit], y[fit], size)
    model = Model((w * ratio).astype(np.float32), ratio.astype(np.float32), bias, 1.0, 0.0, bits)
    held = np.flatnonzero(fold) if fold.any() else fit
    model.a, model.b = platt(model.margins([rows[i] for i in held]), y[held])
    return model


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns (default ``doc_id``) and ``score`` for each row; null texts are empty, a kept ``score`` is replaced."""
    keep = [c for c in keep or ("doc_id",) if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratio, model.bias, model.a, model.b, model.bits))
    rows = docs.select(common.row_of(docs, *keep), F.col("text"))

    def run(batches):
        import pyarrow as pa

        m = Model(*shared.value)
        for batch in batches:
            s = m.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*common.unpacked(rows, keep), "score")


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels.quality`` from rows outside the fifth that is held out."""
    return train(*training_rows(docs, labels, "quality", common.remainder("doc_id", 5) == 0, TRAIN_EACH))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents.

    Null and empty texts are sets without n-grams and score by the bias alone, repeated rows the same score each.
    Without labels of both kinds the score is constant.  Of labels of one id that disagree most rows win, 0 on a tie.
    """
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
