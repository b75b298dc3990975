"""Toxicity by subword-bag embeddings and a linear softmax, trained together in numpy.

A segment's vector is the mean of the embeddings of its character n-grams (3 to 8, blanks mark the ends of
words), hashed into buckets; two outputs and a softmax follow.  A misspelling or a new inflection shares most
of its n-grams with words seen, hence their vectors.  A text's score is that of its worst segment of
``SEGMENT`` words, so that a long text doesn't dilute an insult.  In training a text stands for its worst
segment under the model so far, at first under the log-count ratios of n-grams in whole texts; embeddings and outputs are
updated together by Adagrad.  Every batch has an empty bag that is not toxic, so an empty text scores by a bias that was
taught what it means.

Training reads at most ``TRAIN_EACH`` labelled texts of either label and ``TRAIN_CHARS`` characters, those with the smallest
hash of their id, and all of each text.
Scoring needs of an n-gram only the difference of its two outputs, one number for each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ngrams import Characters

ORDERS = (3, 4, 5, 6, 7, 8)
BITS = 18
DIM = 8
SEGMENT = 2
#: Bounds on the texts of each label that training reads, and on the characters of each label: a text that begins below it is read whole.
TRAIN_EACH = 2000
TRAIN_CHARS = 24 << 20
EPOCHS = 6
THRESHOLD = 0.7
#: Characters scored at once.
STEP = 1 << 20


class Segments:
    """Character positions of texts, cut into segments of words."""

    def __init__(self, texts: list[str], segment: int = SEGMENT):
        import numpy as np

        self.chars = Characters(texts, lower=True)
        first, _, before = self.chars.words()
        self.n = len(texts)
        of = np.searchsorted(self.chars.starts, first, "right") - 1
        number = np.arange(len(first)) - before[of]
        heads = number % segment == 0
        #: First character of each segment and its text; texts without words have none.
        self.starts, self.texts = first[heads] - 1, of[heads]

    def features(self, bits: int = BITS):
        import numpy as np

        n = len(self.chars.codes)
        for _, bucket, counts in self.chars.grams(ORDERS, bits):
            yield np.concatenate([bucket, np.zeros(n - len(bucket), np.uint32)]), np.concatenate([counts, np.zeros(n - len(counts), bool)])

    def logits(self, table, bias: float, bits: int = BITS, features=None):
        """The difference of the two outputs for each segment."""
        import numpy as np

        if not len(self.starts):
            return np.zeros(0)
        total, count = np.zeros(len(self.chars.codes), np.float64), np.zeros(len(self.chars.codes), np.float64)
        for bucket, counts in features or self.features(bits):
            total += np.where(counts, table[bucket], 0)
            count += counts
        return np.add.reduceat(total, self.starts) / np.maximum(1, np.add.reduceat(count, self.starts)) + bias

    def worst(self, values):
        """For each text its largest value and that segment (-1 without segments)."""
        import numpy as np

        out, which = np.full(self.n, -np.inf), np.full(self.n, -1)
        if len(values):
            order = np.lexsort((values, self.texts))
            last = np.flatnonzero(np.r_[self.texts[order][1:] != self.texts[order][:-1], True])
            which[self.texts[order[last]]] = order[last]
            out[self.texts[order[last]]] = values[order[last]]
        return out, which


class Model:
    """``embeddings`` [buckets, dim], ``out`` [dim, 2], ``bias`` [2]."""

    def __init__(self, embeddings, out, bias, bits: int = BITS):
        self.embeddings, self.out, self.bias, self.bits = embeddings, out, bias, bits

    def table(self):
        """What scoring needs: each bucket's share of the difference of outputs, and the bias."""
        import numpy as np

        return (self.embeddings @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], seed: int = 7, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS) -> Model:
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.array(labels, int)
    emb = rng.uniform(-1, 1, (1 << bits, dim)) / dim
    out = np.zeros((dim, 2))
    out[:, 1] = rng.normal(0, 0.5, dim)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = Model(emb, out, np.array([0.0, np.log(share / (1 - share))]), bits)
    if len(set(labels)) < 2:
        model.out[:] = 0
        model.bias[1] = 4.0 if labels and labels[0] else -4.0
        return model
    # Texts in random order, in blocks of bounded size; n-grams are computed anew whenever a block is met.
    order, blocks, held = rng.permutation(len(texts)), [[]], 0
    for k in order:
        if held and held + len(texts[k]) > STEP // 2:
            blocks.append([])
            held = 0
        blocks[-1].append(int(k))
        held += len(texts[k])
    g_emb, g_out, g_bias = np.full((1 << bits, 1), 1e-6), np.full(out.shape, 1e-6), np.full(2, 1e-6)

    def update(rate, ids, of, label):
        label = np.r_[label, 0]  # the empty bag
        n = len(label)
        lens = np.maximum(1, np.bincount(of, minlength=n))[:, None]
        mean = np.stack([np.bincount(of, emb[ids, k], n) for k in range(dim)], 1) / lens
        z = mean @ out + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), label] -= 1
        d_out, d_bias, d_mean = mean.T @ p / n, p.mean(0), (p @ out.T) / lens
        uniq, inv = np.unique(ids, return_inverse=True)
        d_emb = np.stack([np.bincount(inv, d_mean[of, k], len(uniq)) for k in range(dim)], 1)
        g_out[:] += d_out**2
        g_bias[:] += d_bias**2
        g_emb[uniq, 0] += (d_emb**2).mean(1)
        out[:] -= rate * 0.2 * d_out / np.sqrt(g_out)
        model.bias -= rate * 0.2 * d_bias / np.sqrt(g_bias)
        emb[uniq] -= rate * d_emb / np.sqrt(g_emb[uniq])

    # How many texts of either label have an n-gram anywhere: the first guess at what is worst.
    counts_of = np.ones((2, 1 << bits))
    for members in blocks:
        seg = Segments([texts[k] for k in members])
        text_of = np.searchsorted(seg.chars.starts, np.arange(len(seg.chars.codes)), "right") - 1
        own = [np.unique(np.minimum(text_of[c], seg.n - 1).astype(np.int64) << bits | b[c]) for b, c in seg.features(bits)]
        for code in own:
            np.add.at(counts_of, (y[np.array(members)[code >> bits]], code & ((1 << bits) - 1)), 1)
    first = np.log(counts_of[1] / (1 + y.sum())) - np.log(counts_of[0] / (1 + len(y) - y.sum()))
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs) + 0.05
        for block in rng.permutation(len(blocks)):
            members = blocks[block]
            seg = Segments([texts[k] for k in members])
            if not len(seg.starts):
                continue
            features = list(seg.features(bits))
            table, bias = model.table() if epoch else (first, 0.0)
            rows = seg.worst(seg.logits(table, bias, features=features))[1]
            rows = rng.permutation(rows[rows >= 0])
            ends = np.r_[seg.starts[1:], len(seg.chars.codes)]
            for lo in range(0, len(rows), 64):
                r = rows[lo : lo + 64]
                lens = ends[r] - seg.starts[r]
                at = np.repeat(seg.starts[r] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
                own = np.repeat(np.arange(len(r)), lens)
                ids = np.concatenate([bucket[at][counts[at]] for bucket, counts in features])
                of = np.concatenate([own[counts[at]] for _, counts in features])
                if len(ids):
                    update(rate, ids, of, y[np.array(members)[seg.texts[r]]])
    return model


def score(texts: list[str], table, bias: float, bits: int = BITS):
    """Scores of whole texts; one without words has the score of an empty bag."""
    import numpy as np

    out = np.empty(len(texts))
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") < STEP):
            held += len(texts[hi] or "")
            hi += 1
        seg = Segments(texts[lo:hi])
        z, which = seg.worst(seg.logits(table, bias, bits))
        z = np.where(which < 0, bias, z)
        out[lo:hi] = 1 / (1 + np.exp(-z.clip(-30, 30)))
        lo = hi
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, each: int, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts: of each label the ids with the smallest hash, up to ``each`` texts and ``chars`` characters.

    An id whose label rows disagree has the label of most of them, 0 on a tie; one with several texts counts once for each.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg((F.avg(label) > 0.5).cast("int").alias("y"))
    some = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).select(F.col("doc_id").alias("id_"), "y")
        some = part if some is None else some.union(part)
    order = Window.partitionBy("y").orderBy(F.xxhash64("id_"), "id_", "text")
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id_"))
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    rows = rows.withColumn("before", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")).where(F.col("before") < chars)
    got = sorted(rows.select(F.xxhash64("id_"), "id_", "text", "y").collect())
    return [r.text for r in got], [int(r.y) for r in got]


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns (default ``doc_id``) and ``score`` for each row; null texts are empty, a kept ``score`` is replaced."""
    keep = [c for c in keep or ("doc_id",) if c.lower() != "score"]
    table, bias = model.table()
    shared = docs.sparkSession.sparkContext.broadcast((table, bias, model.bits))
    rows = docs.select(common.row_of(docs, *keep), F.col("text"))

    def run(batches):
        import pyarrow as pa

        t, b, bits = shared.value
        for batch in batches:
            s = score(batch.column(1).to_pylist(), t, b, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*common.unpacked(rows, keep), "score")


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels.toxic`` from rows outside the third that is held out."""
    return train(*training_rows(docs, labels, "toxic", common.remainder("doc_id", 3) == 1, TRAIN_EACH))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents.

    Null and empty texts get the score of an empty bag, repeated rows the same score each.  Without labels of both
    kinds the score is constant.  Of labels of one id that disagree most rows win, 0 on a tie.
    """
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
