"""Token encoders against one row at a time; files that are not what they claim."""

import hashlib
import random

import numpy as np
import pytest

from threadloom.config import EngineError
from threadloom.plans import encoders

TABLE = np.random.default_rng(5).normal(size=(50, 8))


def tokenize(text):
    return [1 + sum(w.encode()) % 49 for w in text.split()]


def encode(ids, mask):
    states = TABLE[ids]
    # What attends to a whole row must not see its padding.
    return states + (states * mask[:, :, None]).sum(axis=1, keepdims=True) / np.maximum(mask.sum(axis=1), 1)[:, None, None]


def one_by_one(text, kind, query):
    ids = tokenize((kind.query_prefix if query else kind.passage_prefix) + text)[:512] if text else []
    if not ids:
        return np.zeros(8)
    states = TABLE[ids] + TABLE[ids].mean(axis=0)
    v = states[0] if kind.pooling == "cls" else states.mean(axis=0)
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("name", ["bge-small-en-v1.5", "all-MiniLM-L6-v2", "multilingual-e5-small"])
@pytest.mark.parametrize("query", [False, True])
def test_batches_equal_single_rows(name, query):
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(draw.choice([1, 3, 40, 900]))) for _ in range(80)] + ["", None]
    e = encoders.TokenEncoder(name, tokenize, encode, 8, cells=2000)
    got = np.array(e.vectors(texts, query))
    assert np.allclose(got, [one_by_one(t or "", e.kind, query) for t in texts])
    in_order = sum(512 - min(512, len(t.split())) for t in texts if t)
    assert e.padding < 0.15 * e.tokens < in_order


def test_vectors_in_tasks(spark):
    rows = spark.createDataFrame([("u", k, "a b " * k) for k in range(30)], "uri string, ordinal int, text string").repartition(3)
    e = encoders.TokenEncoder("all-MiniLM-L6-v2", tokenize, encode, 8)
    got = {r.ordinal: r.vector for r in e.embed(rows).collect()}
    assert all(np.allclose(got[k], one_by_one("a b " * k, e.kind, False), atol=1e-6) for k in range(30))


def test_files_are_checked_and_sent_once(spark, tmp_path):
    path, body = tmp_path / "model.onnx", b"weights" * 1000
    path.write_bytes(body)
    digest = hashlib.sha256(body).hexdigest()
    with pytest.raises(EngineError, match="bytes"):
        encoders.send_file(spark, str(path), len(body) + 1, digest)
    with pytest.raises(EngineError, match="digest"):
        encoders.send_file(spark, str(path), len(body), "0" * 64)
    name = encoders.send_file(spark, str(path), len(body), digest)

    def read(batches):
        import pyarrow as pa

        for b in batches:
            with open(encoders.worker_file(name), "rb") as f:
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(f.read())] * b.num_rows)})

    assert {r.n for r in spark.range(4).mapInArrow(read, "n long").collect()} == {len(body)}
    path.unlink()
    assert encoders.send_file(spark, str(path), len(body), digest) == name
