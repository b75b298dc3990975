"""Model files that are what they claim to be, and vectors from a token encoder.

A file is checked by size and SHA-256 before Spark's file server hands it to executors, once for each digest.  The
encoder itself is pluggable: whatever turns padded ids and a mask into a vector for each token.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from ..config import EngineError
from .embedding import Embedder, model_kind

#: (application, digest): the name under which workers find the file.
_sent: dict[tuple[str, str], str] = {}


def digest_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def send_file(spark: SparkSession, path: str, size: int, sha256: str) -> str:
    """Sends a file to the executors if it has this size and digest; returns the name for ``worker_file``.

    A file that differs is refused.  What has been sent once in an application is neither read nor sent again.
    """
    key = spark.sparkContext.applicationId, sha256.lower()
    if key in _sent:
        return _sent[key]
    found = os.path.getsize(path)
    if found != size:
        raise EngineError(f"{path} has {found} bytes instead of {size}: it is torn or another file")
    if digest_of(path) != key[1]:
        raise EngineError(f"{path} does not have the digest {key[1]}")
    name = key[1] + os.path.splitext(path)[1]
    # A copy of that name: Spark follows links, and files of two models may have one name.
    copy = os.path.join(tempfile.mkdtemp(prefix="threadloom-"), name)
    shutil.copyfile(path, copy)
    spark.sparkContext.addFile(copy)
    _sent[key] = name
    return name


def worker_file(name: str) -> str:
    """Where a worker, or the driver, has a file that was sent."""
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def batches_by_length(lengths: list[int], cells: int) -> list[list[int]]:
    """Places of texts in batches of like length, each of at most ``cells`` tokens with padding, or of one text."""
    out: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: (lengths[k], k)):
        # The longest comes last, and all are padded to it.
        if not out or (len(out[-1]) + 1) * max(1, lengths[k]) > cells:
            out.append([])
        out[-1].append(k)
    return out


class TokenEncoder(Embedder):
    """Vectors by a token encoder: prefix, ids, batches of like length, pooling as the model wants it, unit length.

    ``tokenize`` gives a text's ids; ``encode`` takes ids and a mask (both ``[batch, longest]``, padding 0) and gives a vector for
    each token.  Ids beyond ``most`` are cut off, as the models do.  A text without ids has the vector of zeros.
    """

    def __init__(self, name: str, tokenize: Callable[[str], list[int]], encode: Callable[[np.ndarray, np.ndarray], np.ndarray], dimensions: int, most: int = 512, cells: int = 1 << 14):
        self.name, self.kind, self.dimensions = name, model_kind(name), dimensions
        self.tokenize, self.encode, self.most, self.cells = tokenize, encode, most, cells
        #: Tokens and padding of all batches so far.
        self.tokens = self.padding = 0

    def _pooled(self, states: np.ndarray, mask: np.ndarray) -> np.ndarray:
        if self.kind.pooling == "cls":
            v = states[:, 0] * mask[:, :1]
        else:
            v = (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def vectors(self, texts: list[str], query: bool = False) -> list[list[float]]:
        prefix = self.kind.query_prefix if query else self.kind.passage_prefix
        ids = [self.tokenize(prefix + t)[: self.most] if t else [] for t in texts]
        out = np.zeros((len(texts), self.dimensions))
        for batch in batches_by_length([len(x) for x in ids], self.cells):
            longest = max(len(ids[k]) for k in batch)
            if not longest:
                continue
            padded, mask = np.zeros((len(batch), longest), np.int64), np.zeros((len(batch), longest))
            for row, k in enumerate(batch):
                padded[row, : len(ids[k])], mask[row, : len(ids[k])] = ids[k], 1
            out[batch] = self._pooled(np.asarray(self.encode(padded, mask), float), mask)
            self.tokens += int(mask.sum())
            self.padding += int(mask.size - mask.sum())
        return out.tolist()
