"""Text to vectors: an interface, and a model that needs no files."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.text import TOKEN, fold_text


@dataclass(frozen=True)
class KnownModel:
    """A model's traits: how its tokens are pooled, and what stands before queries and passages."""

    name: str
    dimensions: int
    pooling: str
    query_prefix: str = ""
    passage_prefix: str = ""


#: Fixed values of public embedding models.
KNOWN_MODELS = {
    m.name: m
    for m in (
        KnownModel("bge-small-en-v1.5", 384, "cls", "Represent this sentence for searching relevant passages: "),
        KnownModel("all-MiniLM-L6-v2", 384, "mean"),
        KnownModel("multilingual-e5-small", 384, "mean", "query: ", "passage: "),
    )
}


def model_kind(name: str) -> KnownModel:
    """A model's traits by its name, guessed from it where it is not known."""
    if name in KNOWN_MODELS:
        return KNOWN_MODELS[name]
    low = name.lower()
    if "bge" in low:
        return KnownModel(name, 384, "cls", KNOWN_MODELS["bge-small-en-v1.5"].query_prefix)
    if "e5" in low.split("-") or "-e5" in low:
        return KnownModel(name, 384, "mean", "query: ", "passage: ")
    return KnownModel(name, 384, "mean")


class Embedder(ABC):
    """Unit vectors of texts; a batch is embedded at once within a worker."""

    name = ""
    dimensions = 0

    @abstractmethod
    def vectors(self, texts: list[str], query: bool = False) -> list[list[float]]: ...

    def embed(self, rows: DataFrame) -> DataFrame:
        """``uri, ordinal, vector`` of ``uri, ordinal, text`` rows."""
        me = self

        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(me.vectors(b.column(2).to_pylist()), pa.list_(pa.float32()))], names=["uri", "ordinal", "vector"])

        return rows.select("uri", "ordinal", "text").mapInArrow(run, "uri string, ordinal int, vector array<float>")


class HashedWords(Embedder):
    """A bag of words, each hashed to a dimension and a sign; stands in where no model is at hand."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.name = dimensions, f"hashed-words-{dimensions}"

    def vectors(self, texts: list[str], query: bool = False) -> list[list[float]]:
        import re
        import zlib

        run = re.compile(TOKEN.replace(r"\p{L}\p{N}", r"^\W_"))
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for w in run.findall(fold_text(text or "")):
                h = zlib.crc32(w.encode())
                v[h % self.dimensions] += 1.0 if h >> 16 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out
