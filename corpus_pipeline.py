"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

toxicity: documents scored as toxic go.  near duplicates: of texts alike in four fifths of
their five-word shingles the smallest doc_id stays.
decontamination: documents that hold benchmark passages go.  personal data: mentions become surrogates.
packing: what is left is packed into token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common, decontamination, packing, pii, simhash, toxicity

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, all columns."""
    common.ship_package(spark)
    model = toxicity.fitted(docs, common.table(spark, sf_dir, "labels"))
    kept = toxicity.scored(docs.select(common.row_of(docs), "text"), model, "row")
    return kept.where(F.col("score") < toxicity.THRESHOLD).select(*common.unpacked(kept, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest doc_id."""
    common.ship_package(spark)
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make less than a twentieth, or nothing."""
    judged = decontamination.contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    # Written first, so that its size is known before the texts would be sent to meet it.
    bad = common.staged(judged.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    rows = docs.select(common.row_of(docs), F.col("doc_id").cast("long").alias("id_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash_"))
    kept = rows.join(common.small(bad), F.col("id_").eqNullSafe(F.col("bad_id")) & (F.col("hash_") == F.col("bad_hash")), "left_anti")
    return kept.select(*common.unpacked(kept, docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates; n_chars follows the new text."""
    common.ship_package(spark)
    rows = docs.select(common.row_of(docs, *[c for c in docs.columns if c != "text"]), "doc_id", "text")
    out = pii.pseudonymised(rows, pii.key_of(spark))
    out = out.select(*[F.col("text") if c == "text" else common.unpacked(out, [c])[0] for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids."""
    common.ship_package(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir))
    return docs
