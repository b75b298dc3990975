"""The engine's tables over the given ones, as DataFrames and as SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import derive_title, preview
from ..operators import fetch, lexical
from ..operators.lexical import tokenized
from ..plans import scratch

NOW = datetime(2024, 3, 1)
NOW_SQL = "TIMESTAMP '2024-03-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt to all cores where their files have fewer splits than there are.

    A large table has splits enough and is left as it is.
    """
    docs = table(spark, sf_dir, "documents")
    n = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= n else docs.repartition(n, "doc_id")


def sessions(spark: SparkSession, d: str, dealt: bool = True) -> DataFrame:
    """A session for each document.  What reads few columns need not have the texts ``dealt`` to all cores."""
    docs, labels = texts(spark, d) if dealt else table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "toxic")
    i = F.col("doc_id")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 1440 as int))")
    # What is made of texts is made below the join, which large labels turn into an exchange: texts are not sent.
    made = docs.select(
        i,
        F.concat(F.lit("doc://"), "source", F.lit("/"), i.cast("string")).alias("uri"),
        F.col("source").alias("source_id"),
        i.cast("string").alias("native_id"),
        derive_title(F.col("text")).alias("title"),
        preview(F.col("text"), 200).alias("preview"),
        F.concat(F.lit("C:\\work\\"), "source", F.lit("\\"), "lang", F.lit("/")).alias("workspace_path"),
        F.concat(F.lit("Org/"), "source").alias("repository"),
        F.when(i % 3 == 0, "Main").when(i % 3 == 1, "dev").alias("branch"),
        F.col("lang").alias("agent"),
        F.when(i % 4 == 0, F.array(F.lit("Model-A"), F.lit("model-b"))).when(i % 4 == 1, F.array(F.lit("model-c"))).otherwise(F.array().cast("array<string>")).alias("models"),
        at.alias("created_at"),
        (at + F.expr("make_dt_interval(0, 0, cast(doc_id % 60 as int))")).alias("updated_at"),
        F.when(i % 7 != 0, F.col("n_chars").cast("int")).alias("message_count"),
        F.md5("text").alias("content_hash"),
        "text",
    )
    archived = F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_archived")
    first = made.columns[: made.columns.index("content_hash")]
    return made.join(labels, "doc_id", "left").select(*first, archived, "content_hash", "text")


def sql_flatten(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def sql_truncate(c: str, n: int) -> str:
    w = max(1, n // 5)
    tail = f"substr({c}, {n - w + 1}, {w})"
    back = f"instr(reverse({tail}), ' ')"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(substr({c}, 1, CASE WHEN {back} > 0 AND {back} < {n} THEN {n} - {back} ELSE {n} END)) || '…' END"


def sql_title(c: str, n: int = 80) -> str:
    stop = f"length(regexp_extract(substr({c}, 1, {n}), '^[^.?!]*[.?!]'))"
    return f"CASE WHEN length({c}) = 0 THEN '(untitled session)' WHEN {stop} > 13 THEN substr({c}, 1, {stop}) ELSE {sql_truncate(c, n)} END"


SQL_TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"

SESSION = rf"""
docs AS (
  SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, {sql_flatten("d.text")} AS flat, coalesce(l.toxic = 1, false) AS is_archived
  FROM documents d LEFT JOIN labels l USING (doc_id)
),
session AS (
  SELECT doc_id, 'doc://' || source || '/' || doc_id AS uri, source AS source_id, CAST(doc_id AS VARCHAR) AS native_id,
    {sql_title("flat")} AS title, {sql_truncate("flat", 200)} AS preview,
    'C:\work\' || source || '\' || lang || '/' AS workspace_path, 'Org/' || source AS repository,
    CASE WHEN doc_id % 3 = 0 THEN 'Main' WHEN doc_id % 3 = 1 THEN 'dev' END AS branch, lang AS agent,
    CASE WHEN doc_id % 4 = 0 THEN ['Model-A', 'model-b'] WHEN doc_id % 4 = 1 THEN ['model-c'] ELSE [] END AS models,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 1440 AS INTEGER)) AS created_at,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 1440 AS INTEGER)) + to_minutes(CAST(doc_id % 60 AS INTEGER)) AS updated_at,
    CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars AS INTEGER) END AS message_count, is_archived, md5(text) AS content_hash, text
  FROM docs
)"""


def tags(spark: SparkSession, d: str) -> DataFrame:
    """``uri, tag`` from labels."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    named = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("Good")), F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("doc_id") % 5 == 0, F.lit("five"))))
    return j.select(F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("uri"), F.explode(named).alias("tag"))


TAG = """
tag AS (
  SELECT uri, unnest(list_filter([CASE WHEN quality = 1 THEN 'Good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 5 = 0 THEN 'five' END], lambda x: x IS NOT NULL)) AS tag
  FROM (SELECT 'doc://' || d.source || '/' || doc_id AS uri, l.quality, l.toxic, doc_id FROM labels l JOIN documents d USING (doc_id))
)"""


def passages(spark: SparkSession, d: str) -> DataFrame:
    """A passage for each document, with its words, as the index holds them."""
    docs = texts(spark, d).select(
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("uri"), F.lit(0).alias("ordinal"), F.col("source").alias("source_id"),
        "doc_id", "text",
    )
    return tokenized(docs).drop("text")


def index(spark: SparkSession, d: str) -> str:
    """Where the passages' inverted index and their texts by ``uri`` are; they are written when a session first needs them."""

    def build(path: str) -> None:
        lexical.write_index(passages(spark, d), path)
        uri = F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string"))
        fetch.write_clustered(table(spark, d, "documents").select(uri.alias("uri"), "text"), f"{path}/text", "uri")

    return scratch.built(spark, f"index of {d}", build)


def passage_texts(spark: SparkSession, d: str, uris: list[str]) -> DataFrame:
    """``uri, text`` of a few passages."""
    return fetch.few(spark.read.parquet(f"{index(spark, d)}/text"), "uri", uris)


PASSAGE = f"""
passage AS (
  SELECT 'doc://' || source || '/' || doc_id AS uri, 0 AS ordinal, source AS source_id, doc_id, toks AS tokens, len(toks) AS n_tokens
  FROM (SELECT *, {SQL_TOKENS} AS toks FROM documents)
)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """``uri, turn_index, role, text`` of conversations."""
    return table(spark, d, "conversations").select(
        F.concat(F.lit("conv://"), F.col("conv_id").cast("string")).alias("uri"), "conv_id", F.col("turn").cast("int").alias("turn_index"), "role", "text"
    )


TURN = "turns AS (SELECT 'conv://' || conv_id AS uri, conv_id, CAST(turn AS INTEGER) AS turn_index, role, text FROM conversations)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Passage vectors: ``uri`` by label, ``ordinal`` by id."""
    return table(spark, d, "embeddings").select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("uri"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))


VECTOR = "vec AS (SELECT 's' || label AS uri, vec_id AS ordinal, embedding AS vector FROM embeddings)"


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> DataFrame:
    """A row: the vector asked for."""
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))
