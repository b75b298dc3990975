"""Multisets of words, and sketches held against exact counts.  The reference has neither; they are offered beside its operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import multisets, sketches
from . import query
from .bindings import table

_DOCUMENT_WORDS = "SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents"
_PAGE_WORDS = "SELECT unnest(regexp_extract_all(html, '[A-Za-z]+')) AS word FROM pages"


def _words(spark, d):
    each = lambda name, c: table(spark, d, name).select(F.explode(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return each("documents", "text"), each("pages", "html")


@query("words_intersect_all", f"{_DOCUMENT_WORDS} INTERSECT ALL {_PAGE_WORDS}")
def words_intersect_all(spark, d):
    return multisets.intersect_all(*_words(spark, d))


@query("words_except_all", f"{_PAGE_WORDS} EXCEPT ALL {_DOCUMENT_WORDS}")
def words_except_all(spark, d):
    documents, pages = _words(spark, d)
    return multisets.except_all(pages, documents)


@query("words_union_distinct", f"{_DOCUMENT_WORDS} UNION {_PAGE_WORDS}")
def words_union_distinct(spark, d):
    return multisets.union_distinct(*_words(spark, d))


@query(
    "words_union_most",
    f"SELECT word, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM (SELECT word, count(*) AS n FROM ({_DOCUMENT_WORDS}) GROUP BY word) a FULL JOIN (SELECT word, count(*) AS n FROM ({_PAGE_WORDS}) GROUP BY word) b USING (word)",
)
def words_union_most(spark, d):
    return multisets.union_most(*_words(spark, d)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_words_sketched", "SELECT source, count(DISTINCT word) AS n, true AS close FROM (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY source")
def distinct_words_sketched(spark, d):
    """Distinct words by source, from sketches by source and language, within a tenth of the exact numbers."""
    words = table(spark, d, "documents").select("source", "lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    parts = words.groupBy("source", "lang").agg(sketches.keys(F.col("word")).alias("s"))
    merged = parts.groupBy("source").agg(sketches.estimate(sketches.merged_keys(F.col("s"))).alias("about"))
    exact = words.groupBy("source").agg(F.countDistinct("word").alias("n"))
    return exact.join(merged, "source").select("source", "n", (F.abs(F.col("about") - F.col("n")) <= F.col("n") * 0.1).alias("close"))


@query("length_quantiles_sketched", "SELECT source, count(n_chars) AS n, true AS median_close, true AS high_close FROM documents GROUP BY source HAVING count(n_chars) > 0")
def length_quantiles_sketched(spark, d):
    """Median and 90th percentile of lengths by source, from sketches by source and language: their exact ranks are within 0.03."""
    docs = table(spark, d, "documents").select("source", "lang", "n_chars").where("n_chars is not null")
    parts = docs.groupBy("source", "lang").agg(sketches.distribution(F.col("n_chars")).alias("s"))
    merged = parts.groupBy("source").agg(sketches.merged_distribution(F.col("s")).alias("s"))
    about = merged.select("source", sketches.quantile(F.col("s"), 0.5).alias("half"), sketches.quantile(F.col("s"), 0.9).alias("high"))
    rank = lambda c: (F.sum((F.col("n_chars") < F.col(c)).cast("int")) / F.count(F.lit(1)), F.sum((F.col("n_chars") <= F.col(c)).cast("int")) / F.count(F.lit(1)))
    close = lambda c, at: (rank(c)[0] <= at + 0.03) & (rank(c)[1] >= at - 0.03)
    return docs.join(about, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), close("half", 0.5).alias("median_close"), close("high", 0.9).alias("high_close"))


@query("live_documents_sketched", "SELECT source, count(DISTINCT doc_id) AS n, true AS close FROM documents WHERE doc_id % 3 = 1 OR doc_id % 3 = 0 AND doc_id % 2 <> 0 GROUP BY source")
def live_documents_sketched(spark, d):
    """Documents that are live after two generations, the second of which drops some of the first: by subtracting sketches."""
    docs, i = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("id"), "doc_id"), F.col("doc_id")
    some = lambda c: sketches.keys(F.when(c, F.col("id")))
    sets = docs.groupBy("source").agg(some(i % 3 == 0).alias("a"), some(i % 6 == 0).alias("gone"), some(i % 3 == 1).alias("b"), some(F.lit(False)).alias("none"))
    steps = F.array(F.struct(F.col("a").alias("has"), F.col("none").alias("gone")), F.struct(F.col("b").alias("has"), F.col("gone").alias("gone")))
    about = sets.select("source", sketches.estimate(sketches.live(steps, F.col("none"))).alias("about"))
    exact = docs.where((i % 3 == 1) | (i % 3 == 0) & (i % 2 != 0)).groupBy("source").agg(F.countDistinct("doc_id").alias("n"))
    return exact.join(about, "source").select("source", "n", (F.abs(F.col("about") - F.col("n")) <= F.col("n") * 0.1).alias("close"))
