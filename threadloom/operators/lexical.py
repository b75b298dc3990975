"""Keyword search: matching, BM25, the cap on candidates, an inverted index.

Statistics are those of the whole corpus whatever the filter.  ``postings`` lays the corpus out by term with the places of each
term in each file, sorted on disk; ``bm25_places`` reads the runs of a query's terms only, phrases included.  ``bm25`` does
without an index and reads the words of every passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.text import once, word_count, word_list, words as words_of
from ..plans.terms import QueryTerm

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Bytes of words that are sorted by term at once where postings are made, and rows that leave at once.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1 << 16


def _overlaps(term: QueryTerm) -> bool:
    """Whether two finds of a phrase may share tokens."""
    t = term.tokens
    same = lambda a, b: a == b or term.prefix and b.startswith(a)
    return any(all(same(x, y) for x, y in zip(t[k:], t)) or any(same(t[0], y) for y in t[k:]) for k in range(1, len(t)))


def _sign(term: QueryTerm) -> str:
    """What ``words`` holds exactly where the term occurs."""
    return " " + "  ".join(term.tokens) + ("" if term.prefix else " ")


def frequency(words: Column, term: QueryTerm) -> Column:
    """How often a term occurs in ``words``; a term without tokens never does."""
    if not term.tokens:
        return F.lit(0)
    if not _overlaps(term):
        sign = _sign(term)
        return once(words, lambda w: ((F.length(w) - F.length(F.replace(w, F.lit(sign), F.lit("")))) / len(sign)).cast("int"))
    # Finds that may share tokens are looked for at every token.
    tokens, n = word_list(words), len(term.tokens)

    def at(i: Column) -> Column:
        out = F.lit(True)
        for k, t in enumerate(term.tokens):
            x = F.get(tokens, i + k)
            out = out & (x.startswith(t) if term.prefix and k == n - 1 else x == t)
        return out

    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, at))


def matches(words: Column, terms: list[QueryTerm]) -> Column:
    """Whether any term occurs; the words are made once for all terms, and a find ends the search for its term."""

    def any_of(w: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            if t.tokens:
                out |= w.contains(_sign(t))
        return out

    return once(words, any_of)


def tokenized(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks with ``words`` and ``n_tokens``, as an index stores them."""
    made = once(words_of(F.col(text)), lambda w: F.struct(w.alias("words"), word_count(w).alias("n_tokens")))
    return chunks.withColumn("__made", made).withColumns({"words": F.col("__made.words"), "n_tokens": F.col("__made.n_tokens")}).drop("__made")


def _idf(n_rows: Column, n_with: Column) -> Column:
    raw = F.log((n_rows - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def _weight(tf: Column, n_tokens: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / mean))


def bm25(chunks: DataFrame, terms: list[QueryTerm], admitted: DataFrame | None = None) -> DataFrame:
    """``uri, ordinal, score`` of chunks that hold a term.

    Statistics are those of all ``chunks``; ``admitted`` (``uri``) says whose chunks may be returned.  Every chunk is
    read once: what the terms' counts leave of it, a few numbers, goes through an exchange that the statistics and the
    scores share.  For that both must need the same columns, and nothing may be filtered below: a chunk's score is
    positive exactly if it holds a term, and that is only known beside the statistics.
    """
    if not terms:
        return chunks.select("uri", "ordinal", F.lit(0.0).alias("score")).where(F.lit(False))
    every = range(len(terms))
    tf = [frequency(F.col("words"), t).cast("double").alias(f"tf_{i}") for i, t in enumerate(terms)]
    counted = chunks.select("uri", "ordinal", "n_tokens", *tf).repartition("uri")
    held = [F.count(F.when(F.col(f"tf_{i}") > 0, 1)).cast("double").alias(f"df_{i}") for i in every]
    stats = counted.agg(F.max(F.struct("uri", "ordinal")).alias("last"), F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("n_tokens").alias("mean_tokens"), *held)
    rows = counted if admitted is None else counted.join(admitted.select("uri"), "uri", "left_semi")
    beside = rows.crossJoin(F.broadcast(stats.where("last is not null").drop("last")))  # one row
    total = F.lit(0.0)
    for i in every:
        gain = _idf(F.col("n_rows"), F.col(f"df_{i}")) * _weight(F.col(f"tf_{i}"), F.col("n_tokens"), F.col("mean_tokens"))
        total = total + F.when(F.col(f"tf_{i}") > 0, gain).otherwise(0.0)
    return beside.select("uri", "ordinal", total.alias("score")).where("score > 0")


def candidate_cap(top: int, config: SearchConfig = SearchConfig()) -> int:
    return min(max(top * config.candidate_factor, config.candidate_floor), config.candidate_cap)


def top_passages(scored: DataFrame, cap: int) -> DataFrame:
    """The best passages, ties by place; rows are filtered before."""
    return scored.orderBy(F.desc("score"), "uri", "ordinal").limit(cap)


def postings(chunks: DataFrame) -> DataFrame:
    """``term, uri, ordinal, n_tokens, positions``: the corpus by term, to be written sorted by term in each task.

    A passage's terms are grouped where it is, in Arrow batches: gathering lists of places by an aggregation would
    sort a row for each token.  A slice's rows leave in the order of ``term, uri, ordinal``, so a sort by these has
    a few long runs to merge, whatever the rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column(3), ""))
            ends = np.cumsum(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                part, lo = part.take(pc.sort_indices(part, sort_keys=[("uri", "ascending"), ("ordinal", "ascending")])), hi
                n = part.num_rows
                lists = pc.split_pattern(pc.utf8_trim(part.column(3), " "), "  ")
                size = pc.list_value_length(lists).to_numpy()
                coded = pc.dictionary_encode(lists.flatten())
                by_term = pc.sort_indices(coded.dictionary)
                rank = np.empty(len(by_term), np.int64)
                rank[by_term.to_numpy()] = np.arange(len(by_term))
                key = rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), size)
                # Places ascend within a passage, and a stable sort keeps them so.
                order = np.argsort(key, kind="stable")
                place = (np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)[order]
                key = key[order]
                head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(key)].astype(np.int32)), pa.array(place))
                terms, of = coded.dictionary.take(by_term).take(pa.array(key[head] // n)), pa.array(key[head] % n)
                out = pa.RecordBatch.from_arrays([terms, *(part.column(k).take(of) for k in range(3)), lists], names=["term", "uri", "ordinal", "n_tokens", "positions"])
                for k in range(0, out.num_rows, SLICE_ROWS):
                    yield out.slice(k, SLICE_ROWS)

    rows = chunks.select("uri", F.col("ordinal").cast("int").alias("ordinal"), F.col("n_tokens").cast("int").alias("n_tokens"), "words")
    return rows.mapInArrow(run, "term string, uri string, ordinal int, n_tokens int, positions array<int>")


def write_by_term(rows: DataFrame, path: str) -> None:
    """Writes postings where they are made, each task's sorted by term, so that a term's row groups and pages are found by their statistics.

    Nothing is exchanged: a term has a run of rows in each file, which are as many as the texts have splits, and a
    frequent term's rows never meet in one task.
    """
    rows.sortWithinPartitions("term", "uri", "ordinal").write.mode("overwrite").parquet(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """``posting`` and ``stats`` (a row: passages and their mean length) of ``chunks`` below ``path``."""
    write_by_term(postings(chunks), f"{path}/posting")
    # Passages without a token have no posting but count; their tokens are the places of the others.
    placed = chunks.sparkSession.read.parquet(f"{path}/posting").agg(F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("n_tokens"))
    counted = chunks.agg(F.count(F.lit(1)).cast("double").alias("n_rows")).crossJoin(placed)  # one row each
    counted.select("n_rows", F.try_divide(F.col("n_tokens"), F.col("n_rows")).alias("mean_tokens")).write.mode("overwrite").parquet(f"{path}/stats")


def indexed_bm25(spark, path: str, terms: list[QueryTerm], admitted: DataFrame | None = None) -> DataFrame:
    """``bm25_places`` over what ``write_index`` wrote."""
    s = spark.read.parquet(f"{path}/stats").first()
    return bm25_places(spark.read.parquet(f"{path}/posting"), s.n_rows, s.mean_tokens or 1.0, terms, admitted)


def _hit(token: str, prefix: bool) -> Column:
    if not prefix:
        return F.col("term") == token
    return (F.col("term") >= token) & (F.col("term") < token + "\U0010ffff") & F.col("term").startswith(token)


def bm25_places(index: DataFrame, n_rows: float, mean_tokens: float, terms: list[QueryTerm], admitted: DataFrame | None = None) -> DataFrame:
    """``uri, ordinal, score`` as ``bm25`` gives them, from the index: only its rows of the query's tokens are read.

    A phrase is where each token's places follow on those of the one before.
    """
    terms = [t for t in terms if t.tokens]
    if not terms:
        return index.select("uri", "ordinal", F.lit(0.0).alias("score")).where(F.lit(False))
    wanted = sorted({(x, t.prefix and k == len(t.tokens) - 1) for t in terms for k, x in enumerate(t.tokens)})
    any_hit = F.lit(False)
    for token, prefix in wanted:
        any_hit |= _hit(token, prefix)
    none = F.array().cast("array<int>")
    gathered = []
    for i, t in enumerate(terms):
        if len(t.tokens) == 1:
            gathered.append(F.sum(F.when(_hit(t.tokens[0], t.prefix), F.size("positions")).otherwise(0)).cast("double").alias(f"tf_{i}"))
        for k, x in enumerate(t.tokens if len(t.tokens) > 1 else ()):
            gathered.append(F.flatten(F.collect_list(F.when(_hit(x, t.prefix and k == len(t.tokens) - 1), F.col("positions")))).alias(f"at_{i}_{k}"))

    def followed(i: int, t: QueryTerm) -> Column:
        def at(p: Column) -> Column:
            out = F.lit(True)
            for k in range(1, len(t.tokens)):
                out = out & F.array_contains(F.col(f"at_{i}_{k}"), p + k)
            return out

        return F.size(F.filter(F.coalesce(F.col(f"at_{i}_0"), none), at)).cast("double").alias(f"tf_{i}")

    # One exchange for the passages' counts and for the statistics, as in bm25.
    rows = index.where(any_hit).groupBy("uri", "ordinal").agg(F.first("n_tokens").alias("n_tokens"), *gathered)
    counted = rows.select("uri", "ordinal", "n_tokens", *[F.col(f"tf_{i}") if len(t.tokens) == 1 else followed(i, t) for i, t in enumerate(terms)])
    held = [F.count(F.when(F.col(f"tf_{i}") > 0, 1)).cast("double").alias(f"df_{i}") for i in range(len(terms))]
    stats = counted.agg(F.max(F.struct("uri", "ordinal", "n_tokens")).alias("last"), *held)
    beside = counted.crossJoin(F.broadcast(stats.where("last is not null").drop("last")))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        gain = _idf(F.lit(float(n_rows)), F.col(f"df_{i}")) * _weight(F.col(f"tf_{i}"), F.col("n_tokens"), F.lit(float(mean_tokens)))
        total = total + F.when(F.col(f"tf_{i}") > 0, gain).otherwise(0.0)
    scored = beside.select("uri", "ordinal", total.alias("score")).where("score > 0")
    return scored if admitted is None else scored.join(admitted.select("uri"), "uri", "left_semi")


def bm25_postings(index: DataFrame, n_rows: float, mean_tokens: float, terms: list[QueryTerm], admitted: DataFrame | None = None) -> DataFrame:
    """``bm25_places`` for terms of single tokens, which need no places; phrases are refused."""
    if any(len(t.tokens) > 1 for t in terms):
        raise ValueError("phrases need places: use bm25_places")
    return bm25_places(index, n_rows, mean_tokens, terms, admitted)


def live_scan(turns: DataFrame, terms: list[str], sessions: DataFrame, limit: int = 400, snippets: int = 3) -> tuple[DataFrame, DataFrame]:
    """Search without an index: (``uri, score, hits``, snippets) of the first ``limit`` sessions.

    A turn counts the distinct terms it holds, whatever their case; a session sums its turns.
    """
    if not terms:
        empty = turns.where(F.lit(False))
        return empty.select("uri", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("hits")), empty
    wanted = sorted({t.lower() for t in terms})
    low = F.lower("text")
    count = sum((F.coalesce(low.contains(t), F.lit(False)).cast("int") for t in wanted), F.lit(0))
    first = sessions.orderBy(F.desc_nulls_last("updated_at"), "uri").limit(limit).select("uri")
    hit = turns.join(first, "uri", "left_semi").withColumn("n", count).where("n > 0")
    scores = hit.groupBy("uri").agg((F.sum("n") / len(wanted)).alias("score"), F.sum("n").alias("hits"))
    from pyspark.sql import Window

    shown = hit.withColumn("r", F.row_number().over(Window.partitionBy("uri").orderBy("turn_index"))).where(F.col("r") <= snippets)
    return scores, shown
