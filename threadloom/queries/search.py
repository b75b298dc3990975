"""Keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SearchConfig, SessionFilter
from ..functions.text import derive_title
from ..functions.vectors import centroids, cosine, dot, normalize
from ..operators import fetch, filters, fusion, lexical, semantic, snippets
from ..plans.terms import parse
from . import query
from .bindings import index, NOW, NOW_SQL, PASSAGE, SESSION, TURN, VECTOR, passage_texts, passages, query_vector, sessions, table, turns, vectors

#: Terms asked for, as text and as SQL conditions on the token ``t``.
TEXT = 'the tion shwhbl "the of" éler'
TERMS = parse("tion nthe estionr")


def _tf(cond: str) -> str:
    return f"len(list_filter(tokens, lambda t: {cond}))"


_TF = [_tf("starts_with(t, 'tion')"), _tf("starts_with(t, 'nthe')"), _tf("starts_with(t, 'estionr')")]


def _bm25_sql(tfs: list[str], where: str = "true", extra: str = "") -> str:
    cols = ", ".join(f"CAST({t} AS DOUBLE) AS tf{i}" for i, t in enumerate(tfs))
    dfs = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(tfs)))
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END"
    gain = " + ".join(f"CASE WHEN tf{i} > 0 THEN {idf(i)} * (tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n_tokens / mean))) ELSE 0 END" for i in range(len(tfs)))
    hit = " + ".join(f"tf{i}" for i in range(len(tfs)))
    return f"""{PASSAGE},
counted AS (SELECT uri, ordinal, source_id, doc_id, n_tokens, {cols} FROM passage),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(n_tokens) AS mean, {dfs} FROM counted),
scored AS (SELECT uri, ordinal, source_id, doc_id, {gain} AS score FROM counted, stats WHERE {hit} > 0 AND {where}){extra}"""


_RANKED = """,
lex AS (SELECT * FROM scored ORDER BY score DESC, uri, ordinal LIMIT {cap}),
ranks AS (SELECT uri, row_number() OVER (ORDER BY s DESC, uri) AS rank FROM (SELECT uri, max(score) AS s FROM lex GROUP BY uri))"""


@query("match_prefix", f"WITH {PASSAGE} SELECT doc_id, CAST({_tf(chr(115) + 'tarts_with(t, ' + chr(39) + 'tion' + chr(39) + ')')} AS BIGINT) AS tf FROM passage WHERE {_tf(chr(115) + 'tarts_with(t, ' + chr(39) + 'tion' + chr(39) + ')')} > 0")
def match_prefix(spark, d):
    tf = lexical.frequency(F.col("words"), parse("tion")[0])
    return passages(spark, d).select("doc_id", tf.cast("bigint").alias("tf")).where("tf > 0")


_PHRASE = "CAST(len(list_filter(generate_series(1, len(tokens) - 1), lambda i: tokens[i] = 'of' AND tokens[i + 1] = 'the')) AS BIGINT)"


@query("match_phrase", f"WITH {PASSAGE} SELECT doc_id, {_PHRASE} AS tf FROM passage WHERE len(tokens) >= 2 AND {_PHRASE} > 0")
def match_phrase(spark, d):
    tf = lexical.frequency(F.col("words"), parse('"of the"')[0])
    return passages(spark, d).select("doc_id", tf.cast("bigint").alias("tf")).where("tf > 0")


@query("match_or", f"WITH {PASSAGE} SELECT doc_id FROM passage WHERE {_TF[1]} > 0 OR {_TF[2]} > 0 OR len(list_filter(tokens, lambda t: t = 'le')) > 0")
def match_or(spark, d):
    return passages(spark, d).where(lexical.matches(F.col("words"), parse('nthe estionr "le"'))).select("doc_id")


@query("bm25_topk", f"WITH {_bm25_sql(_TF)} SELECT uri, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, uri LIMIT 400")
def bm25_topk(spark, d):
    rows = lexical.indexed_bm25(spark, index(spark, d), TERMS)
    return lexical.top_passages(rows, lexical.candidate_cap(20)).select("uri", F.round("score", 6).alias("score"))


@query("bm25_filtered_cap", f"WITH {_bm25_sql(_TF, where=chr(10) + 'source_id IN (' + chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src2' + chr(39) + ')')} SELECT uri, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, uri LIMIT 50")
def bm25_filtered(spark, d):
    admitted = sessions(spark, d, dealt=False).where(F.col("source_id").isin("src1", "src2"))
    rows = lexical.indexed_bm25(spark, index(spark, d), TERMS, admitted)
    return lexical.top_passages(rows, lexical.candidate_cap(1)).select("uri", F.round("score", 6).alias("score"))


@query("bm25_postings", f"WITH {_bm25_sql(_TF)} SELECT uri, round(score, 6) AS score FROM scored")
def bm25_postings(spark, d):
    return lexical.indexed_bm25(spark, index(spark, d), TERMS).select("uri", F.round("score", 6).alias("score"))


@query("bm25_scan", f"WITH {_bm25_sql(_TF)} SELECT uri, round(score, 6) AS score FROM scored")
def bm25_scan(spark, d):
    """Without an index: the words of every passage are read."""
    return lexical.bm25(passages(spark, d), TERMS).select("uri", F.round("score", 6).alias("score"))


_SINGLES = [_tf("t = 'le'"), _tf("starts_with(t, 'nthe')")]


@query("bm25_phrases", f"WITH {_bm25_sql([_PHRASE.replace('generate_series(1, len(tokens) - 1)', 'generate_series(1, greatest(len(tokens) - 1, 0))'), *_SINGLES])} SELECT uri, round(score, 6) AS score FROM scored")
def bm25_phrases(spark, d):
    """A phrase, an exact word and a prefix, from the index."""
    return lexical.indexed_bm25(spark, index(spark, d), parse('"of the" "le" nthe')).select("uri", F.round("score", 6).alias("score"))


@query("index_postings", f"WITH {PASSAGE}, each AS (SELECT uri, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM passage) SELECT term, uri, CAST(count(*) AS BIGINT) AS tf, CAST(min(pos) AS BIGINT) AS first, CAST(max(pos) AS BIGINT) AS last FROM each GROUP BY ALL")
def index_postings(spark, d):
    """What the written index holds."""
    rows = spark.read.parquet(f"{index(spark, d)}/posting")
    return rows.select("term", "uri", F.size("positions").cast("bigint").alias("tf"), F.array_min("positions").cast("bigint").alias("first"), F.array_max("positions").cast("bigint").alias("last"))


_FINAL = f"""SELECT r.uri, title, round(score * (1 + 0.15 * power(0.5, greatest(epoch_us({NOW_SQL}) - epoch_us(updated_at), 0) / 86400000000.0 / 30)), 9) AS score
FROM (SELECT * FROM {{fused}} ORDER BY score DESC, lexical_rank NULLS LAST, semantic_rank NULLS LAST, uri LIMIT {{cut}}) r JOIN session s ON r.uri = s.uri ORDER BY 3 DESC, r.uri LIMIT {{top}}"""


def search_lexical_rows(spark, d, text="tion nthe estionr", top=10):
    """The whole of a keyword search: candidates of admitted sessions, ranks, boosts; titles are fetched last."""
    s = sessions(spark, d, dealt=False)
    admitted = filters.filtered(s, SessionFilter()).select("uri")
    rows = fetch.local(lexical.top_passages(lexical.indexed_bm25(spark, index(spark, d), parse(text), admitted), lexical.candidate_cap(top)))
    found = fusion.cut(fusion.fused({"lexical": fusion.session_ranks(rows)}), top)
    named = found.join(fetch.few(s, "uri", [r.uri for r in rows.select("uri").distinct().collect()]).select("uri", "updated_at", "workspace_path"), "uri")
    hits = fetch.local(fusion.boosted(named, NOW).orderBy(F.desc("score"), "uri").limit(top))
    shown = passage_texts(spark, d, [r.uri for r in hits.collect()]).join(F.broadcast(hits), "uri")  # at most ``top`` rows
    return shown.withColumn("title", derive_title(F.col("text")))


@query(
    "search_lexical",
    f"WITH {SESSION}, {_bm25_sql(_TF, where='uri IN (SELECT uri FROM session WHERE NOT is_archived)')}{_RANKED.format(cap=200)}, fused AS (SELECT uri, 1.0 / (60 + rank) AS score, rank AS lexical_rank, NULL AS semantic_rank FROM ranks) "
    + _FINAL.format(fused="fused", cut=20, top=10),
)
def search_lexical(spark, d):
    return search_lexical_rows(spark, d).select("uri", "title", F.round("score", 9).alias("score"))


@query("recency_boost", f"WITH {SESSION} SELECT uri, round(coalesce(message_count, 0) * (1 + 0.15 * power(0.5, greatest(epoch_us({NOW_SQL}) - epoch_us(updated_at), 0) / 86400000000.0 / 30)), 6) AS score FROM session")
def recency_boost(spark, d):
    s = sessions(spark, d).withColumn("score", F.coalesce("message_count", F.lit(0)).cast("double"))
    return s.select("uri", F.round(fusion.recency(F.col("score"), F.col("updated_at"), NOW), 6).alias("score"))


@query("workspace_boost", f"WITH {SESSION} SELECT uri, round(b + CASE WHEN source_id = 'src3' THEN b * 0.1 ELSE 0 END, 6) AS score FROM (SELECT uri, source_id, 1 + 0.15 * power(0.5, greatest(epoch_us({NOW_SQL}) - epoch_us(updated_at), 0) / 86400000000.0 / 30) AS b FROM session)")
def workspace_boost(spark, d):
    s = sessions(spark, d).withColumn("score", F.lit(1.0))
    return fusion.boosted(s, NOW, workspace="C:/work/src3").select("uri", F.round("score", 6).alias("score"))


_DOT = "list_inner_product(CAST(vector AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def _asked(spark, d, rows):
    """Rows with the query's vector, one row that is broadcast."""
    return rows.crossJoin(F.broadcast(query_vector(spark, d)))


def _top_vectors(spark, d):
    v = vectors(spark, d)
    q = query_vector(spark, d).first()
    return v, semantic.query_vector(q.q)


@query("vec_dot_topk", f"WITH {VECTOR} SELECT ordinal, round({_DOT}, 6) AS score FROM vec WHERE {_DOT} > 0 ORDER BY {_DOT} DESC, ordinal LIMIT 50")
def vec_dot_topk(spark, d):
    rows = _asked(spark, d, vectors(spark, d))
    scored = semantic.scored(rows, F.col("q")).select("ordinal", "score")
    return scored.orderBy(F.desc("score"), "ordinal").limit(50).select("ordinal", F.round("score", 6).alias("score"))


@query("vec_cosine", f"WITH {VECTOR} SELECT ordinal, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM vec")
def vec_cosine(spark, d):
    return _asked(spark, d, vectors(spark, d)).select("ordinal", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score"))


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))"


@query("vec_normalize_direction", f"SELECT vec_id, round(u[1], 6) AS first, round(u[len(u)], 6) AS last, round(list_sum(list_transform(u, lambda x, i: x * i)), 5) AS weighted FROM (SELECT vec_id, {_UNIT} AS u FROM embeddings)")
def vec_normalize_direction(spark, d):
    n = normalize(F.col("embedding"))
    weighted = F.aggregate(F.transform(n, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(n, 1), 6).alias("first"), F.round(F.element_at(n, -1), 6).alias("last"), F.round(weighted, 5).alias("weighted"))


@query("vec_normalize", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) / list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS square FROM embeddings")
def vec_normalize(spark, d):
    n = normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"))


_CENTROID = f"""{VECTOR},
cells AS (SELECT uri, p, sum(CAST(vector[p] AS DOUBLE)) / count(*) AS x FROM (SELECT uri, vector, unnest(generate_series(1, len(vector))) AS p FROM vec) GROUP BY uri, p),
cent AS (SELECT uri, list(x ORDER BY p) AS v, sqrt(sum(x * x)) AS n FROM cells GROUP BY uri)"""


@query("vec_centroid", f"WITH {_CENTROID} SELECT c.uri, p - 1 AS pos, round(x / n, 6) AS x FROM cells c JOIN cent USING (uri)")
def vec_centroid(spark, d):
    return centroids(vectors(spark, d), "uri").select("uri", F.posexplode("vector").alias("pos", "x")).select("uri", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


_CDOT = "list_inner_product(v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) / n"


@query("vec_shortlist", f"WITH {_CENTROID} SELECT uri, round({_CDOT}, 6) AS score FROM cent WHERE {_CDOT} > 0 ORDER BY {_CDOT} DESC, uri LIMIT 3")
def vec_shortlist(spark, d):
    v, q = _top_vectors(spark, d)
    return semantic.shortlist(centroids(v, "uri"), q, config=SearchConfig(session_shortlist=3)).select("uri", F.round("score", 6).alias("score"))


_SEM = f"""{_CENTROID},
short AS (SELECT uri FROM cent WHERE {_CDOT} > 0 ORDER BY {_CDOT} DESC, uri LIMIT 3),
sem AS (SELECT uri, ordinal, {_DOT} AS score FROM vec WHERE {_DOT} > 0 AND uri IN (SELECT uri FROM short))"""


@query("search_semantic", f"WITH {_SEM} SELECT uri, ordinal, round(score, 6) AS score FROM sem")
def search_semantic(spark, d):
    v, q = _top_vectors(spark, d)
    return semantic.search(v, centroids(v, "uri"), q, config=SearchConfig(session_shortlist=3)).select("uri", "ordinal", F.round("score", 6).alias("score"))


@query("search_semantic_deep", f"WITH {VECTOR} SELECT uri, ordinal, round({_DOT}, 6) AS score FROM vec WHERE {_DOT} > 0")
def search_semantic_deep(spark, d):
    v, q = _top_vectors(spark, d)
    return semantic.search(v, None, q, deep=True).select("uri", "ordinal", F.round("score", 6).alias("score"))


def _by_label(spark, d):
    """Scored passages of documents under the sessions of vectors: ten sessions, documents by id modulo ten."""
    i = F.element_at(F.split("uri", "/"), -1).cast("bigint")
    return lexical.indexed_bm25(spark, index(spark, d), TERMS).select(F.concat(F.lit("s"), (i % 10).cast("string")).alias("uri"), i.alias("ordinal"), "score")


_HYB = (
    _bm25_sql(_TF).replace("'doc://' || source || '/' || doc_id AS uri, 0 AS ordinal", "'s' || (doc_id % 10) AS uri, doc_id AS ordinal")
    + """,
lex AS (SELECT * FROM scored ORDER BY score DESC, uri, ordinal LIMIT 500),
ranks AS (SELECT uri, row_number() OVER (ORDER BY s DESC, uri) AS rank FROM (SELECT uri, max(score) AS s FROM lex GROUP BY uri)),
"""
)
_FUSED = """sranks AS (SELECT uri, row_number() OVER (ORDER BY s DESC, uri) AS rank FROM (SELECT uri, max(score) AS s FROM sem GROUP BY uri))
SELECT coalesce(l.uri, s.uri) AS uri, l.rank AS lexical_rank, s.rank AS semantic_rank, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS score
FROM ranks l FULL JOIN sranks s ON l.uri = s.uri"""


def _hybrid(spark, d, deep: bool):
    v, q = _top_vectors(spark, d)
    lex = lexical.top_passages(_by_label(spark, d), 500)
    sem = semantic.search(v, None if deep else centroids(v, "uri"), q, deep=deep, config=SearchConfig(session_shortlist=3))
    out = fusion.fused({"lexical": fusion.session_ranks(lex), "semantic": fusion.session_ranks(sem.select("uri", "ordinal", "score"), bounded=not deep)})
    return out.select("uri", F.col("lexical_rank").cast("bigint").alias("lexical_rank"), F.col("semantic_rank").cast("bigint").alias("semantic_rank"), F.round("score", 9).alias("score"))


@query("search_hybrid", f"WITH {_HYB}{_SEM}, {_FUSED}")
def search_hybrid(spark, d):
    return _hybrid(spark, d, False)


@query("search_hybrid_deep", f"WITH {_HYB}{VECTOR}, sem AS (SELECT uri, ordinal, {_DOT} AS score FROM vec WHERE {_DOT} > 0), {_FUSED}")
def search_hybrid_deep(spark, d):
    return _hybrid(spark, d, True)


@query(
    "rrf_fusion",
    f"WITH {TURN}, a AS (SELECT conv_id, row_number() OVER (ORDER BY max(length(text)) DESC, uri) AS rank FROM turns GROUP BY uri, conv_id), b AS (SELECT conv_id, row_number() OVER (ORDER BY max(turn_index) DESC, uri) AS rank FROM turns WHERE turn_index >= 3 GROUP BY uri, conv_id) SELECT 'conv://' || conv_id AS uri, round(1.0 / (60 + a.rank), 9) AS lexical_score, round(coalesce(1.0 / (60 + b.rank), 0), 9) AS semantic_score FROM a LEFT JOIN b USING (conv_id)",
)
def rrf_fusion(spark, d):
    t = turns(spark, d)
    a = fusion.session_ranks(t.select("uri", F.col("turn_index").alias("ordinal"), F.length("text").cast("double").alias("score")), bounded=False)
    b = fusion.session_ranks(t.where("turn_index >= 3").select("uri", F.col("turn_index").alias("ordinal"), F.col("turn_index").cast("double").alias("score")), bounded=False)
    return fusion.fused({"lexical": a, "semantic": b}).select("uri", F.round("lexical_score", 9).alias("lexical_score"), F.round("semantic_score", 9).alias("semantic_score"))


@query(
    "chunk_cap8",
    f"WITH {VECTOR}, two AS (SELECT uri, ordinal, 0 AS l, -ordinal AS s FROM vec WHERE ordinal % 3 = 0 UNION ALL SELECT uri, ordinal, 1, -CAST(ordinal AS DOUBLE) / 2 FROM vec), best AS (SELECT uri, ordinal, min(struct_pack(l := l, s := s)) AS m FROM two GROUP BY ALL) SELECT uri, ordinal, CAST(place AS BIGINT) AS place FROM (SELECT uri, ordinal, row_number() OVER (PARTITION BY uri ORDER BY m, ordinal) AS place FROM (SELECT uri, ordinal, min(m) AS m FROM (SELECT uri, ordinal, struct_pack(l := l, s := CAST(s AS DOUBLE)) AS m FROM two) GROUP BY uri, ordinal)) WHERE place <= 8",
)
def chunk_cap8(spark, d):
    v = vectors(spark, d).select("uri", "ordinal")
    lex = v.where("ordinal % 3 = 0").withColumn("score", F.col("ordinal").cast("double"))
    sem = v.withColumn("score", F.col("ordinal").cast("double") / 2)
    return fusion.chosen_passages({"lexical": lex, "semantic": sem}).withColumn("place", F.col("place").cast("bigint"))


@query(
    "live_scan_score",
    f"WITH {TURN}, c AS (SELECT uri, CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'zu') AS INTEGER) AS n FROM turns WHERE uri IN (SELECT uri FROM (SELECT DISTINCT uri, conv_id FROM turns) ORDER BY conv_id DESC, uri LIMIT 400)) SELECT uri, round(sum(n) / 3.0, 6) AS score, CAST(sum(n) AS BIGINT) AS hits FROM c WHERE n > 0 GROUP BY uri",
)
def live_scan_score(spark, d):
    t = turns(spark, d)
    order = t.select("uri", F.col("conv_id").alias("updated_at")).distinct()
    return lexical.live_scan(t, ["tion", "THE", "zu", "the"], order)[0].select("uri", F.round("score", 6).alias("score"), "hits")


@query(
    "live_scan_snippets",
    f"WITH {TURN} SELECT uri, turn_index FROM (SELECT uri, turn_index, row_number() OVER (PARTITION BY uri ORDER BY turn_index) AS r FROM turns WHERE contains(lower(text), 'tion')) WHERE r <= 3",
)
def live_scan_snippets(spark, d):
    t = turns(spark, d)
    return lexical.live_scan(t, ["tion"], t.select("uri", F.col("conv_id").alias("updated_at")).distinct(), limit=1 << 30)[1].select("uri", "turn_index")


@query(
    "native_group_max",
    f"WITH {TURN}, s AS (SELECT uri, turn_index, CAST(len(list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'), lambda t: starts_with(t, 'tion'))) AS BIGINT) AS n FROM turns WHERE role <> 'system') SELECT uri, max(n) AS best FROM s WHERE n > 0 GROUP BY uri",
)
def native_group_max(spark, d):
    t = lexical.tokenized(turns(spark, d).where("role <> 'system'"))
    n = lexical.frequency(F.col("words"), parse("tion")[0]).cast("bigint")
    return t.select("uri", n.alias("n")).where("n > 0").groupBy("uri").agg(F.max("n").alias("best"))


@query("federated_union", f"WITH {SESSION} SELECT uri, score FROM (SELECT uri, doc_id AS score FROM session WHERE source_id = 'src1' UNION ALL SELECT uri, doc_id * 2 FROM session WHERE source_id = 'src2') ORDER BY score DESC, uri LIMIT 20")
def federated_union(spark, d):
    s = sessions(spark, d)
    parts = s.where("source_id = 'src1'").select("uri", F.col("doc_id").alias("score")).unionByName(s.where("source_id = 'src2'").select("uri", (F.col("doc_id") * 2).alias("score")))
    return parts.orderBy(F.desc("score"), "uri").limit(20)


@query("snippet_excerpts")
def snippet_excerpts(spark, d):
    hits = search_lexical_rows(spark, d)
    text = hits.select("uri", F.lit(0).alias("ordinal"), F.lit("Assistant").alias("role"), F.lit(0).alias("turn_index"), "text")
    out = snippets.collected(hits.select("uri", F.lit(0).alias("ordinal"), F.lit(1).alias("place")), text, TERMS, 3)
    return out.select("uri", F.get("snippets", F.lit(0))["highlighted"].alias("highlighted"), F.get("snippets", F.lit(0))["text"].alias("excerpt"))
