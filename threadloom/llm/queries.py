"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, decontamination, forest, packing, pii, quality, repair, simhash, sstable, substrings, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _with_package(f: Query) -> Query:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship_package(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_vector_packing": packing.op1,
        "op2_hash_prefix_forest": forest.op2,
        "op3_keyed_surrogates": pii.op3,
        "op4_sorted_string_tables": sstable.op4,
        "op5_subword_toxicity": toxicity.op5,
        "op6_bit_sliced_simhash": simhash.op6,
        "op7_prefix_filtered_decontamination": decontamination.op7,
        "op8_naive_bayes_svm_quality": quality.op8,
        "op9_gzip_member_warc": warc.op9,
        "op10_super_kmer_dedup": substrings.op10,
        "op11_structure_repair": repair.op11,
        "op12_embedding_whitening": whitening.op12,
        "op13_byte_level_bpe": bpe.op13,
    }
    return {name: _with_package(f) for name, f in found.items()}


#: Words of a text, as a list.
_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, w[s : s + least(len(w), 13) - 1] AS win, least(len(w), 13) AS n
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM wins),
starts AS (
  SELECT doc_id, n, s, w[s : s + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, s, wins.n, item FROM starts JOIN wins USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)
),
firsts AS (SELECT win, min(doc_id) AS first_id FROM wins GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(generate_series(s, s + 49)) AS p FROM wins JOIN firsts USING (win) WHERE doc_id > first_id)
),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Base 32 of the SHA-1's hexadecimal digits ``h``: five of them are four characters.
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1) for k in range(32)], '')"""

OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""


#: CRC-32 of an ASCII text ``key``, byte by byte and bit by bit.
_CRC32 = """xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) for x in string_split(key, '')]),
  lambda c, b: xor(c >> 8, list_reduce([xor(c & 255, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384)))), 4294967295)"""

OP11_SQL = rf"""
WITH RECURSIVE
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
said AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(k.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations k JOIN ids ON k.conv_id IS NOT DISTINCT FROM ids.conv_id
),
fates AS (SELECT *, {_CRC32} % 20 AS fate FROM said),
hurt AS (
  SELECT c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fates WHERE fate <> 0
),
placed AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    right(regexp_replace(text, '[ 	-]+$', ''), 1) AS tail
  FROM hurt
),
told AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
r AS (
  SELECT c, i, turn, role, text, substr(role, 1, 1) AS k, tail = '' AS blank, tail <> '' AND again AS twice, tail = '' OR again AS gone,
    CASE WHEN tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
    i > 1 AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM told
),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (twice) AS duplicate, sum(cut) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM r GROUP BY c
),
back AS (
  SELECT c, n + 1 AS i, CAST(0 AS BIGINT) AS w0, CAST(4 AS BIGINT) AS w1, CAST(2 AS BIGINT) AS w2, CAST(0 AS BIGINT) AS w3 FROM counts
  UNION ALL
  SELECT c, i, least(a0, 2 + a2, 4 + a3), least(a1, 2 + a2, 4 + a3), least(a2, 2 + a3), least(a3, 2 + a2)
  FROM (
    SELECT r.c, r.i,
      least(3 + w0, CASE WHEN gone THEN 1000000000 ELSE cut + least(2 + w2, CASE k WHEN 'u' THEN w2 WHEN 's' THEN w1 ELSE 1000000000 END) END) AS a0,
      least(3 + w1, CASE WHEN gone THEN 1000000000 ELSE cut + least(2 + w2, CASE k WHEN 'u' THEN w2 ELSE 1000000000 END) END) AS a1,
      least(3 + w2, CASE WHEN gone THEN 1000000000 ELSE cut + least(2 + w3, CASE k WHEN 'a' THEN w3 ELSE 1000000000 END) END) AS a2,
      least(3 + w3, CASE WHEN gone THEN 1000000000 ELSE cut + least(2 + w2, CASE k WHEN 'u' THEN w2 ELSE 1000000000 END) END) AS a3
    FROM back JOIN r ON r.c = back.c AND r.i = back.i - 1
  )
),
w AS (SELECT c, i, [w0, w1, w2, w3] AS w FROM back),
steps AS (
  SELECT w.c, w.i, w.w AS w, nxt.w AS v, role, text, k, gone, cut FROM w LEFT JOIN r ON r.c = w.c AND r.i = w.i LEFT JOIN w AS nxt ON nxt.c = w.c AND nxt.i = w.i + 1
),
walk AS (
  SELECT c, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM counts
  UNION ALL
  SELECT c, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN CASE k WHEN 'u' THEN 3 WHEN 'a' THEN 4 ELSE 2 END ELSE CASE q WHEN 3 THEN 4 ELSE 3 END END,
    audit || edit,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE edit WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT walk.*, role, text, k,
      CASE WHEN v IS NULL THEN 'I' WHEN 3 + v[q] = w[q] THEN 'D' WHEN 2 + w[CASE q WHEN 3 THEN 4 ELSE 3 END] = w[q] THEN 'I'
        WHEN NOT gone AND cut + CASE WHEN k = 'u' AND q <> 3 THEN v[3] WHEN k = 'a' AND q = 3 THEN v[4] WHEN k = 's' AND q = 1 THEN v[2] END = w[q] THEN 'K' ELSE 'R' END AS edit
    FROM walk JOIN steps ON steps.c = walk.c AND steps.i = walk.i
    WHERE v IS NOT NULL OR q IN (2, 3)
  )
),
ends AS (SELECT walk.c, arg_max(audit, len(audit)) AS audit, arg_max(lines, len(audit)) AS lines FROM walk GROUP BY walk.c),
costs AS (SELECT c, w[1] AS cost FROM w WHERE i = 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) LEFT JOIN ends USING (c) LEFT JOIN costs USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_structure_repair": OP11_SQL, "op9_gzip_member_warc": OP9_SQL, "op7_prefix_filtered_decontamination": OP7_SQL, "op10_super_kmer_dedup": OP10_SQL}
