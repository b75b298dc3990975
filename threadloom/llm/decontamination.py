"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of an item is the set of its word shingles with their places; a document contains the window exactly if
it has all of them.  For exact containment the prefix of a set is one token: its rarest shingle by the counts
of the whole corpus.  So only documents' shingles equal to some window's rarest one are joined; the shingle's
place in the window must leave room before and after it in the document (position and length), and what
remains is compared word by word over the item-sized window.

Documents are cut into words once.  What that pass finds of the windows' shingles, with their places, is written; counts,
prefixes and candidates come from there, and only documents with a candidate are read again, to compare words.

Windows are few next to the corpus, but nothing bounds them: their rows are counted, and only up to
``BROADCAST_WINDOWS`` of them are broadcast.  Beyond, the same joins are shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 13
SHINGLE = 3
#: Windows that may be broadcast; at 13 words of 8 bytes about 40 MB.
BROADCAST_WINDOWS = 200_000
#: What separates words: ASCII characters other than lower-case letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, runs of lower-case letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows of ``item_id, text`` rows: ``words, n, items`` (ids as strings).

    Items without id or without words have none.
    """
    w = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    each = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("words"))


def _shingle(array: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(array, at + k) for k in range(size)])


def _spread(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each shingle of each document, its hash ``h`` at word ``pos``, and one with a number of its own at -1."""
    rows = docs.select("*", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word")).withColumn("pos", F.col("pos") - 1)
    own = F.when(F.col("pos") == -1, F.xxhash64(F.lit("row"), "row"))
    hashes = [(own if k == 0 else F).when((F.col("pos") >= 0) & (F.col("pos") <= F.size("w") - s), _shingle(F.col("w"), F.col("pos"), s)) for k, s in enumerate(sizes)]
    return rows.withColumn("h", hashes[0] if len(sizes) == 1 else F.explode(F.array(*hashes))).where("h is not null").drop("word")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, items, contaminated`` for each row of ``docs``.

    ``text_hash`` is Spark's xxhash64 of the text, null as empty.
    ``items`` are the sorted ids, as strings, of items with a window in the document.  A null text has no words.
    Repeated rows are returned as often as they come; rows that share a doc_id are judged each on its own text.
    Other columns are not read.  Without items, or with empty ones only, nothing is hit.
    """
    wins = common.staged(windows(items, window, shingle)).withColumn("wid", F.monotonically_increasing_id())
    n_windows = wins.count()
    hint = F.broadcast if n_windows <= BROADCAST_WINDOWS else lambda x: x
    sizes = sorted(r.s for r in wins.select(F.least("n", F.lit(shingle)).alias("s")).distinct().collect())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = base.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    split = keyed.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    no_hit = F.array().cast("array<struct<a:int,n:int,items:array<string>>>")
    if not sizes:
        return _judged(split.select("doc_id", "text_hash", F.size("w").alias("n_words"), no_hit.alias("hits")))

    s = F.least("n", F.lit(shingle))
    places = wins.select("wid", "words", "n", "items", s.alias("s"), F.explode(F.sequence(F.lit(0), F.col("n") - s)).alias("at"))
    hashed = F.coalesce(*[F.when(F.col("s") == k, _shingle(F.col("words"), F.col("at"), k)) for k in sizes])
    places = common.staged(places.withColumn("h", hashed))

    # The one pass over all words: where shingles of windows stand, and how many words there are.
    wanted = places.select("h").distinct().withColumn("known", F.lit(True))
    light = _spread(split, sizes).select("doc_id", "text_hash", "row", F.size("w").alias("n_words"), "pos", "h")
    met = light.join(hint(wanted), "h", "left").where("known or pos = -1")
    mark = F.when(F.col("pos") >= 0, F.struct("pos", "h"))
    marks = common.staged(met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), F.collect_list(mark).alias("marks")))
    each = marks.where("size(marks) > 0").select("doc_id", "text_hash", "n_words", F.explode("marks").alias("m")).select("doc_id", "text_hash", "n_words", "m.pos", "m.h")

    # Counts over the whole corpus: the order of rarity.  A window with a shingle that the corpus lacks is nowhere.
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("wid").orderBy(F.col("df").asc(), F.col("h"), F.col("at"))
    rated = places.join(counts, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = common.staged(rated.withColumn("r", F.row_number().over(order)).where("r = 1 and df > 0").select("h", "at", "words", "n", "items"))

    start = F.col("pos") - F.col("at")
    found = each.join(hint(prefix), "h").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    found = common.staged(found.groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.collect_set(F.struct(start.alias("a"), "n", "words", "items")).alias("places")))
    again = keyed.join(common.small(found), keyed.doc_id.eqNullSafe(found.id_) & (keyed.text_hash == found.hash_))
    # Generated, not projected: a projection would be merged into the next one, and a text cut into words for each place.
    again = again.select("id_", "hash_", "places", F.explode(F.array(words(F.col("text")))).alias("w"))
    same = F.filter("places", lambda p: F.slice("w", p["a"] + 1, p["n"]) == p["words"])
    held = F.transform(same, lambda p: F.struct(p["a"].alias("a"), p["n"].alias("n"), p["items"].alias("items")))
    sure = common.staged(again.select("id_", "hash_", held.alias("hits")).where("size(hits) > 0").dropDuplicates(["id_", "hash_"]))
    joined = marks.join(common.small(sure), marks.doc_id.eqNullSafe(sure.id_) & (marks.text_hash == sure.hash_), "left")
    return _judged(joined.select("doc_id", "text_hash", "n_words", F.coalesce("hits", no_hit).alias("hits")))


def _judged(rows: DataFrame) -> DataFrame:
    """The result for ``doc_id, text_hash, n_words, hits`` rows."""
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["a"], x["a"] + x["n"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    out = rows.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), items.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark windows in all documents, as the contract's digest."""
    out = contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
