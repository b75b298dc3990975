"""Byte-level BPE in Spark's higher-order functions: ids of whole texts, and the bytes of ids.

A rank file says which byte strings are tokens; a token's rank is its id.  A word (one match of the pattern) begins as
the array of its bytes; a fold merges, step by step, the adjacent pair whose joint token has the least rank, the
leftmost of equals, until no pair is a token.  That is the order of the reference library, so the ids are the same.
Within the fold a piece is one character that stands for its id, and a word a string of them: cutting and joining strings
is much quicker here than slicing arrays, and characters of longer tokens order as their ids do.  A byte stands for itself.

The rank map is one literal row, which expressions hold as a scalar subquery: its value goes to each executor with the
stage, is copied for no row and is printed in no plan.  Spark looks keys of a map up one by one, so the map is cut into
buckets by hash: an array of small maps from two pieces to the piece of their union.  Pairs of single bytes have an array.

Words repeat, so most are folded once: of the distinct words that occur again, the ``WORDS`` most frequent of at most
``WORD_BYTES`` bytes are folded beforehand, and the texts look them up.  That list has a fixed bound, whatever the corpus; the
rare rest is folded where it stands, which changes no id.  Texts are never shuffled.  As rows of their own the listed words
need no higher-order function: the same merges are made in Arrow batches, a step for all words of a block at once.

Decoding joins the byte pieces of the ids; those of a known word's ids are joined once, after its fold, and a text's are
joined by words.  Bytes are held as strings of the characters 0 to 255 (ISO-8859-1), since only
strings are joined in one pass.

A fold takes time with the square of its word's length; words are runs of letters, digits, marks or blanks.
"""

from __future__ import annotations

import base64
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rank file that the contract names.
VOCABULARY = "byte_bpe_50k.tiktoken"
WORDS = 3 << 18
WORD_BYTES = 32
#: Buckets of the folded words, and of the pairs.
_WORD_BUCKETS = 1 << 19
_PAIR_BUCKETS = 1 << 17
#: Bytes, padding included, of the words that are folded at once.
_BLOCK = 1 << 16
#: Stands for "no token": above all characters of ids.
_NONE = "\U0010FFFF"
#: What texts are made into: ids, the bytes that they stand for, and themselves as bytes.
MADE = ("ids", "decoded", "packed")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Tokens of a rank file with their ranks.  Every single byte must be one."""
    with open(path or default_path(), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the rank file must hold all single bytes")
    if len(set(ranks.values())) != len(ranks):
        raise ValueError("two tokens of the rank file share a rank")
    return ranks


def pairs_of(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """For each two tokens that make a token: their ids and the id of their union."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


#: No union: above all ids.
_FAR = np.iinfo(np.int32).max


@dataclass
class Merges:
    """Ids of bytes, and the unions of pairs of ids: ``keys``, sorted, are the first id times 2^32 and the second."""

    single: np.ndarray
    keys: np.ndarray
    unions: np.ndarray

    @staticmethod
    def of(ranks: dict[bytes, int]) -> "Merges":
        pairs = sorted((a << 32 | b, rank) for (a, b), rank in pairs_of(ranks).items())
        keys, unions = zip(*pairs) if pairs else ((), ())
        return Merges(np.array([ranks[bytes([b])] for b in range(256)], np.int32), np.array(keys, np.int64), np.array(unions, np.int32))

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The union of each two ids, or ``_FAR``; an id below zero has none."""
        out = np.full(a.shape, _FAR, np.int32)
        if len(self.keys):
            wanted = a.astype(np.int64) << 32 | b
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            np.copyto(out, self.unions[at], where=(self.keys[at] == wanted) & (a >= 0) & (b >= 0))
        return out

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(words[order[hi]]) <= _BLOCK:
                hi += 1
            self._block(words, order[lo:hi], out)
            lo = hi
        return out

    def _block(self, words: list[bytes], rows: list[int], out: list) -> None:
        """Folds some words, the longest last, each by its own least and leftmost pair in every step."""
        width = len(words[rows[-1]]) + 1
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        size = np.array([len(words[i]) for i in rows])
        ids = np.where(np.arange(width) < size[:, None], self.single[raw], -1)
        joint = np.full_like(ids, _FAR)
        joint[:, :-1] = self.union(ids[:, :-1], ids[:, 1:])
        left = np.array(rows)
        while len(left):
            each = np.arange(len(left))
            at = joint.argmin(1)
            least = joint[each, at]
            done = least == _FAR
            for i, row, n in zip(left[done].tolist(), ids[done], size[done].tolist()):
                out[i] = row[:n]
            if done.any():
                left, ids, joint, size, at, least = (x[~done] for x in (left, ids, joint, size, at, least))
                each = np.arange(len(left))
            ids[each, at] = least
            size = size - 1
            beyond = np.minimum(np.arange(width) + (np.arange(width) > at[:, None]), width - 1)
            ids, joint = np.take_along_axis(ids, beyond, 1), np.take_along_axis(joint, beyond, 1)
            joint[each, at] = self.union(least, ids[each, at + 1])
            some = at > 0
            joint[each[some], at[some] - 1] = self.union(ids[each[some], at[some] - 1], least[some])


def _char(rank: int) -> str:
    """The character of a token of several bytes: from U+0100 on, but for the surrogates."""
    return chr(rank + 0x100 if rank + 0x100 < 0xD800 else rank + 0x900)


def _id(char: Column, single: Column) -> Column:
    code = F.ascii(char)
    return F.when(code < 0x100, F.get(single, code)).when(code < 0xD800, code - 0x100).otherwise(code - 0x900)


def _buckets(ranks: dict[bytes, int]) -> list[list[tuple[str, str]]]:
    """The pairs dealt as Spark's xxhash64 of a string deals them."""
    import xxhash

    pieces = {rank: token.decode("latin-1") if len(token) == 1 else _char(rank) for token, rank in ranks.items()}
    out: list[list[tuple[str, str]]] = [[] for _ in range(_PAIR_BUCKETS)]
    for (a, b), rank in pairs_of(ranks).items():
        key = pieces[a] + pieces[b]
        out[xxhash.xxh64_intdigest(key.encode(), seed=42) % _PAIR_BUCKETS].append((key, _char(rank)))
    return out


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(_WORD_BUCKETS - 1))


def _free(df: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in df.columns}
    while (name := f"{name}_") in taken:
        pass
    return name


def _let(value: Column, zero: Column, body) -> Column:
    """``body`` of a value that is computed once; ``zero`` has the type of the outcome.

    As a fold over one element: an element of a transformed array would find its type anew for each row.
    """
    return F.aggregate(F.array(value), zero, lambda _, x: body(x))


def _fields(made: tuple[str, ...], kind: str) -> Column:
    """Null as a struct of these columns, whose bytes have the type ``kind``."""
    return F.lit(None).cast("struct<" + ", ".join(f"{c}: {'array<int>' if c == 'ids' else kind}" for c in made) + ">")


def _ints() -> Column:
    return F.array().cast("array<int>")


@dataclass
class Encoder:
    """Columns of one rank file and pattern in one session; see ``encoder``."""

    spark: SparkSession
    pattern: str
    table: Column
    pieces: Column
    numbers: Column
    merges: Merges

    def _rank(self, t: Column, pair: Column) -> Column:
        """The union of two pieces by the table ``t``, or ``_NONE``."""
        bucket = F.get(t["pairs"], F.xxhash64(pair).bitwiseAND(F.lit(_PAIR_BUCKETS - 1)).cast("int"))
        return F.coalesce(F.try_element_at(bucket, pair), F.lit(_NONE))

    def words(self, text: Column) -> Column:
        """Matches of the pattern in a text, null as empty."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _with(self, df: DataFrame, out: str, zero: Column, body, **held: Column) -> DataFrame:
        """``df`` with a column ``out``: ``body`` of a struct of the held values.

        Spark's analysis takes no subquery within a higher-order function, so the values stand in a projection of
        their own, which the optimizer folds into the next one: each is used once.
        """
        names = {k: _free(df, k) for k in held}
        kept = [F.col(common.quoted(c)) for c in df.columns if c != out]
        values = F.struct(*[F.col(n).alias(k) for k, n in names.items()])
        return df.select("*", *[held[k].alias(n) for k, n in names.items()]).select(*kept, _let(values, zero, body).alias(out))

    def fold_words(self, df: DataFrame, column: str = "word", out: str = "ids") -> DataFrame:
        """Words of a column, none of them null, with their ids: rows of these two columns."""
        common.ship_package(self.spark)
        merges = self.merges

        def folded(batches):
            import pyarrow as pa

            for batch in batches:
                ids = merges.fold(batch.column(0).cast(pa.binary()).to_pylist())
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate([*ids, np.zeros(0, np.int32)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["word", "ids"])

        rows = df.select(F.col(common.quoted(column)).alias("word")).mapInArrow(folded, "word string, ids array<int>")
        return rows.toDF(column, out)

    def _fold(self, t: Column, word: Column) -> Column:
        pieces = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return _let(F.transform(F.split(pieces, ""), lambda c: F.ascii(c)), _ints(), lambda c: self._merged(t, pieces, c))

    def _merged(self, t: Column, pieces: Column, codes: Column) -> Column:
        """Ids of a word of these bytes, as characters and as numbers.  The state holds the pieces ``p``, and ``r``, the union of each with its right neighbour."""

        def merged(s: Column, rank: Column, i: Column) -> Column:
            p, r = s["p"], s["r"]
            left = F.when(i > 1, self._rank(t, F.concat(F.substring(p, i - 1, F.lit(1)), rank))).otherwise("")
            right = self._rank(t, F.concat(rank, F.substring(p, i + 2, F.lit(1))))
            joined = F.concat(F.substring(p, F.lit(1), i - 1), rank, F.substr(p, i + 2))
            ranked = F.concat(F.substring(r, F.lit(1), i - 2), left, right, F.substr(r, i + 2))
            return F.struct(joined.alias("p"), ranked.alias("r"))

        def step(s: Column, _: Column) -> Column:
            least = F.array(F.array_min(F.split(s["r"], "")))
            at = lambda s, m: F.aggregate(F.array(F.instr(s["r"], m)), s, lambda s, i: merged(s, m, i))
            return F.aggregate(least, s, lambda s, m: F.when(m == _NONE, s).otherwise(at(s, m)))

        ranks = F.transform(codes, lambda c, i: F.coalesce(F.get(t["first"], c * 256 + F.get(codes, i + 1)), F.lit(_NONE)))
        start = F.struct(pieces.alias("p"), F.array_join(ranks, "").alias("r"))
        return F.aggregate(codes, start, step, lambda s: F.transform(F.split(s["p"], ""), lambda c: _id(c, t["bytes"])))

    def _held(self, x: Column, word: Column) -> Column:
        """The cell of a known word, or null."""
        return F.try_element_at(F.get(x["known"], _bucket(word)), word)

    def encode(self, df: DataFrame, column: str = "text", out: str = "ids", known: Column | None = None) -> DataFrame:
        """``df`` with the ids of the texts in a column as arrays of integers; null counts as empty."""
        words = self.words(F.col(common.quoted(column)))
        if known is None:
            return self._with(df, out, _ints(), lambda x: F.flatten(F.transform(words, lambda w: self._fold(x["t"], w))), t=self.table)
        one = lambda x, w: F.coalesce(self._held(x, w)["ids"], self._fold(x["t"], w))
        return self._with(df, out, _ints(), lambda x: F.flatten(F.transform(words, lambda w: one(x, w))), t=self.table, known=known)

    def encode_whole(self, df: DataFrame, column: str, known: Column, made: tuple[str, ...] = MADE) -> DataFrame:
        """``df`` with ``ids``, ``decoded`` and ``packed``, or some of these, of the texts in a column: as ``encode``, ``decode``
        and ``pack`` make them.

        The ids of a known word were decoded and packed once, after its fold; those of other words are here.  ``known``
        must have cells of the same columns.
        """
        words = self.words(F.col(common.quoted(column)))

        def folded(x: Column, word: Column) -> Column:
            return _let(self._fold(x["t"], word), _fields(made, "string"), lambda ids: self._cell(x, ids, made))

        def joined(cells: Column) -> Column:
            whole = lambda c: F.flatten(cells[c]) if c == "ids" else F.encode(F.array_join(cells[c], ""), "ISO-8859-1")
            return F.struct(*[whole(c).alias(c) for c in made])

        def body(x: Column) -> Column:
            cells = F.transform(words, lambda w: F.coalesce(self._held(x, w), folded(x, w)))
            return _let(cells, _fields(made, "binary"), joined)

        name = _free(df, "whole")
        values = {"t": self.table, "pieces": self.pieces, "numbers": self.numbers, "known": known}
        kept = [F.col(common.quoted(c)) for c in df.columns if c not in made]
        return self._with(df, name, _fields(made, "binary"), body, **values).select(*kept, *[F.col(name)[c].alias(c) for c in made])

    def _cell(self, x: Column, ids: Column, made: tuple[str, ...]) -> Column:
        """The ids of a word and their bytes, as characters."""
        values = {"ids": lambda: ids, "decoded": lambda: self._chars(x["pieces"], ids), "packed": lambda: self._chars(x["numbers"], ids)}
        return F.struct(*[values[c]().alias(c) for c in made])

    def _chars(self, parts: Column, ids: Column) -> Column:
        return F.array_join(F.transform(ids, lambda i: F.get(parts, i)), "")

    def _joined(self, df: DataFrame, column: str, out: str, parts: Column) -> DataFrame:
        ids = F.coalesce(F.col(common.quoted(column)), _ints())
        return self._with(df, out, F.lit(b""), lambda x: F.encode(self._chars(x["parts"], ids), "ISO-8859-1"), parts=parts)

    def decode(self, df: DataFrame, column: str = "ids", out: str = "decoded") -> DataFrame:
        """``df`` with the bytes of a column of arrays of ids; an id that is none of the file's has no bytes, as has null."""
        return self._joined(df, column, out, self.pieces)

    def pack(self, df: DataFrame, column: str = "ids", out: str = "packed") -> DataFrame:
        """``df`` with a column of arrays of ids as unsigned 32-bit integers, little-endian, one after another."""
        return self._joined(df, column, out, self.numbers)

    def known_words(self, texts: DataFrame, column: str = "text", words: int = WORDS, made: tuple[str, ...] = MADE) -> Column:
        """The most frequent words of at most ``WORD_BYTES`` bytes with cells of the columns ``made``: at most ``words``, in buckets, as one value.

        A threshold of frequency is taken from a count of counts, so no task sorts the words.  The result is an array of
        maps, to be given to ``encode``.
        """
        each = texts.select(F.explode(self.words(F.col(column))).alias("word")).where(F.octet_length("word") <= WORD_BYTES)
        counts = common.staged(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        level = F.floor(F.log2("n") * 16).cast("int")
        total, least = 0, 1 << 30
        for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
            if total + row["count"] > words:
                break
            total, least = total + row["count"], row["level"]
        chosen = counts.where(level >= least).select("word").repartition(max(1, min(64, total // 4096 + 1)), "word")
        ids = common.staged(self.fold_words(chosen))
        values = {"pieces": self.pieces, "numbers": self.numbers}
        folded = common.staged(self._with(ids, "cell", _fields(made, "string"), lambda x: self._cell(x, F.col("ids"), made), **values))
        bucket = _bucket(F.col("word")).cast("long")
        held = folded.groupBy(bucket.alias("bucket")).agg(F.collect_list(F.struct("word", "cell")).alias("held"))
        every = self.spark.range(_WORD_BUCKETS).withColumnRenamed("id", "bucket").join(held, "bucket", "left")
        row = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "held"))).alias("all"))
        return row.select(F.transform("all", lambda x: F.map_from_entries(x["held"])).alias("known")).scalar()


def _ranges(points: list[int]) -> str:
    """Code points as ranges of a character class, behind one test that common characters end at."""
    if not points:
        return ""
    parts, first = [], points[0]
    for a, b in zip(points, [*points[1:], -1]):
        if b != a + 1:
            parts.append(f"\\x{{{first:x}}}-\\x{{{a:x}}}")
            first = b
    return f"[\\x{{{points[0]:x}}}-\\x{{{points[-1]:x}}}&&[{''.join(parts)}]]"


def jvm_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern for the JVM: white space of Unicode, and letters and numbers that its Unicode tables are too old for."""
    new = {}
    for kind in "LN":
        held = "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] == kind)
        unknown = spark.range(1).select(F.regexp_replace(F.lit(held), rf"\p{{{kind}}}+", "").alias("s")).first().s
        new[kind] = _ranges([ord(c) for c in unknown])
    out, within, i = "(?U)", False, 0
    while i < len(pattern):
        piece = pattern[i : i + 5]
        if piece in (r"\p{L}", r"\p{N}"):
            own = piece + new[piece[3]]
            out, i = out + (own if within or own == piece else f"[{own}]"), i + 5
        elif pattern[i] == "\\":
            out, i = out + pattern[i : i + 2], i + 2
        else:
            within = pattern[i] == "[" or within and pattern[i] != "]"
            out, i = out + pattern[i], i + 1
    return out


def encoder(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Encoder:
    """The encoder of a rank file (``public_tokenizers``' by default) and the pattern that cuts texts into words."""
    import pyarrow as pa

    ranks = read_ranks(path)
    single = [bytes([b]) for b in range(256)]
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    numbers = [i.to_bytes(4, "little").decode("latin-1") for i in range(len(pieces))]
    first = [_char(ranks[a + b]) if a + b in ranks else _NONE for a in single for b in single]
    strings, maps = pa.list_(pa.string()), pa.list_(pa.map_(pa.string(), pa.string()))
    parts = [pa.array([[ranks[b] for b in single]], pa.list_(pa.int32())), pa.array([first], strings), pa.array([_buckets(ranks)], maps)]
    row = spark.createDataFrame(pa.table({"t": pa.StructArray.from_arrays(parts, names=["bytes", "first", "pairs"]), "pieces": pa.array([pieces], strings), "numbers": pa.array([numbers], strings)}))
    columns = [row.select(c).scalar() for c in ("t", "pieces", "numbers")]
    return Encoder(spark, jvm_pattern(spark, pattern or default_pattern()), *columns, Merges.of(ranks))


def encoded(docs: DataFrame, column: str = "text", path: str | None = None, pattern: str | None = None, made: tuple[str, ...] = MADE) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole text, ``packed``, the same as little-endian unsigned 32-bit
    integers, and ``decoded``, the bytes that the ids stand for; or with those of them that ``made`` names.

    Every row stays, repeated ones too, in any order and with its other columns; columns of these names are replaced.
    A null or empty text has no ids and no bytes.  An empty table gives an empty one.
    """
    own = encoder(docs.sparkSession, path, pattern)
    known = own.known_words(docs.select(F.col(common.quoted(column)).alias("text")), made=made)
    return own.encode_whole(docs, column, known, made)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the bytes that these ids stand for, as the contract's digests."""
    rows = encoded(common.table(spark, sf_dir, "documents").select("doc_id", "text"), made=("decoded", "packed"))
    tokens = (F.octet_length("packed") / 4).cast("long")
    return rows.select("doc_id", tokens.alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
