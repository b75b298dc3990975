"""Whitening against one matrix of all rows, and byte-level BPE against the library."""

import hashlib
import random
from decimal import Decimal

import numpy as np
import pytest

from threadloom.llm import bpe, queries, whitening

# ---- whitening


def by_hand(vectors, components=32):
    """Deviations, whitened coordinates, shares of variance of whole numbers in exact or long arithmetic."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), [sum(int(v) for v in col) for col in x.T]
    parts = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    c = np.array([[float(v) / n for v in row] for row in parts])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return [sum(v * v for v in row) for row in parts], c @ axes[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


def same_up_to_sign(a, b):
    sign = np.sign((a * b).sum(axis=0))
    return np.abs(a * sign - b).max()


def test_registered_query_on_a_table(spark, sf_dir):
    out = queries.queries()["op12_embedding_whitening"](spark, sf_dir)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = out.toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    deviations, z, share = by_hand([r.embedding for r in table])
    assert rows.vec_id.iloc[::32].tolist() == [r.vec_id for r in table] and set(rows.n) == {len(table)}
    assert rows.deviation.iloc[::32].tolist() == deviations
    assert same_up_to_sign(rows.whitened.to_numpy().reshape(-1, 32), z) < 1e-9
    assert np.abs(rows.explained.to_numpy()[:32] / share - 1).max() < 1e-9
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9


def test_rows_that_take_no_part_repeated_rows_and_clashing_columns(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    draw = random.Random(1)
    good = [[draw.gauss(0, 1) for _ in range(4)] for _ in range(200)]
    good += [good[0]] * 100
    odd = [None, [], [1.0, None, 0.0, 0.0], [nan, 0.0, 0.0, 0.0], [0.0, -inf, 0.0, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0, 0.0]]
    rows = [(i if i % 7 else None, v, "own", i) for i, v in enumerate(good + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, row int").repartition(7)
    out, model, error = whitening.whitened(df, components=3)
    got = out.orderBy("row").collect()
    deviations, z, share = by_hand(good, 3)
    assert [r["row"] for r in got] == list(range(300)) and got[0].vec_id is None and model.n == 300
    assert [int(r.deviation) for r in got] == deviations
    assert same_up_to_sign(np.array([r.whitened for r in got]), z) < 1e-9 and error < 1e-9


def test_components_without_variance_are_null(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "vec_id long, embedding array<float>")
    out, model, error = whitening.whitened(df)
    assert (model.variances > 0).tolist() == [True, False, False] and error < 1e-9
    assert all(r.whitened[1] is None and r.whitened[2] is None and r.whitened[0] is not None for r in out.collect())
    one, _, _ = whitening.whitened(df.limit(1))
    assert [list(r.whitened) for r in one.collect()] == [[None, None, None]]


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    out = whitening.op12(spark, f"file://{tmp_path}")
    assert out.count() == 0 and dict(out.dtypes)["whitened"] == "double"
    assert whitening.fit(spark.createDataFrame([], "embedding array<float>")) is None


def test_partitions_merge_like_one_matrix_and_large_numbers_stay_exact():
    draw = np.random.default_rng(3)
    x = draw.integers(-(10**9), 10**9, (500, 6)) + 10**12
    whole, parts = whitening.moments(x), [whitening.moments(p) for p in np.array_split(x, 7)]
    while len(parts) > 1:
        parts = [whitening.merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert parts[0][:2] == whole[:2] and np.allclose(parts[0][2], whole[2], rtol=1e-12)
    model = whitening.Whitening(500, whole[1], np.ones(6), np.eye(6), np.ones(6), 64, 0)
    exact = [sum((500 * int(v) - s) ** 2 for v, s in zip(row, whole[1])) for row in x]
    assert model.deviations(x) == exact and max(exact) > 1 << 63
    assert Decimal(exact[0])


# ---- byte-level BPE

ODD = [
    None, "", " ", "\n\n  \t x", "don't we'll I'M it's 'sam", "a" * 3000, "abababab" * 40, "日本語のテキスト、漢字とかな。", "naïve café — Ωmega ½ ⅷ ٣٤",
    "😀👩‍👩‍👧 emoji", "x y z　w\u0085v᠎u", "\x00\x01\x1c\x1d control", "0123456789" * 20, "tail spaces   ", "   lead", "a\r\n\r\nb", "<|endoftext|> [INST]",
    "𠀀𮯰\U00031350 letters of later Unicode", "é combining", "_under__score_ --- ...", "ſ'ſ K 's'S", "﻿bom ퟿",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_ids_are_the_librarys_and_bytes_come_back(spark, library):
    draw = random.Random(4)
    texts = ODD + ["".join(draw.choice("abcdefgh ijé的1 9'.\n") for _ in range(draw.randint(1, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "own", "x") for i, t in enumerate(texts)] * 2, "id int, text string, ids string, t_ string")
    rows = bpe.encoded(df).orderBy("id").collect()
    assert len(rows) == 2 * len(texts) and rows[0].t_ == "x"
    for r in rows:
        expected = library.encode_ordinary(r.text or "")
        assert list(r.ids) == expected, r.text
        assert bytes(r.decoded) == (r.text or "").encode() and bytes(r.packed) == np.array(expected, "<u4").tobytes()


def test_words_folded_beforehand_or_in_place_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    own = bpe.encoder(spark)
    few = own.encode(docs, known=own.known_words(docs, words=50))
    none = own.encode(docs)
    assert {r.doc_id: list(r.ids) for r in few.collect()} == {r.doc_id: list(r.ids) for r in none.collect()}


def test_bytes_joined_by_words_are_those_of_the_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(20)
    docs = docs.union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], docs.schema))
    own = bpe.encoder(spark)
    expected = {r.doc_id: (r.decoded, r.packed) for r in own.pack(own.decode(own.encode(docs))).collect()}
    made = ("decoded", "packed")
    out = own.encode_whole(docs, "text", own.known_words(docs, words=50, made=made), made)
    assert out.columns == ["doc_id", "text", *made]
    assert {r.doc_id: (r.decoded, r.packed) for r in out.collect()} == expected


def test_words_of_a_block_fold_as_the_librarys(library):
    draw = random.Random(5)
    words = [draw.choice(["", " "]) + "".join(draw.choice("aeinrsthé的") for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    words += ["a", "a" * 300, "abab" * 40, "日本語のテキスト", " 😀👩‍👩‍👧", "---___---", " ", "0123456789" * 9]
    merges = bpe.Merges.of(bpe.read_ranks())
    assert [x.tolist() for x in merges.fold([w.encode() for w in words])] == [library.encode_ordinary(w) for w in words]
    assert merges.fold([]) == [] and [x.tolist() for x in merges.fold([b""])] == [[]]
    bytes_only = bpe.Merges.of({bytes([b]): 255 - b for b in range(256)})
    assert bytes_only.fold([b"ab"])[0].tolist() == [255 - 97, 255 - 98]


def test_listed_words_are_folded_without_higher_order_functions(spark, library):
    rows = bpe.encoder(spark).fold_words(spark.createDataFrame([(" hetionat",), (" the",), ("é的",)], "w string"), "w", "i")
    assert {r.w: list(r.i) for r in rows.collect()} == {w: library.encode_ordinary(w) for w in (" hetionat", " the", "é的")}
    assert "lambdafunction" not in rows._jdf.queryExecution().executedPlan().toString()


def test_registered_query_on_a_table(spark, sf_dir, library):
    out = {r.doc_id: r for r in queries.queries()["op13_byte_level_bpe"](spark, sf_dir).collect()}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(table)
    for d in table:
        ids = library.encode_ordinary(d.text or "")
        r = out[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_empty_table_and_a_rank_file_without_bytes(spark, tmp_path):
    assert bpe.encoded(spark.createDataFrame([], "text string")).count() == 0
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "few"))


def test_unknown_ids_have_no_bytes(spark):
    df = spark.createDataFrame([([0, 99999999, 1],), (None,)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.encoder(spark).decode(df).collect()] == [b'!"', b""]


def test_decoding_stays_in_spark(spark, sf_dir):
    plan = queries.queries()["op13_byte_level_bpe"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and len(plan) < 200_000
