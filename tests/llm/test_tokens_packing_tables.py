"""Exact token ids, packing invariants, shards read back."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, packing, sstable, tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder()


ODD = ["", "  ", None, "<|endoftext|> x", "a<|startoftext|>", "\x1cfoo\x85bar b", "l'été's ŒUVRE İSTANBUL! ΣΑΣ", "é École À", "日本語 テスト 123 १२३", "don't!!! x's 's't", "́x", "a b　c", "KK ß ẞ", "😀! 👍🏽", "क़ख़! x", "中 \x00 a\x00b", "word " * 5000]


def test_ids_are_the_library_s(enc):
    assert enc.encode(ODD) == enc.whole([t or "" for t in ODD])
    rng = random.Random(4)
    signs = "aAé́ \t\n'!.sT1٣日 \x85\x1cΣσßİıK🙂-_़क"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert enc.encode(texts) == enc.whole(texts)


def test_cache_may_overflow(enc, monkeypatch):
    small = tokens.WordEncoder(tokens.default_path())
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    texts = ["alpha beta gamma delta epsilon", "zeta alpha beta", "gamma! delta?"]
    assert small.encode(texts) == small.whole(texts)


DOCS = [(1, "hello world, again"), (2, None), (3, ""), (3, "twin"), (3, "twin"), (None, "no id"), (4, "long words " * 6000), (5, "x")]


def _docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(2, "doc_id")


def _checked(rows, enc, docs, limits):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= limits.tokens and len(seq) <= limits.segments and sum(r.loss_tokens for r in seq) <= limits.loss
        assert at & (at - 1) == 0 or at == limits.tokens or limits != packing.Limits()
    whole = {}
    for doc, text in docs:
        whole.setdefault(doc, []).append(enc.whole([text or ""])[0] + (2).to_bytes(4, "little"))
    for doc, want in whole.items():
        got = sorted((r.start, r.ids) for r in rows if r.doc_id == doc)
        assert sum(len(i) for _, i in got) == sum(map(len, want))
        if len(want) == 1:
            assert b"".join(i for _, i in got) == want[0]


def test_packing(spark, enc):
    rows = packing.pack(_docs(spark)).collect()
    _checked(rows, enc, DOCS, packing.Limits())
    assert packing.pack(_docs(spark).limit(0)).count() == 0


def test_packing_limits_of_instruction_data(spark, enc):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(["ask", "tell", "why"]) for _ in range(rng.randint(1, 120)))) for k in range(200)]
    limits = packing.Limits(tokens=128, segments=3, loss=60)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.array(F.lit(5), F.lit(9), F.lit(4), F.lit(30)))
    rows = packing.pack(df.coalesce(1), limits=limits, mask="runs").collect()
    _checked(rows, enc, docs, limits)
    assert any(r.loss_tokens < r.length for r in rows)
    full = sum(r.length for r in rows) / (128 * len({r.sequence_id for r in rows}))
    assert full > 0.45  # the loss-bearing tokens fill up first


def test_no_padding_and_high_fill(spark, enc):
    docs = [(k, "word " * (37 * k % 900)) for k in range(300)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())
    assert sum(n == 4096 for n in fill.values()) >= sum(fill.values()) // 4096


def _packed(lengths, limits=packing.Limits(), loss=lambda row, start, n: n - (start == 0 < n)):
    p = packing.Packer(limits, loss)
    done, rest = p.pack([x for row, n in enumerate(lengths) for x in p.pieces(row, n)], True)
    assert not rest
    ranges = {}
    for s in done:
        assert sum(x.length for x in s) <= limits.tokens and len(s) <= limits.segments and sum(x.loss for x in s) <= limits.loss
        assert all(x.loss == loss(x.row, x.start, x.length) and x.length > 0 for x in s)
        for x in s:
            ranges.setdefault(x.row, []).append((x.start, x.length))
    for row, n in enumerate(lengths):
        at = 0
        for start, length in sorted(ranges[row]):
            assert start == at
            at += length
        assert at == n
    return done


@pytest.mark.parametrize("lengths", [[20] * 100_000, [3] * 20_000, [1] * 100_000, [1 + 7 * k % 4200 for k in range(900)], [4096] * 9, [9000, 1, 1, 8192]])
def test_many_short_pieces_pack_fast_and_without_padding(lengths):
    import time

    began = time.perf_counter()
    done = _packed(lengths)
    assert time.perf_counter() - began < 20  # a scan of all waiting pieces for each would take minutes
    sizes = [sum(x.length for x in s) for s in done]
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes)
    assert len(sizes) <= sum(lengths) / min(4096, 128 * min(lengths)) + 64


def test_a_class_taken_at_once_is_what_single_picks_would_take():
    rng = np.random.default_rng(3)
    for _ in range(30):
        limits = packing.Limits(*(int(x) for x in (rng.integers(50, 200), rng.integers(2, 12), rng.integers(30, 150))))
        share = rng.uniform(0.2, 1, 400)
        loss = lambda row, start, n: int((start + n) * share[row]) - int(start * share[row])
        lengths = rng.choice([2, 5, 11, 40], 200).tolist()
        fast = _packed(lengths, limits, loss)
        single = packing.Classes.times
        packing.Classes.times = lambda self, k, free, scarce: 1
        try:
            slow = _packed(lengths, limits, loss)
        finally:
            packing.Classes.times = single
        assert [sorted((x.length, x.loss) for x in s) for s in fast] == [sorted((x.length, x.loss) for x in s) for s in slow]


def test_limits_below_one_are_refused():
    with pytest.raises(ValueError):
        packing.Limits(loss=0)


def test_op1_gives_every_id_once(spark, sf_dir, enc):
    """Ids, places and digests of all documents of a table against the library's own encoding."""
    docs = {r.doc_id: enc.whole([r.text or ""])[0] + (2).to_bytes(4, "little") for r in common.table(spark, sf_dir, "documents").collect()}
    rows = packing.op1(spark, sf_dir).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc, ids in docs.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert at == len(ids) // 4
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at < 4096 and at & (at - 1) == 0


def test_shards(spark, enc, tmp_path):
    d = _docs(spark)
    m = sstable.write(d, f"file://{tmp_path}/a", shard_bytes=1)
    rows = sstable.read(spark, m).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 3, 4, 5]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids[-4:] == (1).to_bytes(4, "little")
        at += r.n_tokens
    assert rows[1].ids[:-4] == enc.whole(["hello world, again"])[0]
    assert sstable.read(spark, sstable.write(d.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_lookup_over_many_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 256)
    path = tmp_path / "x.sst"
    rng = np.random.default_rng(1)
    held = {int(k): rng.integers(0, 70000 if k % 5 == 0 else 60000, rng.integers(0, 40)).astype("<u4").tobytes() for k in np.unique(rng.integers(-(10**6), 10**12, 500))}
    with open(path, "wb") as f:
        w = sstable.Writer(f)
        for k in sorted(held):
            w.add(sstable.key_of(k), held[k])
        w.close()
    with open(path, "rb") as f:
        r = sstable.Reader(f, path.stat().st_size)
        assert len(r.places) > 5 and all(r.get(k) == v for k, v in held.items())
        assert all(r.get(k + 1) is None for k in held if k + 1 not in held) and r.get(None) is None
        assert [sstable.id_of(k) for k, _ in r.scan()] == sorted(held)
        assert sum(r.may_hold(k) for k in range(2 * 10**12, 2 * 10**12 + 2000)) < 100
    torn = path.read_bytes()[:-1]
    (tmp_path / "torn").write_bytes(torn)
    with open(tmp_path / "torn", "rb") as f, pytest.raises(ValueError):
        sstable.Reader(f, len(torn))


def test_queries_on_tables(spark, sf_dir, enc):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = {}
    at = 0
    for r in sorted(docs):
        ids = enc.whole([r.text])[0] + (1).to_bytes(4, "little")
        want[r.doc_id] = (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sstable.op4(spark, sf_dir).collect()} == want
    assert sum(r.length for r in packing.op1(spark, sf_dir).collect()) == at
