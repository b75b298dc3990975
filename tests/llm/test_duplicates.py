"""SimHash components, repeated passages, benchmark windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import common, components, decontamination, overlap, simhash, substrings


def _fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_fingerprints():
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "É é x y z", "w " * 70000 + "x y", "A b C d e f g h"]
    assert [int(x) for x in simhash.fingerprint_texts(texts)] == [_fp(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_forest(radius):
    rng = np.random.default_rng(radius)
    for _ in range(15):
        n = int(rng.integers(2, 400))
        f = rng.integers(0, 2**48, 6, dtype=np.uint64)[rng.integers(0, 6, n)]
        for _ in range(3):
            f = f ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 48, n).astype(np.uint64), np.uint64(0))
        f = np.unique(f)
        groups = np.sort(rng.integers(0, 3, len(f)))
        sides = np.zeros(len(f), np.int64)
        for g in range(3):  # one group in two halves, as a large bucket's blocks are
            at = np.flatnonzero(groups == g)
            if g == 1:
                sides[at[len(at) // 2 :]] = 1
        a, _ = simhash.forest(f, groups, sides, range(16), radius)
        ok = lambda i, j: groups[i] == groups[j] and (sides[i] != sides[j] or groups[i] != 1 or not sides[groups == 1].any())
        links = [(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if ok(i, j) and bin(int(f[i] ^ f[j])).count("1") <= radius]
        assert len(f) - len(a) == len(set(_roots(len(f), links)))


def test_large_buckets_are_split(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    want = _roots(len(fps), links)
    for block, bands in ((7, None), (1 << 20, 4), (1 << 20, 5), (9, 6)):
        got = {r.node: r.root for r in components.connected(simhash.links(nodes, bands, block=block)).collect()}
        seen = [got.get(f, f) for f in signed]
        assert len({(a, b) for a, b in zip(seen, want)}) == len(set(want)) == len(set(seen))


def test_keys_meet_every_link():
    rng = random.Random(2)
    for bands in (4, 5, 6):
        made = simhash.keys(bands)
        assert len(made) == {4: 4, 5: 10, 6: 20}[bands]
        for _ in range(200):
            bits = set(rng.sample(range(64), 3))
            assert any(all(p not in bits for a, b in k for p in range(a, b)) for k in made)
    assert [simhash.bands_for(n) for n in (10, 4_000_000, 5_000_000, 10**11)] == [4, 4, 5, 6]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


ROWS = [(7, "a b c d e f g h i j"), (2, "A B c d e f g h i j"), (2, "A B c d e f g h i j"), (9, None), (4, " "), (None, "solo words here now"), (None, "a b c d e f g h i j"), (11, "quite another text it is")]


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = [(r.doc_id is None, r.doc_id or 0, r.component_id, r.fingerprint) for r in simhash.near_duplicates(df).collect()]
    f = f"{_fp(ROWS[0][1]):016x}"
    assert (False, 2, 2, f) in got and got.count((False, 2, 2, f)) == 2 and (False, 7, 2, f) in got and (True, 0, 2, f) in got
    assert (False, 9, 4, "0" * 16) in got and (True, 0, None, f"{_fp('solo words here now'):016x}") in got
    kept = simhash.representatives(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["11", "2", "4", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_op6_by_brute_force(spark, sf_dir):
    docs = sorted(common.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    fps = [_fp(r.text) for r in docs]
    want = _roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6(spark, sf_dir).collect()}
    assert got == {r.doc_id: (f"{f:016x}", docs[w].doc_id) for r, f, w in zip(docs, fps, want)}


def _five(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _similar(texts):
    sets = [_five(t) for t in texts]
    return _roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])


def _edited(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        yield " ".join(w)


def test_forest_of_similar_sets():
    rng = random.Random(8)
    for edits in (1, 4, 9):
        texts = [t for _ in range(4) for t in _edited(rng, 12, 150, edits)] + ["a b", "c"]
        links = overlap.forest([overlap.shingles(t)[1] for t in texts])
        want = _similar(texts)
        assert _roots(len(texts), links) == want and len(links) == len(texts) - len(set(want))


@pytest.mark.parametrize("block", [overlap.BLOCK, 5])
def test_stage_links_texts_beyond_three_bits(spark, monkeypatch, block):
    monkeypatch.setattr(overlap.links, "__defaults__", (block,))
    rng = random.Random(9)
    texts = [t for e in (1, 3, 6) for t in _edited(rng, 20, 200, e)] + ["a b c d", "A  b\nC d", "a b c e", "", None, " \t"]
    want = _similar(texts)
    fps = [_fp(t) for t in texts]
    assert any(w == want[j] and bin(fps[i] ^ fps[j]).count("1") > 3 for i, w in enumerate(want) for j in range(i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == dict(enumerate(want))
    assert {r.doc_id for r in simhash.representatives(df).collect()} == set(want)


def test_stage_by_brute_force(spark, sf_dir):
    docs = sorted(common.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    want = _similar([r.text for r in docs])
    got = {r.doc_id for r in simhash.representatives(common.table(spark, sf_dir, "documents")).collect()}
    assert got == {docs[w].doc_id for w in want}


def _kept(rows, window=50):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = " ".join(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        stay = [True] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[" ".join(w[i : i + window])] < d:
                stay[i : i + window] = [False] * window
        out.append((d, len(w), stay.count(False), hashlib.sha256(" ".join(x for x, s in zip(w, stay) if s).encode()).hexdigest()))
    return out


def _digest(df):
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h"))


def test_repeats_of_odd_rows(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(999)}" for _ in range(60))
    filler = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
    rows = [(1, filler(20) + " " + passage), (2, passage + "  " + filler(30)), (2, filler(10) + "\n" + passage), (3, None), (4, ""), (None, passage), (6, "a " * 300), (5, "a " * 200), (7, " ".join(passage.split()[:49])), (8, passage.upper()), (9, filler(5) + "\t" + passage + " " + passage), (9, "same"), (9, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("spans", F.lit("x"))
    for parts in (1, 5):
        got = sorted(map(tuple, _digest(substrings.remove_repeats(df.repartition(parts))).collect()), key=repr)
        assert got == sorted(_kept(rows), key=repr)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("window,size", [(3, 2), (5, 4), (4, 9)])
def test_repeats_with_small_windows(spark, window, size):
    rng = random.Random(window)
    rows = [(rng.randrange(12), " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for _ in range(12)]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = sorted(map(tuple, _digest(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, size)).collect()))
    assert got == sorted(_kept(rows, window))


@pytest.mark.parametrize("flush", [1 << 20, 2000])
def test_repeats_around_hot_minimisers(spark, monkeypatch, flush):
    """Word runs that a third of all rows have, each time in another context, and some passages that do repeat."""
    monkeypatch.setattr(substrings, "HOT_LEAST", 3)
    monkeypatch.setattr(substrings, "FLUSH_BYTES", flush)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    hot, passage = "a b c d e f g h", " ".join(word() for _ in range(40))
    rows = []
    for d in rng.sample(range(1000), 90):
        text = " ".join(word() for _ in range(rng.randrange(60)))
        text += f" {hot} " * 3 + passage * (d % 5 == 0) + " " + hot if d % 3 == 0 else " " + passage * (d % 4 == 0)
        rows.append((d, text + " " + " ".join(word() for _ in range(rng.randrange(30)))))
    rows += [rows[0], (2000, rows[1][1]), (2001, None), (None, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = substrings.hot_minimisers(df.where("doc_id is not null and text is not null").selectExpr("doc_id", "xxhash64(text)", "text"), 20, 4, 1)
    assert found
    got = sorted(map(tuple, _digest(substrings.remove_repeats(df, 20, 4, sample=1)).collect()), key=repr)
    assert got == sorted(_kept(rows, 20), key=repr)


def test_buckets_are_bounded_by_bytes(spark):
    """A run of words in 3 of 1,000 documents, each time in another context, is hot once its bucket would hold too much."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    run, passage = "a b c d e f", " ".join(word() for _ in range(30))
    rows = [(d, " ".join(word() for _ in range(25)) + (f" {run} " + " ".join(word() for _ in range(25)) if d % 333 == 0 else "") + (" " + passage) * (d % 250 == 0)) for d in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = df.selectExpr("doc_id", "xxhash64(text)", "text")
    sizes = {}
    for _, text in rows:
        words = text.encode().split()
        for first, n, low in zip(*substrings.super_kmers(substrings.word_hashes(words, {}), 20, 4)):
            sizes.setdefault(low, {})[b" ".join(words[first : first + n + 19])] = None
    held = {low: sum(map(len, strings)) for low, strings in sizes.items()}
    most = sorted(held.values())[-3]
    hot = substrings.hot_minimisers(keyed, 20, 4, 1, most=most)
    assert hot == {low for low, n in held.items() if n > most} and 1 <= len(hot) <= 2
    assert substrings.hot_minimisers(keyed, 20, 4, 1) == frozenset()
    for bound in (most, 200):
        got = sorted(map(tuple, _digest(substrings.remove_repeats(df, 20, 4, sample=1, most=bound)).collect()), key=repr)
        assert got == sorted(_kept(rows, 20), key=repr)


def test_op10_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, substrings.op10(spark, sf_dir).collect())) == sorted(_kept(rows))


def _hits(docs, items, window=13):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("bound", [0, 10**6])
def test_contamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", bound)
    rng = random.Random(5)
    long_item = " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(20))
    items = [(10, long_item), (2, "Short, item"), (3, "one"), (4, None), (5, "!!"), (6, long_item), (None, "x y z"), (7, "É Ünïcode words")]
    tail = " ".join(f"f{k}" for k in range(400))
    docs = [(1, long_item.upper() + "; " + tail), (2, "pre " + " ".join(long_item.split()[3:17])), (3, "short-ITEM short item one"), (4, None), (5, ""), (6, "x y z"), (7, " ".join(long_item.split()[:12])), (8, "é ünïcode words!"), (8, "one"), (9, "one"), (9, "one"), (None, "one"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("items", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    show = lambda df: sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in df.collect()), key=repr)
    assert show(decontamination.contaminated(d, b)) == sorted(_hits(docs, items), key=repr)
    assert all(not r[4] and r[3] == "" for r in show(decontamination.contaminated(d, b.limit(0))))
    assert decontamination.contaminated(d.limit(0), b).count() == 0


def test_op7_by_brute_force(spark, sf_dir):
    docs, items = ([tuple(r) for r in common.table(spark, sf_dir, t).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = [(d, n, h, len(i.split(",")) if i else 0, hashlib.sha256(i.encode()).hexdigest(), c) for d, n, h, i, c in _hits(docs, items)]
    assert sorted(map(tuple, decontamination.op7(spark, sf_dir).collect())) == sorted(want)


def test_tables_beyond_the_broadcast_bounds(spark, sf_dir, monkeypatch):
    """What is written is joined by a shuffle where it is too large to be broadcast; the results are the same."""
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    show = lambda df: sorted(map(tuple, df.collect()))
    kept, judged = show(simhash.representatives(docs).select("doc_id")), show(decontamination.contaminated(docs, items).select("doc_id", "n_hit", "n_words"))
    monkeypatch.setattr(common, "SMALL_ROWS", -1)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = common.small(common.staged(spark.range(3)))._jdf.queryExecution().toString()
        assert "broadcast" not in plan
        assert show(simhash.representatives(docs).select("doc_id")) == kept
        assert show(decontamination.contaminated(docs, items).select("doc_id", "n_hit", "n_words")) == judged
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_op7_runs_no_python(spark, sf_dir):
    plan = decontamination.op7(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
