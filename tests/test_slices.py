"""Passages leave a Python worker in slices, whatever the size of the batch."""

import random

from threadloom.operators import chunking


def test_pieces_of_many_texts_in_slices(spark, monkeypatch):
    draw = random.Random(3)
    texts = [" ".join("w" * draw.randrange(1, 12) + draw.choice(["", "", ".", "\n\n"]) for _ in range(draw.randrange(600))) for _ in range(60)] + [None, "", "short"]
    rows = spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)], "i int, `a.b` string, text string").repartition(2)
    want = sorted((i, f"t{i}", k, p) for i, t in enumerate(texts) for k, p in enumerate(chunking.split(t)))
    for size in (1, 3000, chunking.SLICE_CHARACTERS):
        monkeypatch.setattr(chunking, "SLICE_CHARACTERS", size)
        out = chunking.split_texts(rows)
        assert out.columns == ["i", "a.b", "piece_no", "piece"] and sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
