"""The stateful operator against the same of a table: late and repeated events, a restart, a last event that closes all."""

import random

from pyspark.sql import functions as F

from threadloom.streaming import bursts


def test_bursts_of_a_stream_equal_those_of_a_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value").orderBy("ts").limit(300)
    rows = [tuple(r) for r in events.collect()]
    draw = random.Random(1)
    # Four files in order of time, each also with some events of the file before, and some twice.
    parts = [rows[i : i + 75] for i in range(0, 300, 75)]
    for k in range(1, 4):
        parts[k] = parts[k] + draw.sample(parts[k], 20) + draw.sample(parts[k - 1], 10)
        draw.shuffle(parts[k])
    held = [parts[k].pop() for k in range(1, 3)]  # and one that comes a file late
    parts[2].append(held[0])
    parts[3].append(held[1])
    span = max(r[2] for r in rows) - min(r[2] for r in rows)
    late = f"{int(span.total_seconds()) + 60} seconds"
    schema = events.schema
    for k, part in enumerate(parts[:2]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")

    def run():
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        out = bursts.bursts(files, 6 * 3600, late)
        q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    run()
    for k, part in enumerate(parts[2:], 2):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    last = max(r[2] for r in rows)
    closing = [(10**9, 10**9, last.replace(year=last.year + 1), None)]
    spark.createDataFrame(closing, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/9")
    run()  # from its checkpoint
    expected = bursts.settled(spark.createDataFrame([r for p in parts for r in p], schema), 6 * 3600)
    key = lambda r: (r.user_id, r.start_us, r.end_us, r.n, round(r.total, 6))
    got = sorted(key(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == sorted(key(r) for r in expected.collect()) and len(got) > 100
