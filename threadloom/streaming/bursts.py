"""Bursts of events by a stateful operator with timers.

The operator keeps each key's events of bursts that may still grow, once each however often they are delivered, in any
order, and sets a timer for when a burst could last be added to.  When the watermark passes it, the burst is given out
and its events leave the state.  State lives in RocksDB, and so needs no memory for keys that rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id long, start_us long, end_us long, n long, total double"


class _Bursts(StatefulProcessor):
    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event_id long", "at long, value double")

    def _bursts(self):
        """The key's bursts in order, each the sorted (time, id, value) of its events."""
        rows = sorted((v[0], k[0], v[1]) for k, v in self.events.iterator())
        burst: list = []
        for row in rows:
            if burst and row[0] - burst[-1][0] >= self.gap:
                yield burst
                burst = []
            burst.append(row)
        if burst:
            yield burst

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for part in rows:
            for event_id, at, value in zip(part["event_id"], part["at"], part["value"]):
                self.events.updateValue((int(event_id),), (int(at), None if pd.isna(value) else float(value)))
                self.handle.registerTimer((int(at) + self.gap) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out = []
        for burst in self._bursts():
            if burst[-1][0] + self.gap < now:
                out.append((key[0], burst[0][0], burst[-1][0], len(burst), sum(v or 0.0 for _, _, v in burst)))
                for _, event_id, _ in burst:
                    self.events.removeKey((event_id,))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "start_us", "end_us", "n", "total"])

    def close(self) -> None:
        pass


def bursts(events: DataFrame, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """``user_id, start_us, end_us, n, total`` of each user's events no further apart than a gap, once a burst is closed.

    ``events`` (``event_id, user_id, ts, value``) may come repeated and out of order, by at most ``late``; what is later is
    dropped.  Events without id, user or time take no part.  The stream's state store is RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).where("event_id is not null and user_id is not null and ts is not null").withWatermark("ts", late)
    rows = e.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Bursts(gap_seconds * 1_000_000), OUT, "Append", "EventTime")


def settled(events: DataFrame, gap_seconds: int) -> DataFrame:
    """The same of a table, all bursts closed: gaps and islands over distinct events."""
    from pyspark.sql import Window

    one = events.where("event_id is not null and user_id is not null and ts is not null").groupBy("user_id", "event_id").agg(F.max(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")).alias("x")).select("user_id", "event_id", "x.at", "x.value")
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(w) >= gap_seconds * 1_000_000, F.lit(True)).cast("int")
    k = one.withColumn("fresh", fresh).withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy("user_id", "burst").agg(F.min("at").alias("start_us"), F.max("at").alias("end_us"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total")).drop("burst")
