"""Joins by time over events and orders.  The reference has none; they are offered beside its operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from . import query
from .bindings import table

_DAY = 86_400_000_000


@query(
    "asof_last_view",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT p.event_id, v.event_id AS view_id, epoch_us(p.ts) - epoch_us(v.ts) AS since_us FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_last_view(spark, d):
    """For each purchase the user's last view at or before it."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bought, seen = (events.where(F.col("event_type") == k).drop("event_type") for k in ("purchase", "view"))
    met = intervals.as_of(bought, seen, "user_id", "ts", tie="event_id")
    since = F.unix_micros(F.col("left.ts").cast("timestamp")) - F.unix_micros(F.col("right.ts").cast("timestamp"))
    return met.select("left.event_id", F.col("right.event_id").alias("view_id"), since.alias("since_us"))


@query(
    "asof_previous_order",
    """WITH last AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT o.o_orderkey, CASE WHEN date_diff('day', last.o_orderdate, o.o_orderdate) <= 90 THEN last.k END AS previous
FROM orders o ASOF LEFT JOIN last ON o.o_custkey = last.o_custkey AND o.o_orderdate > last.o_orderdate""",
)
def asof_previous_order(spark, d):
    """For each order the customer's last order on an earlier day, if it is at most 90 days old."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    met = intervals.as_of(orders, orders, "o_custkey", "o_orderdate", strict=True, tie="o_orderkey", within=90 * _DAY)
    return met.select("left.o_orderkey", F.col("right.o_orderkey").alias("previous"))


_SHIPPED = "shipped AS (SELECT o_custkey, o_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


@query(
    "overlapping_shipments",
    f"WITH {_SHIPPED} SELECT a.o_custkey, a.o_orderkey AS one, b.o_orderkey AS two FROM shipped a JOIN shipped b ON a.o_custkey = b.o_custkey AND a.first <= b.last AND b.first <= a.last WHERE a.o_orderkey < b.o_orderkey",
)
def overlapping_shipments(spark, d):
    """Pairs of a customer's orders that were shipped at the same time."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    shipped = lines.groupBy("o_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    shipped = shipped.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    met = intervals.overlaps(shipped, shipped, "o_custkey", ("first", "last"), ("first", "last"), 16 * _DAY)
    return met.where("left.o_orderkey < right.o_orderkey").select("left.o_custkey", F.col("left.o_orderkey").alias("one"), F.col("right.o_orderkey").alias("two"))


@query(
    "clicks_before_errors",
    "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT user_id, ts FROM events WHERE event_type = 'click') SELECT e.event_id, count(*) AS clicks FROM e JOIN c ON e.user_id = c.user_id AND c.ts BETWEEN e.ts - INTERVAL '2 days' AND e.ts GROUP BY e.event_id",
)
def clicks_before_errors(spark, d):
    """For each error the number of the user's clicks in the two days before it, where there are any."""
    events = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    clicks = events.where("event_type = 'click'").select("user_id", "at")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", (F.col("at") - 2 * _DAY).alias("since"), "at")
    met = intervals.containing(clicks, errors, "user_id", "at", ("since", "at"), _DAY)
    return met.groupBy(F.col("right.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("clicks"))
