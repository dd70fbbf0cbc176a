"""Windows over the event table: extensions that the streaming operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.registry import Tables, query


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL 30 MINUTE * k AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1")
def events_sliding(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '2 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def events_session(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start")).select("user_id", "start", "n")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT p.event_id, v.event_id AS seen FROM p ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_events(t: Tables) -> DataFrame:
    """The last view before each purchase: one sort per user and a running last value, no range join."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    x = t.events.where("event_type in ('purchase', 'view')").withColumn("seen", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w))
    return x.where("event_type = 'purchase'").select("event_id", "seen")
