"""Streaming queries over the events table, drained to the end, with their batch oracles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.plans import domain as d
from moraine.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = d.table(spark, sf, "events").schema
    e = streams.file_stream(spark, sf, schema, "events.parquet")
    return e.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"), d.cents("value").alias("amount"))


def _closed(sql: str, span: str) -> str:
    """Append mode emits a window once the watermark has passed its end."""
    return f"WITH late AS (SELECT max(ts) AS t FROM events) {sql} HAVING {span}"


@query("SELECT user_id AS lake_id, event_id, s_suppkey AS recipient FROM events JOIN supplier ON s_suppkey = user_id WHERE event_type IN ('error', 'click')")
def sensor_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "flow_surge").when(F.col("event_type") == "click", "manual").otherwise("other")
    readings = _events(spark, sf).select(F.col("user_id").alias("lake_id"), F.col("event_id").alias("sensor_id"), kind.alias("kind"), "event_id")
    people = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lake_id"), F.col("s_suppkey").alias("recipient"))
    return streams.run_to_end(streams.fan_out(readings, people).select("lake_id", "event_id", "recipient"), "sensor")


@query("SELECT DISTINCT user_id AS lake_id, event_id % 20 AS scene_id FROM events")
def drain_alert_once(spark: SparkSession, sf: str) -> DataFrame:
    looks = _events(spark, sf).select(F.col("user_id").alias("lake_id"), (F.col("event_id") % 20).alias("scene_id"), "at")
    return streams.run_to_end(streams.once_per_scene(looks, "60 days").select("lake_id", "scene_id"), "drain")


@query("""SELECT lake_id, scene_id, seq FROM (SELECT user_id % 50 AS lake_id, CAST(event_id // 7 % 3 AS VARCHAR) AS scene_id, event_id AS seq,
  lag(event_id // 7 % 3) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS before FROM events WHERE event_type IN ('view', 'click')) WHERE before IS NULL OR before <> CAST(scene_id AS BIGINT)""")
def drain_alert_last(spark: SparkSession, sf: str) -> DataFrame:
    """Each lake's drained scenes, alerted again when another one was alerted in between."""
    looks = _events(spark, sf).select(
        (F.col("user_id") % 50).alias("lake_id"), (F.floor(F.col("event_id") / 7) % 3).cast("string").alias("scene_id"), F.col("event_id").alias("seq"), F.col("event_type").isin("view", "click").alias("drained")
    )
    return streams.alert_last_scene(looks, "last-scene")


@query("""WITH late AS (SELECT max(ts) AS t FROM events)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS from_time, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount FROM events, late GROUP BY 1, 2, t
HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= t - INTERVAL 10 MINUTE""")
def tumbling_hours(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.tumbling(_events(spark, sf), "1 hour", "10 minutes", "event_type")
    return streams.run_to_end(out.select(F.col("window.start").cast("timestamp_ntz").alias("from_time"), "event_type", "n", "amount"), "tumbling")


@query("""WITH late AS (SELECT max(ts) AS t FROM events), slid AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS from_time, value FROM events, (SELECT unnest([0, 1]) AS k))
SELECT from_time, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount FROM slid, late GROUP BY 1, t HAVING from_time + INTERVAL 1 HOUR <= t - INTERVAL 10 MINUTE""")
def sliding_hours(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.sliding(_events(spark, sf), "1 hour", "30 minutes", "10 minutes")
    return streams.run_to_end(out.select(F.col("window.start").cast("timestamp_ntz").alias("from_time"), "n", "amount"), "sliding")


@query("""WITH late AS (SELECT max(ts) AS t FROM events), marks AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marks)
SELECT user_id, min(ts) AS from_time, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount FROM runs, late GROUP BY user_id, run, t HAVING max(ts) + INTERVAL 6 HOUR <= t - INTERVAL 10 MINUTE""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.sessions(_events(spark, sf), "6 hours", "10 minutes", "user_id")
    return streams.run_to_end(out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("from_time"), "n", "amount"), "sessions")


@query(None)
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Ten requests in any two days a client; tests hold the state to a loop."""
    asked = _events(spark, sf).select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.col("at").cast("double").alias("at_s"))
    return streams.run_to_end(streams.rate_limited(asked, 10, 2 * 86_400.0), "limit")


@query("SELECT event_id, version, status FROM (SELECT event_id % 3000 AS event_id, event_id AS version, event_type AS status, row_number() OVER (PARTITION BY event_id % 3000 ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def event_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select((F.col("event_id") % 3000).alias("event_id"), F.col("event_id").alias("version"), F.col("event_type").alias("status"))
    return streams.log_events(rows, "log")


def _season(pdf: pd.DataFrame) -> pd.DataFrame:
    if not (pdf["event_type"] == "purchase").any():
        raise ValueError("no clear scene")
    return pd.DataFrame({"lake_id": pdf["lake_id"].iloc[:1], "n": [len(pdf)], "amount": [int(pdf["amount"].sum())]})


def _risk(pdf: pd.DataFrame) -> pd.DataFrame:
    if pdf["amount"].iloc[0] % 5 == 0:
        raise ArithmeticError("no outline")
    return pdf.assign(score=pdf["amount"] % 97)[["lake_id", "score"]]


LAKES = """lakes AS (SELECT user_id AS lake_id, count(*) FILTER (event_type = 'purchase') AS clear, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount FROM events GROUP BY 1)"""


@query(f"""WITH {LAKES} SELECT lake_id, 'risk' AS stage, NULL AS reason, amount % 97 AS score FROM lakes WHERE clear > 0 AND amount % 5 <> 0
UNION ALL SELECT lake_id, CASE WHEN clear = 0 THEN 'season' ELSE 'risk' END, CASE WHEN clear = 0 THEN 'ValueError: no clear scene' ELSE 'ArithmeticError: no outline' END, NULL FROM lakes WHERE clear = 0 OR amount % 5 = 0""")
def refresh_lakes(spark: SparkSession, sf: str) -> DataFrame:
    """Two stages over each lake's looks: scores, and the reasons of the lakes that failed in either."""
    looks = _events(spark, sf).select(F.col("user_id").alias("lake_id"), "event_type", "amount")
    stages = [("season", _season, "lake_id long, n long, amount long"), ("risk", _risk, "lake_id long, score long")]
    done, failed = streams.refresh(looks, stages, "refresh")
    rows = done.select("lake_id", F.lit("risk").alias("stage"), F.lit(None).cast("string").alias("reason"), "score")
    return rows.unionByName(failed.withColumn("score", F.lit(None).cast("long")))
