"""Who is warned, in which order, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import rules
from moraine.operators.exposure import first_per

PHONE = r"^\+[1-9][0-9]{7,14}$"
SCENARIOS, SOURCES = ("expected", "severe"), ("manual", "sensor", "drain")
NOTE_LIMIT = 300
#: What a sensor may report.
SENSOR_KINDS = ("water_level_drop", "flow_surge", "manual")


def affected_places(impacts: DataFrame, scenario: str) -> DataFrame:
    """Distinct people places of each lake that the scenario reaches, nearest first."""
    hit = rules.affected_under(scenario, F.col("status"), F.lit(True), F.col("expected"), F.col("severe"))
    rows = first_per(impacts.where(rules.is_people_place(F.col("kind")) & hit), ["lake_id", "osm"], ["km", "order_id", "line", "part"])
    w = Window.partitionBy("lake_id").orderBy(F.asc_nulls_last("fast_min"), "km", "osm")
    return rows.withColumn("seq", F.row_number().over(w))


def plan(places: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Recipients of each place in order; places without one stay, phones count once a place."""
    subs = first_per(subscriptions, ["osm", "phone", "channel"], ["created_at", "sub_id"])
    return places.join(subs, "osm", "left").select("lake_id", "seq", "osm", "sub_id", "phone", "channel")


def subscriber_counts(plan_rows: DataFrame) -> DataFrame:
    return plan_rows.groupBy("lake_id", "osm").agg(F.countDistinct("phone", "channel").alias("subscribers"))


def delivery_summary(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("event_id").agg(
        F.count("*").alias("recipients"), F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed")
    )


def normalise(subs: DataFrame) -> DataFrame:
    """Defaults filled in, and why a subscription is refused, if it is."""
    channel, lang = (F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)) for c, v in (("channel", "sms"), ("lang", "hi")))
    out = subs.withColumn("channel", channel).withColumn("lang", lang)
    reject = (
        F.when(~F.col("channel").isin("sms", "voice", "webpush"), "channel")
        .when(~F.col("lang").isin("hi", "en"), "language")
        .when((F.col("channel") != "webpush") & ~F.coalesce(F.col("phone").rlike(PHONE), F.lit(False)), "phone")
    )
    return out.withColumn("reject", reject)


def trigger_problem(scenario: Column, source: Column, dry_run: Column, note: Column) -> Column:
    """What is wrong with a trigger request; null if nothing is."""
    return (
        F.when(~F.coalesce(scenario.isin(*SCENARIOS), F.lit(False)), "scenario")
        .when(~F.coalesce(source.isin(*SOURCES), F.lit(False)), "source")
        .when((source == "drain") & ~dry_run, "dry_run")
        .when(F.char_length(F.coalesce(note, F.lit(""))) > NOTE_LIMIT, "note")
    )


def route(channel: Column, known: list[str], fallback: str = "log") -> Column:
    return F.when(channel.isin(known), channel).otherwise(fallback)


def sensor_triggers(readings: DataFrame) -> DataFrame:
    """A field sensor's ``readings(lake_id, sensor_id, kind)`` as requests for a severe warning, with why one is refused, if it is."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    refused = F.when(none("lake_id") | none("sensor_id"), "ids").when(~F.coalesce(F.col("kind").isin(*SENSOR_KINDS), F.lit(False)), "kind")
    note = F.concat(F.lit("sensor "), F.col("sensor_id").cast("string"), F.lit(" reported "), F.col("kind"))
    return readings.select("*", F.lit("severe").alias("scenario"), F.lit("sensor").alias("source"), note.alias("note"), refused.alias("refused"))


def planned_for(triggers: DataFrame, impacts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(trigger_id, seq, osm, sub_id, phone, channel): whom each accepted ``triggers(trigger_id, lake_id, scenario, refused)`` warns, in order."""
    rows = None
    for scenario in SCENARIOS:
        asked = triggers.where(F.col("refused").isNull() & (F.col("scenario") == scenario)).select("trigger_id", "lake_id")
        one = asked.join(plan(affected_places(impacts, scenario), subscriptions), "lake_id").drop("lake_id")
        rows = one if rows is None else rows.unionByName(one)
    return rows
