"""Hindsight-free hazard scores: every season sees only itself and the past."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import hydrology, rules


def growth(years: DataFrame) -> DataFrame:
    """Theil-Sen growth of each lake as of each of its seasons.

    A pair of full seasons counts for every season from the later one on, so the
    pairs of a lake are made once and the as-of side is a range join on the lake.
    """
    ok = years.where((F.col("status") == "ok") & (F.col("area_m2") > 0)).select("lake_id", "year", "area_m2", "uncertainty_m2")
    seasons = years.select("lake_id", F.col("year").alias("season")).distinct()
    a = ok.select("lake_id", F.col("year").alias("y1"), F.col("area_m2").alias("a1"))
    b = ok.select("lake_id", F.col("year").alias("y2"), F.col("area_m2").alias("a2"))
    pairs = a.join(b, "lake_id").where("y1 < y2").withColumn("slope", (F.col("a2") - F.col("a1")) / (F.col("y2") - F.col("y1")))
    slopes = seasons.join(pairs, "lake_id").where("y2 <= season").groupBy("lake_id", "season").agg(F.median("slope").alias("slope"))
    levels = seasons.join(ok, "lake_id").where("year <= season").groupBy("lake_id", "season").agg(
        F.count("*").alias("n_ok"), F.median("area_m2").alias("mid_area"), F.min("year").alias("from_year"),
        F.max("year").alias("to_year"), F.median(F.coalesce("uncertainty_m2", F.lit(0.0))).alias("mid_unc"),
    )
    enough = F.col("n_ok") >= rules.MIN_GROWTH_YEARS
    change = F.col("slope") * (F.col("to_year") - F.col("from_year"))
    return seasons.join(levels, ["lake_id", "season"], "left").join(slopes, ["lake_id", "season"], "left").select(
        "lake_id", "season", F.coalesce("n_ok", F.lit(0)).cast("long").alias("n_ok"),
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, 100 * F.col("slope") / F.col("mid_area")).alias("pct_per_yr"),
        F.coalesce(enough & (F.abs(change) > 2 * F.col("mid_unc")), F.lit(False)).alias("significant"),
    )


def current_outline(years: DataFrame) -> DataFrame:
    """Per season the last full season up to it, else the last measured one."""
    seasons = years.select("lake_id", F.col("year").alias("season")).distinct()
    past = seasons.join(years.where(F.col("area_m2") > 0), "lake_id").where("year <= season")
    row = F.struct("year", "area_m2")
    return past.groupBy("lake_id", "season").agg(
        F.coalesce(F.max(F.when(F.col("status") == "ok", row)), F.max(row)).alias("current"), F.max("last_day").alias("data_until")
    ).select("lake_id", "season", F.col("current.year").alias("area_year"), F.col("current.area_m2").alias("area_m2"), "data_until")


def factor_values(spark: SparkSession) -> DataFrame:
    """The factor table: key, group, rule and weight; it has as many rows as ``rules.FACTORS``."""
    return spark.createDataFrame(rules.FACTORS, "key string, grp string, lo double, hi double, log10 boolean, weight double")


def factor_score(key: str, value: Column, counts: Column | None = None) -> Column:
    _, _, lo, hi, log10, _ = next(f for f in rules.FACTORS if f[0] == key)
    score = rules.round_to(rules.rule_score(value, lo, hi, log10), 3)
    return score if counts is None else F.when(counts, score).otherwise(F.lit(0.0))


def risk_replay(years: DataFrame, terrain: DataFrame) -> DataFrame:
    """Score and level of each lake as of each season.

    ``terrain(lake_id, outlet_slope, avalanche, glacier)`` may lack a lake or hold
    nulls: unknown factors score 0. A lake without a measured season has no row.
    """
    rows = current_outline(years).join(growth(years), ["lake_id", "season"]).join(terrain, "lake_id", "left")
    volume = hydrology.lake_volume(F.col("area_m2"))
    scores = {
        "volume": factor_score("volume", volume),
        "growth": factor_score("growth", 5 * F.col("pct_per_yr"), F.col("significant")),
        "outlet_slope": factor_score("outlet_slope", F.col("outlet_slope")),
        "avalanche": factor_score("avalanche", F.col("avalanche")),
        "glacier": factor_score("glacier", F.col("glacier")),
    }

    def total(group: str) -> Column:
        return reduce(lambda a, b: a + b, [scores[k] * w for k, g, _, _, _, w in rules.FACTORS if g == group])

    rows = rows.withColumn("size", total("size")).withColumn("likelihood", total("likelihood"))
    rows = rows.withColumn("score", rules.round_to(100 * F.col("size") * F.col("likelihood"), 1))
    rounded = F.floor(volume + 0.5).cast("double")
    return rows.select(
        "lake_id", "season", "area_year", "area_m2", "data_until", "n_ok", "significant", "size", "likelihood", "score",
        rules.level_for(F.col("score")).alias("level"), F.round(volume).cast("long").alias("volume_m3"),
        F.round(hydrology.peak(rounded, hydrology.EXPECTED)).cast("long").alias("peak_expected_m3s"),
        F.round(hydrology.severe_peak(rounded)).cast("long").alias("peak_severe_m3s"),
        hydrology.severe_relation(rounded).alias("severe_relation"),
    )


def kpi_rollup(scores: DataFrame) -> DataFrame:
    """Lakes by level with a grand total, from each lake's latest season."""
    latest = scores.groupBy("lake_id").agg(F.max_by("level", "season").alias("level"), F.max("data_until").alias("data_until"))
    return latest.rollup("level").agg(F.count("*").alias("lakes"), F.max("data_until").alias("data_until"))


def ranked(scores: DataFrame) -> DataFrame:
    """Lakes by latest score, highest first, unknown as -1, then by name."""
    latest = scores.groupBy("lake_id").agg(F.max_by("score", "season").alias("score"))
    return latest.orderBy(F.desc(F.coalesce("score", F.lit(-1.0))), "lake_id")
