"""Lake-year series: composites, scene choice, upserts, pivots and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CLEAR, MAX_SCENES = 0.2, 12
MIN_FREQ = 0.5


def one_per_day(scenes: DataFrame, *key: str) -> DataFrame:
    """Per key and day the newest baseline, then the least cloud, then the least id."""
    w = Window.partitionBy(*key, "day").orderBy(F.desc_nulls_last("baseline"), F.asc_nulls_last("cloud"), "scene_id")
    return scenes.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def clearest(scenes: DataFrame, *key: str, least: float = MIN_CLEAR, most: int = MAX_SCENES) -> DataFrame:
    """Per key up to ``most`` scenes of the greatest clear fraction, at least ``least``."""
    w = Window.partitionBy(*key).orderBy(F.desc("clear"), "day", "scene_id")
    return scenes.where(F.col("clear") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def composite(obs: DataFrame, *cell: str, slope: Column | None = None) -> DataFrame:
    """Per cell the looks, the wet share of them and whether the season calls it water."""
    out = obs.groupBy(*cell).agg(
        F.sum(F.col("observed").cast("long")).alias("obs_count"),
        F.sum((F.col("observed") & F.col("water")).cast("long")).alias("water_count"),
    )
    freq = F.try_divide(F.col("water_count"), F.col("obs_count"))
    wet = (F.col("obs_count") >= 1) & (freq >= MIN_FREQ)
    if slope is not None:
        wet = wet & (slope <= 25)
    return out.withColumn("water_freq", freq).withColumn("water", F.coalesce(wet, F.lit(False)))


def min_obs(n_scenes: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(2), n_scenes))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` rows, and the ``old`` ones whose key is not among them."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def pivot_years(years: DataFrame, values: list[int]) -> DataFrame:
    """One row a lake, one column a year, partial areas marked with an asterisk."""
    shown = F.concat(F.col("area_m2").cast("long").cast("string"), F.when(F.col("status") == "partial", "*").otherwise(""))
    out = years.withColumn("shown", shown).groupBy("lake_id").pivot("year", values).agg(F.first("shown", ignorenulls=True))
    return out.select("lake_id", *[F.col(f"`{y}`").alias(f"y{y}") for y in values])


def first_latest(years: DataFrame) -> DataFrame:
    """First and latest measured year of each lake; no measured year gives nulls."""
    measured = F.col("area_m2").isNotNull()
    row = F.when(measured, F.struct("year", "area_m2"))
    return years.groupBy("lake_id").agg(F.min(row).alias("first"), F.max(row).alias("latest")).select(
        "lake_id", F.col("first.year").alias("first_year"), F.col("first.area_m2").alias("first_area"),
        F.col("latest.year").alias("latest_year"), F.col("latest.area_m2").alias("latest_area"),
    )


def evidence_rows(years: DataFrame, outlines: DataFrame) -> DataFrame:
    """Years of either side, the series record preferred."""
    return years.alias("y").join(outlines.alias("o"), ["lake_id", "year"], "full_outer").select(
        "lake_id", "year", F.coalesce("y.area_m2", "o.area_m2").alias("area_m2"),
        F.coalesce("y.status", F.lit("outline_only")).alias("status"),
        F.col("o.area_m2").isNotNull().alias("has_outline"),
    )


def next_year(years: DataFrame) -> DataFrame:
    return years.select("lake_id", "year", F.lead("year").over(Window.partitionBy("lake_id").orderBy("year")).alias("next_year"))


def latest_outline_year(years: DataFrame, outlines: DataFrame) -> DataFrame:
    """Latest year with an outline, else the latest year."""
    both = years.join(outlines.select("lake_id", "year", F.lit(True).alias("drawn")), ["lake_id", "year"], "left")
    return both.groupBy("lake_id").agg(F.coalesce(F.max(F.when(F.col("drawn"), F.col("year"))), F.max("year")).alias("year"))
