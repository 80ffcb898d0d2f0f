"""Rain and heat triggers from a weather outlook."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import rules


def zip_days(reports: DataFrame, past_days: int = 3) -> DataFrame:
    """Parallel arrays of a report to one row a day; a short array is null there."""
    days = F.arrays_zip("time", "precipitation_mm", "tmax_c")
    return reports.select("lake_id", F.posexplode(days).alias("at", "d")).select(
        "lake_id", F.col("d.time").alias("date"), "d.precipitation_mm", "d.tmax_c", (F.col("at") >= past_days).alias("forecast")
    )


def trigger(days: DataFrame) -> DataFrame:
    """``days(lake_id, date, precipitation_mm, tmax_c, forecast)`` to level and reasons.

    Missing values are ignored; an outlook without data is normal.
    """
    ahead = F.col("forecast")
    agg = days.groupBy("lake_id").agg(
        F.max(F.when(ahead, F.col("precipitation_mm"))).alias("wettest"),
        F.sum(F.when(ahead, F.coalesce("precipitation_mm", F.lit(0.0))).otherwise(0.0)).alias("total"),
        F.max(F.when(ahead, F.col("tmax_c"))).alias("hottest"),
        F.avg(F.when(~ahead, F.col("tmax_c"))).alias("past"),
    )
    graded = lambda x, limits, name: F.when(x >= limits[0], F.lit(f"high:{name}")).when(x >= limits[1], F.lit(f"elevated:{name}"))
    reasons = F.array_compact(F.array(
        graded(F.col("wettest"), rules.RAIN_DAY, "day"), graded(F.col("total"), rules.RAIN_TOTAL, "total"),
        F.when(F.col("hottest") - F.col("past") >= rules.HEAT_JUMP, F.lit("elevated:heat")),
    ))
    high = F.exists(reasons, lambda r: F.startswith(r, F.lit("high")))
    level = F.when(high, "high").when(F.size(reasons) > 0, "elevated").otherwise("normal")
    return agg.select("lake_id", level.alias("level"), F.array_join(reasons, ",").alias("reasons"))


def mark_forecast(days: DataFrame, ahead: int = 3) -> DataFrame:
    """The last ``ahead`` days of each lake are the forecast."""
    w = Window.partitionBy("lake_id").orderBy(F.desc("date"))
    return days.withColumn("forecast", F.row_number().over(w) <= ahead)
