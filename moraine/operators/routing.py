"""Stations along a flood path: windows, interpolation and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import hydrology

HALF_WINDOW = 4  # 1000 m of 250 m stations


def bed_profile(stations: DataFrame, path: str = "path_id") -> DataFrame:
    """``stations(path, km, bed_m)`` with the running least bed and the centred slope."""
    order = Window.partitionBy(path).orderBy("km")
    lows = F.min(F.coalesce("bed_m", F.lit(float("inf")))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = stations.withColumn("low_m", lows)
    near = order.rowsBetween(-HALF_WINDOW, HALF_WINDOW)
    run = F.greatest(F.last("km").over(near) * 1000 - F.first("km").over(near) * 1000, F.lit(1.0))
    slope = F.greatest((F.first("low_m").over(near) - F.last("low_m").over(near)) / run, F.lit(hydrology.MIN_SLOPE))
    return out.withColumn("slope", slope)


def chain_length(points: DataFrame, path: str = "path_id") -> DataFrame:
    """``points(path, seq, x, y)`` with the length along the path up to each."""
    order = Window.partitionBy(path).orderBy("seq")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("chain", F.sum("step").over(order)).drop("step")


def tangents(points: DataFrame, path: str = "path_id") -> DataFrame:
    """Unit direction over two points either side; a standstill points east."""
    near = Window.partitionBy(path).orderBy("seq").rowsBetween(-2, 2)
    dx, dy = (F.last(c).over(near) - F.first(c).over(near) for c in ("x", "y"))
    norm = F.hypot("dx", "dy")
    out = points.withColumn("dx", dx).withColumn("dy", dy)
    tx, ty = F.when(norm > 0, F.col("dx") / norm).otherwise(1.0), F.when(norm > 0, F.col("dy") / norm).otherwise(0.0)
    return out.withColumn("tx", tx).withColumn("ty", ty).drop("dx", "dy")


def attenuated(stations: DataFrame) -> DataFrame:
    """``stations(km, peak_m3s)`` with discharge and both arrival times."""
    metres = F.col("km") * 1000
    return stations.select(
        "*", hydrology.discharge_at(F.col("km"), F.col("peak_m3s")).alias("discharge_m3s"),
        hydrology.arrival_min(metres, hydrology.SPEED_EXPECTED).alias("arrival_expected"),
        hydrology.arrival_min(metres, hydrology.SPEED_FAST).alias("arrival_fast"),
    )


def _passed(path: str) -> tuple[Window, Window]:
    """What a walk down the path, and one up it, has passed at each row: frames that only grow."""
    order = ("km", "side", "asset_id")
    walks = Window.partitionBy(path).orderBy(*order), Window.partitionBy(path).orderBy(*map(F.desc_nulls_last, order))
    return tuple(w.rowsBetween(Window.unboundedPreceding, 0) for w in walks)


def level_along(assets: DataFrame, stations: DataFrame, path: str = "path_id") -> DataFrame:
    """``assets(path, asset_id, km)`` with the level between its two stations, held at the ends.

    Both sides are ordered together once, so no asset meets all stations.
    """
    a = assets.select(path, "km", "asset_id", F.lit(None).cast("double").alias("wse_m"), F.lit(1).alias("side"))
    s = stations.select(path, "km", F.lit(None).cast(assets.schema["asset_id"].dataType).alias("asset_id"), "wse_m", F.lit(0).alias("side"))
    mark = F.when(F.col("side") == 0, F.struct("km", "wse_m"))
    up, down = _passed(path)
    both = a.unionByName(s).withColumn("lo", F.last(mark, True).over(up)).withColumn("hi", F.last(mark, True).over(down))
    share = F.try_divide(F.col("km") - F.col("lo.km"), F.col("hi.km") - F.col("lo.km"))
    level = F.col("lo.wse_m") + F.coalesce(share, F.lit(0.0)) * (F.col("hi.wse_m") - F.col("lo.wse_m"))
    out = both.where("side = 1").withColumn("level_m", F.coalesce(level, F.col("lo.wse_m"), F.col("hi.wse_m")))
    return out.select(path, "asset_id", "km", "level_m")


def nearest_station(assets: DataFrame, stations: DataFrame, path: str = "path_id") -> DataFrame:
    """Each asset's nearest station along its path, the upstream one on a tie."""
    a = assets.select(path, "km", "asset_id", F.lit(1).alias("side"))
    s = stations.select(path, "km", F.lit(None).cast(assets.schema["asset_id"].dataType).alias("asset_id"), F.lit(0).alias("side"))
    mark = F.when(F.col("side") == 0, F.col("km"))
    up, down = _passed(path)
    both = a.unionByName(s).withColumn("up", F.last(mark, True).over(up)).withColumn("down", F.last(mark, True).over(down)).where("side = 1")
    upper = F.col("down").isNull() | (F.col("up").isNotNull() & (F.col("km") - F.col("up") <= F.col("down") - F.col("km")))
    return both.select(path, "asset_id", "km", F.when(upper, F.col("up")).otherwise(F.col("down")).alias("station_km"))


def resample(points: DataFrame, step: float, path: str = "path_id") -> DataFrame:
    """Points every ``step`` along a path, its end excluded, by linear interpolation."""
    chained = chain_length(points, path)
    order = Window.partitionBy(path).orderBy("seq")
    seg = chained.select(path, "chain", "x", "y", *[F.lead(c).over(order).alias(f"{c}2") for c in ("chain", "x", "y")])
    seg = seg.where("chain2 > chain")
    first, last = F.ceil(F.col("chain") / step), F.ceil(F.col("chain2") / step) - 1
    out = seg.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("k") * step - F.col("chain")) / (F.col("chain2") - F.col("chain"))
    return out.select(
        path, F.col("k").cast("long").alias("k"), (F.col("x") + share * (F.col("x2") - F.col("x"))).alias("x"),
        (F.col("y") + share * (F.col("y2") - F.col("y"))).alias("y"),
    )


def owner_station(chain_m, n_stations):
    """Index of the station that owns a chainage: the nearest, half to even, clipped."""
    return F.least(n_stations - 1, F.greatest(F.lit(0), F.bround(chain_m / hydrology.STATION_M, 0).cast("int")))
