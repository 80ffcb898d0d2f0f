"""Search for unlisted lakes over many windows: sub-windows, the scenes that cover them, lakes, and one row a lake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import geo
from moraine.operators import downstream, spatial

#: Half a sub-window in kilometres, lakes nearer than this are one, and lakes that are reported.
HALF_KM, APART_KM, REPORTED = 5.0, 0.5, 15
#: Scenes that a sub-window is mapped from.
SCENES = 4
#: Degrees of the squares in which scenes and sub-windows meet.
SQUARE = 0.5


def _degrees(km: float, lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude."""
    return km / (geo.DEGREE_KM * F.cos(F.radians(lat))), F.lit(km / geo.DEGREE_KM)


def sub_windows(windows: DataFrame, half_km: float = HALF_KM) -> DataFrame:
    """(window, part, lon, lat, x0, y0, x1, y1): the four quarters of ``windows(window, lon, lat)``.

    A box that straddles two scenes lies in neither, so a quarter of it may.
    """
    east, north = _degrees(half_km, F.col("lat"))
    quarter = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(x).alias("sx"), F.lit(y).alias("sy")) for k, (y, x) in enumerate([(-1, -1), (-1, 1), (1, -1), (1, 1)])])).alias("q")
    out = windows.select("window", "lon", "lat", quarter).select("window", "q.part", (F.col("lon") + F.col("q.sx") * east).alias("lon"), (F.col("lat") + F.col("q.sy") * north).alias("lat"))
    return out.select("*", *[(F.col(v) + s * d).alias(f"{n}{k}") for v, n, d in (("lon", "x", east), ("lat", "y", north)) for k, s in ((0, -1), (1, 1))])


def covering(subs: DataFrame, scenes: DataFrame, most: int = SCENES) -> DataFrame:
    """(window, part, scene_id, rank): the clearest ``most`` of ``scenes(scene_id, day, cloud, x0, y0, x1, y1)`` that hold the whole sub-window.

    The clearest first, then the newest, then by id. Both meet in the square that the sub-window's corner lies in.
    """
    at = lambda v: F.floor(F.col(v) / SQUARE)
    tiled = scenes.withColumn("bx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("by", F.explode(F.sequence(at("y0"), at("y1"))))
    tiled = tiled.select("scene_id", "day", "cloud", "bx", "by", *[F.col(c).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
    met = subs.withColumn("bx", at("x0")).withColumn("by", at("y0")).join(tiled, ["bx", "by"])
    held = met.where("sx0 <= x0 and sy0 <= y0 and sx1 >= x1 and sy1 >= y1")
    rank = F.row_number().over(Window.partitionBy("window", "part").orderBy("cloud", F.desc("day"), "scene_id"))
    return held.withColumn("rank", rank).where(F.col("rank") <= most).select("window", "part", "scene_id", "rank")


def discover(
    spark: SparkSession, subs: DataFrame, water: DataFrame, cells: DataFrame, places: DataFrame, res: float, side: int,
    least_m2: float = downstream.LISTED_M2, least_m: float = downstream.LISTED_M, apart_km: float = APART_KM, top: int = REPORTED,
) -> DataFrame:
    """The ``top`` largest lakes of all windows: (rank, window, part, lon, lat, area_m2, height_m, near, near_km).

    ``water(grid_id, r, c)`` and ``cells(grid_id, r, c, z)`` are the sub-windows' rasters, ``side`` cells wide, with ``grid_id`` in
    ``subs(grid_id, window, part, lon, lat)``. A lake that several windows saw is the largest of its outlines within
    ``apart_km``. ``places(b_id, lon, lat)`` name the nearest one. Equal areas go by window, part and label.
    """
    found = downstream.find_lakes(spark, water, cells, res, least_m2, least_m).join(subs.select("grid_id", "window", "part", "lon", "lat"), "grid_id")
    metres = lambda v: (F.col(v) + 0.5) * res - side * res / 2
    lon = F.col("lon") + metres("centre_c") / (geo.DEGREE_KM * 1000 * F.cos(F.radians("lat")))
    lat = F.col("lat") - metres("centre_r") / (geo.DEGREE_KM * 1000)
    at = F.struct("window", "part", "label_r", "label_c").alias("id")
    lakes = found.select(F.lit(0).alias("grp"), at, F.col("area_m2").alias("area"), "height_m", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))
    kept = lakes.join(spatial.greedy_spread(lakes.select("grp", "id", "area", "lon", "lat"), apart_km).select("id"), "id", "left_semi")
    best = kept.orderBy(F.desc("area"), "id").limit(top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("area"), "id")))
    near = spatial.nearest(best.select(F.col("id").alias("a_id"), "lon", "lat"), places, 1).select(F.col("a_id").alias("id"), F.col("b_id").alias("near"), F.col("km").alias("near_km"))
    out = best.join(near, "id", "left")
    return out.select("rank", "id.window", "id.part", "lon", "lat", F.col("area").alias("area_m2"), "height_m", "near", "near_km")
