"""Nearest, within-distance and point-in-polygon joins, bucketed on a degree grid."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import geo
from moraine.sources.workspace import Work


#: As many times ``top`` places may share a cube when a search begins, and no cube is halved below this width, in radii of the earth.
CROWD, NARROW = 4, 1e-7


def _bucket(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _grid(km: float) -> tuple[Callable[[DataFrame, str, str], DataFrame], Callable[[DataFrame, str, str], DataFrame]]:
    """Adds the cell (by, bx) of a place, and that cell and all others that hold places at most ``km`` from it, a row each.

    Cells lie in bands of latitude as high as the radius; a
    band's cells are as wide as the radius is there, divide the full circle evenly and close at 180 degrees. So
    dense places are spread over their cells and far ones never meet.
    """
    deg = km / geo.DEGREE_KM

    def cells_of(band: Column) -> Column:
        """How many cells a band has: the radius, seen from a band beside it at most, fits into one; one near the poles."""
        flat = F.least(*[F.cos(F.radians(F.least(F.lit(90.0), F.abs(band + k) * deg))) for k in (-1, 0, 1, 2)])
        return F.greatest(F.lit(1), F.floor(flat * (360.0 / deg) * (1 - 1e-9))).cast("long")

    turn = lambda lon: F.pmod(F.col(lon) + 180.0, F.lit(360.0)) / 360.0

    def own(df: DataFrame, lon: str, lat: str) -> DataFrame:
        df = df.withColumn("by", _bucket(F.col(lat), deg))
        return df.withColumn("bx", F.floor(turn(lon) * cells_of(F.col("by"))))

    def around(df: DataFrame, lon: str, lat: str) -> DataFrame:
        df = df.withColumn("o", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
        df = df.withColumn("by", _bucket(F.col(lat), deg) + F.col("o")).withColumn("n", cells_of(F.col("by")))
        mine = F.floor(turn(lon) * F.col("n"))
        return df.withColumn("bx", F.explode(F.array_distinct(F.array(*[F.pmod(mine + k, F.col("n")) for k in (-1, 0, 1)])))).drop("o", "n")

    return own, around


def within_km(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Pairs of ``a(a_id, lon, lat)`` and ``b(b_id, lon, lat)`` at most ``km`` apart, anywhere on the globe.

    Points meet by equality on a cell and its neighbours.
    """
    own, around = _grid(km)
    left = around(a.select("a_id", F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a")), "lon_a", "lat_a")
    right = own(b.select("b_id", F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b")), "lon_b", "lat_b")
    out = left.join(right, ["by", "bx"]).withColumn("km", geo.equirect_km(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")))
    return out.where(F.col("km") <= km).select("a_id", "b_id", "km")


def nearest_within(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Each of ``a`` with its nearest ``b`` in reach, null if none; the least id on a tie."""
    best = within_km(a, b, km).groupBy("a_id").agg(F.min(F.struct("km", "b_id")).alias("n"))
    return a.select("a_id").join(best, "a_id", "left").select("a_id", "n.b_id", "n.km")


def uncrowded(places: DataFrame, wide: float, most: int) -> float:
    """``wide``, halved until a cube of that width holds at most so many of ``places(x, y, z)`` as its places see it on average."""
    while wide > NARROW:
        cubes = places.groupBy(*[F.floor(F.col(v) / wide).alias(f"c{v}") for v in "xyz"]).count()
        if (cubes.agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("seen")).first().seen or 0) <= most:
            break
        wide /= 2
    return wide


def nearest(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """(a_id, b_id, km, rank): the ``top`` nearest of ``b(b_id, lon, lat)`` to each of ``a(a_id, lon, lat)``, the least id on a tie.

    Places are points on the unit sphere, so the poles and 180 degrees are like anywhere else. In
    rounds, those of ``a`` that have not found ``top`` yet meet what lies in the cubes around their own, each round's
    twice as wide, until a cube holds the sphere. Places without coordinates are near nothing. All of ``a`` on one spot
    ask once, and of ``b`` on one spot only the ``top`` least ids can answer.
    """
    work = Work(a.sparkSession)
    sphere = [F.cos(F.radians("lat")) * F.cos(F.radians("lon")), F.cos(F.radians("lat")) * F.sin(F.radians("lon")), F.sin(F.radians("lat"))]
    there = lambda df: df.where("lon is not null and lat is not null")
    on_spot = F.row_number().over(Window.partitionBy("lon", "lat").orderBy("b_id"))
    few = there(b).select("b_id", "lon", "lat").withColumn("k", on_spot).where(F.col("k") <= top)  # limited in each task before the shuffle
    right = work.cut(few.select("b_id", "lon", "lat", *[v.alias(n) for v, n in zip(sphere, "xyz", strict=True)]))
    n = max(1, right.count())
    spots = there(a).select("lon", "lat").distinct().select(*[F.col(v).alias(f"{v}a") for v in ("lon", "lat")], *[v.alias(f"{n}a") for v, n in zip(sphere, "xyz", strict=True)])
    left, waiting = work.counted(spots, F.lit(True))
    wide = uncrowded(right, math.sqrt(top / n), CROWD * top)  # a cap of this radius holds about a quarter of ``top`` if places are spread evenly
    parts = []
    around = F.array(*[F.struct(*[F.lit(k).alias(v) for k, v in zip(o, "ijk", strict=True)]) for o in product((-1, 0, 1), repeat=3)])
    w = Window.partitionBy("lona", "lata").orderBy("km", "b_id")
    # Sizes of files say little about rows that are derived from them, so no side is left to be broadcast.
    while waiting:
        cube = lambda v, s=wide: F.floor(F.col(v) / s)
        asked = left.select("*", F.explode(around).alias("o")).select(*left.columns, *[(cube(f"{v}a") + F.col(f"o.{k}")).alias(f"c{v}") for v, k in zip("xyz", "ijk", strict=True)])
        met = asked.join(right.select("*", *[cube(v).alias(f"c{v}") for v in "xyz"]).hint("merge"), ["cx", "cy", "cz"])
        chord = F.sqrt(sum(F.pow(F.col(v) - F.col(f"{v}a"), 2) for v in "xyz"))
        near = met.where(chord <= wide).select("lona", "lata", "b_id", geo.haversine_km(F.col("lona"), F.col("lata"), F.col("lon"), F.col("lat")).alias("km"))
        best = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        full = F.count("*").over(Window.partitionBy("lona", "lata"))
        done = work.cut(best.withColumn("found", full).where((F.col("found") >= min(top, n)) | F.lit(wide > 2)).drop("found"))
        parts.append(done)
        if wide > 2:
            break
        left, waiting = work.counted(left.join(done.select("lona", "lata").distinct().hint("merge"), ["lona", "lata"], "left_anti"), F.lit(True), left)
        wide *= 2
    if not parts:
        return work.result(there(a).select("a_id", F.lit(None).cast(b.schema["b_id"].dataType).alias("b_id"), F.lit(0.0).alias("km"), F.lit(0).alias("rank")))
    asking = there(a).select("a_id", F.col("lon").alias("lona"), F.col("lat").alias("lata"))
    return work.result(asking.join(all_of(parts).hint("merge"), ["lona", "lata"]).select("a_id", "b_id", "km", "rank"))


def in_polygon(points: DataFrame, areas: DataFrame, cell: float = 1.0) -> DataFrame:
    """Each point with the smallest of ``areas(area_id, ring, size, x0, y0, x1, y1)`` around it, or null."""
    span = lambda lo, hi: F.sequence(_bucket(F.col(lo), cell), _bucket(F.col(hi), cell))
    tiled = areas.withColumn("bx", F.explode(span("x0", "x1"))).withColumn("by", F.explode(span("y0", "y1")))
    met = points.withColumn("bx", _bucket(F.col("x"), cell)).withColumn("by", _bucket(F.col("y"), cell)).join(tiled, ["bx", "by"])
    inside = met.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")) & geo.in_ring(F.col("x"), F.col("y"), F.col("ring")))
    best = inside.groupBy("point_id").agg(F.min(F.struct("size", "area_id")).alias("b"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", F.col("b.area_id").alias("area_id"))


def greedy_spread(points: DataFrame, km: float) -> DataFrame:
    """Of ``points(grp, id, area, lon, lat)`` per group the largest first, unknown last, each if no kept one is within ``km``.

    In rounds: the first undecided point of a cell is kept if it comes before those of the cells around it, and all
    within ``km`` of it go. Pairs of points are never listed: a round grows with what is undecided,
    and a point meets the few that its round kept in the cells around it. Of points on one spot only the first can be kept.
    """
    work = Work(points.sparkSession)
    own, around = _grid(km)
    lon, lat = F.col("lon"), F.col("lat")
    meets = F.coalesce(geo.equirect_km(lon, lat, lon, lat) <= km, F.lit(False))  # a place that is unknown is near nothing
    ranked = points.select(F.struct("grp").alias("g"), F.struct(F.isnull("area").alias("u"), (-F.col("area")).alias("o"), "id").alias("rank"), "lon", "lat", meets.alias("meets"))
    spots = ranked.where("meets").groupBy("g", "lon", "lat").agg(F.min("rank").alias("rank"))
    kept = [work.cut(ranked.where("not meets").select("g", "rank"))]
    open_, left = work.counted(own(spots, "lon", "lat"), F.lit(True))
    cell = ["g", "by", "bx"]
    while left:
        best = work.cut(open_.groupBy(*cell).agg(F.min(F.struct("rank", "lon", "lat")).alias("p")).select(*cell, "p.*"))
        met = around(best.select("g", "rank", "lon", "lat"), "lon", "lat").join(best.select(*cell, F.col("rank").alias("other")).hint("merge"), cell)
        beaten = met.groupBy("g", "rank", "lon", "lat").agg(F.bool_or(F.col("other") < F.col("rank")).alias("beaten"))
        first = work.cut(beaten.where("not beaten").select("g", "rank", F.col("lon").alias("lon_k"), F.col("lat").alias("lat_k")), best)
        kept.append(first)
        near = around(first.drop("rank"), "lon_k", "lat_k")
        within = geo.equirect_km(lon, lat, F.col("lon_k"), F.col("lat_k")) <= km
        goes = reduce(Column.__and__, [open_[c] == near[c] for c in cell], within)
        open_, left = work.counted(open_.join(near.hint("merge"), goes, "left_anti"), F.lit(True), open_)
    return work.result(all_of([k.select("g.grp", "rank.id") for k in kept]))


#: Segments of a path that are ruled out together.
RUN = 64


def along_path(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``points(path_id, id, x, y)`` to the least distance and place along ``segments(path_id, chain, ax, ay, bx, by)``.

    A path's segments are taken in runs of ``RUN``, and a point meets a run only if the run's
    box is no further than the nearest of all runs' first points: an upper bound of the distance.
    """
    order = Window.partitionBy("path_id").orderBy("chain", "ax", "ay", "bx", "by")
    numbered = segments.withColumn("run", F.floor((F.row_number().over(order) - 1) / RUN))
    low, high = (lambda c, f=f: f(F.least(f"a{c}", f"b{c}") if f is F.min else F.greatest(f"a{c}", f"b{c}")) for f in (F.min, F.max))
    box = numbered.groupBy("path_id", "run").agg(
        low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"), F.min_by(F.struct("ax", "ay"), "chain").alias("p")
    )
    runs = box.groupBy("path_id").agg(F.collect_list(F.struct("run", "x0", "y0", "x1", "y1", "p")).alias("runs"))
    zero = F.lit(0.0)
    beyond = lambda v, lo, hi: F.greatest(lo - v, v - hi, zero)
    to_box = lambda r: F.hypot(beyond(F.col("x"), r["x0"], r["x1"]), beyond(F.col("y"), r["y0"], r["y1"]))
    to_point = lambda r: F.hypot(F.col("x") - r["p"]["ax"], F.col("y") - r["p"]["ay"])
    bounded = points.join(runs, "path_id").withColumn("bound", F.array_min(F.transform("runs", to_point)) * (1 + 1e-12))
    met = bounded.withColumn("run", F.explode(F.transform(F.filter("runs", lambda r: to_box(r) <= F.col("bound")), lambda r: r["run"]))).drop("runs", "bound")
    met = met.join(numbered, ["path_id", "run"])
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    t = F.coalesce(F.try_divide((x - ax) * (bx - ax) + (y - ay) * (by - ay), F.pow(bx - ax, 2) + F.pow(by - ay, 2)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    row = F.struct(geo.segment_distance(x, y, ax, ay, bx, by).alias("distance"), (F.col("chain") + t * F.hypot(bx - ax, by - ay)).alias("along"))
    return met.groupBy("path_id", "id").agg(F.min(row).alias("b")).select("path_id", "id", "b.*")


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
