"""Documents and lists that are served: one lake, its weather, nearest water, layers of two sources, and columns by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.sources import readers

#: Metres of a degree in the snap, and features taken from a layer.
SNAP_DEGREE_M, LAYER_MOST = 111_320.0, 2000


def lake_document(lakes: DataFrame, risk: DataFrame, downstream: DataFrame) -> DataFrame:
    """(lake_id, lake, risk, downstream): each of ``lakes`` whole, its latest risk, and its way down without the stations.

    ``risk(lake_id, latest)`` and ``downstream(lake_id, scenarios, ...)`` are null where a lake has none.
    """
    way = downstream.select("lake_id", F.struct(*[c for c in downstream.columns if c not in ("lake_id", "scenarios")]).alias("downstream"))
    return lakes.select("lake_id", F.struct(*lakes.columns).alias("lake")).join(risk.select("lake_id", F.col("latest").alias("risk")), "lake_id", "left").join(way, "lake_id", "left")


def _kept(value: Column, kind: T.DataType, suffix: str) -> Column:
    """A value without the fields whose names end with ``suffix``, at any depth."""
    if isinstance(kind, T.StructType):
        fields = [_kept(value[f.name], f.dataType, suffix).alias(f.name) for f in kind if not f.name.endswith(suffix)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("struct<>")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _kept(x, kind.elementType, suffix))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda k, _: ~F.endswith(k, F.lit(suffix))), lambda _, v: _kept(v, kind.valueType, suffix))
    return value


def without(df: DataFrame, suffix: str = "_hi") -> DataFrame:
    """``df`` without columns, fields and map keys whose names end with ``suffix``, however deep."""
    return df.select(*[_kept(F.col(f"`{f.name}`"), f.dataType, suffix).alias(f.name) for f in df.schema if not f.name.endswith(suffix)])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Those of the named columns that are present, in the order asked."""
    return df.select(*[n for n in names if n in df.columns])


def lake_weather(lakes: DataFrame, outlook: DataFrame) -> DataFrame:
    """Every lake with its outlook, null where it has none."""
    return lakes.select("lake_id").join(outlook, "lake_id", "left")


def snapped(asked: DataFrame, found: DataFrame) -> DataFrame:
    """``asked(job_id, lat, lon)`` to the nearest of its own ``found(job_id, water_id, lat, lon)``: whole metres, the least id on a tie."""
    north = (F.col("f.lat") - F.col("a.lat")) * SNAP_DEGREE_M
    east = (F.col("f.lon") - F.col("a.lon")) * SNAP_DEGREE_M * F.cos(F.radians("a.lat"))
    met = asked.alias("a").join(found.alias("f"), "job_id").select("job_id", "f.water_id", F.floor(F.hypot(north, east) + 0.5).cast("long").alias("distance_m"))
    best = met.groupBy("job_id").agg(F.min(F.struct("distance_m", "water_id")).alias("b"))
    return asked.select("job_id").join(best, "job_id", "left").select("job_id", "b.water_id", "b.distance_m")


def layers(parts: list[tuple[str, DataFrame]], box: tuple[float, float, float, float], most: int = LAYER_MOST) -> DataFrame:
    """(layer, id, bbox) of several ``(name, features(id, bbox))`` that meet a box, each layer's first ``most`` by id."""
    out = None
    for name, df in parts:
        rows = df.where(readers.overlaps(F.col("bbox"), box)).orderBy("id").limit(most).select(F.lit(name).alias("layer"), "id", "bbox")
        out = rows if out is None else out.unionByName(rows)
    return out


def terrain_of_year(risk: DataFrame, terrain: DataFrame) -> DataFrame:
    """``risk(lake_id, season, area_year)`` with the terrain of the year whose outline its area has; a year without one stays."""
    return risk.join(terrain.withColumnRenamed("year", "area_year"), ["lake_id", "area_year"], "left")


def ranked(df: DataFrame, within: str, *order: Column) -> DataFrame:
    """``df`` with each row's place in its list."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(*order)))


def by_arrival(impacts: DataFrame) -> DataFrame:
    """A lake's impacts by the way down to them, unknown last, then by id."""
    return ranked(impacts, "lake_id", F.asc_nulls_last("km"), F.asc("osm"))


def by_name(places: DataFrame) -> DataFrame:
    """A district's places by name without case, then by id."""
    return ranked(places, "district", F.lower("name"), F.asc("osm"))
