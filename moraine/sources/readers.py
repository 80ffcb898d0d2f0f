"""Scans: JSON documents, scene search, bounding boxes, mosaics and job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.sources import schemas

SCENE_LIMIT, MAX_CLOUD = 2000, 80


def documents(spark: SparkSession, path: str, schema: str, malformed: str = "PERMISSIVE") -> DataFrame:
    """JSON files under an explicit schema; rows that do not parse are null or dropped."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", malformed).json(path)


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene catalogue with its defaults filled in."""
    s = spark.read.schema(schemas.SCENES).parquet(path)
    return s.select(
        "item_id", "day", F.coalesce("cloud", F.lit(100.0)).alias("cloud"), F.coalesce("baseline", F.lit("00.00")).alias("baseline"),
        F.coalesce("azimuth", F.lit(160.0)).alias("azimuth"), F.coalesce("elevation", F.lit(45.0)).alias("elevation"), "hrefs",
        F.transform_values("hrefs", lambda k, _: F.when(k == "scl", 1.0).otherwise(F.coalesce(F.try_element_at("scale", k), F.lit(1e-4)))).alias("scale"),
        F.transform_values("hrefs", lambda k, _: F.when(F.coalesce("boa_offset_applied", F.lit(False)), 0.0).otherwise(F.coalesce(F.try_element_at("offset", k), F.lit(0.0)))).alias("offset"),
        "bbox",
    )


def search_scenes(catalogue: DataFrame, box: tuple[float, float, float, float], start: str, end: str, max_cloud: float = MAX_CLOUD, limit: int = SCENE_LIMIT) -> DataFrame:
    """Scenes that meet a box between two days, both included, with less cloud than ``max_cloud``."""
    hit = overlaps(F.col("bbox"), box) & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("cloud") < max_cloud)
    return catalogue.where(hit).orderBy("day", "item_id").limit(limit)


def overlaps(box: Column, other: tuple[float, float, float, float]) -> Column:
    x0, y0, x1, y1 = other
    return (box["x0"] <= x1) & (box["x1"] >= x0) & (box["y0"] <= y1) & (box["y1"] >= y0)


def covers(box: Column, other: tuple[float, float, float, float]) -> Column:
    x0, y0, x1, y1 = other
    return (box["x0"] <= x0) & (box["x1"] >= x1) & (box["y0"] <= y0) & (box["y1"] >= y1)


def mosaic(tiles: DataFrame) -> DataFrame:
    """``tiles(grid_id, r, c, tile, z)``: the first known height of each cell in tile order."""
    return tiles.where("z is not null").groupBy("grid_id", "r", "c").agg(F.min_by("z", "tile").alias("z"))


def overview(levels: DataFrame, target: float) -> DataFrame:
    """The coarsest stored level of each raster that is no coarser than asked."""
    w = Window.partitionBy("raster").orderBy(F.desc("res"))
    return levels.where(F.col("res") <= target + 1e-6).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def boundaries(osm: DataFrame) -> DataFrame:
    """Named administrative relations of the two levels that are used."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return osm.where(tag("admin_level").isin("4", "5") & (tag("boundary") == "administrative") & tag("name").isNotNull())


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Research jobs, newest first, with the whole lines of the last 2000 characters of the log."""
    j = documents(spark, path, schemas.JOBS, "DROPMALFORMED").where("id is not null")
    tail = F.right("log", F.lit(2000))
    whole = F.when(F.length("log") <= 2000, F.col("log")).otherwise(F.substring_index(tail, "\n", -1000))
    return j.withColumn("log_tail", F.when(F.length("log") <= 2000, whole).otherwise(F.regexp_replace(tail, r"^[^\n]*\n", ""))).orderBy(F.desc("created_at"), F.desc("id"))


def years_asked(text: Column, default_last: int, first: int = 2016, most: int = 10) -> Column:
    """"2018,2020-2022" as sorted distinct years; empty text is the last six; null if refused."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s*,\s*"), lambda p: p != "")
    ok = F.forall(parts, lambda p: p.rlike(r"^\d{4}(-\d{4})?$"))
    ends = F.transform(parts, lambda p: F.struct(F.try_element_at(F.split(p, "-"), F.lit(1)).try_cast("int").alias("a"), F.coalesce(F.try_element_at(F.split(p, "-"), F.lit(2)), p).try_cast("int").alias("b")))
    years = F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], F.greatest(e["a"], e["b"]))))))
    fits = ok & (F.size(years) <= most) & (F.array_min(years) >= first) & (F.array_max(years) <= default_last)
    return F.when(F.size(parts) == 0, F.sequence(F.lit(default_last - 5), F.lit(default_last))).when(fits, years)
