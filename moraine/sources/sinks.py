"""Sinks: keyed upserts, dated history with a latest pointer, nested documents and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators.series import upsert


def upsert_years(spark: SparkSession, path: str, new: DataFrame, target: str) -> None:
    """Write the merge of the stored series and the recomputed years, partitioned by year."""
    merged = upsert(spark.read.parquet(path), new, ["lake_id", "year"])
    merged.write.partitionBy("year").mode("overwrite").parquet(target)


def append_dated(rows: DataFrame, path: str) -> None:
    """History by ``as_of`` day; a repeated day replaces itself."""
    rows.write.partitionBy("as_of").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def latest(spark: SparkSession, path: str, *key: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*key).agg(F.max("as_of").alias("as_of"))
    return rows.join(newest, [*key, "as_of"])


def feature(geometry: str, coordinates: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    shape = F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates"))
    props = F.struct(*[c.alias(n) for n, c in properties.items()])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry")))


def write_documents(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def index_mart(lakes: DataFrame, years: DataFrame, scores: DataFrame, exposed: DataFrame, drains: DataFrame) -> DataFrame:
    """One nested document a lake; a missing part is a null struct, never a default."""
    series = years.groupBy("lake_id").agg(F.array_sort(F.collect_list(F.struct("year", "status", "area_m2", "uncertainty_m2"))).alias("years"))
    risk = scores.groupBy("lake_id").agg(F.max_by(F.struct("season", "score", "level"), "season").alias("risk"))
    counts = exposed.groupBy("lake_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.struct("in_flood_path", "at_risk"))))).alias("exposed_counts"))
    drain = drains.select("lake_id", F.struct(*[c for c in drains.columns if c != "lake_id"]).alias("drain"))
    out = lakes
    for part in (series, risk, counts, drain):
        out = out.join(part, "lake_id", "left")
    return out
