"""Domain tables projected from the driver's tables, as DataFrames and as SQL.

Areas and beds are whole cents, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def micro(x: Column) -> Column:
    """A computed double as whole ten-thousandths: comparable across engines."""
    return F.floor(x * 10_000 + 0.5).cast("long")


def micro_sql(x: str) -> str:
    return f"CAST(floor(({x}) * 10000 + 0.5) AS BIGINT)"


def lake_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moraine.functions import rules

    items = table(spark, sf_dir, "lineitem")
    years = items.groupBy(F.col("l_suppkey").alias("lake_id"), F.year("l_shipdate").alias("year")).agg(
        F.sum(cents("l_extendedprice")).cast("double").alias("area_m2"),
        (F.sum(cents("l_tax") * cents("l_extendedprice")).cast("double") / 1000).alias("uncertainty_m2"),
        F.count("*").alias("n_used"), F.max(F.to_date("l_shipdate")).alias("last_day"),
    )
    status = rules.lake_year_status(F.col("n_used"), F.col("n_used") / 80.0, F.col("area_m2"), 2)
    return years.withColumn("status", status)


LAKE_YEARS = """lake_years AS (
  SELECT lake_id, year, area_m2, uncertainty_m2, n_used, last_day,
    CASE WHEN n_used / 80.0 >= 0.9 AND n_used >= 2 THEN 'ok' ELSE 'partial' END AS status
  FROM (SELECT l_suppkey AS lake_id, CAST(year(l_shipdate) AS INT) AS year,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS area_m2,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1000 AS uncertainty_m2,
    count(*) AS n_used, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1, 2))"""


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("lake_id"), ((key % 13) * 1.0).alias("outlet_slope"), ((key % 7) / 8.0).alias("avalanche"),
        F.when(key % 5 != 0, (key % 9) * 75.0).alias("glacier"),
    )


TERRAIN = """terrain AS (SELECT s_suppkey AS lake_id, (s_suppkey % 13) * 1.0::DOUBLE AS outlet_slope,
  (s_suppkey % 7) / 8.0::DOUBLE AS avalanche, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 9) * 75.0::DOUBLE END AS glacier FROM supplier)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks: a cell is a user, a day the event's."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("scene_id"), F.col("user_id").alias("cell"), F.to_date("ts").alias("day"),
        (F.col("event_id") % 4).alias("baseline"), F.round(F.col("value") * 100).cast("long").alias("cloud"),
        (F.col("event_type") != "error").alias("observed"), F.col("event_type").isin("view", "click").alias("water"),
    )


SCENES = """scenes AS (SELECT event_id AS scene_id, user_id AS cell, CAST(ts AS DATE) AS day, event_id % 4 AS baseline,
  CAST(round(value * 100) AS BIGINT) AS cloud, event_type <> 'error' AS observed, event_type IN ('view', 'click') AS water FROM events)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path is a customer, its stations the orders in time."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(
        F.col("o_custkey").alias("path_id"), seq.cast("long").alias("seq"), ((seq - 1) * 0.25).alias("km"),
        cents("o_totalprice").cast("double").alias("bed_m"), F.col("o_orderkey").alias("order_id"),
    )


STATIONS = """stations AS (SELECT o_custkey AS path_id, n AS seq, (n - 1) * 0.25::DOUBLE AS km,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS bed_m, o_orderkey AS order_id
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders))"""


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets: a line item on an order's customer; the lake is its supplier."""
    i, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, ("settlement", "school", "road", "bridge", "hydro")))
    outcome = lambda c, flood, margin: F.when(F.col(c) == flood, "flooded").when(F.col(c) == margin, "margin").otherwise("outside")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_suppkey").alias("lake_id"), F.col("o_custkey").alias("osm"), F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.element_at(kinds, F.substring("o_orderpriority", 1, 1).cast("int")).alias("kind"),
        F.col("l_quantity").alias("km"), outcome("l_returnflag", "R", "A").alias("expected"),
        outcome("l_linestatus", "F", "X").alias("severe"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity") * 100 / 60).alias("fast_min"),
        ((F.col("l_partkey") % 40) * 100.0).alias("lateral_m"),
    )


IMPACTS = """impacts AS (SELECT l_suppkey AS lake_id, o_custkey AS osm, l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part,
  ['settlement', 'school', 'road', 'bridge', 'hydro'][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS kind, l_quantity AS km,
  CASE l_returnflag WHEN 'R' THEN 'flooded' WHEN 'A' THEN 'margin' ELSE 'outside' END AS expected,
  CASE l_linestatus WHEN 'F' THEN 'flooded' WHEN 'X' THEN 'margin' ELSE 'outside' END AS severe,
  CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 100 / 60 END AS fast_min, (l_partkey % 40) * 100.0::DOUBLE AS lateral_m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding is an 8 by 8 raster."""
    e = table(spark, sf_dir, "embeddings")
    cell = e.select(F.col("vec_id").alias("grid_id"), F.posexplode("embedding").alias("cell", "z"))
    return cell.select(
        "grid_id", F.floor(F.col("cell") / 8).cast("int").alias("r"), (F.col("cell") % 8).cast("int").alias("c"), F.col("z").cast("double").alias("z")
    )


GRIDS = """grids AS (SELECT vec_id AS grid_id, CAST((k - 1) // 8 AS INT) AS r, CAST((k - 1) % 8 AS INT) AS c, CAST(embedding[k] AS DOUBLE) AS z
  FROM embeddings, (SELECT unnest(range(1, 65)) AS k) AS cells)"""
