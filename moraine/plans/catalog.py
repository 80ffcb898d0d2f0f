"""Catalogue queries: scans, orders, rollups and validations, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import catalog, text
from moraine.operators import exposure, places
from moraine.plans import domain as d
from moraine.plans import hazard, warning
from moraine.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) BETWEEN make_date(year(o_orderdate), 8, 15) AND make_date(year(o_orderdate), 10, 31) AS in_season FROM orders")
def season_filter(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), catalog.in_season(F.to_date("o_orderdate")).alias("in_season"))


@query("""SELECT user_id AS cell, count(*) FILTER (CAST(ts AS DATE) BETWEEN DATE '2024-01-29' - 20 AND DATE '2024-01-29') AS now,
  count(*) FILTER (CAST(ts AS DATE) BETWEEN DATE '2024-01-29' - 400 AND DATE '2024-01-29' - 21) AS base FROM events GROUP BY 1""")
def lookback_windows(spark: SparkSession, sf: str) -> DataFrame:
    day, as_of = F.to_date("ts"), F.lit("2024-01-29").cast("date")
    return d.table(spark, sf, "events").groupBy(F.col("user_id").alias("cell")).agg(
        F.count_if(catalog.in_lookback(day, as_of, 0, 20)).alias("now"), F.count_if(catalog.in_lookback(day, as_of, 21, 400)).alias("base")
    )


@query("WITH " + d.GRIDS + " SELECT grid_id, count(*) AS cells, avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END) AS clear FROM grids WHERE (r - 3) * (r - 3) + (c - 3) * (c - 3) <= 6.25 GROUP BY 1")
def focus_clear_fraction(spark: SparkSession, sf: str) -> DataFrame:
    near = catalog.in_disk(F.col("r"), F.col("c"), 3, 3, 100.0, 200.0)
    return d.grids(spark, sf).where(near).groupBy("grid_id").agg(F.count("*").alias("cells"), F.avg((F.col("z") > 0).cast("double")).alias("clear"))


@query("""SELECT id, name, regexp_matches(b, '^(19|20)\\d{2}$') OR b IN ('outlet', 'glaciers', 'flood_path', 'corridor_expected', 'corridor_severe', 'outlines') AS is_layer,
  regexp_matches(osm, '^(node|way|relation)/[0-9]+$') AS is_osm FROM (SELECT *, regexp_replace(name, '\\.geojson$', '') AS b FROM (SELECT p_partkey AS id,
  CASE p_partkey % 4 WHEN 0 THEN CAST(1890 + p_partkey % 200 AS VARCHAR) || '.geojson' WHEN 1 THEN 'glaciers' WHEN 2 THEN 'flood_path.geojson' ELSE p_name END AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'node/' || p_partkey WHEN 1 THEN 'way/x' || p_partkey ELSE 'relation/' END AS osm FROM part))""")
def name_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat((k % 200 + 1890).cast("string"), F.lit(".geojson"))).when(k % 4 == 1, "glaciers").when(k % 4 == 2, "flood_path.geojson").otherwise(F.col("p_name"))
    osm = F.when(k % 3 == 0, F.concat(F.lit("node/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("way/x"), k.cast("string"))).otherwise("relation/")
    rows = d.table(spark, sf, "part").select(k.alias("id"), name.alias("name"), osm.alias("osm"))
    return rows.select("id", "name", catalog.is_layer(F.col("name")).alias("is_layer"), catalog.is_osm_id(F.col("osm")).alias("is_osm"))


@query("""SELECT c_custkey AS id, CASE WHEN h < 0 THEN 'below' WHEN h >= 0 THEN 'above' END AS side, abs(h) AS metres, CAST(floor(abs(h) / 7) AS BIGINT) AS minutes,
  CAST(least(5000, greatest(1000, floor((4 * sqrt(abs(h) * 1000 / 3.141592653589793::DOUBLE) + 700) / 100 + 0.5) * 100)) AS BIGINT) AS radius_m
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS h FROM customer)""")
def flood_side(spark: SparkSession, sf: str) -> DataFrame:
    h = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))
    side = catalog.flood_side(h)
    radius = F.when(h.isNull(), F.lit(1000)).otherwise(catalog.research_radius(F.abs(h) * 1000))
    return d.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), side["side"].alias("side"), side["metres"].alias("metres"),
        catalog.minutes_to_say(F.abs(h) / 7).cast("long").alias("minutes"), radius.cast("long").alias("radius_m"),
    )


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INT) AS place FROM events")
def events_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return d.table(spark, sf, "events").select("event_id", F.row_number().over(w).alias("place"))


@query("""SELECT n_nationkey AS place, n_name AS name, r_name AS state, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name), n_nationkey) AS INT) AS seq,
  coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, r_name, 'unknown') AS district FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""")
def district_state(spark: SparkSession, sf: str) -> DataFrame:
    n, r = d.table(spark, sf, "nation"), d.table(spark, sf, "region")
    w = Window.partitionBy("n_regionkey").orderBy(F.lower("n_name"), "n_nationkey")
    named = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(
        F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), F.col("r_name").alias("state"), F.row_number().over(w).alias("seq"),
        F.coalesce(named, "r_name", F.lit("unknown")).alias("district"),
    )


@query("WITH " + d.IMPACTS + """ SELECT lake_id, kind, count(*) AS n, min(km) AS near, max(km) AS far, CAST(GROUPING(lake_id) + 2 * GROUPING(kind) AS BIGINT) AS level FROM impacts GROUP BY GROUPING SETS ((lake_id, kind), (lake_id), (kind), ())""")
def exposure_cube(spark: SparkSession, sf: str) -> DataFrame:
    """All four groupings at once."""
    cube = d.impacts(spark, sf).cube("lake_id", "kind")
    return cube.agg(F.count("*").alias("n"), F.min("km").alias("near"), F.max("km").alias("far"), (F.grouping("lake_id") + 2 * F.grouping("kind")).cast("long").alias("level"))


@query("WITH " + d.GRIDS + " SELECT g % 50 AS grid_id, r, c, arg_min(z, g) AS z FROM (SELECT grid_id AS g, r, c, z FROM grids WHERE z > -0.05) GROUP BY 1, 2, 3")
def dem_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    tiles = d.grids(spark, sf).withColumn("z", F.when(F.col("z") > -0.05, F.col("z"))).withColumnRenamed("grid_id", "tile").withColumn("grid_id", F.col("tile") % 50)
    return readers.mosaic(tiles)


@query("SELECT raster, level, res FROM (SELECT s_suppkey AS raster, l AS level, 10.0::DOUBLE * pow(2, l) AS res, row_number() OVER (PARTITION BY s_suppkey ORDER BY l DESC) AS k FROM supplier, (SELECT unnest(range(0, 6)) AS l) WHERE 10.0 * pow(2, l) <= 20 + s_suppkey % 200 AND s_suppkey % 200 < 1000 AND 10.0 * pow(2, l) <= 85) WHERE k = 1")
def overview_level(spark: SparkSession, sf: str) -> DataFrame:
    levels = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("raster"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level"))
    levels = levels.withColumn("res", 10.0 * F.pow(F.lit(2.0), "level")).where(F.col("res") <= F.col("raster") % 200 + 20)
    return readers.overview(levels, 85.0).select("raster", F.col("level").cast("long").alias("level"), "res")


@query("SELECT c_custkey AS id, '{\"type\":\"Feature\",\"properties\":{\"name\":\"' || c_name || '\"},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || c_nationkey || ',' || c_custkey % 90 || ']}}' AS feature FROM customer")
def point_features(spark: SparkSession, sf: str) -> DataFrame:
    at = F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 90)
    return d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), sinks.feature("Point", at, name=F.col("c_name")).alias("feature"))


@query("""SELECT l_orderkey AS id, min(l_partkey % 360 - 180) AS x0, max(l_partkey % 360 - 180) AS x1, min(l_suppkey % 90) AS y0, max(l_suppkey % 90) AS y1,
  max(l_partkey % 360 - 180) >= -20 AND min(l_partkey % 360 - 180) <= 40 AND max(l_suppkey % 90) >= 30 AND min(l_suppkey % 90) <= 60 AS meets,
  max(l_partkey % 360 - 180) >= 40 AND min(l_partkey % 360 - 180) <= -20 AND max(l_suppkey % 90) >= 60 AND min(l_suppkey % 90) <= 30 AS covers FROM lineitem GROUP BY 1""")
def box_query(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("l_partkey") % 360 - 180, F.col("l_suppkey") % 90
    b = d.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    box, asked = F.struct("x0", "y0", "x1", "y1"), (-20, 30, 40, 60)
    return b.select("*", readers.overlaps(box, asked).alias("meets"), readers.covers(box, asked).alias("covers"))


@query("SELECT l_orderkey AS id, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS evidence FROM lineitem GROUP BY 1")
def evidence_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    joined = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"))), ",")
    return d.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), joined.alias("evidence"))


@query("""SELECT q, id, CAST(rank AS INT) AS rank FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN starts_with(f, q) THEN 1 ELSE 2 END, id) AS rank
FROM (SELECT p_partkey AS id, translate(lower(p_name), ' -_.,''', '') AS f FROM part), (SELECT unnest(['red', 'small', 'gadget', 'nosuch']) AS q) WHERE contains(f, q)) WHERE rank <= 10""")
def resolver_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best hits of a few typed names: prefixes, then the rest."""
    names = d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.fold_name(F.col("p_name")).alias("f"))
    asked = spark.createDataFrame([("red",), ("small",), ("gadget",), ("nosuch",)], "q string")
    return places.resolver_hits(names, asked)


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE event_type END AS state FROM events")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    return d.table(spark, sf, "events").select(F.col("event_id").alias("id"), catalog.job_state(state, F.col("ts"), F.col("user_id") % 2 != 0).alias("state"))


@query("WITH " + d.LAKE_YEARS + f""", s AS (SELECT lake_id, string_agg(year || ':' || status, ',' ORDER BY year) AS years FROM lake_years GROUP BY 1),
r AS (SELECT lake_id, arg_max(level, season) AS level, arg_max(score_e4, season) AS score_e4 FROM ({hazard.ORACLES["risk_replay"]}) GROUP BY 1), v AS ({warning.ORACLES["drain_verdict"]}),
e AS (SELECT l_suppkey AS lake_id, count(*) FILTER (l_returnflag = 'R') AS hit FROM lineitem GROUP BY 1)
SELECT s_suppkey AS lake_id, s_name AS name, years, hit, hit IS NOT NULL AS known, level, score_e4, v.status AS drain, v.drained FROM supplier
LEFT JOIN s ON s.lake_id = s_suppkey LEFT JOIN e ON e.lake_id = s_suppkey LEFT JOIN r ON r.lake_id = s_suppkey LEFT JOIN v ON v.lake_id = s_suppkey""")
def index_mart(spark: SparkSession, sf: str) -> DataFrame:
    """One row a lake with its nested parts, its latest score and its drain verdict; a missing part is null."""
    lakes = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lake_id"), F.col("s_name").alias("name"))
    years = d.lake_years(spark, sf)
    scores = hazard.risk_replay(spark, sf).select("lake_id", "season", F.col("score_e4").alias("score"), "level")
    hit = F.count_if(F.col("l_returnflag") == "R")
    exposed = d.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("lake_id")).agg(hit.alias("in_flood_path"))
    exposed = exposed.select("lake_id", F.lit("road").alias("kind"), "in_flood_path", F.lit(0).cast("long").alias("at_risk"))
    out = sinks.index_mart(lakes, years, scores, exposed, warning.drain_verdict(spark, sf).select("lake_id", "status", "drained"))
    listed = F.array_join(F.transform("years", lambda y: F.concat_ws(":", y["year"].cast("string"), y["status"])), ",")
    hits = F.try_element_at("exposed_counts", F.lit("road"))["in_flood_path"]
    return out.select(
        "lake_id", "name", listed.alias("years"), hits.alias("hit"), F.col("exposed_counts").isNotNull().alias("known"),
        "risk.level", F.col("risk.score").alias("score_e4"), F.col("drain.status").alias("drain"), "drain.drained",
    )


@query("SELECT o_custkey AS osm, o_orderkey AS order_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return exposure.first_per(d.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("osm"), F.col("o_orderkey").alias("order_id"))
