"""Raster, spatial and graph queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import geo, rules
from moraine.operators import downstream, drain, drainage, raster, spatial
from moraine.plans import domain as d
from moraine.plans.domain import micro, micro_sql
from moraine.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ctes(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


@query(ctes(d.GRIDS) + f""", g AS (SELECT *, coalesce((lead(z) OVER v - lag(z) OVER v) / 2, lead(z) OVER v - z, z - lag(z) OVER v) AS gr,
  coalesce((lead(z) OVER h - lag(z) OVER h) / 2, lead(z) OVER h - z, z - lag(z) OVER h) AS gc FROM grids WINDOW v AS (PARTITION BY grid_id, c ORDER BY r), h AS (PARTITION BY grid_id, r ORDER BY c))
SELECT grid_id, r, c, {micro_sql("degrees(atan(sqrt(gr * gr + gc * gc)))")} AS slope_e4 FROM g""")
def cell_slope(spark: SparkSession, sf: str) -> DataFrame:
    return raster.slope(d.grids(spark, sf)).select("grid_id", "r", "c", micro(F.col("slope")).alias("slope_e4"))


WET = "wet AS (SELECT grid_id, r, c FROM grids WHERE z > 0.1)"


def _wet(spark: SparkSession, sf: str) -> DataFrame:
    return d.grids(spark, sf).where("z > 0.1").select("grid_id", "r", "c")


@query(ctes(d.GRIDS, WET, """reach AS (SELECT grid_id, r, c, r AS lr, c AS lc FROM wet
  UNION SELECT w.grid_id, w.r, w.c, x.lr, x.lc FROM reach x JOIN wet w ON w.grid_id = x.grid_id AND abs(w.r - x.r) <= 1 AND abs(w.c - x.c) <= 1)""", recursive=True)
    + "SELECT grid_id, r, c, min(lr * 8 + lc) // 8 AS label_r, min(lr * 8 + lc) % 8 AS label_c FROM reach GROUP BY 1, 2, 3")
def lake_components(spark: SparkSession, sf: str) -> DataFrame:
    return raster.components(spark, _wet(spark, sf))


@query(ctes(d.GRIDS, WET) + "SELECT DISTINCT grid_id, r + dr AS r, c + dc AS c FROM wet, (SELECT unnest([0, -1, 1, 0, 0]) AS dr, unnest([0, 0, 0, -1, 1]) AS dc)")
def dilated_mask(spark: SparkSession, sf: str) -> DataFrame:
    return raster.dilate(_wet(spark, sf))


@query(ctes(d.GRIDS, WET, "off AS (SELECT unnest([0, -1, 1, 0, 0]) AS dr, unnest([0, 0, 0, -1, 1]) AS dc)", "dil AS (SELECT DISTINCT grid_id, r + dr AS r, c + dc AS c FROM wet, off)")
    + "SELECT a.grid_id, a.r, a.c FROM dil a, off JOIN dil b ON b.grid_id = a.grid_id AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2, 3 HAVING count(*) = 5")
def closed_mask(spark: SparkSession, sf: str) -> DataFrame:
    return raster.close(_wet(spark, sf))


@query(ctes(d.GRIDS) + f"""SELECT a.grid_id, a.r, a.c, {micro_sql("min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)))")} AS distance_e4
FROM grids a LEFT JOIN grids b ON a.grid_id = b.grid_id AND b.z <= -0.1 GROUP BY 1, 2, 3""")
def edge_distance(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.grids(spark, sf)
    return raster.distance_to(cells, cells.where("z <= -0.1")).select("grid_id", "r", "c", micro(F.col("distance")).alias("distance_e4"))


DROPS = "off AS (SELECT k, (k + CASE WHEN k >= 4 THEN 1 ELSE 0 END) // 3 - 1 AS dr, (k + CASE WHEN k >= 4 THEN 1 ELSE 0 END) % 3 - 1 AS dc FROM (SELECT unnest(range(0, 8)) AS k))"
TO = """ranked AS (SELECT a.grid_id, a.r, a.c, b.r AS to_r, b.c AS to_c, row_number() OVER (PARTITION BY a.grid_id, a.r, a.c ORDER BY (a.z - b.z) / sqrt(dr * dr + dc * dc) DESC, k) AS n
  FROM grids a, off JOIN grids b ON b.grid_id = a.grid_id AND b.r = a.r + dr AND b.c = a.c + dc WHERE b.z < a.z),
receivers AS (SELECT g.grid_id, g.r, g.c, to_r, to_c FROM grids g LEFT JOIN ranked x ON x.grid_id = g.grid_id AND x.r = g.r AND x.c = g.c AND n = 1)"""


@query(ctes(d.GRIDS, DROPS, TO) + "SELECT CAST(grid_id AS BIGINT) AS grid_id, r, c, to_r, to_c FROM receivers")
def flow_receivers(spark: SparkSession, sf: str) -> DataFrame:
    return raster.receivers(d.grids(spark, sf))


@query(ctes(d.GRIDS, DROPS, TO, """path AS (SELECT grid_id, 0 AS seq, arg_max(r, z * 1.0 - (r * 8 + c) * 0) AS r, arg_max(c, z) AS c FROM grids GROUP BY 1
  UNION ALL SELECT p.grid_id, p.seq + 1, t.to_r, t.to_c FROM path p JOIN receivers t ON p.grid_id = t.grid_id AND p.r = t.r AND p.c = t.c WHERE t.to_r IS NOT NULL)""", recursive=True)
    + "SELECT grid_id, seq, r, c FROM path")
def flow_path(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.grids(spark, sf)
    top = cells.groupBy("grid_id").agg(F.max(F.struct("z", "r", "c")).alias("m")).select("grid_id", "m.r", "m.c")
    return raster.flow_paths(spark, raster.receivers(cells), top).drop("path_id")


@query(ctes(d.GRIDS, DROPS, TO, """up AS (SELECT grid_id, arg_min(r, z) AS r, arg_min(c, z) AS c FROM grids GROUP BY 1
  UNION ALL SELECT t.grid_id, t.r, t.c FROM up u JOIN receivers t ON u.grid_id = t.grid_id AND t.to_r = u.r AND t.to_c = u.c)""", recursive=True) + "SELECT grid_id, r, c FROM up")
def catchment(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.grids(spark, sf)
    low = cells.groupBy("grid_id").agg(F.min(F.struct("z", "r", "c")).alias("m")).select("grid_id", "m.r", "m.c")
    return raster.catchment(spark, raster.receivers(cells), low)


@query(ctes(d.GRIDS) + f""", b AS (SELECT grid_id, floor(z * 4) AS bin, z * 4 AS z FROM grids), m AS (SELECT grid_id, bin, row_number() OVER (PARTITION BY grid_id ORDER BY count(*) DESC, bin) AS k FROM b GROUP BY 1, 2)
SELECT b.grid_id, {micro_sql("quantile_cont(z, 0.5)")} AS level_e4 FROM b JOIN m ON b.grid_id = m.grid_id AND b.bin = m.bin AND k = 1 GROUP BY 1""")
def water_level(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.grids(spark, sf).withColumn("z", F.col("z") * 4)
    return raster.water_level(cells).select("grid_id", micro(F.col("level")).alias("level_e4"))


@query(ctes(d.GRIDS, WET) + """, ring AS (SELECT g.* FROM grids g WHERE EXISTS (SELECT 1 FROM wet w WHERE w.grid_id = g.grid_id AND abs(w.r - g.r) <= 1 AND abs(w.c - g.c) <= 1)
  AND NOT EXISTS (SELECT 1 FROM wet w WHERE w.grid_id = g.grid_id AND w.r = g.r AND w.c = g.c))
SELECT grid_id, arg_min(r, z) AS r, arg_min(c, z) AS c, min(z) AS z FROM ring GROUP BY 1""")
def outlet_cell(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.grids(spark, sf)
    return raster.outlet(raster.ring_of(_wet(spark, sf), cells))


@query(ctes(d.GRIDS) + """SELECT a.grid_id, a.r, a.c, coalesce(bool_or(b.z > a.z + sqrt(2 * k * k) * 0.2::DOUBLE), false) AS shadow
FROM grids a CROSS JOIN (SELECT unnest(range(1, 4)) AS k) LEFT JOIN grids b ON b.grid_id = a.grid_id AND b.r = a.r - k AND b.c = a.c + k GROUP BY 1, 2, 3""")
def cast_shadow(spark: SparkSession, sf: str) -> DataFrame:
    return raster.shadow(d.grids(spark, sf), -1, 1, 0.2, 3)


@query(ctes(d.GRIDS, WET) + """, shared AS (SELECT a.grid_id, count(*) AS n FROM wet a JOIN wet b ON a.grid_id = b.grid_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY 1)
SELECT w.grid_id, count(*) * 100.0::DOUBLE AS area_m2, (4 * count(*) - coalesce(max(n), 0)) * 10.0::DOUBLE AS perimeter_m, (4 * count(*) - coalesce(max(n), 0)) * 50.0::DOUBLE AS uncertainty_m2
FROM wet w LEFT JOIN shared s ON w.grid_id = s.grid_id GROUP BY 1""")
def lake_extent(spark: SparkSession, sf: str) -> DataFrame:
    return raster.lake_extent(_wet(spark, sf))


@query(ctes(d.GRIDS) + """, idx AS (SELECT *, CASE WHEN z + abs(z / 2 + 0.1) <> 0 THEN (z - abs(z / 2 + 0.1)) / (z + abs(z / 2 + 0.1)) END AS i, (r * 8 + c) % 12 AS scl, c = 7 AS shade FROM grids),
seen AS (SELECT *, coalesce((scl NOT IN (0, 1, 8, 9, 10, 11, 3, 7) OR (scl IN (3, 7) AND i > 0.3 AND i > 0.5)) AND NOT shade AND i IS NOT NULL, false) AS observed FROM idx)
SELECT grid_id, r, c, observed, coalesce(observed AND i > 0.3, false) AS water FROM seen""")
def scene_masks(spark: SparkSession, sf: str) -> DataFrame:
    nir = F.abs(F.col("z") / 2 + 0.1)
    cells = d.grids(spark, sf).withColumn("i", rules.ndwi(F.col("z"), nir))
    seen = rules.observed((F.col("r") * 8 + F.col("c")) % 12, F.col("i"), F.col("c") == 7)
    return cells.withColumn("observed", seen).select("grid_id", "r", "c", "observed", rules.water(F.col("observed"), F.col("i")).alias("water"))


def _points(spark: SparkSession, sf: str, name: str, key: str, out: str, *more: Column) -> DataFrame:
    k = F.col(key)
    return d.table(spark, sf, name).select(k.alias(out), (k * 37 % 400 / 100.0 + 75).alias("lon"), (k * 91 % 300 / 100.0 + 30).alias("lat"), *more)


PTS = """a AS (SELECT c_custkey AS a_id, c_custkey * 37 % 400 / 100.0::DOUBLE + 75 AS lon, c_custkey * 91 % 300 / 100.0::DOUBLE + 30 AS lat FROM customer),
b AS (SELECT s_suppkey AS b_id, s_suppkey * 37 % 400 / 100.0::DOUBLE + 75 AS lon, s_suppkey * 91 % 300 / 100.0::DOUBLE + 30 AS lat FROM supplier),
pairs AS (SELECT a_id, b_id, 111.0::DOUBLE * sqrt(pow(b.lat - a.lat, 2) + pow((b.lon - a.lon) * cos(radians(a.lat)), 2)) AS km FROM a, b)"""


@query(ctes(PTS) + f""", best AS (SELECT a_id, min(ROW(floor(km * 1e6), b_id)) AS n, arg_min(b_id, floor(km * 1e6) * 1e6 + b_id) AS b_id FROM pairs WHERE km <= 12 GROUP BY 1)
SELECT a.a_id, best.b_id, {micro_sql("p.km")} AS km_e4 FROM a LEFT JOIN best ON a.a_id = best.a_id LEFT JOIN pairs p ON p.a_id = a.a_id AND p.b_id = best.b_id""")
def nearest_within(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _points(spark, sf, "customer", "c_custkey", "a_id"), _points(spark, sf, "supplier", "s_suppkey", "b_id")
    return spatial.nearest_within(a, b, 12.0).select("a_id", "b_id", micro(F.col("km")).alias("km_e4"))


@query(ctes(PTS) + f", h AS (SELECT a_id, b_id, 2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM a, b)" + f"""
SELECT a_id, CAST(k AS INT) AS rank, {micro_sql("km")} AS km_e4 FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY km, b_id) AS k FROM h) WHERE k <= 3""")
def haversine_top3(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _points(spark, sf, "customer", "c_custkey", "a_id"), _points(spark, sf, "supplier", "s_suppkey", "b_id")
    return spatial.nearest(a, b, 3).select("a_id", "rank", micro(F.col("km")).alias("km_e4"))


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    x0, y0, w = k * 31 % 17 / 5.0 + 75.0537, k * 17 % 13 / 5.0 + 30.0537, k % 4 * 0.3 + 0.42
    ring = F.array(*[F.struct((x0 + w * a).alias("x"), (y0 + w * b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return d.table(spark, sf, "nation").select(k.alias("area_id"), ring.alias("ring"), (w * w).alias("size"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + w).alias("y1"))


@query(ctes(PTS) + """, n AS (SELECT n_nationkey AS area_id, n_nationkey * 31 % 17 / 5.0::DOUBLE + 75.0537::DOUBLE AS x0, n_nationkey * 17 % 13 / 5.0::DOUBLE + 30.0537::DOUBLE AS y0, n_nationkey % 4 * 0.3::DOUBLE + 0.42::DOUBLE AS w FROM nation)
SELECT a.a_id AS point_id, arg_min(area_id, w * 1000 + area_id) AS area_id FROM a LEFT JOIN n ON a.lon > x0 AND a.lon < x0 + w AND a.lat > y0 AND a.lat < y0 + w GROUP BY 1""")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "customer", "c_custkey", "point_id").select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.in_polygon(points, _areas(spark, sf))


@query(None)
def greedy_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Largest first within twenty kilometres; tests hold the rounds to a loop."""
    p = _points(spark, sf, "customer", "c_custkey", "id", F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("area")).where("id is not null")
    return spatial.greedy_spread(p, 20.0)


@query(ctes(PTS) + """, seg AS (SELECT g AS path_id, i, (i - 1) * 0.5 * sqrt(2::DOUBLE) AS chain, 75 + (i - 1) * 0.5::DOUBLE AS ax, 30 + (i - 1) * 0.5::DOUBLE AS ay, 75 + i * 0.5::DOUBLE AS bx, 30 + i * 0.5::DOUBLE AS by_
  FROM (SELECT unnest(range(0, 5)) AS g), (SELECT unnest(range(1, 7)) AS i)),
t AS (SELECT a_id % 5 AS path_id, a_id AS id, lon, lat, seg.*, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((lon - ax) * (bx - ax) + (lat - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM a JOIN seg ON a_id % 5 = seg.path_id)
""" + f"SELECT path_id, id, {micro_sql('min(sqrt(pow(lon - (ax + t * (bx - ax)), 2) + pow(lat - (ay + t * (by_ - ay)), 2)))')} AS distance_e4 FROM t GROUP BY 1, 2")
def along_path(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "customer", "c_custkey", "id").select((F.col("id") % 5).alias("path_id"), "id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    seg = spark.range(5).select(F.col("id").alias("path_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    seg = seg.select("path_id", (F.col("i") * 0.5 * 2**0.5).alias("chain"), *[(F.col("i") * 0.5 + k).alias(n) for n, k in (("ax", 75), ("ay", 30), ("bx", 75.5), ("by", 30.5))])
    return spatial.along_path(points, seg).select("path_id", "id", micro(F.col("distance")).alias("distance_e4"))


@query(ctes(PTS) + "SELECT a_id, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone FROM a")
def utm_zones(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf, "customer", "c_custkey", "a_id").select("a_id", geo.utm_zone(F.col("lon")).alias("zone"))


@query(None)
def utm_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Projected coordinates; tests hold them to known points."""
    east, north = geo.utm(F.col("lon"), F.col("lat"))
    return _points(spark, sf, "customer", "c_custkey", "a_id").select("a_id", east.alias("east"), north.alias("north"))


@query(ctes(PTS) + """SELECT a_id, strpos(tile, 'E') > 0 AS east, tile FROM (SELECT a_id, 'N' || lpad(CAST(CAST(floor(lat) AS INT) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(CAST(floor(lon) AS INT) AS VARCHAR), 3, '0') AS tile FROM a)""")
def dem_tiles(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda c, n: F.lpad(F.floor(c).cast("int").cast("string"), n, "0")
    tile = F.concat(F.lit("N"), part("lat", 2), F.lit("E"), part("lon", 3))
    return _points(spark, sf, "customer", "c_custkey", "a_id").select("a_id", F.contains(tile, F.lit("E")).alias("east"), tile.alias("tile"))


def _starts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("grid_id").agg(F.max(F.struct("z", "r", "c")).alias("m")).select("grid_id", "m.r", "m.c")


@query(None)
def traced_path(spark: SparkSession, sf: str) -> DataFrame:
    """Flow paths that leave pits; tests hold them to the lowest barriers of a plain search."""
    cells = d.grids(spark, sf)
    return drainage.trace_paths(spark, cells, _starts(cells)).drop("path_id", "along_m")


def _mosaic(cells: DataFrame) -> DataFrame:
    """Tiles of eight by eight side by side, four in a row and four rows, each lower than its left and upper neighbours."""
    k = F.col("grid_id") % 16
    r, c = F.col("r") + F.floor(k / 4).cast("int") * 8, F.col("c") + (k % 4).cast("int") * 8
    return cells.select(F.floor(F.col("grid_id") / 16).alias("grid_id"), r.alias("r"), c.alias("c"), (F.col("z") - (r + c) * 0.05).alias("z"))


MOSAIC = """mosaic AS (SELECT grid_id // 16 AS grid_id, r, c, z - (r + c) * 0.05::DOUBLE AS z
  FROM (SELECT grid_id, r + CAST(grid_id % 16 // 4 AS INT) * 8 AS r, c + CAST(grid_id % 4 AS INT) * 8 AS c, z FROM grids))"""


@query(None)
def mosaic_path(spark: SparkSession, sf: str) -> DataFrame:
    """A path from each mosaic's first cell across its tiles; tests hold it to one walk over the whole."""
    cells = _mosaic(d.grids(spark, sf))
    start = cells.groupBy("grid_id").agg(F.min(F.struct("r", "c")).alias("m")).select("grid_id", (F.col("m.r") + 1).alias("r"), (F.col("m.c") + 1).alias("c"))
    return drainage.trace_paths(spark, cells, start, 30.0)


@query(ctes(d.GRIDS, """reach AS (SELECT grid_id, r, c, z AS level FROM grids WHERE r IN (0, 7) OR c IN (0, 7)
  UNION SELECT g.grid_id, g.r, g.c, greatest(g.z, x.level) FROM reach x JOIN grids g ON g.grid_id = x.grid_id AND abs(g.r - x.r) <= 1 AND abs(g.c - x.c) <= 1)""", recursive=True)
    + f"SELECT grid_id, r, c, {micro_sql('min(level)')} AS level_e4 FROM reach GROUP BY 1, 2, 3")
def filled_height(spark: SparkSession, sf: str) -> DataFrame:
    """The height that water must reach in each cell to leave its tile."""
    return drainage.filled(spark, d.grids(spark, sf)).select("grid_id", "r", "c", micro(F.col("level")).alias("level_e4"))


@query(ctes(d.GRIDS) + f""", pts AS (SELECT grid_id, k, least(7.0::DOUBLE, greatest(0.0::DOUBLE, k * 1.75::DOUBLE - 0.5)) AS x, least(7.0::DOUBLE, greatest(0.0::DOUBLE, 7.25::DOUBLE - k * 1.25::DOUBLE)) AS y
  FROM (SELECT DISTINCT grid_id FROM grids), (SELECT unnest(range(0, 6)) AS k)),
corners AS (SELECT *, CAST(floor(y) AS INT) + a AS r, CAST(floor(x) AS INT) + b AS c, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w
  FROM pts, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT grid_id, k, {micro_sql("sum(w * z)")} AS z_e4 FROM corners JOIN grids USING (grid_id, r, c) GROUP BY 1, 2""")
def bilinear_samples(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.grids(spark, sf)
    k = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("point")
    points = cells.select("grid_id").distinct().select("grid_id", k).select("grid_id", "point", (F.col("point") * 1.75 - 0.5).alias("x"), (7.25 - F.col("point") * 1.25).alias("y"))
    return downstream.sample(points, cells).select("grid_id", F.col("point").cast("long").alias("k"), micro(F.col("z")).alias("z_e4"))


@query(None)
def route(spark: SparkSession, sf: str) -> DataFrame:
    """Stations of a flood down each tile, at 300 m a cell; tests hold them to a worked valley."""
    cells = d.grids(spark, sf).withColumn("z", F.col("z") * 1000)
    path = drainage.trace_paths(spark, cells, _starts(cells), 300.0)
    peaks = cells.select("grid_id").distinct().withColumn("peak_m3s", F.lit(800.0) + F.col("grid_id") % 7 * 100)
    return downstream.route(cells, path, peaks, 300.0, half_m=1200.0)


LAKE_PARTS = """reach AS (SELECT grid_id, r, c, r AS lr, c AS lc FROM wet
  UNION SELECT w.grid_id, w.r, w.c, x.lr, x.lc FROM reach x JOIN wet w ON w.grid_id = x.grid_id AND abs(w.r - x.r) <= 1 AND abs(w.c - x.c) <= 1),
labels AS (SELECT grid_id, r, c, min(lr * 8 + lc) AS label FROM reach GROUP BY 1, 2, 3)"""


@query(ctes(d.GRIDS, WET, LAKE_PARTS, recursive=True) + f""", parts AS (SELECT grid_id, label, count(*) * 400.0::DOUBLE AS area_m2, avg(r) AS cr, avg(c) AS cc, quantile_cont(z, 0.5) AS h FROM labels JOIN grids USING (grid_id, r, c) GROUP BY 1, 2)
SELECT grid_id, label // 8 AS label_r, label % 8 AS label_c, area_m2, {micro_sql("cr")} AS r_e4, {micro_sql("cc")} AS c_e4, {micro_sql("h")} AS h_e4,
  CAST(row_number() OVER (PARTITION BY grid_id ORDER BY area_m2 DESC, label) AS INT) AS rank FROM parts WHERE area_m2 >= 1200 AND h >= 0.12""")
def find_lakes(spark: SparkSession, sf: str) -> DataFrame:
    found = downstream.find_lakes(spark, _wet(spark, sf), d.grids(spark, sf), 20.0, 1200.0, 0.12)
    values = [micro(F.col(f"{n}")).alias(a) for n, a in (("centre_r", "r_e4"), ("centre_c", "c_e4"), ("height_m", "h_e4"))]
    return found.select("grid_id", "label_r", "label_c", "area_m2", *values, "rank")


@query(ctes(d.GRIDS, DROPS, TO, WET, """g1 AS (SELECT *, coalesce((lead(z) OVER v - lag(z) OVER v) / 2, lead(z) OVER v - z, z - lag(z) OVER v) AS gr,
  coalesce((lead(z) OVER h - lag(z) OVER h) / 2, lead(z) OVER h - z, z - lag(z) OVER h) AS gc FROM grids WINDOW v AS (PARTITION BY grid_id, c ORDER BY r), h AS (PARTITION BY grid_id, r ORDER BY c))""",
    "low AS (SELECT grid_id, r, c FROM grids WHERE z < -0.1)", """up AS (SELECT grid_id, r, c FROM low
  UNION SELECT t.grid_id, t.r, t.c FROM up u JOIN receivers t ON u.grid_id = t.grid_id AND t.to_r = u.r AND t.to_c = u.c)""",
    """far AS (SELECT a.grid_id, a.r, a.c, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) AS dist FROM grids a JOIN low b ON a.grid_id = b.grid_id GROUP BY 1, 2, 3)""", recursive=True)
    + """, hit AS (SELECT g1.grid_id, count(*) AS n FROM g1 JOIN up USING (grid_id, r, c) JOIN far USING (grid_id, r, c)
  WHERE dist > 0 AND degrees(atan(sqrt(gr * gr + gc * gc) / 0.1::DOUBLE)) >= 30 AND degrees(atan2(z + 0.1::DOUBLE, dist * 0.1::DOUBLE)) > 14 GROUP BY 1)
SELECT grid_id, CAST(coalesce(n, 0) AS BIGINT) AS cells FROM (SELECT DISTINCT grid_id FROM grids) LEFT JOIN hit USING (grid_id)""")
def steep_catchment(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that can shed into the low ground of each tile."""
    cells = d.grids(spark, sf)
    level = cells.select("grid_id").distinct().withColumn("level", F.lit(-0.1))
    slopes = downstream.steep_slopes(spark, cells, cells.where("z < -0.1"), level, 0.1)
    area = downstream.source_area(slopes, cells, 0.1)
    return area.select("grid_id", F.rint(F.col("km2") * 1e8).cast("long").alias("cells"))


@query("""SELECT l_orderkey AS way_id, CAST(floor(avg(l_partkey) * 10000 + 0.5) AS BIGINT) AS x_e4, CAST(floor(avg(l_suppkey) * 10000 + 0.5) AS BIGINT) AS y_e4 FROM lineitem GROUP BY 1""")
def way_centres(spark: SparkSession, sf: str) -> DataFrame:
    """The way of each order, closed by its first point again."""
    node = F.struct("l_linenumber", F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"))
    ways = d.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.array_sort(F.collect_list(node)).alias("p"))
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    closed = F.when(F.size("p") > 1, F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    out = downstream.way_centres(ways.select("way_id", closed.alias("points")))
    return out.select("way_id", micro(F.col("x")).alias("x_e4"), micro(F.col("y")).alias("y_e4"))


@query("""SELECT way_id, CAST(floor(coalesce(sum(CASE WHEN wet AND was THEN sqrt(dx * dx + 9.0::DOUBLE) END), 0) * 10000 + 0.5) AS BIGINT) AS m_e4 FROM (SELECT l_orderkey AS way_id, l_returnflag = 'R' AS wet, lag(l_returnflag = 'R') OVER w AS was,
  CAST(l_quantity - lag(l_quantity) OVER w AS DOUBLE) AS dx FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) GROUP BY 1""")
def flooded_road_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    points = rows.select(F.col("l_orderkey").alias("way_id"), F.col("n").alias("seq"), F.col("l_quantity").cast("double").alias("x"), (F.col("n") * 3.0).alias("y"), (F.col("l_returnflag") == "R").alias("flooded"))
    return downstream.flooded_length(points).select("way_id", micro(F.col("flooded_m")).alias("m_e4"))


@query("""SELECT l_suppkey AS lake_id, CAST(floor(count(*) FILTER (l_partkey % 7 <> 0) / CAST(count(*) AS DOUBLE) * 10000 + 0.5) AS BIGINT) AS usable_e4,
  CAST(floor(count(*) FILTER (l_partkey % 7 <> 0 AND l_returnflag = 'A') / CAST(nullif(count(*) FILTER (l_partkey % 7 <> 0), 0) AS DOUBLE) * 10000 + 0.5) AS BIGINT) AS snow_e4 FROM lineitem GROUP BY 1""")
def outline_cover(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("lake_id"), (F.col("l_returnflag") == "A").alias("snow"), (F.col("l_partkey") % 7 != 0).alias("usable"))
    return downstream.outline_cover(cells).select("lake_id", micro(F.col("usable")).alias("usable_e4"), micro(F.col("snow")).alias("snow_e4"))


@query(ctes(d.GRIDS, """met AS (SELECT g.grid_id, g.r, g.c, abs(g.r - 3) AS dist FROM grids g WHERE abs(g.r - 3) <= 2 AND g.z < 0.05 + g.c * 0.01::DOUBLE)""", """reach AS (SELECT grid_id, r, c FROM met WHERE r = 3
  UNION SELECT w.grid_id, w.r, w.c FROM reach x JOIN met w ON w.grid_id = x.grid_id AND abs(w.r - x.r) <= 1 AND abs(w.c - x.c) <= 1)""", recursive=True) + "SELECT grid_id, r, c FROM reach")
def corridor(spark: SparkSession, sf: str) -> DataFrame:
    """The flood of a path along each tile's fourth row."""
    cells = d.grids(spark, sf)
    path = cells.where("r = 3").select("grid_id", F.col("c").alias("seq"), "r", "c", (0.05 + F.col("c") * 0.01).alias("level"))
    return raster.corridor(spark, cells, path, 2.0)


@query(ctes(d.GRIDS, WET, """sl AS (SELECT *, coalesce((lead(z) OVER v - lag(z) OVER v) / 2, lead(z) OVER v - z, z - lag(z) OVER v) AS gr,
  coalesce((lead(z) OVER h - lag(z) OVER h) / 2, lead(z) OVER h - z, z - lag(z) OVER h) AS gc FROM grids WINDOW v AS (PARTITION BY grid_id, c ORDER BY r), h AS (PARTITION BY grid_id, r ORDER BY c))""",
    "near AS (SELECT *, degrees(atan(sqrt(gr * gr + gc * gc))) < 3 AS calm FROM sl WHERE abs(z - 0.05::DOUBLE) <= 0.06)",
    """flat AS (SELECT DISTINCT a.grid_id, a.r, a.c FROM near a JOIN near b ON b.calm AND a.grid_id = b.grid_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
both_ AS (SELECT grid_id, r, c FROM flat UNION SELECT grid_id, r, c FROM wet)""", """reach AS (SELECT grid_id, r, c FROM wet
  UNION SELECT w.grid_id, w.r, w.c FROM reach x JOIN both_ w ON w.grid_id = x.grid_id AND abs(w.r - x.r) <= 1 AND abs(w.c - x.c) <= 1)""", recursive=True) + "SELECT grid_id, r, c FROM reach")
def spill_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Each tile's water with the calm ground at its level that it touches."""
    cells = d.grids(spark, sf)
    level = cells.select("grid_id").distinct().withColumn("level", F.lit(0.05))
    return raster.spill_mask(spark, cells, _wet(spark, sf), level, 0.06, 1.0, 3.0)


@query("""SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 4 IN (0, 1) AND n_regionkey <> 2""")
def admin_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as tagged relations: two levels of four are used, and one region has no boundary tag."""
    k = F.col("n_nationkey")
    tags = F.create_map(F.lit("admin_level"), (k % 4 + 4).cast("string"), F.lit("boundary"), F.when(F.col("n_regionkey") != 2, "administrative").otherwise("political"), F.lit("name"), F.col("n_name"))
    osm = d.table(spark, sf, "nation").select(k.alias("id"), tags.alias("tags"))
    return readers.boundaries(osm).select("id", F.col("tags")["name"].alias("name"))


@query(f"""SELECT l_suppkey AS reach, l_partkey % 10 AS label, count(*) * 5000.0::DOUBLE AS area_m2, max(l_quantity) * 4.0::DOUBLE AS width_m, {micro_sql("avg(l_linenumber % 5)")} AS freq_e4
FROM lineitem GROUP BY 1, 2 HAVING count(*) * 5000.0 >= 20000 AND max(l_quantity) * 4.0 >= 60""")
def water_blobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("reach"), (F.col("l_partkey") % 10).alias("label"), (F.col("l_quantity") * 4.0).alias("width_m"), (F.col("l_linenumber") % 5).alias("base_freq")
    )
    return drain.blobs(rows, 5000.0).select("reach", "label", "area_m2", "width_m", micro(F.col("base_freq")).alias("freq_e4"))
