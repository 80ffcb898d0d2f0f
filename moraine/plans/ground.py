"""Corridors, outlines, blobs, spill points and map elements, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators import downstream, drain, elements, inventory, outlines, raster
from moraine.plans import domain as d
from moraine.plans.domain import micro, micro_sql
from moraine.plans.terrain import DROPS, WET, _areas, _points, _wet, ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(ctes(d.GRIDS, """near AS (SELECT *, least(6, greatest(1, c)) AS p, r - 3 AS side FROM grids)""",
    """met AS (SELECT grid_id, r, c FROM near WHERE z < 0.05::DOUBLE + p * 0.01::DOUBLE AND sqrt((r - 3) * (r - 3) + (c - p) * (c - p)) <= least(2.5, CASE WHEN side >= 0 THEN 2.0 ELSE 1.0 END + 0.5)
  AND c BETWEEN 1 AND 6 AND NOT (r = 4 AND c = 5) UNION SELECT grid_id, r, c FROM grids WHERE r = 3 AND c BETWEEN 1 AND 6)""",
    """reach AS (SELECT grid_id, r, c FROM met WHERE r = 3 AND c BETWEEN 1 AND 6
  UNION SELECT w.grid_id, w.r, w.c FROM reach x JOIN met w ON w.grid_id = x.grid_id AND abs(w.r - x.r) <= 1 AND abs(w.c - x.c) <= 1)""", recursive=True) + "SELECT grid_id, r, c FROM reach")
def flood_corridor(spark: SparkSession, sf: str) -> DataFrame:
    """The flood along each tile's fourth row: two cells on the left, one on the right, nothing behind the start or beyond the end, a lake cut out."""
    cells = d.grids(spark, sf)
    path = cells.where("r = 3 and c between 1 and 6")
    points = path.select(
        "grid_id", F.col("c").alias("seq"), F.col("c").cast("double").alias("x"), F.lit(3.0).alias("y"), (0.05 + F.col("c") * 0.01).alias("level"),
        F.lit(1.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(2.0).alias("left_m"), F.lit(1.0).alias("right_m"),
    )
    return raster.flood_corridor(spark, cells, points, 1.0, 2.5, cells.where("r = 4 and c = 5"))


@query(ctes(d.GRIDS, WET) + """, shared AS (SELECT a.grid_id, count(*) AS n FROM wet a JOIN wet b ON a.grid_id = b.grid_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY 1)
SELECT w.grid_id, CAST(count(*) AS DOUBLE) AS area, CAST(4 * count(*) - coalesce(max(n), 0) AS BIGINT) AS length FROM wet w LEFT JOIN shared s ON w.grid_id = s.grid_id GROUP BY 1""")
def outline_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Area and length of each tile's rings: holes count against the area and for the length."""
    sizes = outlines.ring_sizes(outlines.rings(spark, _wet(spark, sf)))
    return sizes.groupBy("grid_id").agg(F.sum("area").alias("area"), F.sum("length").cast("long").alias("length"))


@query(ctes(d.GRIDS, WET, """reach AS (SELECT grid_id, r, c, r AS lr, c AS lc FROM wet
  UNION SELECT w.grid_id, w.r, w.c, x.lr, x.lc FROM reach x JOIN wet w ON w.grid_id = x.grid_id AND abs(w.r - x.r) + abs(w.c - x.c) = 1)""", recursive=True)
    + "SELECT grid_id, count(DISTINCT label) AS parts FROM (SELECT grid_id, r, c, min(lr * 8 + lc) AS label FROM reach GROUP BY 1, 2, 3) GROUP BY 1")
def outline_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Outer rings of each tile."""
    sizes = outlines.ring_sizes(outlines.rings(spark, _wet(spark, sf)))
    return sizes.where("area > 0").groupBy("grid_id").agg(F.count("*").alias("parts"))


@query(ctes(d.GRIDS, WET) + "SELECT grid_id, r, c FROM wet")
def refilled_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Each tile's water, as rings and back."""
    return outlines.cells_of(outlines.rings(spark, _wet(spark, sf)))


@query(None)
def simplified_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of each tile's water within half a cell; tests hold them to the recursion."""
    rings = outlines.rings(spark, _wet(spark, sf))
    lines = rings.select(F.struct("grid_id", "ring").alias("line_id"), "seq", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return outlines.simplify(spark, lines, 0.5).select("line_id.grid_id", "line_id.ring", "seq", "x", "y")


@query(ctes(d.GRIDS, """seen AS (SELECT grid_id, r, c, z > 0.02 AS now, c <> 3 AND z > 0.02 AND r < 7 AS new, c = 3 AND z > 0.02 AND r < 7 AS old FROM grids)""", """joined AS (SELECT grid_id, r, c, new FROM seen WHERE new
  UNION SELECT o.grid_id, o.r, o.c, false FROM seen o JOIN seen n ON o.old AND n.new AND o.grid_id = n.grid_id AND abs(o.r - n.r) + abs(o.c - n.c) <= 3)""", """reach AS (SELECT grid_id, r, c, r AS lr, c AS lc FROM joined
  UNION SELECT w.grid_id, w.r, w.c, x.lr, x.lc FROM reach x JOIN joined w ON w.grid_id = x.grid_id AND abs(w.r - x.r) <= 1 AND abs(w.c - x.c) <= 1)""",
    "labels AS (SELECT grid_id, r, c, min(lr * 8 + lc) AS label FROM reach GROUP BY 1, 2, 3)", """far AS (SELECT a.grid_id, a.r, a.c, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) AS far
  FROM seen a JOIN seen b ON a.new AND NOT b.new AND a.grid_id = b.grid_id GROUP BY 1, 2, 3)""", recursive=True)
    + f"""SELECT grid_id, label // 8 AS label_r, label % 8 AS label_c, count(*) AS cells, count(*) * 2500.0::DOUBLE AS area_m2, {micro_sql("2 * max(far) * 50")} AS width_e4, {micro_sql("avg(CASE WHEN c = 3 THEN 0.9::DOUBLE ELSE 0.0 END)")} AS freq_e4
FROM labels JOIN joined USING (grid_id, r, c) LEFT JOIN far USING (grid_id, r, c) GROUP BY 1, label HAVING count(*) FILTER (new) * 2500 >= 20000 AND 2 * max(far) * 50 >= 60""")
def new_water_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """New water on both sides of each tile's fourth column, an old river, at fifty metres a cell."""
    river = F.col("c") == 3
    cells = d.grids(spark, sf).select(
        *raster.CELL, (F.col("z") > 0.02).alias("now"), F.lit(4).alias("base_obs"), F.when(river, 0.9).otherwise(0.0).alias("base_freq"), (F.col("r") < 7).alias("corridor")
    )
    out = drain.label_blobs(spark, cells, 50.0)
    return out.select("grid_id", "label_r", "label_c", "cells", "area_m2", micro(F.col("width_m")).alias("width_e4"), micro(F.col("base_freq")).alias("freq_e4"))


TILTED = d.GRIDS.replace("grids AS", "raw AS") + """, ground AS (SELECT grid_id, r, c, z * 0.5::DOUBLE - r * 2 - c AS z, r IN (3, 4) AND c IN (2, 3) AS lake FROM raw),
grids AS (SELECT grid_id, r, c, z FROM ground WHERE NOT lake)"""


@query(ctes(TILTED, DROPS, """ranked AS (SELECT a.grid_id, a.r, a.c, b.r AS to_r, b.c AS to_c, sqrt(dr * dr + dc * dc) * 30 AS step, row_number() OVER (PARTITION BY a.grid_id, a.r, a.c ORDER BY (a.z - b.z) / sqrt(dr * dr + dc * dc) DESC, k) AS n
  FROM grids a, off JOIN grids b ON b.grid_id = a.grid_id AND b.r = a.r + dr AND b.c = a.c + dc WHERE b.z < a.z AND a.r BETWEEN 1 AND 6 AND a.c BETWEEN 1 AND 6)""",
    "shore AS (SELECT grid_id, r, c, z, row_number() OVER (PARTITION BY grid_id ORDER BY z, r, c) AS rank FROM grids WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 4)",
    """walk AS (SELECT grid_id, rank, r, c, 0.0::DOUBLE AS along FROM shore WHERE rank <= 8
  UNION ALL SELECT w.grid_id, w.rank, t.to_r, t.to_c, w.along + step FROM walk w JOIN ranked t ON n = 1 AND t.grid_id = w.grid_id AND t.r = w.r AND t.c = w.c WHERE w.along < 70)""",
    "ends AS (SELECT grid_id, rank, arg_max(r, along) AS end_r, arg_max(c, along) AS end_c, max(along) AS run FROM walk GROUP BY 1, 2)",
    """best AS (SELECT e.*, s.r, s.c, -8.0::DOUBLE - g.z AS fall, row_number() OVER (PARTITION BY e.grid_id ORDER BY -8.0::DOUBLE - g.z DESC, e.rank) AS k FROM ends e
  JOIN shore s USING (grid_id, rank) JOIN grids g ON g.grid_id = e.grid_id AND g.r = end_r AND g.c = end_c)""", recursive=True)
    + f"SELECT grid_id, r, c, end_r, end_c, {micro_sql('run')} AS run_e4, {micro_sql('fall')} AS drop_e4, fall > 2 AS surface_outlet, {micro_sql('CASE WHEN fall > 2 AND run > 0 THEN degrees(atan2(fall, run)) ELSE 0 END')} AS slope_e4 FROM best WHERE k = 1")
def spill_points(spark: SparkSession, sf: str) -> DataFrame:
    """The spill point of a lake on each tile, tilted so that it has no pits: of eight shore cells, after seventy metres."""
    cells = d.grids(spark, sf).withColumn("z", F.col("z") * 0.5 - F.col("r") * 2 - F.col("c"))
    level = cells.select("grid_id").distinct().withColumn("level", F.lit(-8.0))
    out = downstream.spill_points(spark, cells, cells.where("r in (3, 4) and c in (2, 3)"), level, 30.0, 8, 70.0)
    values = [micro(F.col(n)).alias(a) for n, a in (("run_m", "run_e4"), ("drop_m", "drop_e4"), ("slope_deg", "slope_e4"))]
    return out.select("grid_id", "r", "c", "end_r", "end_c", "surface_outlet", *values)


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as nodes, orders as closed ways, suppliers as relations of three ways, every fourth with a gap."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    kinds = "map<string,string>", f"array<{elements.POINT}>", f"array<struct<type:string,role:string,x:double,y:double,geometry:array<{elements.POINT}>>>"
    none = [F.lit(None).cast(k) for k in ("double", "double", kinds[1], kinds[2])]

    def rows(name: str, key: str, kind: str, tags: list, x=none[0], y=none[1], geometry=none[2], members=none[3]) -> DataFrame:
        made = [F.lit(kind).alias("type"), F.col(key).alias("id"), F.create_map(*tags).cast(kinds[0]).alias("tags")]
        return d.table(spark, sf, name).select(*made, x.cast("double").alias("x"), y.cast("double").alias("y"), geometry.cast(kinds[1]).alias("geometry"), members.cast(kinds[2]).alias("members"))

    k = F.col("c_custkey")
    nodes = rows("customer", "c_custkey", "node", [F.when(k % 5 != 0, "place").otherwise("shop"), F.lit("village")], F.when(k % 7 != 0, k % 100), k % 90)
    k = F.col("o_orderkey")
    corners = lambda k, w: [point(k % 50 + w * a, k % 40 + w * b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    loop = corners(k, k % 3 + 1)
    tags = [F.when(k % 2 == 0, "place").otherwise("highway"), F.when(k % 2 == 0, "hamlet").otherwise("primary"), F.lit("area"), F.when(k % 6 == 1, "yes").when(k % 6 == 2, "no").otherwise("maybe")]
    ways = rows("orders", "o_orderkey", "way", tags, geometry=F.array(*loop, loop[0]))
    k = F.col("s_suppkey")
    a, b, c, e = corners(k, F.lit(2))
    way = lambda role, *p: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), none[0].alias("x"), none[1].alias("y"), F.array(*p).alias("geometry"))
    last = F.when(k % 4 != 0, F.array(way("outer", a, e))).otherwise(F.array().cast(kinds[2]))
    members = F.concat(F.array(way("outer", a, b), way("", c, b), way("inner", a, c)).cast(kinds[2]), last.cast(kinds[2]), F.array(way("outer", c, e)).cast(kinds[2]))
    relations = rows("supplier", "s_suppkey", "relation", [F.lit("place"), F.lit("town")], members=members)
    return nodes.unionByName(ways).unionByName(relations)


@query("""SELECT 'node' AS osm_type, c_custkey AS osm_id, 'settlement' AS kind, 'village' AS subkind, 'point' AS shape, CAST(c_custkey % 100 * 10000 AS BIGINT) AS x_e4, CAST(c_custkey % 90 * 10000 AS BIGINT) AS y_e4, NULL::DOUBLE AS area
FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
UNION ALL SELECT 'way', k, CASE WHEN k % 2 = 0 THEN 'settlement' ELSE 'road' END, CASE WHEN k % 2 = 0 THEN 'hamlet' ELSE 'primary' END, CASE WHEN is_area THEN 'area' ELSE 'line' END, NULL, NULL, CASE WHEN is_area THEN CAST((k % 3 + 1) * (k % 3 + 1) AS DOUBLE) END
FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 6 <> 2 ELSE o_orderkey % 6 = 1 END AS is_area FROM orders)
UNION ALL SELECT 'relation', s_suppkey, 'settlement', 'town', CASE WHEN s_suppkey % 4 <> 0 THEN 'area' ELSE 'point' END, CASE WHEN s_suppkey % 4 = 0 THEN CAST(floor((s_suppkey % 50 + 4.0::DOUBLE / 3) * 10000 + 0.5) AS BIGINT) END,
  CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 40 + 1) * 10000 END, CASE WHEN s_suppkey % 4 <> 0 THEN 4.0::DOUBLE END FROM supplier""")
def element_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Assets of map elements, with the area of their rings or the place of their point."""
    out = elements.assets(_elements(spark, sf))
    turn = lambda ring: F.abs(F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda s, k: s + F.get(ring, k)["x"] * F.get(ring, k + 1)["y"] - F.get(ring, k + 1)["x"] * F.get(ring, k)["y"])) / 2
    area = F.when(F.col("rings").isNotNull(), F.aggregate("rings", F.lit(0.0), lambda s, ring: s + turn(ring)))
    place = [micro(F.col(f"point.{v}")).alias(f"{v}_e4") for v in ("x", "y")]
    return out.select("osm_type", "osm_id", "kind", "subkind", "shape", *place, area.alias("area"))


@query("""WITH l AS (SELECT c_custkey AS line_id, c_custkey * 37 % 400 / 100.0::DOUBLE + 75.001307 AS x, c_custkey * 91 % 300 / 100.0::DOUBLE + 30.001729 AS y, (c_custkey % 9 - 4) * 0.3::DOUBLE AS dx, (c_custkey % 7 - 3) * 0.4::DOUBLE AS dy FROM customer),
a AS (SELECT n_nationkey AS area_id, n_nationkey * 31 % 17 / 5.0::DOUBLE + 75.0537::DOUBLE AS x0, n_nationkey * 17 % 13 / 5.0::DOUBLE + 30.0537::DOUBLE AS y0, n_nationkey % 4 * 0.3::DOUBLE + 0.42::DOUBLE AS w FROM nation),
t AS (SELECT line_id, area_id, sqrt(dx * dx + dy * dy) AS length,
  CASE WHEN dx <> 0 THEN least((x0 - x) / dx, (x0 + w - x) / dx) WHEN x BETWEEN x0 AND x0 + w THEN 0 ELSE 2 END AS in_x, CASE WHEN dx <> 0 THEN greatest((x0 - x) / dx, (x0 + w - x) / dx) ELSE 1 END AS out_x,
  CASE WHEN dy <> 0 THEN least((y0 - y) / dy, (y0 + w - y) / dy) WHEN y BETWEEN y0 AND y0 + w THEN 0 ELSE 2 END AS in_y, CASE WHEN dy <> 0 THEN greatest((y0 - y) / dy, (y0 + w - y) / dy) ELSE 1 END AS out_y FROM l, a)
SELECT line_id, area_id, CAST(floor((least(1, out_x, out_y) - greatest(0, in_x, in_y)) * length * 10000 + 0.5) AS BIGINT) AS inside_e4 FROM t WHERE least(1, out_x, out_y) - greatest(0, in_x, in_y) > 1e-9 AND length > 0""")
def length_inside(spark: SparkSession, sf: str) -> DataFrame:
    """How far a customer's way leads through each nation it crosses."""
    k = F.col("a_id")
    start = _points(spark, sf, "customer", "c_custkey", "a_id").select("a_id", (F.col("lon") + 0.001307).alias("x"), (F.col("lat") + 0.001729).alias("y"))
    step = F.explode(F.array(F.lit(0), F.lit(1))).alias("seq")
    lines = start.select("*", step).select(k.alias("line_id"), "seq", (F.col("x") + F.col("seq") * ((k % 9 - 4) * 0.3)).alias("x"), (F.col("y") + F.col("seq") * ((k % 7 - 3) * 0.4)).alias("y"))
    out = outlines.length_inside(spark, lines, _areas(spark, sf).select("area_id", "ring"), 0.5)
    return out.where("inside > 1e-9").select("line_id", "area_id", micro(F.col("inside")).alias("inside_e4"))


SUBS = """w AS (SELECT n_nationkey AS win, 77 + n_nationkey % 5 * 0.05::DOUBLE AS lon, 32 + n_nationkey // 5 * 0.06::DOUBLE AS lat FROM nation),
q AS (SELECT win, k AS part, lon + (k % 2 * 2 - 1) * 5.0::DOUBLE / (111.0::DOUBLE * cos(radians(lat))) AS lon, lat + (k // 2 * 2 - 1) * 5.0::DOUBLE / 111.0::DOUBLE AS lat FROM w, (SELECT unnest(range(0, 4)) AS k)),
subs AS (SELECT *, win * 4 + part AS grid_id, lon - 5.0::DOUBLE / (111.0::DOUBLE * cos(radians(lat))) AS x0, lon + 5.0::DOUBLE / (111.0::DOUBLE * cos(radians(lat))) AS x1, lat - 5.0::DOUBLE / 111.0::DOUBLE AS y0, lat + 5.0::DOUBLE / 111.0::DOUBLE AS y1 FROM q)"""


def _sub_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty-five windows that overlap, by nation."""
    k = F.col("n_nationkey")
    windows = d.table(spark, sf, "nation").select(k.alias("window"), (77 + k % 5 * 0.05).alias("lon"), (32 + F.floor(k / 5) * 0.06).alias("lat"))
    return inventory.sub_windows(windows).withColumn("grid_id", F.col("window").cast("long") * 4 + F.col("part"))


@query(ctes(SUBS, """s AS (SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 17 AS cloud, 76.5 + o_orderkey % 11 * 0.08::DOUBLE AS x0, 31.5 + o_orderkey % 7 * 0.1::DOUBLE AS y0 FROM orders WHERE o_orderkey % 5 = 0)""",
    """r AS (SELECT win, part, scene_id, row_number() OVER (PARTITION BY win, part ORDER BY cloud, day DESC, scene_id) AS rank FROM subs a JOIN s ON s.x0 <= a.x0 AND s.y0 <= a.y0 AND s.x0 + 0.6::DOUBLE >= a.x1 AND s.y0 + 0.55::DOUBLE >= a.y1)""")
    + "SELECT win, part, scene_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4")
def window_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """The four clearest scenes that hold each sub-window."""
    k = F.col("o_orderkey")
    scenes = d.table(spark, sf, "orders").where(k % 5 == 0).select(
        k.alias("scene_id"), F.to_date("o_orderdate").alias("day"), (k % 17).alias("cloud"), (76.5 + k % 11 * 0.08).alias("x0"), (31.5 + k % 7 * 0.1).alias("y0")
    )
    scenes = scenes.withColumn("x1", F.col("x0") + 0.6).withColumn("y1", F.col("y0") + 0.55)
    return inventory.covering(_sub_windows(spark, sf), scenes).withColumnRenamed("window", "win")


@query(ctes(d.GRIDS, WET, SUBS, """reach AS (SELECT grid_id, r, c, r AS lr, c AS lc FROM wet WHERE grid_id < 100
  UNION SELECT w.grid_id, w.r, w.c, x.lr, x.lc FROM reach x JOIN wet w ON w.grid_id = x.grid_id AND abs(w.r - x.r) <= 1 AND abs(w.c - x.c) <= 1)""",
    "labels AS (SELECT grid_id, r, c, min(lr * 8 + lc) AS label FROM reach GROUP BY 1, 2, 3)",
    "parts AS (SELECT grid_id, label, count(*) * 1562500.0::DOUBLE AS area, avg(r) AS cr, avg(c) AS cc, quantile_cont(z, 0.5) AS h FROM labels JOIN grids USING (grid_id, r, c) GROUP BY 1, 2)",
    """lakes AS (SELECT row_number() OVER (ORDER BY area DESC, win, part, label) AS n, win, part, area, h, round(lon + ((cc + 0.5) * 1250 - 5000) / (111000.0::DOUBLE * cos(radians(lat))), 5) AS lon, round(lat - ((cr + 0.5) * 1250 - 5000) / 111000.0::DOUBLE, 5) AS lat
  FROM parts JOIN subs USING (grid_id) WHERE area >= 3000000 AND h >= 0.12)""",
    """greedy AS (SELECT 0 AS n, []::STRUCT(n BIGINT, lon DOUBLE, lat DOUBLE)[] AS kept
  UNION ALL SELECT l.n, CASE WHEN len(list_filter(kept, lambda k: 111.0::DOUBLE * sqrt(pow(k.lat - l.lat, 2) + pow((k.lon - l.lon) * cos(radians(l.lat)), 2)) <= 2.0)) = 0
    THEN list_append(kept, {'n': l.n, 'lon': l.lon, 'lat': l.lat}) ELSE kept END FROM greedy g JOIN lakes l ON l.n = g.n + 1)""",
    "kept AS (SELECT k.n FROM (SELECT unnest(kept) AS k FROM greedy WHERE n = (SELECT count(*) FROM lakes)))",
    "best AS (SELECT *, row_number() OVER (ORDER BY n) AS rank FROM lakes WHERE n IN (SELECT n FROM kept) ORDER BY n LIMIT 15)",
    """near AS (SELECT rank, c_custkey, 2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(32 + c_custkey * 91 % 300 / 1000.0::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(32 + c_custkey * 91 % 300 / 1000.0::DOUBLE)) * pow(sin(radians(77 + c_custkey * 37 % 400 / 1000.0::DOUBLE - lon) / 2), 2)))) AS km FROM best, customer)""", recursive=True)
    + f"""SELECT CAST(b.rank AS INT) AS rank, win, part, lon, lat, area AS area_m2, {micro_sql("h")} AS height_e4, n.c_custkey AS near, {micro_sql("n.km")} AS near_e4
FROM best b JOIN (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY km, c_custkey) AS k FROM near) n ON n.rank = b.rank AND k = 1""")
def discover_lakes(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen largest lakes of all windows, 1,250 m a cell, one row a lake, with the nearest customer."""
    subs = _sub_windows(spark, sf)
    cells = d.grids(spark, sf).join(subs.select("grid_id"), "grid_id", "left_semi")
    k = F.col("c_custkey")
    named = d.table(spark, sf, "customer").select(k.alias("b_id"), (77 + k * 37 % 400 / 1000.0).alias("lon"), (32 + k * 91 % 300 / 1000.0).alias("lat"))
    out = inventory.discover(spark, subs, cells.where("z > 0.1").select("grid_id", "r", "c"), cells, named, 1250.0, 8, 3_000_000.0, 0.12, 2.0)
    return out.select("rank", F.col("window").alias("win"), "part", "lon", "lat", "area_m2", micro(F.col("height_m")).alias("height_e4"), "near", micro(F.col("near_km")).alias("near_e4"))


@query(ctes(d.GRIDS, """sun AS (SELECT *, radians(grid_id * 37 % 360 + 0.3::DOUBLE) AS az, tan(radians(greatest(1.0, grid_id % 40 - 3.0::DOUBLE))) AS t FROM grids)""",
    "u AS (SELECT *, sin(az) AS e, -cos(az) AS s FROM sun)", "v AS (SELECT *, abs(e) >= abs(s) AS flat, CASE WHEN abs(e) >= abs(s) THEN s / e ELSE e / s END AS lean FROM u)",
    """w AS (SELECT *, CASE WHEN flat THEN c ELSE r END AS long, CASE WHEN flat THEN r - round_even(c * lean, 0) ELSE c - round_even(r * lean, 0) END AS line, CASE WHEN CASE WHEN flat THEN e ELSE s END >= 0 THEN 1 ELSE -1 END AS toward FROM v)""")
    + """SELECT a.grid_id, a.r, a.c, coalesce(bool_or(b.z > a.z + abs(b.long - a.long) * sqrt(1 + a.lean * a.lean) * 0.1::DOUBLE * a.t), false) AS shadow
FROM w a LEFT JOIN w b ON a.grid_id = b.grid_id AND a.line = b.line AND (b.long - a.long) * a.toward > 0 GROUP BY 1, 2, 3""")
def sun_shadow(spark: SparkSession, sf: str) -> DataFrame:
    """Shadows at a bearing and height of its own for each tile."""
    k = F.col("grid_id")
    return raster.horizon_shadow(d.grids(spark, sf), k * 37 % 360 + 0.3, k % 40 - 3.0, 0.1)
