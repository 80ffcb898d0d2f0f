"""Messages, served documents and the smaller rules over the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import display, messages, rules, text
from moraine.operators import admin, alerts, drain, exposure, places, raster, records, weather
from moraine.plans import domain as d
from moraine.plans.domain import micro, micro_sql
from moraine.plans.terrain import WET, _areas, _points, _wet, ctes
from moraine.sources import readers, sinks
from moraine.sources.workspace import workspace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'en' ELSE 'fr' END AS lang, c_name || CASE c_custkey % 4 WHEN 0 THEN ' Lake' WHEN 1 THEN ' झील' ELSE '' END AS name,
  CASE WHEN c_custkey % 5 <> 0 THEN 'Village ' || c_nationkey END AS place, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 90 AS VARCHAR) END AS m FROM customer),
l AS (SELECT *, CASE WHEN lang = 'hi' THEN CASE WHEN ends_with(name, 'झील') THEN name ELSE name || ' झील' END WHEN ends_with(lower(name), 'lake') THEN name ELSE name || ' lake' END AS lake FROM r)
SELECT id, CASE WHEN lang = 'en' THEN 'WARNING: Flood danger from ' || lake || '. Water may reach your village' || coalesce(' ' || place, '') || ' ' || coalesce('in about ' || m || ' minutes', 'soon') || '. Move to high ground immediately.'
  ELSE 'चेतावनी: ' || lake || ' से बाढ़ का खतरा। आपके गाँव' || coalesce(' ' || place, '') || ' तक पानी ' || coalesce('लगभग ' || m || ' मिनट में', 'जल्द') || ' पहुँच सकता है। तुरंत ऊँचे स्थान पर जाएँ।' END AS message,
  CASE WHEN lang = 'en' THEN 'FLOOD WARNING: water may reach ' || coalesce(place, '') || ' in ~' || coalesce(m, '') || ' min. Go to high ground now.' ELSE 'बाढ़ चेतावनी: ' || coalesce(place, '') || ' में ~' || coalesce(m, '') || ' मिनट में पानी। ऊँचे स्थान पर जाएँ' END AS short,
  CASE WHEN lang = 'en' THEN 'Moraine: flood warning' ELSE 'Moraine: बाढ़ चेतावनी' END AS title FROM l""")
def warning_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Long, short and title of a warning to each customer, in two languages, a third one getting the first."""
    k = F.col("c_custkey")
    lang = F.when(k % 3 == 0, "hi").when(k % 3 == 1, "en").otherwise("fr")
    name = F.concat("c_name", F.when(k % 4 == 0, " Lake").when(k % 4 == 1, " झील").otherwise(""))
    place = F.when(k % 5 != 0, F.concat(F.lit("Village "), F.col("c_nationkey").cast("string")))
    minutes = F.when(k % 7 != 0, (k % 90).cast("string"))
    return d.table(spark, sf, "customer").select(
        k.alias("id"), messages.warning(lang, messages.lake_label(lang, name), place, minutes).alias("message"),
        messages.short_warning(lang, place, minutes).alias("short"), messages.title(lang, F.lit("Moraine")).alias("title"),
    )


@query("""WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'hi' ELSE 'en' END AS lang, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE '' END AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'हि ' || s_suppkey END AS name_hi,
  CASE WHEN s_suppkey % 12 <> 0 THEN 'node/' || s_suppkey END AS osm, CASE WHEN s_suppkey % 5 <> 0 THEN 'Kullu' END AS district, CASE s_suppkey % 7 WHEN 0 THEN ' Himachal Pradesh' WHEN 1 THEN 'Punjab' END AS state FROM supplier),
f AS (SELECT *, nullif(CASE WHEN lang = 'hi' THEN name_hi ELSE name END, '') AS a, nullif(CASE WHEN lang = 'hi' THEN name ELSE name_hi END, '') AS b FROM p)
SELECT id, coalesce(a, b, osm, '—') AS shown, CASE WHEN b <> coalesce(a, b, osm, '—') THEN b END AS other,
  nullif(concat_ws(', ', district || ' district', CASE WHEN lower(trim(state)) <> 'himachal pradesh' THEN state END), '') AS line FROM f""")
def place_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The shown and the other name of a place, and where it is."""
    k = F.col("s_suppkey")
    lang, osm = F.when(k % 2 == 0, "hi").otherwise("en"), F.when(k % 12 != 0, F.concat(F.lit("node/"), k.cast("string")))
    name, hindi = F.when(k % 3 != 0, F.col("s_name")).otherwise(""), F.when(k % 4 != 0, F.concat(F.lit("हि "), k.cast("string")))
    district, state = F.when(k % 5 != 0, "Kullu"), F.when(k % 7 == 0, " Himachal Pradesh").when(k % 7 == 1, "Punjab")
    return d.table(spark, sf, "supplier").select(
        k.alias("id"), messages.shown_name(lang, name, hindi, osm).alias("shown"), messages.other_name(lang, name, hindi, osm).alias("other"), messages.admin_line(district, state).alias("line")
    )


@query("""SELECT p_partkey AS id, substr(sha1(p_name || p_partkey), 1, 16) AS key, '0 at 1,000 m² rising (log scale) to 1 at 1,000,000 m²' AS area_rule, '0 at 0.5 % rising linearly to 1 at 12 %' AS growth_rule FROM part""")
def request_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A key for each request, and two score rules in words."""
    k = F.col("p_partkey")
    rules_ = [F.lit(messages.rule_text(*r)).alias(n) for n, r in (("area_rule", (3, 6, True, "m²")), ("growth_rule", (0.5, 12.0, False, "%")))]
    return d.table(spark, sf, "part").select(k.alias("id"), messages.request_key(F.concat("p_name", k.cast("string"))).alias("key"), *rules_)


@query("""SELECT s_suppkey AS lake_id, s_name AS name, r.level, r.score, w.path_km, w.lake_id IS NOT NULL AS has_way FROM supplier
LEFT JOIN (SELECT l_suppkey AS lake_id, max(l_quantity) AS score, 'level ' || count(*) AS level FROM lineitem GROUP BY 1 HAVING count(*) % 3 <> 0) r ON r.lake_id = s_suppkey
LEFT JOIN (SELECT s_suppkey AS lake_id, s_nationkey * 1.5::DOUBLE AS path_km FROM supplier WHERE s_suppkey % 4 <> 0) w ON w.lake_id = s_suppkey""")
def lake_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One document a lake, in English: no field whose name ends in _hi, no stations."""
    k = F.col("s_suppkey")
    lakes = d.table(spark, sf, "supplier").select(k.alias("lake_id"), F.col("s_name").alias("name"), F.concat(F.lit("हि "), "s_name").alias("name_hi"))
    level = F.struct(F.concat(F.lit("level "), F.count("*").cast("string")).alias("level"), F.lit("स्तर").alias("level_hi"), F.max("l_quantity").alias("score")).alias("latest")
    risk = d.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("lake_id")).agg(level, F.count("*").alias("n")).where("n % 3 <> 0").drop("n")
    way = d.table(spark, sf, "supplier").where(k % 4 != 0).select(k.alias("lake_id"), (F.col("s_nationkey") * 1.5).alias("path_km"), F.array(F.lit(1)).alias("scenarios"))
    out = records.without(records.lake_document(lakes, risk, way))
    return out.select("lake_id", "lake.name", "risk.level", "risk.score", "downstream.path_km", F.col("downstream").isNotNull().alias("has_way"))


@query("""SELECT s_suppkey AS lake_id, n AS days, hottest FROM supplier LEFT JOIN (SELECT user_id AS lake_id, count(*) AS n, max(CAST(round(value * 100) AS BIGINT)) AS hottest FROM events GROUP BY 1) ON lake_id = s_suppkey""")
def lake_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Every lake with its outlook, missing ones kept."""
    outlook = d.table(spark, sf, "events").groupBy(F.col("user_id").alias("lake_id")).agg(F.count("*").alias("days"), F.max(d.cents("value")).alias("hottest"))
    return records.lake_weather(d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lake_id")), outlook)


@query("""WITH a AS (SELECT o_orderkey AS job_id, 32 + o_custkey % 10 * 0.001::DOUBLE AS lat, 77 + o_custkey % 7 * 0.002::DOUBLE AS lon FROM orders), f AS (SELECT l_orderkey AS job_id, l_partkey * 10 + l_linenumber AS water_id, 32 + l_partkey % 23 * 0.0013::DOUBLE AS lat, 77 + l_suppkey % 19 * 0.0017::DOUBLE AS lon FROM lineitem),
m AS (SELECT a.job_id, water_id, CAST(floor(sqrt(pow((f.lat - a.lat) * 111320, 2) + pow((f.lon - a.lon) * 111320 * cos(radians(a.lat)), 2)) + 0.5) AS BIGINT) AS distance_m FROM a JOIN f ON a.job_id = f.job_id),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY distance_m, water_id) AS k FROM m)
SELECT a.job_id, water_id, distance_m FROM a LEFT JOIN r ON r.job_id = a.job_id AND k = 1""")
def snapped_water(spark: SparkSession, sf: str) -> DataFrame:
    """Each asked place with the nearest water body that its search found."""
    asked = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), (32 + F.col("o_custkey") % 10 * 0.001).alias("lat"), (77 + F.col("o_custkey") % 7 * 0.002).alias("lon"))
    found = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("water_id"), (32 + F.col("l_partkey") % 23 * 0.0013).alias("lat"), (77 + F.col("l_suppkey") % 19 * 0.0017).alias("lon")
    )
    return records.snapped(asked, found)


@query("""WITH b AS (SELECT 'customers' AS layer, c_custkey AS id, c_custkey % 50 AS x, c_custkey % 40 AS y FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_suppkey % 50, s_suppkey % 40 FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY id) AS k FROM b WHERE x <= 30 AND x + 2 >= 10 AND y <= 25 AND y + 1 >= 5)
SELECT layer, id FROM r WHERE k <= 40""")
def layer_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of two layers in a box, the first of each."""
    box = lambda k: F.struct((k % 50).cast("double").alias("x0"), (k % 40).cast("double").alias("y0"), (k % 50 + 2).cast("double").alias("x1"), (k % 40 + 1).cast("double").alias("y1")).alias("bbox")
    parts = [(n, d.table(spark, sf, t).select(F.col(k).alias("id"), box(F.col(k)))) for n, t, k in (("customers", "customer", "c_custkey"), ("suppliers", "supplier", "s_suppkey"))]
    return records.layers(parts, (10.0, 5.0, 30.0, 25.0), 40).select("layer", "id")


@query("""WITH r AS (SELECT l_suppkey AS lake_id, CAST(year(l_shipdate) AS INT) AS season, CAST(year(l_shipdate) - l_suppkey % 3 AS INT) AS area_year FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT l_suppkey AS lake_id, CAST(year(l_shipdate) AS INT) AS area_year, count(*) AS slope FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT lake_id, season, area_year, slope FROM r LEFT JOIN t USING (lake_id, area_year)""")
def terrain_of_year(spark: SparkSession, sf: str) -> DataFrame:
    """Each season's risk with the terrain of the outline that its area comes from."""
    items = d.table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate")).withColumnRenamed("l_suppkey", "lake_id")
    risk = items.select("lake_id", F.col("year").alias("season"), (F.col("year") - F.col("lake_id") % 3).cast("int").alias("area_year")).distinct()
    terrain = items.where("l_returnflag = 'R'").groupBy("lake_id", "year").agg(F.count("*").alias("slope"))
    return records.terrain_of_year(risk, terrain).select("lake_id", "season", "area_year", "slope")


@query(ctes(d.GRIDS, WET) + """SELECT grid_id, r * 3 + i AS r, c * 3 + j AS c FROM wet, (SELECT CAST(unnest(range(0, 3)) AS INT) AS i), (SELECT CAST(unnest(range(0, 3)) AS INT) AS j)""")
def refined_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Each tile's water on a grid three times as fine."""
    return raster.refined(_wet(spark, sf), 3)


@query(ctes(d.GRIDS) + f"SELECT grid_id, {micro_sql('max(z) - min(z)')} AS relief_e4 FROM grids GROUP BY 1")
def tile_relief(spark: SparkSession, sf: str) -> DataFrame:
    return raster.relief(d.grids(spark, sf)).select("grid_id", micro(F.col("relief_m")).alias("relief_e4"))


@query(ctes(d.GRIDS, WET, "near AS (SELECT DISTINCT g.* FROM grids g JOIN wet w ON g.grid_id = w.grid_id AND abs(g.r - w.r) + abs(g.c - w.c) <= 2)")
    + f"SELECT grid_id, {micro_sql('count(*) FILTER ((r * 3 + c) % 5 >= 2) / CAST(count(*) AS DOUBLE)')} AS coverage_e4 FROM near GROUP BY 1")
def rim_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each tile's water and its rim was seen twice."""
    cells = d.grids(spark, sf)
    return raster.rim_coverage(_wet(spark, sf), cells.withColumn("n", (F.col("r") * 3 + F.col("c")) % 5), 2).select("grid_id", micro(F.col("coverage")).alias("coverage_e4"))


@query(f"""SELECT l_orderkey AS id, l_linenumber AS line, {micro_sql("CASE WHEN g + s <> 0 THEN (g - s) / (g + s) END")} AS index_e4 FROM (
  SELECT l_orderkey, l_linenumber, l_partkey % 9 * 0.5::DOUBLE - 1.0::DOUBLE AS g, l_suppkey % 7 * 0.5::DOUBLE - 1.0::DOUBLE AS s FROM lineitem)""")
def snow_water_index(spark: SparkSession, sf: str) -> DataFrame:
    """The short-wave water index of scaled bands; a zero sum is unknown."""
    green, swir = (rules.reflectance(F.col(c) % m, F.lit(0.5), F.lit(-1.0)) for c, m in (("l_partkey", 9), ("l_suppkey", 7)))
    return d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), micro(rules.mndwi(green, swir)).alias("index_e4"))


@query("""WITH imp AS (SELECT o_custkey AS osm, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0 GROUP BY 1),
idx AS (SELECT c_custkey AS osm, c_name AS name, 'D' || c_nationkey AS district, ['city', 'town', 'suburb', 'village', 'hamlet', 'farm'][c_custkey % 6 + 1] AS place FROM customer WHERE c_custkey % 5 <> 0)
SELECT i.osm AS place_id, 'Seen ' || first AS name, district, CASE WHEN idx.osm IS NULL THEN 5 ELSE i.osm % 6 END AS size, true AS covered FROM imp i LEFT JOIN idx ON idx.osm = i.osm
UNION ALL SELECT osm, name, district, osm % 6, false FROM idx WHERE osm NOT IN (SELECT osm FROM imp)""")
def search_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Places that can be found: those of the analyses, and the rest of the index."""
    o, k = d.table(spark, sf, "orders"), F.col("c_custkey")
    impacts = o.where("o_custkey % 4 <> 0").select(
        F.col("o_custkey").alias("osm"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 != 0, "settlement").otherwise("school").alias("kind"),
        F.concat(F.lit("Seen "), F.col("o_orderkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("name_hi"),
    )
    kinds = F.array(*map(F.lit, ("city", "town", "suburb", "village", "hamlet", "farm")))
    index = d.table(spark, sf, "customer").where(k % 5 != 0).select(
        k.alias("osm"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("name_hi"), F.concat(F.lit("D"), F.col("c_nationkey").cast("string")).alias("district"), F.lit(None).cast("string").alias("state"), F.get(kinds, (k % 6).cast("int")).alias("place")
    )
    return places.universe(impacts, index).select("place_id", "name", "district", "size", "covered")


@query("""SELECT l_suppkey AS lake_id, l_orderkey AS osm, l_linenumber AS line, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END NULLS LAST, l_orderkey * 10 + l_linenumber) AS INT) AS rank FROM lineitem""")
def impacts_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """A lake's impacts in the order in which its flood arrives."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = d.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("lake_id"), k.alias("osm"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("km"))
    return records.by_arrival(rows).select("lake_id", F.floor(F.col("osm") / 10).cast("long").alias("osm"), "line", "rank")


@query("""SELECT p_size AS district, p_partkey AS osm, CAST(row_number() OVER (PARTITION BY p_size ORDER BY lower(p_name), p_partkey) AS INT) AS rank FROM part""")
def places_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """A district's places by name."""
    rows = d.table(spark, sf, "part").select(F.col("p_size").alias("district"), F.col("p_partkey").alias("osm"), F.col("p_name").alias("name"))
    return records.by_name(rows).select("district", "osm", "rank")


CATALOGUE = """cat AS (SELECT 'S' || o_orderkey AS item_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 100 END AS cloud, o_orderkey % 40 AS x, o_orderkey % 30 AS y, o_orderkey AS k FROM orders),
filled AS (SELECT *, coalesce(cloud, 100.0::DOUBLE) AS c, CASE WHEN k % 3 = 0 THEN 0.0001::DOUBLE ELSE 0.0002::DOUBLE END AS scale, CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE -0.1::DOUBLE END AS offset_ FROM cat)"""


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue of scenes, written as one is and read with its defaults."""
    k = F.col("o_orderkey")
    written = d.table(spark, sf, "orders").select(
        F.concat(F.lit("S"), k.cast("string")).alias("item_id"), F.to_date("o_orderdate").alias("day"), F.when(k % 9 != 0, (k % 100).cast("double")).alias("cloud"),
        F.lit(None).cast("string").alias("baseline"), F.lit(None).cast("double").alias("azimuth"), F.lit(30.0).alias("elevation"), F.when(k % 4 == 0, True).alias("boa_offset_applied"),
        F.create_map(F.lit("green"), F.lit("g.tif"), F.lit("scl"), F.lit("s.tif")).alias("hrefs"), F.when(k % 3 != 0, F.create_map(F.lit("green"), F.lit(2e-4))).alias("scale"),
        F.create_map(F.lit("green"), F.lit(-0.1)).alias("offset"),
        F.struct((k % 40).cast("double").alias("x0"), (k % 30).cast("double").alias("y0"), (k % 40 + 3).cast("double").alias("x1"), (k % 30 + 2).cast("double").alias("y1")).alias("bbox"),
    )
    path = workspace(spark, "catalogue")
    written.write.parquet(path)
    return readers.scenes(spark, path)


@query(f"""WITH {CATALOGUE} SELECT item_id, day, c AS cloud, '00.00' AS baseline, 160.0::DOUBLE AS azimuth, 30.0::DOUBLE AS elevation, scale, offset_ AS offset_value FROM filled
WHERE x <= 20 AND x + 3 >= 12 AND y <= 18 AND y + 2 >= 10 AND day BETWEEN DATE '1995-01-01' AND DATE '1997-06-30' AND c < 70 ORDER BY day, item_id LIMIT 2000""")
def scene_search(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of a catalogue that meet a box in a season, with their defaults filled in."""
    found = readers.search_scenes(_catalogue(spark, sf), (12.0, 10.0, 20.0, 18.0), "1995-01-01", "1997-06-30", 70.0)
    return found.select("item_id", "day", "cloud", "baseline", "azimuth", "elevation", F.col("scale")["green"].alias("scale"), F.col("offset")["green"].alias("offset_value"))


@query(f"""WITH {CATALOGUE}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY c, item_id) AS n FROM filled WHERE x <= 20 AND x + 3 >= 12 AND y <= 18 AND y + 2 >= 10 AND c < 80)
SELECT day, item_id FROM r WHERE n = 1""")
def scene_of_each_day(spark: SparkSession, sf: str) -> DataFrame:
    """The clearest scene of each day that meets a box."""
    hit = _catalogue(spark, sf).where(readers.overlaps(F.col("bbox"), (12.0, 10.0, 20.0, 18.0)) & (F.col("cloud") < readers.MAX_CLOUD))
    return hit.groupBy("day").agg(F.min(F.struct("cloud", "item_id"))["item_id"].alias("item_id"))


@query("""WITH e AS (SELECT user_id AS lake_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, CAST(round(value * 100) AS BIGINT) AS v FROM events)
SELECT lake_id, 'day ' || event_id AS date, CASE WHEN pos < n - 2 THEN v END AS rain, v * 2 AS warm, pos >= 3 AS forecast FROM e""")
def weather_days(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays of an outlook as days; the rain of the last two is missing."""
    rows = d.table(spark, sf, "events").groupBy(F.col("user_id").alias("lake_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", d.cents("value").alias("v")))).alias("r"))
    every = F.transform("r", lambda x: x["v"])
    reports = rows.select(
        "lake_id", F.transform("r", lambda x: F.concat(F.lit("day "), x["event_id"].cast("string"))).alias("time"),
        F.slice(every, F.lit(1), F.greatest(F.size("r") - 2, F.lit(0))).alias("precipitation_mm"), F.transform("r", lambda x: x["v"] * 2).alias("tmax_c"),
    )
    return weather.zip_days(reports).select("lake_id", "date", F.col("precipitation_mm").alias("rain"), F.col("tmax_c").alias("warm"), "forecast")


@query("""WITH s AS (SELECT l_orderkey AS asset_id, l_linenumber AS point, CASE l_orderkey % 3 WHEN 0 THEN 'road' ELSE 'school' END AS kind, CASE WHEN l_partkey % 13 <> 0 THEN round_even(l_partkey % 40 - 12.0::DOUBLE - l_quantity % 5 * 0.7::DOUBLE, 1) END AS h, l_suppkey % 3 = 0 AS reached, l_suppkey % 2 = 0 AS near FROM lineitem),
a AS (SELECT asset_id, kind, min(h) FILTER (reached) AS in_reach, min(h) AS lowest, bool_or(near) AS near FROM s GROUP BY 1, 2),
t AS (SELECT *, coalesce(in_reach, lowest) AS raw, CASE WHEN in_reach < 0 THEN 'flooded' WHEN kind <> 'road' AND near AND coalesce(in_reach, lowest) <= 10 THEN 'margin' ELSE 'outside' END AS status FROM a)
SELECT asset_id, kind, status, CASE WHEN raw < 0 AND status <> 'flooded' THEN NULL ELSE raw END AS height_m FROM t""")
def assessed_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Status and height of each asset above a flood whose level falls by the kilometre."""
    k = F.col("l_partkey")
    ground = F.when(k % 13 != 0, k % 40 - F.lit(12.0) - F.col("l_quantity") % 5 * 0.7 + (100 - F.col("l_linenumber")))
    samples = d.table(spark, sf, "lineitem").select(
        F.lit(1).alias("path_id"), F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("point"), F.when(F.col("l_orderkey") % 3 == 0, "road").otherwise("school").alias("kind"),
        F.col("l_linenumber").cast("double").alias("km"), ground.alias("ground_m"), (F.col("l_suppkey") % 3 == 0).alias("reached"), (F.col("l_suppkey") % 2 == 0).alias("near"),
    )
    stations = spark.range(0, 5).select(F.lit(1).alias("path_id"), (F.col("id") * 2.0).alias("km"), (100 - F.col("id") * 2.0).alias("wse_m"))
    return exposure.assess(samples, stations).select("asset_id", "kind", "status", "height_m")


LETTERS, DEVANAGARI = "abcdefghijklmnopqrstuvwxyz", "कखगघङचछजझञटठडढणतथदधनपफबभमय"


@query(f"""WITH p AS (SELECT p_partkey AS id, translate(p_name, '{LETTERS}', '{DEVANAGARI}') || CASE p_partkey % 3 WHEN 0 THEN ' lake' WHEN 1 THEN 'ँ' ELSE '' END AS name FROM part),
m AS (SELECT MAP {{{", ".join(f"'{a}': '{b}'" for a, b in text.LATIN.items())}}} AS letters)
SELECT id, regexp_replace(replace(name, 'ँ', 'ं'), '[^ऀ-ॿ]', '', 'g') AS hindi, array_to_string(list_transform(string_split(name, ''), lambda x: coalesce(letters[x], '')), '') AS latin FROM p, m""")
def hindi_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of names in Devanagari, and the names in rough Latin."""
    k = F.col("p_partkey")
    name = F.concat(F.translate("p_name", LETTERS, DEVANAGARI), F.when(k % 3 == 0, " lake").when(k % 3 == 1, "ँ").otherwise(""))
    return d.table(spark, sf, "part").select(k.alias("id"), text.hindi_key(name).alias("hindi"), text.transliterate(name).alias("latin"))


@query("""WITH f AS (SELECT s_suppkey AS id, '{"type":"Feature","properties":{"name":"' || s_name || '"},"geometry":{"type":"Point","coordinates":[' || s_suppkey || ',' || s_nationkey || ']}}' AS feature FROM supplier) SELECT * FROM f""")
def point_features(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as GeoJSON points."""
    at = F.array(F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long"))
    return d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), sinks.feature("Point", at, name=F.col("s_name")).alias("feature"))


@query("""SELECT c_custkey % 20 AS reach, 'day ' || lpad(CAST(max(c_custkey % 9) AS VARCHAR), 2, '0') AS as_of, max(c_custkey % 9) AS n FROM customer GROUP BY 1""")
def latest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The newest day of a dated history, one day of it written twice."""
    k = F.col("c_custkey")
    rows = d.table(spark, sf, "customer").select((k % 20).alias("reach"), F.concat(F.lit("day "), F.lpad((k % 9).cast("string"), 2, "0")).alias("as_of"), (k % 9).alias("n")).distinct()
    path = workspace(spark, "scans")
    sinks.append_dated(rows, path)
    sinks.append_dated(rows.where("n = 3"), path)
    return sinks.latest(spark, path, "reach").select("reach", F.col("as_of").cast("string").alias("as_of"), "n")


AREAS = """n AS (SELECT n_nationkey AS area_id, CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 5 END AS level, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'tag ' || n_regionkey END AS state, n_nationkey * 31 % 17 / 5.0::DOUBLE + 75.0537::DOUBLE AS x0, n_nationkey * 17 % 13 / 5.0::DOUBLE + 30.0537::DOUBLE AS y0, n_nationkey % 4 * 0.3::DOUBLE + 0.42::DOUBLE AS w FROM nation),
p AS (SELECT c_custkey AS id, c_custkey * 37 % 400 / 100.0::DOUBLE + 75 AS x, c_custkey * 91 % 300 / 100.0::DOUBLE + 30 AS y FROM customer)"""


@query(f"""WITH {AREAS}, m AS (SELECT p.id, level, name, state, row_number() OVER (PARTITION BY p.id, level ORDER BY w, area_id) AS k FROM p JOIN n ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + w)
SELECT p.id AS point_id, a.name AS district, coalesce(b.name, a.state) AS state FROM p LEFT JOIN m a ON a.id = p.id AND a.level = 5 AND a.k = 1 LEFT JOIN m b ON b.id = p.id AND b.level = 4 AND b.k = 1""")
def place_districts(spark: SparkSession, sf: str) -> DataFrame:
    """The district and state of each customer; outside all states the district's own."""
    k = F.col("n_nationkey")
    tags = d.table(spark, sf, "nation").select(k.alias("area_id"), F.when(k % 3 == 0, admin.STATE).otherwise(admin.DISTRICT).alias("level"), F.col("n_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("tag "), F.col("n_regionkey").cast("string"))).alias("state"))
    points = _points(spark, sf, "customer", "c_custkey", "point_id").select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return admin.assign(points, _areas(spark, sf).join(tags, "area_id"))


@query(f"""WITH {AREAS}, d AS (SELECT *, x0 + w / 2 AS x, y0 + w / 2 AS y FROM n WHERE level = 5), s AS (SELECT * FROM n WHERE level = 4),
m AS (SELECT d.area_id, s.name, row_number() OVER (PARTITION BY d.area_id ORDER BY s.w, s.area_id) AS k FROM d JOIN s ON d.x > s.x0 AND d.x < s.x0 + s.w AND d.y > s.y0 AND d.y < s.y0 + s.w),
l AS (SELECT area_id + 1 AS area_id, name FROM s WHERE area_id % 2 = 0)
SELECT d.area_id, coalesce(m.name, l.name, d.state) AS state FROM d LEFT JOIN m ON m.area_id = d.area_id AND k = 1 LEFT JOIN l ON l.area_id = d.area_id""")
def district_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each district's state: around it, else by the state's members, else by its tag."""
    k = F.col("n_nationkey")
    rows = d.table(spark, sf, "nation").select(
        k.alias("area_id"), F.when(k % 3 == 0, admin.STATE).otherwise(admin.DISTRICT).alias("level"), F.col("n_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("tag "), F.col("n_regionkey").cast("string"))).alias("is_in"),
        F.when(k % 2 == 0, F.array(F.struct(F.lit("relation").alias("type"), F.lit("subarea").alias("role"), (k + 1).alias("ref")), F.struct(F.lit("way").alias("type"), F.lit("outer").alias("role"), k.alias("ref")))).alias("members"),
    )
    areas = _areas(spark, sf).join(rows, "area_id")
    inside = areas.where(F.col("level") == admin.DISTRICT).select("area_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "is_in")
    states = areas.where(F.col("level") == admin.STATE).select("area_id", "name", "ring", "size", "x0", "y0", "x1", "y1")
    return admin.district_states(inside, states, admin.subareas(rows)).select("area_id", "state")


@query("""WITH v AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_partkey % 9 <> 0 THEN l_suppkey * 137.0::DOUBLE END AS a, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey * 9917.0::DOUBLE END AS b, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity * 29 + 0.5::DOUBLE END AS f, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity * 29 + l_linenumber // 2 + 0.75::DOUBLE END AS e FROM lineitem)
SELECT id, line, coalesce(CASE WHEN a > 0 AND a < 500 THEN '<0.001 km²' ELSE format('{:,.3f} km²', a / 1000000) END, '—') AS area, coalesce(CASE WHEN b >= 1000000 THEN format('{:,.2f} million m³', b / 1000000) ELSE format('{:,.0f} m³', b) END, '—') AS volume,
  coalesce(format('{:,.0f} m³/s', a), '—') AS discharge, CASE WHEN f IS NULL AND e IS NULL THEN '—' WHEN floor(f) = floor(e) THEN '~' || format('{:,.0f}', floor(f)) || ' min' ELSE '~' || coalesce(format('{:,.0f}', floor(f)), '—') || '–' || coalesce(format('{:,.0f}', floor(e)), '—') || ' min' END AS arrival,
  CASE line % 4 WHEN 0 THEN 'Evans 1986' WHEN 1 THEN 'Costa 1988' WHEN 2 THEN 'other' END AS relation FROM v""")
def shown_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Areas, volumes, discharges and arrivals as they are shown."""
    p, line = F.col("l_partkey"), F.col("l_linenumber")
    a, b = F.when(p % 9 != 0, F.col("l_suppkey") * 137.0), F.when(p % 7 != 0, p * 9917.0)
    fast, late = F.when(p % 5 != 0, F.col("l_quantity") * 29 + 0.5), F.when(p % 4 != 0, F.col("l_quantity") * 29 + F.floor(line / 2) + 0.75)
    relation = F.when(line % 4 == 0, "evans1986: Q = 0.72 V^0.53").when(line % 4 == 1, "costa1988").when(line % 4 == 2, "other").otherwise("")
    return d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), line.alias("line"), display.square_km(a).alias("area"), display.volume(b).alias("volume"), display.discharge(a).alias("discharge"),
        display.arrival(fast, late).alias("arrival"), display.relation_name(relation).alias("relation"),
    )


@query("""SELECT event_id AS trigger_id, 'severe' AS scenario, 'sensor' AS source, 'sensor ' || user_id || ' reported ' || CASE event_type WHEN 'error' THEN 'flow_surge' WHEN 'click' THEN 'manual' ELSE 'other' END AS note,
  CASE WHEN event_id % 11 = 0 THEN 'ids' WHEN event_type NOT IN ('error', 'click') THEN 'kind' END AS refused FROM events""")
def sensor_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Readings as requests for a warning, and why some are refused."""
    kind = F.when(F.col("event_type") == "error", "flow_surge").when(F.col("event_type") == "click", "manual").otherwise("other")
    readings = d.table(spark, sf, "events").select(F.col("event_id").alias("trigger_id"), F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("lake_id"), F.col("user_id").alias("sensor_id"), kind.alias("kind"))
    return alerts.sensor_triggers(readings).select("trigger_id", "scenario", "source", "note", "refused")


@query("WITH " + d.LAKE_YEARS + """, q AS (SELECT DISTINCT lake_id, 1996 + lake_id % 6 AS as_of_year FROM lake_years)
SELECT q.lake_id, q.as_of_year, y.year, y.area_m2 FROM q JOIN lake_years y ON y.lake_id = q.lake_id WHERE y.status = 'ok' AND y.year <= q.as_of_year AND (y.lake_id + y.year) % 4 > 0
QUALIFY row_number() OVER (PARTITION BY q.lake_id, q.as_of_year ORDER BY y.year DESC) = 1""")
def drawn_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The last full season with an outline that is not empty."""
    years = d.lake_years(spark, sf)
    asked = years.select("lake_id", (F.col("lake_id") % 6 + 1996).alias("as_of_year")).distinct()
    outlines = years.select("lake_id", "year", ((F.col("lake_id") + F.col("year")) % 4).alias("cells"))
    return drain.drawn_baseline(years, outlines, asked).select("lake_id", "as_of_year", "year", "area_m2")
