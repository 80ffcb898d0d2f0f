"""Series, scoring and routing queries over the domain tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import hydrology, rules
from moraine.operators import replay, routing, series
from moraine.plans import domain as d
from moraine.plans.domain import micro, micro_sql

YEARS = list(range(1995, 2002))
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with the oracle if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


@query(ctes(d.SCENES) + "SELECT scene_id, cell, day, baseline, cloud FROM (SELECT *, row_number() OVER (PARTITION BY cell, day ORDER BY baseline DESC, cloud, scene_id) AS k FROM scenes) WHERE k = 1")
def scene_top1_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return series.one_per_day(d.scenes(spark, sf), "cell").select("scene_id", "cell", "day", "baseline", "cloud")


CLEAR = "clear AS (SELECT cell, day, min(scene_id) AS scene_id, CAST(sum(CASE WHEN observed THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS clear FROM scenes GROUP BY 1, 2)"


@query(ctes(d.SCENES, CLEAR) + "SELECT cell, day, scene_id, clear, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY clear DESC, day, scene_id) AS k FROM clear WHERE clear >= 0.2) WHERE k <= 12")
def clear_rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    looks = d.scenes(spark, sf).groupBy("cell", "day").agg(
        F.min("scene_id").alias("scene_id"), (F.sum(F.col("observed").cast("int")).cast("double") / F.count("*")).alias("clear")
    )
    return series.clearest(looks, "cell").select("cell", "day", "scene_id", "clear", "rank")


@query(ctes(d.SCENES) + """SELECT cell, obs_count, water_count, CASE WHEN obs_count > 0 THEN CAST(water_count AS DOUBLE) / obs_count END AS water_freq,
  coalesce(obs_count >= 1 AND CAST(water_count AS DOUBLE) / nullif(obs_count, 0) >= 0.5, false) AS water
FROM (SELECT cell, CAST(sum(CASE WHEN observed THEN 1 ELSE 0 END) AS BIGINT) AS obs_count,
  CAST(sum(CASE WHEN observed AND water THEN 1 ELSE 0 END) AS BIGINT) AS water_count FROM scenes GROUP BY 1)""")
def season_composite(spark: SparkSession, sf: str) -> DataFrame:
    return series.composite(d.scenes(spark, sf), "cell")


@query(ctes(d.LAKE_YEARS) + "SELECT lake_id, year, status, n_used, area_m2, uncertainty_m2, last_day FROM lake_years")
def lake_year_status(spark: SparkSession, sf: str) -> DataFrame:
    return d.lake_years(spark, sf).select("lake_id", "year", "status", "n_used", "area_m2", "uncertainty_m2", "last_day")


GROWTH = """ok AS (SELECT * FROM lake_years WHERE status = 'ok' AND area_m2 > 0),
seasons AS (SELECT DISTINCT lake_id, year AS season FROM lake_years),
slopes AS (SELECT s.lake_id, s.season, quantile_cont((b.area_m2 - a.area_m2) / (b.year - a.year), 0.5) AS slope
  FROM seasons s JOIN ok a ON a.lake_id = s.lake_id JOIN ok b ON b.lake_id = s.lake_id AND a.year < b.year AND b.year <= s.season GROUP BY 1, 2),
levels AS (SELECT s.lake_id, s.season, count(*) AS n_ok, quantile_cont(area_m2, 0.5) AS mid_area, min(year) AS from_year,
  max(year) AS to_year, quantile_cont(uncertainty_m2, 0.5) AS mid_unc FROM seasons s JOIN ok o ON o.lake_id = s.lake_id AND o.year <= s.season GROUP BY 1, 2),
growth AS (SELECT s.lake_id, s.season, coalesce(n_ok, 0) AS n_ok, CASE WHEN n_ok >= 3 THEN slope END AS slope,
  CASE WHEN n_ok >= 3 THEN 100 * slope / mid_area END AS pct_per_yr,
  coalesce(n_ok >= 3 AND abs(slope * (to_year - from_year)) > 2 * mid_unc, false) AS significant
  FROM seasons s LEFT JOIN levels USING (lake_id, season) LEFT JOIN slopes USING (lake_id, season))"""


@query(ctes(d.LAKE_YEARS, GROWTH) + f"SELECT lake_id, season, CAST(n_ok AS BIGINT) AS n_ok, {micro_sql('slope')} AS slope_e4, {micro_sql('pct_per_yr')} AS pct_e4, significant FROM growth")
def theil_sen_growth(spark: SparkSession, sf: str) -> DataFrame:
    return replay.growth(d.lake_years(spark, sf)).select(
        "lake_id", "season", "n_ok", micro(F.col("slope")).alias("slope_e4"), micro(F.col("pct_per_yr")).alias("pct_e4"), "significant"
    )


CURRENT = """current AS (SELECT s.lake_id, s.season,
  coalesce(max(CASE WHEN status = 'ok' THEN year END), max(year)) AS area_year, max(last_day) AS data_until
  FROM seasons s JOIN lake_years y ON y.lake_id = s.lake_id AND y.year <= s.season AND area_m2 > 0 GROUP BY 1, 2),
outline AS (SELECT c.*, y.area_m2 FROM current c JOIN lake_years y ON y.lake_id = c.lake_id AND y.year = c.area_year)"""


def _score_sql(x: str, lo: float, hi: float) -> str:
    return f"(round_even((CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({x} - {lo}::DOUBLE) / {hi - lo}::DOUBLE)) END) * 1000, 0) / 1000)"


REPLAY = f"""scored AS (SELECT o.*, g.n_ok, g.significant, 0.104::DOUBLE * pow(o.area_m2, 1.42::DOUBLE) AS volume,
  {_score_sql("log10(greatest(0.104::DOUBLE * pow(o.area_m2, 1.42::DOUBLE), 1e-12))", 5.0, 8.0)} AS size,
  (CASE WHEN g.significant THEN {_score_sql("5 * g.pct_per_yr", 0.0, 25.0)} ELSE 0.0::DOUBLE END) * 0.25::DOUBLE
   + {_score_sql("t.outlet_slope", 0.0, 10.0)} * 0.25::DOUBLE + {_score_sql("t.avalanche", 0.0, 0.5)} * 0.25::DOUBLE
   + {_score_sql("t.glacier", 500.0, 0.0)} * 0.25::DOUBLE AS likelihood
  FROM outline o JOIN growth g ON g.lake_id = o.lake_id AND g.season = o.season LEFT JOIN terrain t ON t.lake_id = o.lake_id),
levelled AS (SELECT *, round_even(100 * size * likelihood * 10, 0) / 10 AS score, floor(volume + 0.5) AS v FROM scored)"""


@query(ctes(d.LAKE_YEARS, GROWTH, CURRENT, d.TERRAIN, REPLAY) + f"""SELECT lake_id, season, area_year, CAST(n_ok AS BIGINT) AS n_ok, significant, data_until,
  {micro_sql("likelihood")} AS likelihood_e4, {micro_sql("score")} AS score_e4,
  CASE WHEN score >= 60 THEN 'very_high' WHEN score >= 40 THEN 'high' WHEN score >= 20 THEN 'moderate' ELSE 'low' END AS level,
  CAST(round(0.72::DOUBLE * pow(v, 0.53::DOUBLE)) AS BIGINT) AS peak_expected_m3s,
  CASE WHEN 0.00077::DOUBLE * pow(v, 1.017::DOUBLE) > 0.72::DOUBLE * pow(v, 0.53::DOUBLE) THEN 'huggel2002' ELSE 'evans1986' END AS severe_relation
FROM levelled""")
def risk_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: every lake scored as of every season."""
    out = replay.risk_replay(d.lake_years(spark, sf), d.terrain(spark, sf))
    return out.select(
        "lake_id", "season", "area_year", "n_ok", "significant", "data_until", micro(F.col("likelihood")).alias("likelihood_e4"),
        micro(F.col("score")).alias("score_e4"), "level", "peak_expected_m3s", "severe_relation",
    )


@query(f"""SELECT p_partkey AS part_id, {micro_sql("0.72::DOUBLE * pow(v, 0.53::DOUBLE)")} AS expected_e4,
  {micro_sql("greatest(0.72::DOUBLE * pow(v, 0.53::DOUBLE), 0.00077::DOUBLE * pow(v, 1.017::DOUBLE))")} AS severe_e4,
  {micro_sql("0.0048::DOUBLE * pow(v, 0.896::DOUBLE)")} AS popov_e4,
  NOT (0.00077::DOUBLE * pow(v, 1.017::DOUBLE) > 0.72::DOUBLE * pow(v, 0.53::DOUBLE)) AS identical
FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) * 100.0::DOUBLE AS v FROM part)""")
def peak_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    v = d.cents("p_retailprice") * 100.0
    return d.table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"), micro(hydrology.peak(v, "evans1986")).alias("expected_e4"),
        micro(hydrology.severe_peak(v)).alias("severe_e4"), micro(hydrology.peak(v, "popov1991")).alias("popov_e4"),
        (hydrology.severe_relation(v) == "evans1986").alias("identical"),
    )


@query(ctes(d.LAKE_YEARS, GROWTH, CURRENT, d.TERRAIN, REPLAY) + """, latest AS (SELECT lake_id, arg_max(CASE WHEN score >= 60 THEN 'very_high' WHEN score >= 40 THEN 'high' WHEN score >= 20 THEN 'moderate' ELSE 'low' END, season) AS level,
  max(data_until) AS data_until FROM levelled GROUP BY 1)
SELECT level, count(*) AS lakes, max(data_until) AS data_until FROM latest GROUP BY ROLLUP (level)""")
def level_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return replay.kpi_rollup(replay.risk_replay(d.lake_years(spark, sf), d.terrain(spark, sf)))


@query(ctes(d.LAKE_YEARS, GROWTH, CURRENT, d.TERRAIN, REPLAY) + f"""SELECT lake_id, {micro_sql("score")} AS score_e4, row_number() OVER (ORDER BY score DESC, lake_id) AS place
FROM (SELECT lake_id, arg_max(score, season) AS score FROM levelled GROUP BY 1) ORDER BY score DESC, lake_id LIMIT 20""")
def ranked_lakes(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the twenty most hazardous lakes."""
    top = replay.ranked(replay.risk_replay(d.lake_years(spark, sf), d.terrain(spark, sf))).limit(20)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "lake_id"))  # of twenty rows
    return top.select("lake_id", micro(F.col("score")).alias("score_e4"), place.cast("long").alias("place"))


@query(ctes(d.LAKE_YEARS) + """, fresh AS (SELECT lake_id, year, area_m2 * 2 AS area_m2, 'ok' AS status FROM lake_years WHERE year = 2001 OR (year = 1999 AND lake_id % 3 = 0))
SELECT lake_id, year, area_m2, status FROM fresh UNION ALL
SELECT lake_id, year, area_m2, status FROM lake_years o WHERE NOT EXISTS (SELECT 1 FROM fresh n WHERE n.lake_id = o.lake_id AND n.year = o.year)""")
def series_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = d.lake_years(spark, sf).select("lake_id", "year", "area_m2", "status")
    fresh = old.where((F.col("year") == 2001) | ((F.col("year") == 1999) & (F.col("lake_id") % 3 == 0)))
    fresh = fresh.select("lake_id", "year", (F.col("area_m2") * 2).alias("area_m2"), F.lit("ok").alias("status"))
    return series.upsert(old, fresh, ["lake_id", "year"])


@query(ctes(d.LAKE_YEARS) + "SELECT lake_id, " + ", ".join(
    f"max(CASE WHEN year = {y} THEN CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || CASE WHEN status = 'partial' THEN '*' ELSE '' END END) AS y{y}" for y in YEARS
) + " FROM lake_years GROUP BY 1")
def series_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return series.pivot_years(d.lake_years(spark, sf), YEARS)


@query(ctes(d.LAKE_YEARS) + """SELECT lake_id, min(year) AS first_year, arg_min(area_m2, year) AS first_area, max(year) AS latest_year, arg_max(area_m2, year) AS latest_area
FROM lake_years WHERE area_m2 IS NOT NULL GROUP BY 1""")
def first_latest(spark: SparkSession, sf: str) -> DataFrame:
    return series.first_latest(d.lake_years(spark, sf))


@query(ctes(d.LAKE_YEARS) + """, drawn AS (SELECT lake_id, CASE WHEN year % 3 = 0 THEN year + 10 ELSE year END AS year, area_m2 + 1 AS area_m2 FROM lake_years WHERE year % 2 = 1)
SELECT coalesce(y.lake_id, o.lake_id) AS lake_id, coalesce(y.year, o.year) AS year, coalesce(y.area_m2, o.area_m2) AS area_m2,
  coalesce(y.status, 'outline_only') AS status, o.area_m2 IS NOT NULL AS has_outline
FROM lake_years y FULL OUTER JOIN drawn o ON y.lake_id = o.lake_id AND y.year = o.year""")
def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    years = d.lake_years(spark, sf)
    shifted = F.when(F.col("year") % 3 == 0, F.col("year") + 10).otherwise(F.col("year"))
    drawn = years.where("year % 2 = 1").select("lake_id", shifted.alias("year"), (F.col("area_m2") + 1).alias("area_m2"))
    return series.evidence_rows(years, drawn)


@query(ctes(d.LAKE_YEARS) + "SELECT lake_id, year, lead(year) OVER (PARTITION BY lake_id ORDER BY year) AS next_year FROM lake_years")
def next_recorded_year(spark: SparkSession, sf: str) -> DataFrame:
    return series.next_year(d.lake_years(spark, sf))


@query(ctes(d.LAKE_YEARS) + "SELECT lake_id, coalesce(max(CASE WHEN year < 1998 AND lake_id % 4 <> 0 THEN year END), max(year)) AS year FROM lake_years GROUP BY 1")
def latest_outline_year(spark: SparkSession, sf: str) -> DataFrame:
    years = d.lake_years(spark, sf)
    return series.latest_outline_year(years, years.where((F.col("year") < 1998) & (F.col("lake_id") % 4 != 0)))


@query(ctes(d.LAKE_YEARS) + "SELECT DISTINCT year FROM lake_years UNION SELECT DISTINCT CAST(year(o_orderdate) AS INT) FROM orders")
def year_union(spark: SparkSession, sf: str) -> DataFrame:
    a = d.lake_years(spark, sf).select("year")
    return a.union(d.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))).distinct()


@query("SELECT s_suppkey AS chunk FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09")
def chunks_left(spark: SparkSession, sf: str) -> DataFrame:
    done = d.table(spark, sf, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select("l_suppkey")
    return d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("chunk")).exceptAll(done.distinct())


@query(ctes(d.STATIONS) + "SELECT path_id, seq, min(bed_m) OVER (PARTITION BY path_id ORDER BY seq) AS low_m FROM stations")
def running_min_bed(spark: SparkSession, sf: str) -> DataFrame:
    return routing.bed_profile(d.stations(spark, sf)).select("path_id", "seq", "low_m")


@query(ctes(d.STATIONS) + f""", low AS (SELECT *, min(bed_m) OVER (PARTITION BY path_id ORDER BY km) AS low_m FROM stations),
near AS (SELECT *, first_value(low_m) OVER w AS a, last_value(low_m) OVER w AS b, first_value(km) OVER w AS ka, last_value(km) OVER w AS kb FROM low
  WINDOW w AS (PARTITION BY path_id ORDER BY km ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT path_id, seq, {micro_sql("greatest((a - b) / greatest(kb * 1000 - ka * 1000, 1.0::DOUBLE), 0.002::DOUBLE)")} AS slope_e4 FROM near""")
def station_slope(spark: SparkSession, sf: str) -> DataFrame:
    return routing.bed_profile(d.stations(spark, sf)).select("path_id", "seq", micro(F.col("slope")).alias("slope_e4"))


@query(ctes(d.STATIONS) + f""", steps AS (SELECT *, coalesce(sqrt(pow(seq * 100 - lag(seq * 100) OVER w, 2) + pow(bed_m - lag(bed_m) OVER w, 2)), 0) AS step FROM stations
  WINDOW w AS (PARTITION BY path_id ORDER BY seq))
SELECT path_id, seq, {micro_sql("sum(step) OVER (PARTITION BY path_id ORDER BY seq) / 1000")} AS chain_e4 FROM steps""")
def chain_length(spark: SparkSession, sf: str) -> DataFrame:
    points = d.stations(spark, sf).select("path_id", "seq", (F.col("seq") * 100.0).alias("x"), F.col("bed_m").alias("y"))
    return routing.chain_length(points).select("path_id", "seq", micro(F.col("chain") / 1000).alias("chain_e4"))


@query(ctes(d.STATIONS) + f""", near AS (SELECT path_id, seq, last_value(seq * 100.0::DOUBLE) OVER w - first_value(seq * 100.0::DOUBLE) OVER w AS dx,
  last_value(bed_m) OVER w - first_value(bed_m) OVER w AS dy FROM stations WINDOW w AS (PARTITION BY path_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
unit AS (SELECT *, sqrt(dx * dx + dy * dy) AS norm FROM near)
SELECT path_id, seq, {micro_sql("CASE WHEN norm > 0 THEN dx / norm ELSE 1.0 END")} AS tx_e4, {micro_sql("CASE WHEN norm > 0 THEN dy / norm ELSE 0.0 END")} AS ty_e4 FROM unit""")
def station_tangents(spark: SparkSession, sf: str) -> DataFrame:
    points = d.stations(spark, sf).select("path_id", "seq", (F.col("seq") * 100.0).alias("x"), F.col("bed_m").alias("y"))
    return routing.tangents(points).select("path_id", "seq", micro(F.col("tx")).alias("tx_e4"), micro(F.col("ty")).alias("ty_e4"))


@query(ctes(d.STATIONS) + f"""SELECT path_id, seq, {micro_sql("bed_m / 1000 * exp(-km / 42.4::DOUBLE)")} AS discharge_e4,
  {micro_sql("km * 1000 / 8.0::DOUBLE / 60")} AS expected_e4, {micro_sql("km * 1000 / 10.0::DOUBLE / 60")} AS fast_e4 FROM stations""")
def attenuate_arrival(spark: SparkSession, sf: str) -> DataFrame:
    out = routing.attenuated(d.stations(spark, sf).withColumn("peak_m3s", F.col("bed_m") / 1000))
    return out.select(
        "path_id", "seq", micro(F.col("discharge_m3s")).alias("discharge_e4"), micro(F.col("arrival_expected")).alias("expected_e4"),
        micro(F.col("arrival_fast")).alias("fast_e4"),
    )


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    i, o = d.table(spark, sf, "lineitem"), d.table(spark, sf, "orders")
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("asset_id")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("path_id"), key, (F.col("l_quantity") / 8).alias("km"))


ASSETS = """assets AS (SELECT DISTINCT o_custkey AS path_id, l_orderkey * 8 + l_linenumber AS asset_id, l_quantity / 8 AS km FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
UNIQUE = "one AS (SELECT path_id, asset_id, min(km) AS km FROM assets GROUP BY 1, 2)"


@query(ctes(d.STATIONS, ASSETS, UNIQUE) + f""", lo AS (SELECT a.path_id, a.asset_id, a.km, s.km AS k0, s.bed_m AS w0 FROM one a ASOF LEFT JOIN stations s ON a.path_id = s.path_id AND a.km >= s.km),
hi AS (SELECT a.path_id, a.asset_id, s.km AS k1, s.bed_m AS w1 FROM one a ASOF LEFT JOIN stations s ON a.path_id = s.path_id AND a.km < s.km)
SELECT lo.path_id, lo.asset_id, {micro_sql("CASE WHEN k1 IS NULL THEN w0 ELSE w0 + (lo.km - k0) / (k1 - k0) * (w1 - w0) END / 100")} AS level_e4
FROM lo JOIN hi USING (path_id, asset_id)""")
def interp_level(spark: SparkSession, sf: str) -> DataFrame:
    assets = _assets(spark, sf).groupBy("path_id", "asset_id").agg(F.min("km").alias("km"))
    stations = d.stations(spark, sf).select("path_id", "km", F.col("bed_m").alias("wse_m"))
    return routing.level_along(assets, stations).select("path_id", "asset_id", micro(F.col("level_m") / 100).alias("level_e4"))


@query(ctes(d.STATIONS, ASSETS, UNIQUE) + """SELECT a.path_id, a.asset_id, arg_min(s.km, abs(a.km - s.km) * 1000000 + s.km) AS station_km
FROM one a JOIN stations s ON a.path_id = s.path_id GROUP BY 1, 2""")
def nearest_station(spark: SparkSession, sf: str) -> DataFrame:
    assets = _assets(spark, sf).groupBy("path_id", "asset_id").agg(F.min("km").alias("km"))
    return routing.nearest_station(assets, d.stations(spark, sf)).select("path_id", "asset_id", "station_km")


@query(ctes(d.STATIONS) + f""", seg AS (SELECT path_id, (seq - 1) * 130.0::DOUBLE AS a, lead((seq - 1) * 130.0::DOUBLE) OVER w AS b, bed_m AS y, lead(bed_m) OVER w AS y2 FROM stations
  WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
ks AS (SELECT *, unnest(range(CAST(ceil(a / 250) AS BIGINT), CAST(ceil(b / 250) AS BIGINT))) AS k FROM seg WHERE b > a)
SELECT path_id, k, {micro_sql("(k * 250.0::DOUBLE - a) / (b - a) * 130 + a")} AS x_e4 FROM ks""")
def resample_path(spark: SparkSession, sf: str) -> DataFrame:
    points = d.stations(spark, sf).select("path_id", "seq", ((F.col("seq") - 1) * 130.0).alias("x"), F.lit(0.0).alias("y"))
    return routing.resample(points, 250.0).select("path_id", "k", micro(F.col("x")).alias("x_e4"))


@query(ctes(d.STATIONS) + """SELECT path_id, seq, CAST(least(9, greatest(0, round_even(km * 300 / 250.0::DOUBLE, 0))) AS INT) AS owner FROM stations""")
def owner_station(spark: SparkSession, sf: str) -> DataFrame:
    return d.stations(spark, sf).select("path_id", "seq", routing.owner_station(F.col("km") * 300, F.lit(10)).alias("owner"))


@query(None)
def normal_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Section hydraulics; bisection is beyond SQL, so tests hold it to closed forms."""
    s = d.stations(spark, sf).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("seq", "bed_m"))).alias("p"))
    ground = F.transform("p", lambda x: x["bed_m"] / 1e6)
    offsets = F.transform("p", lambda x: (x["seq"] - F.size("p") / 2) * 30.0)
    sections = s.select("path_id", offsets.alias("offsets"), ground.alias("ground"), F.lit(500.0).alias("discharge"), F.lit(0.01).alias("slope"))
    return hydrology.section_flow(sections).select("path_id", "wse", "width", "capped", "left_m", "right_m")


@query(f"""SELECT p_partkey AS part_id, {", ".join(
    f"{micro_sql(_score_sql(('log10(greatest(x, 1e-12))' if log else 'x'), lo, hi))} AS {k}_e4" for k, _, lo, hi, log, _ in rules.FACTORS)}
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)""")
def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    scores = [micro(replay.factor_score(k, x)).alias(f"{k}_e4") for k, *_ in rules.FACTORS]
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), *scores)
