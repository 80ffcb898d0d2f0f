"""Exposure, alert, place, weather and drain queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import rules, text
from moraine.operators import alerts, drain, exposure, places, weather
from moraine.plans import domain as d
from moraine.plans.domain import micro, micro_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _status(spark: SparkSession, sf: str) -> DataFrame:
    """One impact a lake and asset, with its merged status."""
    rows = exposure.first_per(d.impacts(spark, sf), ["lake_id", "osm"], ["km", "order_id", "line", "part"])
    return rows.withColumn("status", rules.merged_status(F.col("expected"), F.col("severe")))


STATUS = """assets AS (SELECT *, CASE WHEN expected = 'flooded' THEN 'in_flood_path'
  WHEN expected IN ('flooded', 'margin') OR severe IN ('flooded', 'margin') THEN 'at_risk' ELSE 'outside' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY lake_id, osm ORDER BY km, order_id, line, part) AS k FROM impacts) WHERE k = 1)"""
ASSETS = (d.IMPACTS, STATUS)


@query(ctes(*ASSETS) + "SELECT lake_id, osm, kind, km, expected, severe, status FROM assets")
def distinct_assets(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf).select("lake_id", "osm", "kind", "km", "expected", "severe", "status")


@query(ctes(d.IMPACTS) + """, per AS (SELECT lake_id, osm, 'expected' AS scenario, expected AS outcome, km, kind FROM impacts UNION ALL
  SELECT lake_id, osm, 'severe', severe, km, kind FROM impacts WHERE line <> 1),
merged AS (SELECT lake_id, osm, min(km) AS km, arg_min(kind, km::VARCHAR) AS k0, max(CASE WHEN scenario = 'expected' THEN outcome END) AS expected,
  max(CASE WHEN scenario = 'severe' THEN outcome END) AS severe FROM per GROUP BY 1, 2)
SELECT lake_id, osm, km, expected, severe, CASE WHEN expected = 'flooded' THEN 'in_flood_path'
  WHEN coalesce(expected IN ('flooded', 'margin'), false) OR coalesce(severe IN ('flooded', 'margin'), false) THEN 'at_risk' ELSE 'outside' END AS status FROM merged""")
def merge_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    i = d.impacts(spark, sf)
    rows = i.select("lake_id", "osm", F.lit("expected").alias("scenario"), F.col("expected").alias("outcome"), "km", "kind").unionByName(
        i.where("line <> 1").select("lake_id", "osm", F.lit("severe").alias("scenario"), F.col("severe").alias("outcome"), "km", "kind")
    )
    return exposure.merge_scenarios(rows).drop("kind")


@query(ctes(*ASSETS) + """SELECT lake_id, osm, CASE WHEN status = 'outside' THEN false ELSE expected IN ('flooded', 'margin') END AS under_expected,
  CASE WHEN status = 'outside' THEN false ELSE expected IN ('flooded', 'margin') OR severe IN ('flooded', 'margin') END AS under_severe FROM assets""")
def affected_under(spark: SparkSession, sf: str) -> DataFrame:
    under = [rules.affected_under(s, F.col("status"), F.lit(True), F.col("expected"), F.col("severe")).alias(f"under_{s}") for s in ("expected", "severe")]
    return _status(spark, sf).select("lake_id", "osm", *under)


@query(ctes(*ASSETS) + "SELECT lake_id, osm, kind, status FROM assets WHERE status IN ('in_flood_path', 'at_risk') AND kind IN ('school', 'bridge')")
def impacts_filter(spark: SparkSession, sf: str) -> DataFrame:
    return exposure.filter_impacts(_status(spark, sf), "in_flood_path, at_risk", "school,,bridge").select("lake_id", "osm", "kind", "status")


@query(ctes(*ASSETS) + """SELECT l.lake_id, k.kind, count(*) FILTER (status = 'in_flood_path') AS in_flood_path, count(*) FILTER (status = 'at_risk') AS at_risk
FROM (SELECT DISTINCT lake_id FROM assets) l CROSS JOIN (SELECT unnest(['settlement', 'school', 'health', 'hydro', 'bridge', 'road']) AS kind) k
LEFT JOIN assets a ON a.lake_id = l.lake_id AND a.kind = k.kind GROUP BY 1, 2""")
def exposed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return exposure.exposed_counts(_status(spark, sf))


@query(ctes(*ASSETS) + """SELECT lake_id, arg_min(osm, km * 1e9 + osm) FILTER (status <> 'outside') AS first_exposed,
  arg_min(osm, km * 1e9 + osm) FILTER (status <> 'outside' AND kind = 'settlement') AS first_settlement FROM assets GROUP BY 1""")
def first_exposed(spark: SparkSession, sf: str) -> DataFrame:
    return exposure.first_exposed(_status(spark, sf))


@query(ctes(*ASSETS, """o AS (SELECT lake_id, km, kind || '/' || status AS key, fast_min, row_number() OVER (PARTITION BY lake_id ORDER BY km, osm, kind || '/' || status, fast_min) AS n FROM assets)""",
    """fold AS (SELECT lake_id, n, 0 AS run, key, km AS from_km, km, fast_min FROM o WHERE n = 1
  UNION ALL SELECT o.lake_id, o.n, CASE WHEN o.key = f.key AND o.km - f.from_km <= 1 THEN f.run ELSE f.run + 1 END, o.key, CASE WHEN o.key = f.key AND o.km - f.from_km <= 1 THEN f.from_km ELSE o.km END, o.km, o.fast_min
  FROM fold f JOIN o ON o.lake_id = f.lake_id AND o.n = f.n + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT lake_id, run, key, from_km, max(km) AS to_km, count(*) AS n, min(fast_min) AS fast_min FROM fold GROUP BY lake_id, run, key, from_km")
def merge_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Anchored runs."""
    rows = _status(spark, sf).select("lake_id", "km", F.col("osm").alias("seq"), F.concat_ws("/", "kind", "status").alias("what"), "fast_min")
    return exposure.merge_runs(rows, "what")


@query(ctes(d.STATIONS) + """SELECT o_custkey AS path_id, o_orderkey AS asset, count(*) AS points FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1, 2 HAVING count(*) = count(*) FILTER (l_partkey % 50 <> 0)""")
def way_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """A way is an order, its nodes the parts of its lines; some nodes are missing."""
    i, o = d.table(spark, sf, "lineitem"), d.table(spark, sf, "orders")
    ways = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    ways = ways.select(F.col("l_orderkey").alias("way_id"), F.transform("r", lambda x: x["l_partkey"]).alias("refs"))
    nodes = d.table(spark, sf, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"))
    out = exposure.way_geometry(ways, nodes).join(o, F.col("way_id") == F.col("o_orderkey"))
    return out.select(F.col("o_custkey").alias("path_id"), F.col("way_id").alias("asset"), F.size("points").cast("long").alias("points"))


@query(ctes(*ASSETS) + """, want AS (SELECT lake_id, unnest(range(0, 53)) AS chunk FROM (SELECT DISTINCT lake_id FROM assets)),
have AS (SELECT DISTINCT lake_id, CAST(floor(km) AS INT) AS chunk FROM assets WHERE kind = 'school')
SELECT w.lake_id, w.chunk * 1.0::DOUBLE AS from_km, least((w.chunk + 1) * 1.0::DOUBLE, 52.5::DOUBLE) AS to_km FROM want w LEFT JOIN have h ON w.lake_id = h.lake_id AND w.chunk = h.chunk WHERE h.lake_id IS NULL""")
def chunk_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = _status(spark, sf)
    lakes = rows.select("lake_id").distinct().withColumn("path_km", F.lit(52.5))
    return exposure.chunk_gaps(rows.where("kind = 'school'"), lakes, 1.0)


PLACED = """placed AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY fast_min NULLS LAST, km, osm) AS seq FROM
  (SELECT *, row_number() OVER (PARTITION BY lake_id, osm ORDER BY km, order_id, line, part) AS k2 FROM assets WHERE kind IN ('settlement', 'school', 'health')
   AND status <> 'outside' AND (expected IN ('flooded', 'margin') OR severe IN ('flooded', 'margin'))) WHERE k2 = 1)"""
SUBS = """subs AS (SELECT c_custkey AS sub_id, c_custkey % 500 AS osm, '+9198' || lpad(CAST(c_custkey % 50 AS VARCHAR), 8, '0') AS phone,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'voice' ELSE 'sms' END AS channel, c_custkey * 7 % 1000 AS created_at FROM customer)"""


def _subs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return d.table(spark, sf, "customer").select(
        key.alias("sub_id"), (key % 500).alias("osm"), F.concat(F.lit("+9198"), F.lpad((key % 50).cast("string"), 8, "0")).alias("phone"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "voice").otherwise("sms").alias("channel"), (key * 7 % 1000).alias("created_at"),
    )


@query(ctes(*ASSETS, PLACED) + "SELECT lake_id, osm, CAST(seq AS INT) AS seq, fast_min FROM placed")
def alert_places(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.affected_places(_status(spark, sf), "severe").select("lake_id", "osm", "seq", "fast_min")


PLAN = "plan AS (SELECT p.lake_id, p.seq, p.osm, s.sub_id, s.phone, s.channel FROM placed p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY osm, phone, channel ORDER BY created_at, sub_id) AS k FROM subs) s ON s.osm = p.osm AND s.k = 1)"


@query(ctes(*ASSETS, PLACED, SUBS, PLAN) + "SELECT lake_id, CAST(seq AS INT) AS seq, osm, sub_id, phone, channel FROM plan")
def alert_plan(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.plan(alerts.affected_places(_status(spark, sf), "severe"), _subs(spark, sf))


@query(ctes(*ASSETS, PLACED, SUBS, PLAN) + "SELECT lake_id, osm, count(DISTINCT phone || channel) AS subscribers FROM plan GROUP BY 1, 2")
def subscriber_counts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.subscriber_counts(alerts.plan(alerts.affected_places(_status(spark, sf), "severe"), _subs(spark, sf)))


@query(ctes(*ASSETS, SUBS) + "SELECT sub_id, osm FROM subs WHERE osm IN (SELECT osm FROM assets WHERE status = 'in_flood_path')")
def subscriptions_for_places(spark: SparkSession, sf: str) -> DataFrame:
    hit = _status(spark, sf).where("status = 'in_flood_path'").select("osm")
    return _subs(spark, sf).join(hit, "osm", "left_semi").select("sub_id", "osm")


@query(ctes(*ASSETS, SUBS) + "SELECT DISTINCT osm FROM subs WHERE osm IN (SELECT osm FROM assets WHERE kind IN ('settlement', 'school', 'health') UNION SELECT p_partkey FROM part WHERE p_size > 40)")
def known_places(spark: SparkSession, sf: str) -> DataFrame:
    index = d.table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("osm"))
    people = _status(spark, sf).where(rules.is_people_place(F.col("kind"))).select("osm")
    return _subs(spark, sf).select("osm").distinct().join(index.union(people), "osm", "left_semi")


@query("SELECT user_id AS event_id, count(*) AS recipients, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS sent, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def delivery_summary(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type").isin("view", "click", "purchase"), "sent").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    return alerts.delivery_summary(d.table(spark, sf, "events").select(F.col("user_id").alias("event_id"), status.alias("status")))


@query("""SELECT c_custkey AS sub_id, channel, lang, CASE WHEN channel NOT IN ('sms', 'voice', 'webpush') THEN 'channel' WHEN lang NOT IN ('hi', 'en') THEN 'language'
  WHEN channel <> 'webpush' AND NOT coalesce(regexp_matches(phone, '^\\+[1-9][0-9]{7,14}$'), false) THEN 'phone' END AS reject
FROM (SELECT c_custkey, phone, coalesce(nullif(trim(channel), ''), 'sms') AS channel, coalesce(nullif(trim(lang), ''), 'hi') AS lang FROM
  (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'webpush' WHEN 1 THEN ' ' WHEN 2 THEN 'fax' WHEN 3 THEN 'voice' END AS channel,
   CASE c_custkey % 7 WHEN 0 THEN 'de' WHEN 1 THEN 'en' END AS lang, CASE WHEN c_custkey % 3 <> 0 THEN '+9198' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE '0123' END AS phone FROM customer))""")
def subscription_checks(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    subs = d.table(spark, sf, "customer").select(
        key.alias("sub_id"), F.when(key % 5 == 0, "webpush").when(key % 5 == 1, " ").when(key % 5 == 2, "fax").when(key % 5 == 3, "voice").alias("channel"),
        F.when(key % 7 == 0, "de").when(key % 7 == 1, "en").alias("lang"),
        F.when(key % 3 != 0, F.concat(F.lit("+9198"), F.lpad(key.cast("string"), 8, "0"))).otherwise("0123").alias("phone"),
    )
    return alerts.normalise(subs).select("sub_id", "channel", "lang", "reject")


@query("""SELECT doc_id, CASE WHEN scenario IS NULL THEN 'scenario' WHEN src IS NULL THEN 'source' WHEN src = 'drain' AND doc_id % 2 = 0 THEN 'dry_run'
  WHEN length(text) > 300 THEN 'note' END AS problem FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'expected' WHEN 1 THEN 'severe' END AS scenario,
  CASE doc_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'sensor' WHEN 2 THEN 'drain' END AS src FROM documents)""")
def trigger_checks(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    scenario = F.when(key % 3 == 0, "expected").when(key % 3 == 1, "severe")
    source = F.when(key % 4 == 0, "manual").when(key % 4 == 1, "sensor").when(key % 4 == 2, "drain")
    problem = alerts.trigger_problem(scenario, source, key % 2 != 0, F.col("text"))
    return d.table(spark, sf, "documents").select("doc_id", problem.alias("problem"))


THREATS = """threats AS (SELECT *, row_number() OVER (PARTITION BY osm, role ORDER BY fast_min NULLS LAST, lake_id) AS seq FROM
  (SELECT *, CASE WHEN status <> 'outside' THEN 'threat' WHEN lateral_m <= 2000 THEN 'nearby' ELSE 'none' END AS role FROM assets))"""


@query(ctes(*ASSETS, THREATS) + "SELECT osm, role, CAST(seq AS INT) AS seq, lake_id, status, fast_min FROM threats")
def place_threats(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.impacts(spark, sf).withColumn("status", rules.merged_status(F.col("expected"), F.col("severe")))
    return places.threats(rows)


@query(ctes(*ASSETS, THREATS) + """SELECT c_custkey AS osm, CASE WHEN t.osm IS NOT NULL THEN 'threat' WHEN n.osm IS NOT NULL THEN 'nearby' WHEN c_custkey % 2 = 0 THEN 'safe' END AS headline,
  coalesce(t.lake_id, n.lake_id) AS lake_id FROM customer LEFT JOIN threats t ON t.osm = c_custkey AND t.role = 'threat' AND t.seq = 1
  LEFT JOIN threats n ON n.osm = c_custkey AND n.role = 'nearby' AND n.seq = 1""")
def place_headline(spark: SparkSession, sf: str) -> DataFrame:
    known = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("osm"), (F.col("c_custkey") % 2 == 0).alias("known"))
    return places.headline(known, place_threats(spark, sf))


RUNS = "|".join(f"{c}+" for c in "abcdefghijklmnopqrstuvwxyz0123456789")


def key_sql(x: str) -> str:
    marks = "".join(m for ms in text.MARKED.values() for m in ms)
    bases = "".join(b for b, ms in text.MARKED.items() for _ in ms)
    folded = f"regexp_replace(translate(lower({x}), '{marks}w', '{bases}v'), '[^a-z0-9]', '', 'g')"
    runs = f"list_transform(regexp_extract_all({folded}, '{RUNS}'), lambda r: CASE WHEN r = 'ee' THEN 'i' WHEN r = 'oo' THEN 'u' WHEN len(r) = 2 AND (r[1] < '0' OR r[1] > '9') THEN r[1] ELSE r END)"
    return f"replace(array_to_string({runs}, ''), 'ph', 'f')"


@query(f"""SELECT kind, id, k AS latin, replace(k, 'a', '') AS bare, regexp_replace(k, '[aeiouyh]', '', 'g') AS skeleton FROM (
  SELECT 'part' AS kind, p_partkey AS id, {key_sql('p_name')} AS k FROM part UNION ALL
  SELECT 'document', doc_id, {key_sql('text')} FROM documents)""")
def search_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of part names, and of whole documents, which have marks."""
    parts = d.table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    docs = d.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("name"))
    both = places.with_keys(parts.unionByName(docs))
    return both.select("kind", "id", "keys.latin", "keys.bare", "keys.skeleton")


ASKED = ["small", "Smaal", "brown", "red widget", "weedget", "zzqx", "a", "part"]


@query(f"""WITH places AS (SELECT p_partkey AS place_id, {key_sql('p_name')} AS latin, p_size % 6 AS size, p_partkey % 3 = 0 AS covered FROM part),
asked AS (SELECT q, {key_sql('q')} AS k FROM (SELECT unnest({ASKED}) AS q)),
graded AS (SELECT q, place_id, size, covered, CASE WHEN k = '' THEN 3 WHEN latin = k THEN 0 WHEN starts_with(latin, k) THEN 1 WHEN contains(latin, k) THEN 2 ELSE 3 END AS first,
  CASE WHEN length(regexp_replace(k, '[aeiouyh]', '', 'g')) >= 3 AND regexp_replace(k, '[aeiouyh]', '', 'g') = regexp_replace(latin, '[aeiouyh]', '', 'g') THEN 2 ELSE 3 END AS third FROM asked, places),
hits AS (SELECT q, place_id, size, covered, CASE WHEN first < 3 THEN 0 ELSE 2 END AS p, CASE WHEN first < 3 THEN first ELSE third END AS tier FROM graded WHERE first < 3 OR third < 3),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, covered DESC, size, place_id) AS rank FROM hits JOIN (SELECT q AS q2, min(p) AS p2 FROM hits GROUP BY 1) ON q = q2 AND p = p2)
SELECT q, CAST(rank AS INT) AS rank, place_id, p, tier FROM best WHERE rank <= 20""")
def search_places(spark: SparkSession, sf: str) -> DataFrame:
    index = d.table(spark, sf, "part").select(
        F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"), (F.col("p_size") % 6).alias("size"), (F.col("p_partkey") % 3 == 0).alias("covered")
    )
    return places.search(places.with_keys(index), spark.createDataFrame([(q,) for q in ASKED], "q string"))


@query("""WITH names AS (SELECT id, CASE WHEN ends_with(f, 'lake') AND strlen(f) >= 8 THEN f[:-5] WHEN ends_with(f, 'tal') AND strlen(f) >= 7 THEN f[:-4] ELSE f END AS key FROM
  (SELECT c_custkey AS id, translate(lower(c_name), ' -_.,''', '') || CASE c_custkey % 3 WHEN 0 THEN 'lake' WHEN 1 THEN 'tal' ELSE '' END AS f FROM customer)),
asked AS (SELECT s_name AS q, translate(lower(replace(s_name, 'Supplier', 'Customer')), ' -_.,''', '') AS key FROM supplier)
SELECT q, id FROM asked LEFT JOIN (SELECT key, min(id) AS id FROM names GROUP BY 1 HAVING count(*) = 1) USING (key)""")
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("c_custkey") % 3 == 0, " Lake").when(F.col("c_custkey") % 3 == 1, " Tal").otherwise("")
    names = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", tail).alias("name"))
    asked = d.table(spark, sf, "supplier").select("s_name", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("q"))
    return places.resolve(asked.select("q"), names).select(F.replace("q", F.lit("Customer"), F.lit("Supplier")).alias("q"), "id")


NUMS = r"(?:\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})+,\d{3}|\d+)(?:\.\d+)?"


def canon_sql(n: str) -> str:
    n = f"replace({n}, ',', '')"
    whole = f"coalesce(nullif(ltrim(split_part({n}, '.', 1), '0'), ''), '0')"
    frac = f"rtrim(split_part({n}, '.', 2), '0')"
    return f"({whole} || CASE WHEN {frac} = '' THEN '' ELSE '.' || {frac} END)"


@query(rf"""WITH pairs AS (SELECT page_id, html AS answer, coalesce(text, '') AS source FROM pages LEFT JOIN documents ON doc_id = page_id),
found AS (SELECT page_id, regexp_extract_all(answer, '{NUMS}') AS said,
  list_transform(list_concat(regexp_extract_all(source, '\d+(?:\.\d+)?'), regexp_extract_all(source, '{NUMS}')), lambda n: {canon_sql('n')}) AS ok FROM pairs),
allowed AS (SELECT page_id, said, list_concat(['112', '1077'], list_concat(ok, list_transform(ok, lambda n: split_part(n, '.', 1)))) AS ok FROM found),
bad AS (SELECT page_id, list_filter(said, lambda n: NOT (list_contains(ok, {canon_sql('n')}) OR (contains(n, ',')
  AND len(list_filter(split(n, ','), lambda p: NOT list_contains(ok, {canon_sql('p')}))) = 0))) AS bad FROM allowed)
SELECT page_id, len(list_distinct(bad)) AS n_bad, coalesce(array_to_string(list_sort(list_distinct(bad)), ' '), '') AS bad FROM bad""")
def grounding_check(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a page that its source document does not hold."""
    pages, docs = d.table(spark, sf, "pages"), d.table(spark, sf, "documents")
    both = pages.join(docs, pages["page_id"] == docs["doc_id"], "left")
    bad = text.unsupported_numbers(F.col("html"), F.col("allowed"))
    out = both.select("page_id", "html", text.allowed_numbers(F.col("text")).alias("allowed")).select("page_id", bad.alias("bad"))
    return out.select("page_id", F.size("bad").cast("long").alias("n_bad"), F.array_join(F.array_sort("bad"), " ").alias("bad"))


@query("SELECT c_custkey AS id, left(phone, 5) || repeat('*', length(phone) - 7) || right(phone, 2) AS masked FROM (SELECT c_custkey, '+9198' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone FROM customer)")
def masked_phones(spark: SparkSession, sf: str) -> DataFrame:
    phone = F.concat(F.lit("+9198"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.mask_phone(phone).alias("masked"))


DAYS = """days AS (SELECT user_id AS lake_id, CAST(ts AS DATE) AS date, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) / 1000 AS precipitation_mm,
  CAST(max(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) / 1000 AS tmax_c FROM events GROUP BY 1, 2),
marked AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY date DESC) <= 3 AS forecast FROM days)"""


def _days(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    days = e.groupBy(F.col("user_id").alias("lake_id"), F.to_date("ts").alias("date")).agg(
        (F.sum(F.when(F.col("event_type") == "purchase", d.cents("value"))).cast("double") / 1000).alias("precipitation_mm"),
        (F.max(F.when(F.col("event_type") != "error", d.cents("value"))).cast("double") / 1000).alias("tmax_c"),
    )
    return weather.mark_forecast(days)


@query(ctes(DAYS) + """, agg AS (SELECT lake_id, max(precipitation_mm) FILTER (forecast) AS wettest, coalesce(sum(precipitation_mm) FILTER (forecast), 0) AS total,
  max(tmax_c) FILTER (forecast) AS hottest, avg(tmax_c) FILTER (NOT forecast) AS past FROM marked GROUP BY 1),
r AS (SELECT lake_id, list_filter([CASE WHEN wettest >= 50 THEN 'high:day' WHEN wettest >= 20 THEN 'elevated:day' END,
  CASE WHEN total >= 100 THEN 'high:total' WHEN total >= 40 THEN 'elevated:total' END, CASE WHEN hottest - past >= 5 THEN 'elevated:heat' END], lambda x: x IS NOT NULL) AS r FROM agg)
SELECT lake_id, CASE WHEN len(list_filter(r, lambda x: starts_with(x, 'high'))) > 0 THEN 'high' WHEN len(r) > 0 THEN 'elevated' ELSE 'normal' END AS level,
  coalesce(array_to_string(r, ','), '') AS reasons FROM r""")
def weather_trigger(spark: SparkSession, sf: str) -> DataFrame:
    return weather.trigger(_days(spark, sf))


LOOKS = """looks AS (SELECT user_id AS lake_id, CAST(ts AS DATE) AS day, event_id AS scene_id,
  CASE WHEN event_type = 'error' THEN 'frozen_or_snow' WHEN event_type = 'view' THEN 'no_clear_scene' ELSE 'ok' END AS look FROM events WHERE value < 60)"""


def _looks(spark: SparkSession, sf: str) -> DataFrame:
    look = F.when(F.col("event_type") == "error", "frozen_or_snow").when(F.col("event_type") == "view", "no_clear_scene").otherwise("ok")
    return d.table(spark, sf, "events").where("value < 60").select(F.col("user_id").alias("lake_id"), F.to_date("ts").alias("day"), F.col("event_id").alias("scene_id"), look.alias("look"))


LATEST = """latest AS (SELECT lake_id, CASE WHEN nlook = 'frozen_or_snow' OR cid IS NULL THEN nid ELSE cid END AS scene_id, CASE WHEN nlook = 'frozen_or_snow' OR cid IS NULL THEN nlook ELSE 'ok' END AS look FROM
  (SELECT lake_id, max(CASE WHEN k = 1 THEN scene_id END) AS nid, max(CASE WHEN k = 1 THEN look END) AS nlook, max(CASE WHEN look = 'ok' AND k2 = 1 THEN scene_id END) AS cid FROM
   (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY day DESC, scene_id DESC) AS k, row_number() OVER (PARTITION BY lake_id, look ORDER BY day DESC, scene_id DESC) AS k2 FROM looks) GROUP BY 1))"""


@query(ctes(LOOKS, LATEST) + "SELECT lake_id, scene_id, look FROM latest")
def latest_look(spark: SparkSession, sf: str) -> DataFrame:
    return drain.latest_look(_looks(spark, sf)).select("lake_id", "scene_id", "look")


@query(ctes(LOOKS, LATEST) + f""", s AS (SELECT s_suppkey AS lake_id, CASE WHEN s_suppkey % 6 <> 0 THEN CAST(CAST(round((s_acctbal + 2000) * 100) AS BIGINT) AS DOUBLE) END AS season_area, s_suppkey % 5 * 20000.0::DOUBLE AS season_unc FROM supplier),
r AS (SELECT s.*, l.look, season_area * ((s.lake_id % 10) / 10.0::DOUBLE) AS area, 5000.0::DOUBLE AS unc FROM s LEFT JOIN latest l ON l.lake_id = s.lake_id),
v AS (SELECT *, CASE WHEN season_area IS NULL THEN 'not_found' WHEN season_area < 50000 THEN 'too_small' WHEN look IS NULL THEN 'no_clear_scene' ELSE look END AS status FROM r)
SELECT lake_id, status, CASE WHEN status = 'ok' THEN {micro_sql("1 - area / season_area")} END AS drop_e4,
  coalesce(status = 'ok' AND 1 - area / season_area > greatest(0.3::DOUBLE, 3 * sqrt(season_unc * season_unc + unc * unc) / season_area), false) AS drained FROM v""")
def drain_verdict(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    area = F.when(key % 6 != 0, F.round((F.col("s_acctbal") + 2000) * 100).cast("long").cast("double"))
    s = d.table(spark, sf, "supplier").select(key.alias("lake_id"), area.alias("season_area"), (key % 5 * 20000.0).alias("season_unc"))
    looks = drain.latest_look(_looks(spark, sf)).select("lake_id", "look")
    rows = s.join(looks, "lake_id", "left").withColumn("area", F.col("season_area") * ((F.col("lake_id") % 10) / 10.0)).withColumn("unc", F.lit(5000.0))
    return drain.verdict(rows).select("lake_id", "status", micro(F.col("drop")).alias("drop_e4"), "drained")


@query(ctes(d.LAKE_YEARS) + """SELECT q.lake_id, q.as_of_year, y.year, y.area_m2 FROM (SELECT DISTINCT lake_id, 1996 + lake_id % 6 AS as_of_year FROM lake_years) q
JOIN lake_years y ON y.lake_id = q.lake_id WHERE y.status = 'ok' AND y.year <= q.as_of_year
QUALIFY row_number() OVER (PARTITION BY q.lake_id, q.as_of_year ORDER BY y.year DESC) = 1""")
def season_baseline(spark: SparkSession, sf: str) -> DataFrame:
    years = d.lake_years(spark, sf)
    asked = years.select("lake_id", (F.col("lake_id") % 6 + 1996).alias("as_of_year")).distinct()
    return drain.baseline(years, asked).select("lake_id", "as_of_year", "year", "area_m2")


@query(ctes(d.SCENES) + """, now AS (SELECT cell, bool_or(observed AND water) AS now FROM scenes WHERE day >= DATE '2024-01-20' GROUP BY 1),
base AS (SELECT cell, count(*) FILTER (observed) AS base_obs, CAST(count(*) FILTER (observed AND cloud < 4000) AS DOUBLE) / nullif(count(*) FILTER (observed), 0) AS base_freq FROM scenes WHERE day < DATE '2024-01-20' GROUP BY 1)
SELECT cell, coalesce(now AND base_obs >= 2 AND coalesce(base_freq, 1) <= 0.1 AND cell % 2 = 0, false) AS new_water FROM now JOIN base USING (cell)""")
def new_water(spark: SparkSession, sf: str) -> DataFrame:
    s = d.scenes(spark, sf)
    edge = F.lit("2024-01-20").cast("date")
    now = s.where(F.col("day") >= edge).groupBy("cell").agg(F.bool_or(F.col("observed") & F.col("water")).alias("now"))
    seen, wet = F.count_if(F.col("observed")), F.count_if(F.col("observed") & (F.col("cloud") < 4000))
    base = s.where(F.col("day") < edge).groupBy("cell").agg(seen.alias("base_obs"), F.try_divide(wet, seen).alias("base_freq"))
    return drain.new_water(now.join(base, "cell").withColumn("corridor", F.col("cell") % 2 == 0)).select("cell", "new_water")


@query("""SELECT s_suppkey AS reach, w AS window_no, w * 5.0::DOUBLE AS centre_km FROM (SELECT s_suppkey, unnest(range(0, CAST(floor((s_suppkey % 40) * 1.5 / 5) AS BIGINT) + 1)) AS w FROM supplier)""")
def scan_windows(spark: SparkSession, sf: str) -> DataFrame:
    reaches = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("reach"), ((F.col("s_suppkey") % 40) * 1.5).alias("length_km"))
    return drain.fan_windows(reaches).select("reach", F.col("window").cast("long").alias("window_no"), "centre_km")


@query("""SELECT id FROM (SELECT event_id AS id, row_number() OVER (PARTITION BY round_even(user_id * 0.0004 + 77, 3), round_even(event_id % 9 * 0.0004 + 32, 3) ORDER BY event_id % 13, event_id) AS k FROM events) WHERE k = 1""")
def barrier_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 13).alias("window"), (F.col("user_id") * 0.0004 + 77).alias("lon"), (F.col("event_id") % 9 * 0.0004 + 32).alias("lat")
    )
    return drain.dedupe_rounded(rows).select("id")


@query("SELECT c_custkey AS lake_id, CASE WHEN DATE '2001-12-31' > CAST(last + INTERVAL 18 MONTH AS DATE) THEN year(last) END AS stale_year FROM (SELECT o_custkey AS c_custkey, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1)")
def stale_data(spark: SparkSession, sf: str) -> DataFrame:
    last = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("lake_id")).agg(F.to_date(F.max("o_orderdate")).alias("last"))
    return last.select("lake_id", F.when(F.lit("2001-12-31").cast("date") > F.add_months("last", 18), F.year("last")).alias("stale_year"))


OSM = """CASE WHEN t0 IN ('city', 'town', 'village', 'hamlet', 'suburb') THEN 'settlement/' || t0 WHEN power = 'plant' AND (src = 'hydro' OR regexp_matches(p_name, '(?i)hydro|\\bh\\.?e\\.?p\\b')) THEN 'hydro/hydro_plant'
  WHEN highway <> '' AND bridge <> 'no' THEN 'bridge/' || CASE WHEN highway IN ('footway', 'path', 'track', 'steps') THEN 'footbridge' ELSE 'road_bridge' END
  WHEN amenity IN ('school', 'college') THEN 'school/' || amenity WHEN amenity IN ('hospital', 'clinic') THEN 'health/' || amenity
  WHEN highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary') THEN 'road/' || highway END"""
TAGS = {
    "place": ["city", "hamlet", None, None, None, None, "isle"], "power": ["plant", None, None, "line"], "plant:source": ["hydro", "solar", None],
    "highway": [None, "primary", "path", "residential", "trunk"], "bridge": [None, "yes", "no"], "amenity": ["school", "clinic", "bar", None, None, "college"],
}


def _tag_sql(name: str) -> str:
    values = TAGS[name]
    return f"CASE (p_partkey + {len(name)}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END"


@query(f"""SELECT id, {OSM} AS kind FROM (SELECT p_partkey AS id, p_name, {_tag_sql("place")} AS t0, {_tag_sql("power")} AS power, {_tag_sql("plant:source")} AS src,
  {_tag_sql("highway")} AS highway, coalesce({_tag_sql("bridge")}, 'no') AS bridge, {_tag_sql("amenity")} AS amenity FROM part)""")
def classify_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = [F.lit("name"), F.col("p_name")]
    for name, values in TAGS.items():
        at = (F.col("p_partkey") + len(name)) % len(values)
        tags += [F.lit(name), F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))]
    kind = rules.classify_kind(F.map_filter(F.create_map(*tags), lambda _, v: v.isNotNull()))
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", kind["kind"], kind["subkind"]).alias("k")).select("id", F.nullif("k", F.lit("")).alias("kind"))
