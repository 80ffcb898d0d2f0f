"""Operators on small fixtures with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from moraine.operators import downstream, drain, exposure, places, raster, replay, routing, series, spatial
from moraine.sources import readers, sinks, workspace
from moraine.streaming import streams

YEARS = "lake_id string, year int, status string, area_m2 double, uncertainty_m2 double, last_day string"


def seasons(spark, areas, unc=0.01, status="ok"):
    return spark.createDataFrame([("x", y, status, a, unc * a, f"{y}-10-20") for y, a in areas.items()], YEARS)


def test_growth(spark):
    two = seasons(spark, {2017: 1.0e6, 2018: 1.03e6})
    assert [r.pct_per_yr for r in replay.growth(two).collect()] == [None, None]
    more = two.unionByName(seasons(spark, {2019: 0.5e6}, status="partial")).unionByName(seasons(spark, {2020: 1.09e6}))
    last = next(r for r in replay.growth(more).collect() if r.season == 2020)
    assert 2.5 < last.pct_per_yr < 3.5 and last.significant
    noisy = seasons(spark, {2017: 0.219e6, 2018: 0.226e6, 2019: 0.236e6, 2020: 0.222e6, 2021: 0.247e6, 2022: 0.226e6}, unc=0.09)
    assert not any(r.significant for r in replay.growth(noisy).collect())


def test_no_hindsight(spark):
    terrain = spark.createDataFrame([("x", 5.0, 0.1, 0.0)], "lake_id string, outlet_slope double, avalanche double, glacier double")
    past = seasons(spark, {2017: 1.0e6, 2018: 1.1e6, 2019: 1.2e6})
    future = past.unionByName(seasons(spark, {2020: 9.0e6}))
    a, b = (next(r for r in replay.risk_replay(y, terrain).collect() if r.season == 2019) for y in (past, future))
    assert a == b and a.data_until == "2019-10-20"
    assert replay.risk_replay(past, terrain.limit(0)).count() == 3


def test_peaks(spark):
    terrain = spark.createDataFrame([], "lake_id string, outlet_slope double, avalanche double, glacier double")
    small = replay.risk_replay(seasons(spark, {2017: 6000.0}), terrain).first()
    assert small.severe_relation == "evans1986" and small.peak_severe_m3s == small.peak_expected_m3s
    big = replay.risk_replay(seasons(spark, {2017: 2.0e6}), terrain).first()
    assert big.severe_relation == "huggel2002" and big.peak_severe_m3s > big.peak_expected_m3s


def test_upsert_and_latest(spark, tmp_path):
    old = spark.createDataFrame([("x", 2019, 1.0), ("x", 2020, 2.0)], "lake_id string, year int, area double")
    new = spark.createDataFrame([("x", 2020, 3.0)], old.schema)
    assert sorted(map(tuple, series.upsert(old, new, ["lake_id", "year"]).collect())) == [("x", 2019, 1.0), ("x", 2020, 3.0)]
    rows = spark.createDataFrame([("r", "2026-01-01", 1), ("r", "2026-01-03", 2)], "reach string, as_of string, n int")
    sinks.append_dated(rows, f"{tmp_path}/b")
    sinks.append_dated(rows.where("n = 2"), f"{tmp_path}/b")
    assert [r.n for r in sinks.latest(spark, f"{tmp_path}/b", "reach").collect()] == [2]


def test_interpolation_and_nearest(spark):
    stations = spark.createDataFrame([(1, 0.0, 100.0), (1, 1.0, 90.0), (1, 3.0, 70.0)], "path_id int, km double, wse_m double")
    assets = spark.createDataFrame([(1, 7, 0.5), (1, 8, 2.0), (1, 9, 5.0), (1, 10, 1.0), (1, 11, -1.0), (2, 12, 0.0)], "path_id int, asset_id int, km double")
    got = {r.asset_id: r.level_m for r in routing.level_along(assets, stations).collect()}
    assert got == {7: 95.0, 8: 80.0, 9: 70.0, 10: 90.0, 11: 100.0, 12: None}
    near = {r.asset_id: r.station_km for r in routing.nearest_station(assets, stations).collect()}
    assert near == {7: 0.0, 8: 1.0, 9: 3.0, 10: 1.0, 11: 0.0, 12: None}


def test_runs_equal_a_loop(spark):
    rng = random.Random(2)
    rows = [("x", rng.randrange(80) / 4, k, rng.choice("ab"), float(rng.randrange(9))) for k in range(120)]
    want = []
    for _, km, _, key, fast in sorted(rows, key=lambda r: (r[1], r[2])):
        if want and want[-1][0] == key and km - want[-1][1] <= 1.0:
            want[-1] = (key, want[-1][1], km, want[-1][3] + 1, min(want[-1][4], fast))
        else:
            want.append((key, km, km, 1, fast))
    df = spark.createDataFrame(rows, "lake_id string, km double, seq int, what string, fast_min double")
    got = [tuple(r)[2:] for r in exposure.merge_runs(df, "what").orderBy("run").collect()]
    assert got == want


def test_runs_of_unknown_places_and_times(spark):
    rows = [("x", None, 1, "a", 2.0), ("x", 1.0, 2, "a", None), ("x", 1.5, 3, "a", 4.0), ("x", 1.6, 4, None, 4.0), ("x", 1.6, 5, None, 4.0), ("y", 1.6, 6, "a", 1.0)]
    df = spark.createDataFrame(rows, "lake_id string, km double, seq int, what string, fast_min double")
    got = sorted((tuple(r) for r in exposure.merge_runs(df, "what").collect()), key=lambda r: r[:2])
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in got][:2] == [("x", 0, "a", 1, 2.0), ("x", 1, "a", 2, 4.0)] and len(got) == 5
    assert exposure.merge_runs(df.limit(0), "what").count() == 0


def test_a_failing_lake_leaves_the_others_alone(spark):
    def stage(pdf):
        return pdf.assign(twice=2 * pdf["n"] if pdf["n"].iloc[0] != 13 else 1 / 0)[["lake_id", "twice"]]

    rows = spark.createDataFrame([("a", 1), ("b", 13), ("c", 3), ("c", 4)], "lake_id string, n long")
    got = sorted(map(tuple, streams.isolated(rows, stage, "lake_id string, twice long").select("lake_id", "reason", "out.twice").collect()), key=str)
    assert got == [("a", None, 2), ("b", "ZeroDivisionError: division by zero", None), ("c", None, 6), ("c", None, 8)]


@pytest.mark.parametrize("azimuth", [0, 45, 90, 135, 180, 225, 270, 315])
def test_horizon_equals_the_march(spark, azimuth):
    rng = random.Random(azimuth)
    z = {(r, c): rng.uniform(0, 30) for r in range(9) for c in range(11)}
    got = raster.horizon_shadow(spark.createDataFrame([(1, r, c, h) for (r, c), h in z.items()], "grid_id int, r int, c int, z double"), F.lit(float(azimuth)), F.lit(20.0), 10.0)
    east, south = round(math.sin(math.radians(azimuth)) * 1.2), round(-math.cos(math.radians(azimuth)) * 1.2)
    for x in got.collect():
        ray = [(k * 10 * math.hypot(east, south), z.get((x.r + k * south, x.c + k * east))) for k in range(1, 12)]
        assert x.shadow == any(h is not None and h > z[x.r, x.c] + run * math.tan(math.radians(20.0)) for run, h in ray)


def test_projection_there_and_back(spark):
    from moraine.functions import geo

    places = spark.createDataFrame([(lon, lat) for lon in (75.1, 76.9, 78.0, 80.9) for lat in (0.5, 30.0, 32.5, 60.0)], "lon double, lat double")
    east, north = geo.utm(F.col("lon"), F.col("lat"))
    back = places.withColumn("e", east).withColumn("n", north).withColumn("zone", geo.utm_zone(F.col("lon")))
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"), F.col("zone"))
    for x in back.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(x.lon - x.lon2) < 1e-8 and abs(x.lat - x.lat2) < 1e-8


def test_filter_rejects_unknown(spark):
    rows = spark.createDataFrame([("a", "at_risk", "road")], "osm string, status string, kind string")
    assert exposure.filter_impacts(rows, "", "").count() == 1
    with pytest.raises(ValueError, match="unknown status"):
        exposure.filter_impacts(rows, "at_risk,drowned")


def test_search(spark):
    names = {1: "Sissu Village", 2: "Sisu Gompa", 3: "Sissu", 4: "Manali Bazar", 5: "Manali", 6: "Keylong", 7: "Kyelang"}
    index = spark.createDataFrame([(k, n, 3, False) for k, n in names.items()], "place_id int, name string, size int, covered boolean")
    asked = spark.createDataFrame([("Sisu",), ("manali",), ("मनाली",), ("Kyelang",), ("qwxzkj",), ("Kelong",), ("",)], "q string")
    got = {}
    for r in places.search(places.with_keys(index), asked).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.place_id)
    assert got == {"Sisu": [3, 1, 2], "manali": [5, 4], "मनाली": [5], "Kyelang": [7], "Kelong": [6, 7]}


def test_latest_look(spark):
    day = lambda n, look: ("x", n, n, look)
    cases = [([day(1, "ok"), day(2, "no_clear_scene")], "ok"), ([day(1, "ok"), day(2, "frozen_or_snow")], "frozen_or_snow"),
             ([day(1, "frozen_or_snow"), day(2, "no_clear_scene")], "no_clear_scene"), ([day(1, "ok"), day(2, "frozen_or_snow"), day(3, "no_clear_scene")], "ok")]
    for looks, want in cases:
        df = spark.createDataFrame(looks, "lake_id string, day int, scene_id int, look string")
        assert drain.latest_look(df).first().look == want


def test_nearest_anywhere_equals_a_loop(spark):
    rng = random.Random(6)
    places = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(80)] + [(77 + rng.random() / 9, 32 + rng.random() / 9) for _ in range(60)] + [(180.0, 0.0), (-180.0, 0.1), (3.0, 90.0)]
    b = [(k, *p) for k, p in enumerate(places)] + [(900, *places[0])]
    a = [(k, *p) for k, p in enumerate(places[::5])] + [(99, 0.0, -90.0)]

    def km(p, q):
        h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return round(2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h))), 6)

    schema = "lon double, lat double"
    frames = spark.createDataFrame(a, f"a_id long, {schema}"), spark.createDataFrame([*b, (901, None, 3.0)], f"b_id long, {schema}")
    for top in (1, 3):
        got = sorted((x.a_id, x["rank"], x.b_id) for x in spatial.nearest(*frames, top).collect())
        assert got == [(p[0], k + 1, q[0]) for p in sorted(a) for k, q in enumerate(sorted(b, key=lambda q: (km(p, q), q[0]))[:top])]
    assert spatial.nearest(frames[0], frames[1].limit(0), 3).count() == 0
    assert spatial.nearest(frames[0], frames[1].where("b_id < 2"), 3).count() == 2 * len(a)


@pytest.fixture
def written(monkeypatch):
    """The rows of each step that is written, in order; the last is the result."""
    sizes, write = [], workspace.Work._write

    def counting(self, df):
        out = write(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(workspace.Work, "_write", counting)
    return sizes


def test_nearest_asks_once_a_spot(spark, written):
    spots = [(77.0 + k / 50, 32.0 - k / 70) for k in range(5)]
    a, b = [(k, *spots[k % 3]) for k in range(600)], [(k, *spots[k % 4 + 1]) for k in range(500)]
    got = sorted((x.a_id, x["rank"], x.b_id) for x in spatial.nearest(spark.createDataFrame(a, "a_id long, lon double, lat double"), spark.createDataFrame(b, "b_id long, lon double, lat double"), 3).collect())
    far = lambda p, q: round(math.hypot((p[1] - q[1]) * math.cos(math.radians(32)), p[2] - q[2]), 6)
    assert got == [(p[0], k + 1, q[0]) for p in a for k, q in enumerate(sorted(b, key=lambda q: (far(p, q), q[0]))[:3])]
    assert max(written[:-1]) <= 12  # 4 spots with 3 ids each


def test_nearest_begins_where_few_share_a_cube(spark):
    rng = random.Random(8)
    xyz = "x double, y double, z double"
    town = spark.createDataFrame([(0.5 + rng.random() / 1000, 0.5 + rng.random() / 1000, 0.7) for _ in range(1000)], xyz)
    wide = spatial.uncrowded(town, 0.05, 12)
    assert town.groupBy(*[F.floor(F.col(v) / wide) for v in "xyz"]).count().agg(F.sum(F.col("count") ** 2) / 1000).first()[0] <= 12 and wide > 1e-5
    assert spatial.uncrowded(town, wide, 12) == wide and spatial.uncrowded(town.limit(0), 0.05, 12) == 0.05
    same = spark.createDataFrame([(0.1, 0.1, 0.1)] * 50, xyz)
    assert spatial.uncrowded(same, 1e-6, 12) <= spatial.NARROW


def test_the_index_finds_what_comparing_all_finds(spark):
    rng = random.Random(7)
    parts, hindi = ["sis", "su", "man", "ali", "key", "long", "gompa", "tal", "ee", "ph", "a"], ["मना", "ली", "सिस", "्सू", "ताल"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 4))), rng.choice([None, "".join(rng.choice(hindi) for _ in range(2))]), rng.randrange(6), rng.random() < 0.3) for k in range(300)]
    asked = {"".join(rng.choice(parts) for _ in range(rng.randrange(1, 3)))[rng.randrange(2) :] for _ in range(40)} | {"".join(rng.choice(hindi) for _ in range(rng.randrange(1, 3))) for _ in range(12)} | {"s", "su", "", "म"}
    index = places.with_keys(spark.createDataFrame(rows, "place_id int, name string, name_hi string, size int, covered boolean"), "name", "name_hi")
    q = spark.createDataFrame([(x,) for x in asked], "q string")
    flat = index.select("place_id", "size", "covered", *[F.col(f"keys.{k}").alias(f"k_{n}") for k, n in (("latin", "latin"), ("hindi", "hindi"), ("bare", "bare"), ("skeleton", "bones"))])
    graded = flat.crossJoin(places._asked_keys(q)).select("q", "place_id", "size", "covered", *[t.alias(f"t{k}") for k, t in enumerate(places._passes())]).collect()
    want = []
    for x in asked:
        for k in range(3):
            hits = sorted((r[f"t{k}"], not r.covered, r["size"], r.place_id) for r in graded if r.q == x and r[f"t{k}"] < 3)
            if hits:
                want += [(x, n + 1, h[3], k, h[0]) for n, h in enumerate(hits[:20])]
                break
    assert sorted(map(tuple, places.search(index, q).collect())) == sorted(want)


def test_resolver_hits_takes_copies_of_a_name_as_one(spark, written):
    rng = random.Random(9)
    kinds = ["redring", "smallred", "ring", "re", "smallgadget", "", None, "gadgetred", "résmall"]
    rows = [(k, rng.choice(kinds)) for k in range(900)] + [(900 + k, f"red{k}small{k * k}") for k in range(40)]
    rng.shuffle(rows)
    asked = ["red", "small", "re", "r", "gadgetr", "nosuch", "", "red7small49", None]
    got = places.resolver_hits(spark.createDataFrame(rows, "id long, f string"), spark.createDataFrame([(q,) for q in [*asked, "red"]], "q string"), 7)
    want = [(q, k, n + 1) for q in asked if q for n, (_, k) in enumerate(sorted((not f.startswith(q), k) for k, f in rows if f and q in f)[:7])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert max(written[:-1]) <= 7 * 8 + 40  # seven ids of each name


def test_search_takes_places_with_equal_keys_as_one(spark, written):
    rng = random.Random(10)
    names, asked = ["Manali", "Manaali", "Mana", "Old Manali", "Kyelang", "Keylong", None], ["Manali", "man", "Kelong", "a", "qwxzkj", ""]
    rows = [(k, rng.choice(names), rng.randrange(6), rng.choice([True, False, None])) for k in range(800)]
    index = places.with_keys(spark.createDataFrame(rows, "place_id int, name string, size int, covered boolean"))
    got = places.search(index, spark.createDataFrame([(q,) for q in asked], "q string"), 5)
    latin = lambda x: x.lower().replace(" ", "").replace("aa", "a")
    bones = lambda x: "".join(c for c in latin(x) if c not in "aeiouyh")
    want = []
    for q in filter(None, asked):
        grade = {x: (2, 2) for x in names[:-1] if len(bones(q)) >= 3 and bones(q) == bones(x)}
        grade |= {x: (0, 0 if latin(x) == latin(q) else 1 if latin(x).startswith(latin(q)) else 2) for x in names[:-1] if latin(q) in latin(x)}
        hits = sorted((*grade[x], not c, c is None, size, k) for k, x, size, c in rows if x in grade)
        want += [(q, n + 1, h[-1], h[0], h[1]) for n, h in enumerate([h for h in hits if h[0] == hits[0][0]][:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert written[0] <= 5 * 6 and max(written[:-1]) <= 60  # five of each of the six different keys, and what is asked


def test_universe_joins_analysed_places_with_the_index(spark):
    impacts = spark.createDataFrame([("n/1", 2, "settlement", "Late", None), ("n/1", 1, "settlement", "Sissu", "सिस्सू"), ("n/2", 3, "school", "GPS", None), ("n/9", 4, "settlement", "Only", None)], "osm string, seq int, kind string, name string, name_hi string")
    index = spark.createDataFrame([("n/1", "Sisu", None, "Lahaul", "HP", "village"), ("n/5", "Manali", "मनाली", "Kullu", "HP", "town"), ("n/2", "Gompa", None, None, None, None)], "osm string, name string, name_hi string, district string, state string, place string")
    got = sorted(map(tuple, places.universe(impacts, index).collect()))
    assert got == [("n/1", "Sissu", "सिस्सू", "Lahaul", "HP", 3, True), ("n/2", "Gompa", None, None, None, 5, False), ("n/5", "Manali", "मनाली", "Kullu", "HP", 1, False), ("n/9", "Only", None, None, None, 5, True)]


def test_greedy_spread_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(1, k, float(rng.randrange(50)), 77 + rng.random() / 10, 32 + rng.random() / 10) for k in range(60)]
    kept = []
    for _, k, _, lon, lat in sorted(rows, key=lambda r: (-r[2], r[1])):
        far = [111.0 * math.hypot(b - lat, (a - lon) * math.cos(math.radians(lat))) > 2.0 for _, a, b in kept]
        if all(far):
            kept.append((k, lon, lat))
    df = spark.createDataFrame(rows, "grp int, id long, area double, lon double, lat double")
    assert sorted(r.id for r in spatial.greedy_spread(df, 2.0).collect()) == sorted(k for k, _, _ in kept)


def spread_by_a_loop(rows, km):
    kept = []
    for g, k, area, lon, lat in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[1])):
        near = lambda x, y: 111.0 * math.hypot(y - lat, (x - lon) * math.cos(math.radians(lat))) <= km  # noqa: B023, E731
        if lon is None or not any(h == g and x is not None and near(x, y) for h, _, x, y in kept):
            kept.append((g, k, lon, lat))
    return sorted((g or 0, k) for g, k, _, _ in kept)


def test_greedy_spread_lists_no_pairs(spark, written):
    rng = random.Random(11)
    rows = [(rng.choice([1, 2, None]), k, rng.choice([None, float(rng.randrange(9))]), 77 + rng.random() / 30, 32 + rng.random() / 30) for k in range(300)]
    rows += [(1, 1000 + k, 5.0, 77.5 + k % 4 / 90, 32.5) for k in range(200)] + [(2, 2000 + k, 1.0, None, 32.0) for k in range(5)]
    df = spark.createDataFrame(rows, "grp int, id long, area double, lon double, lat double")
    assert sorted((r.grp or 0, r.id) for r in spatial.greedy_spread(df, 2.0).collect()) == spread_by_a_loop(rows, 2.0)
    assert max(written) <= 309  # each undecided spot once, and what is near nothing


def test_greedy_spread_measures_from_the_later_point(spark):
    # the third is in reach of the fourth as the third's latitude has it, not as the fourth's has; the second goes by the first
    rows = [(1, 1, 4.0, 20.0, 80.19), (1, 2, 3.0, 20.0, 80.12), (1, 3, 2.0, 20.0, 80.05), (1, 4, 1.0, 20.3271, 79.98), (1, 5, 0.5, 20.3271, 79.93)]
    df = spark.createDataFrame(rows, "grp int, id long, area double, lon double, lat double")
    assert sorted((r.grp, r.id) for r in spatial.greedy_spread(df, 10.0).collect()) == spread_by_a_loop(rows, 10.0) == [(1, 1), (1, 3), (1, 4)]


def test_components_and_closing(spark):
    shape = ["##..#", "#...#", "....."]
    cells = [(1, r, c) for r, line in enumerate(shape) for c, x in enumerate(line) if x == "#"]
    got = raster.components(spark, spark.createDataFrame(cells, "grid_id int, r int, c int")).collect()
    assert {(r.r, r.c): (r.label_r, r.label_c) for r in got} == {(0, 0): (0, 0), (0, 1): (0, 0), (1, 0): (0, 0), (0, 4): (0, 4), (1, 4): (0, 4)}
    ring = spark.createDataFrame([(1, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "grid_id int, r int, c int")
    assert raster.close(ring).where("r = 1 and c = 1").count() == 1


def test_long_chains_have_no_limit(spark):
    """A winding valley of 300 cells: its path, its catchment and its one component."""
    line, r, c = [(0, 0)], 0, 0
    for turn in range(15):
        for _ in range(23):
            c += 1 if turn % 2 == 0 else -1
            line.append((r, c))
        for _ in range(2):
            r += 1
            line.append((r, c))
    assert len(line) > 300
    cells = spark.createDataFrame([(1, a, b, float(len(line) - k)) for k, (a, b) in enumerate(line)], "grid_id int, r int, c int, z double")
    to = raster.receivers(cells).checkpoint()
    got = [(p.r, p.c) for p in raster.flow_paths(spark, to, spark.createDataFrame([(1, 0, 0)], "grid_id int, r int, c int")).orderBy("seq").collect()]
    height, want = {(a, b): z for _, a, b, z in cells.collect()}, [(0, 0)]
    while True:
        a, b = want[-1]
        drops = [((height[a, b] - height[a + i, b + j]) / math.hypot(i, j), -k, (a + i, b + j)) for k, (i, j) in enumerate(raster.NEIGHBOURS) if (a + i, b + j) in height]
        if not drops or max(drops)[0] <= 0:
            break
        want.append(max(drops)[2])
    assert len(want) > 300 and got == want
    end = spark.createDataFrame([(1, *line[-1])], "grid_id int, r int, c int")
    assert raster.catchment(spark, to, end).count() == len(line)
    labels = raster.components(spark, cells).select("label_r", "label_c").distinct().collect()
    assert [tuple(x) for x in labels] == [(0, 0)]


def test_distance_equals_all_pairs(spark):
    rng = random.Random(4)
    cells = [(g, r, c) for g in (1, 2, 3) for r in range(12) for c in range(9)]
    targets = [x for x in cells if x[0] != 3 and rng.random() < 0.04]
    frames = (spark.createDataFrame(x, "grid_id int, r int, c int") for x in (cells, targets))
    got = {(x.grid_id, x.r, x.c): x.distance for x in raster.distance_to(*frames).collect()}
    assert len(got) == len(cells)
    for g, r, c in cells:
        want = min((math.hypot(r - a, c - b) for t, a, b in targets if t == g), default=None)
        assert got[g, r, c] == (want if want is None else pytest.approx(want))


def test_along_path_equals_all_pairs(spark):
    rng = random.Random(8)
    x, y, chain, segments = 0.0, 0.0, 0.0, []
    for _ in range(400):
        nx, ny = x + rng.uniform(-1, 2), y + rng.uniform(-1.5, 1.5)
        segments.append((1, chain, x, y, nx, ny))
        chain, x, y = chain + math.hypot(nx - x, ny - y), nx, ny
    points = [(1, k, rng.uniform(-50, 300), rng.uniform(-60, 60)) for k in range(80)]
    schema = "path_id int, chain double, ax double, ay double, bx double, by double"
    got = {r.id: r for r in spatial.along_path(spark.createDataFrame(points, "path_id int, id int, x double, y double"), spark.createDataFrame(segments, schema)).collect()}
    for _, k, px, py in points:
        best = None
        for _, at, ax, ay, bx, by in segments:
            t = min(1.0, max(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            d = math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))
            best = min(best or (d, 0.0), (d, at + t * math.hypot(bx - ax, by - ay)))
        assert got[k].distance == pytest.approx(best[0]) and got[k].along == pytest.approx(best[1])


def test_corridor(spark):
    cells = [(1, r, c, float(abs(r - 5)) + (20.0 if c == 14 else 0.0)) for r in range(11) for c in range(20)]
    path = [(1, k, 5, k, 3.5) for k in range(12)] + [(1, 12, 5, 18, 3.5)]
    got = {(x.r, x.c) for x in raster.corridor(spark, spark.createDataFrame(cells, "grid_id int, r int, c int, z double"), spark.createDataFrame(path, "grid_id int, seq int, r int, c int, level double"), 2.5).collect()}
    near = lambda r, c: min((math.hypot(r - a, c - b), s) for _, s, a, b, _ in path)[0]
    assert got == {(r, c) for _, r, c, z in cells if z < 3.5 and near(r, c) <= 2.5}


def test_spill_mask_stays_on_the_flat(spark):
    cells = [(1, r, c, 100.0 if c <= 20 and 8 <= r <= 22 else 100.0 - 5.0 * (c - 20) + 3.0 * abs(r - 15)) for r in range(31) for c in range(40)]
    lake = [(1, r, c) for r in range(11, 19) for c in range(6, 15)]
    frames = spark.createDataFrame(cells, "grid_id int, r int, c int, z double"), spark.createDataFrame(lake, "grid_id int, r int, c int")
    level = spark.createDataFrame([(1, 100.0)], "grid_id int, level double")
    got = {(x.r, x.c) for x in raster.spill_mask(spark, *frames, level, res=30.0).collect()}
    assert {(r, c) for r in range(9, 22) for c in range(1, 20)} <= got and not any(c > 21 for _, c in got)


def test_flow_path(spark):
    cells = spark.createDataFrame([(1, r, c, float(10 - c + abs(r - 1))) for r in range(3) for c in range(5)], "grid_id int, r int, c int, z double")
    start = spark.createDataFrame([(1, 1, 0)], "grid_id int, r int, c int")
    path = raster.flow_paths(spark, raster.receivers(cells), start).orderBy("seq").collect()
    assert [(p.r, p.c) for p in path] == [(1, k) for k in range(5)]


def test_years_asked(spark):
    cases = {"2018,2020-2022": [2018, 2020, 2021, 2022], "": [2021, 2022, 2023, 2024, 2025, 2026], "2015": None, "2016-2026": None, "soon": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.y for r in df.select("t", readers.years_asked(F.col("t"), 2026).alias("y")).collect()}
    assert got == cases


def test_documents_tolerate_old_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "lat": 1.0, "unknown": 3}, {"id": "y", "sources": ["s"]}]')
    rows = {r.id: r for r in readers.documents(spark, str(tmp_path / "a.json"), "id string, lat double, sources array<string>").collect()}
    assert rows["x"].lat == 1.0 and rows["x"].sources is None and rows["y"].sources == ["s"]


def test_rate_limit_equals_a_loop():
    rng = random.Random(1)
    times = sorted(rng.uniform(0, 400) for _ in range(300))
    kept, want = [], []
    for t in times:
        recent = [k for k in kept if t - k < 60]
        want.append(len(recent) < 10)
        kept += [t] * want[-1]
    first, state = streams._admit(times[:100], [], 10, 60)
    second, _ = streams._admit(times[100:], state, 10, 60)
    assert first + second == want


def test_extract_lake(spark):
    """A hole is filled and a cloud is bridged; a dry gap is not, and dry seeds meet no lake."""
    cloudy = ["..........", ".####..##.", ".#.#???##.", ".####..##.", ".........."]
    dry = [line.replace("?", ".") for line in cloudy]
    rows = [(g, r, c, x == "#", x != "?") for g, lines in ((1, cloudy), (2, dry), (3, cloudy)) for r, line in enumerate(lines) for c, x in enumerate(line)]
    cells = spark.createDataFrame(rows, "grid_id int, r int, c int, water boolean, observed boolean")
    seeds = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 0, 0)], "grid_id int, r int, c int")
    lakes = {1: set(), 2: set(), 3: set()}
    for x in raster.extract_lake(spark, cells, seeds).collect():
        lakes[x.grid_id].add((x.r, x.c))
    assert {(2, 2), (1, 7), (2, 8)} <= lakes[1]
    assert (2, 2) in lakes[2] and (1, 7) not in lakes[2]
    assert not lakes[3]


def test_assess(spark):
    stations = spark.createDataFrame([(1, 0.0, 100.0), (1, 1.0, 90.0)], "path_id int, km double, wse_m double")
    rows = [(1, 1, 0, "settlement", 0.5, 94.0, True, True), (1, 1, 1, "settlement", 0.5, 99.0, True, True), (1, 2, 0, "bridge", 1.0, 95.0, False, True),
            (1, 3, 0, "road", 1.0, 95.0, False, True), (1, 4, 0, "school", 0.0, None, False, True), (1, 5, 0, "school", 0.0, 90.0, False, False)]
    df = spark.createDataFrame(rows, "path_id int, asset_id int, point int, kind string, km double, ground_m double, reached boolean, near boolean")
    got = {r.asset_id: (r.status, r.height_m) for r in exposure.assess(df, stations).collect()}
    assert got == {1: ("flooded", -1.0), 2: ("margin", 5.0), 3: ("outside", 5.0), 4: ("outside", None), 5: ("outside", None)}


def valley(height=60, width=60):
    """(r, c): z of a V-shaped valley that falls to the east."""
    return {(r, c): 1000.0 - 5.0 * c + 3.0 * abs(r - height // 2) for r in range(height) for c in range(width)}


def tile(spark, z, blocked=()):
    rows = [(1, r, c, h, (r, c) in blocked) for (r, c), h in z.items()]
    return spark.createDataFrame(rows, "grid_id int, r int, c int, z double, blocked boolean")


def test_route_down_a_valley(spark):
    cells = tile(spark, {(r, c): 1000.0 - 0.6 * c + 1.5 * abs(r - 30) for r in range(60) for c in range(60)})
    path = spark.createDataFrame([(1, k, 30, c) for k, c in enumerate(range(2, 58))], "grid_id int, seq int, r int, c int")
    peaks = spark.createDataFrame([(1, 20_000.0)], "grid_id int, peak_m3s double")
    rows = downstream.route(cells, path, peaks, 30.0, half_m=600.0).orderBy("km").collect()
    assert [r.km for r in rows] == [0.25 * k for k in range(7)]
    assert all(r.slope == pytest.approx(0.02) for r in rows)
    for r in rows:
        assert r.discharge == pytest.approx(20_000 * math.exp(-r.km / 42.4)) and r.depth_m == pytest.approx(r.wse - r.bed_m)
        # a V of side slope 1/20: area 20 h^2, wetted sides 40 h and a little
        area, wet = 20 * r.depth_m**2, 2 * math.sqrt(401) * r.depth_m
        assert area * (area / wet) ** (2 / 3) * math.sqrt(0.02) / 0.06 == pytest.approx(r.discharge, rel=0.1) and not r.capped
    wall = spark.createDataFrame([(1, r, c) for r in range(48, 60) for c in range(60)], "grid_id int, r int, c int")
    assert [r.wse for r in downstream.route(cells, path, peaks, 30.0, 600.0, wall).orderBy("km").collect()] == [r.wse for r in rows]


def test_samples_between_cells(spark):
    cells = spark.createDataFrame([(1, r, c, float(10 * r + c) if (r, c) != (0, 2) else None) for r in range(3) for c in range(3)], "grid_id int, r int, c int, z double")
    points = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, -4.0, 9.0), (1, 2, 1.5, 0.0), (1, 3, 2.0, 1.0)], "grid_id int, point int, x double, y double")
    assert {p.point: p.z for p in downstream.sample(points, cells).collect()} == {0: 5.5, 1: 20.0, 2: None, 3: 12.0}
