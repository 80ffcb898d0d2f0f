"""Corridors, outlines, blobs, spill points, map elements and distances against loops."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_drainage import levels
from test_operators import tile, valley

from moraine.operators import downstream, drain, elements, outlines, raster, spatial

CELL = "grid_id int, r int, c int"


def marks(spark, cells):
    return spark.createDataFrame([(1, r, c) for r, c in cells], CELL)


def reached(wet: set, start: set) -> set:
    todo, out = list(start & wet), set(start & wet)
    while todo:
        r, c = todo.pop()
        for k in ((r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if k in wet and k not in out:
                out.add(k)
                todo.append(k)
    return out


def test_flood_corridor_equals_a_loop(spark):
    rng = random.Random(41)
    z = {(r, c): rng.uniform(0, 10) for r in range(24) for c in range(30)}
    points = [(k, 4 + k * 0.9, 10 + 3 * math.sin(k / 4), 6.0 + 0.05 * k, 0.8, 0.6, rng.uniform(1, 8), rng.uniform(1, 8)) for k in range(22)]
    lake = {(r, c) for r in range(8, 12) for c in range(8, 11)}
    first: dict = {}
    for p in points:
        first.setdefault((round(p[2]), round(p[1])), p)
    wet = set(first)
    for (r, c), h in z.items():
        d, p = min((math.hypot(r - a, c - b), p) for (a, b), p in first.items())
        dx, dy = c - p[1], r - p[2]
        along, side = dx * p[4] + dy * p[5], dy * p[4] - dx * p[5]
        inside = h < p[3] and d <= min(6.0, (p[6] if side >= 0 else p[7]) + 0.5)
        if inside and not (p[0] == 0 and along < -0.5) and not (p[0] == 21 and along > 0.5) and (r, c) not in lake:
            wet.add((r, c))
    rows = [(1, *p) for p in points]
    frame = spark.createDataFrame(rows, "grid_id int, seq int, x double, y double, level double, tx double, ty double, left_m double, right_m double")
    got = raster.flood_corridor(spark, tile(spark, z), frame, 1.0, 6.0, marks(spark, lake)).collect()
    assert {(x.r, x.c) for x in got} == reached(wet, set(first))


def test_distance_equals_a_loop(spark):
    rng = random.Random(42)
    cells = {(r, c) for r in range(25) for c in range(31) if rng.random() < 0.9}
    for share in (0.0, 0.01, 0.3):
        targets = {k for k in cells if rng.random() < share}
        got = {(x.r, x.c): x.distance for x in raster.distance_to(marks(spark, cells), marks(spark, targets) if targets else marks(spark, cells).limit(0)).collect()}
        assert set(got) == cells
        for (r, c), d in got.items():
            want = min((math.hypot(r - a, c - b) for a, b in targets), default=None)
            assert d == (want if want is None else pytest.approx(want))


def test_masks_are_rings_and_rings_masks(spark):
    rng = random.Random(43)
    rows = [(g, r, c) for g in range(3) for r in range(12) for c in range(12) if rng.random() < (0.3, 0.5, 0.8)[g]]
    mask = spark.createDataFrame(rows, CELL)
    rings = outlines.rings(spark, mask)
    assert sorted(map(tuple, outlines.cells_of(rings).select("grid_id", "r", "c").collect())) == sorted(rows)
    # a ring with a hole, and a cell that touches it at a corner alone
    shape = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)} | {(3, 3)}
    sizes = sorted((x.area, x.length) for x in outlines.ring_sizes(outlines.rings(spark, marks(spark, shape))).collect())
    assert sizes == [(-1.0, 4), (1.0, 4), (9.0, 12)]
    corners = outlines.rings(spark, marks(spark, {(5, 7), (5, 8)})).orderBy("seq").collect()
    assert [(x.r, x.c) for x in corners] == [(5, 7), (5, 9), (6, 9), (6, 7)]
    assert outlines.rings(spark, mask.limit(0)).count() == 0


def simple(points: list, tol: float) -> list:
    (ax, ay), (bx, by) = points[0], points[-1]

    def off(p):
        d2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / d2)) if d2 else 0
        return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))

    if len(points) < 3 or max(map(off, points[1:-1])) <= tol:
        return [points[0], points[-1]]
    k = max(range(1, len(points) - 1), key=lambda i: off(points[i]))
    return simple(points[: k + 1], tol)[:-1] + simple(points[k:], tol)


def test_simpler_lines_equal_the_recursion(spark):
    rng = random.Random(44)
    lines = {}
    for k in range(4):
        x = y = 0.0
        lines[k] = [(x := x + rng.uniform(0, 2), y := y + rng.uniform(-1, 1)) for _ in range((2, 30, 60, 1)[k])]
    rows = [(k, i, x, y) for k, p in lines.items() for i, (x, y) in enumerate(p)]
    got = outlines.simplify(spark, spark.createDataFrame(rows, "line_id int, seq int, x double, y double"), 0.8).orderBy("line_id", "seq").collect()
    for k, p in lines.items():
        assert [(x.x, x.y) for x in got if x.line_id == k] == (simple(p, 0.8) if len(p) > 1 else p)


def test_lines_are_cut_at_any_polygon(spark):
    rng = random.Random(45)
    ring = [(5 + (3 + 2 * (k % 2)) * math.cos(k * math.pi / 7), 5 + (3 + 2 * (k % 2)) * math.sin(k * math.pi / 7)) for k in range(14)]
    lines = {k: [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)] for k in range(40)}

    def inside(x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    rows = [(k, i, x, y) for k, p in lines.items() for i, (x, y) in enumerate(p)]
    areas = spark.createDataFrame([(1, ring), (2, ring[:2])], "area_id int, ring array<struct<x:double,y:double>>")
    got = {x.line_id: x.inside for x in outlines.length_inside(spark, spark.createDataFrame(rows, "line_id int, seq int, x double, y double"), areas, 1.5).where("area_id = 1").collect()}
    for k, p in lines.items():
        n, want = 4000, 0.0
        for (ax, ay), (bx, by) in zip(p, p[1:], strict=False):
            share = sum(inside(ax + (i + 0.5) / n * (bx - ax), ay + (i + 0.5) / n * (by - ay)) for i in range(n)) / n
            want += share * math.hypot(bx - ax, by - ay)
        assert got.get(k, 0.0) == pytest.approx(want, abs=0.02)
    # a road that enters and leaves a square, over its corner and along its side
    square = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "area_id int, ring array<struct<x:double,y:double>>")
    road = spark.createDataFrame([(1, 0, -2.0, 1.0), (1, 1, 6.0, 1.0), (1, 2, 6.0, 3.0), (1, 3, 2.0, 3.0), (2, 0, -1.0, -1.0), (2, 1, 5.0, 5.0)], "line_id int, seq int, x double, y double")
    assert {x.line_id: round(x.inside, 9) for x in outlines.length_inside(spark, road, square, 3.0).collect()} == {1: 6.0, 2: round(4 * math.sqrt(2), 9)}


def looks(spark, now, river=(), corridor=lambda r, c: True, obs=4):
    rows = [(1, r, c, (r, c) in now, obs, 0.9 if (r, c) in river else 0.0, corridor(r, c)) for r in range(40) for c in range(40)]
    return spark.createDataFrame(rows, f"{CELL}, now boolean, base_obs int, base_freq double, corridor boolean")


def test_new_water_blobs(spark):
    river = {(20, c) for c in range(40)}
    lake = {(r, c) for r in range(14, 27) for c in range(10, 20)}
    blob = drain.label_blobs(spark, looks(spark, lake | river, river), 20.0).first()
    # both halves, the river between them and the river two cells on: three steps from new water
    assert (blob.cells, blob.area_m2, blob.width_m) == (134, 134 * 400.0, 2 * 3 * 20.0)
    sliver = {(21, c) for c in range(40)} | {(22, c) for c in range(40)}
    assert drain.label_blobs(spark, looks(spark, sliver | river, river), 20.0).count() == 0
    assert drain.label_blobs(spark, looks(spark, lake, corridor=lambda r, c: False), 20.0).count() == 0
    assert drain.label_blobs(spark, looks(spark, lake, obs=1), 20.0).count() == 0


def spill(spark, z, lake, **more):
    level = spark.createDataFrame([(1, z[next(iter(lake))])], "grid_id int, level double")
    return downstream.spill_points(spark, tile(spark, z), marks(spark, lake), level, 30.0, **more).first()


def test_spill_point_is_where_water_drains_away(spark):
    z = valley(40, 40)
    lake = {(r, c) for r in range(17, 24) for c in range(8, 15)}
    z |= dict.fromkeys(lake, z[20, 15] + 1)
    z[16, 8] = z[20, 15] - 30  # the lowest shore cell is a pit beside the lake
    got = spill(spark, z, lake, run_m=300.0)
    assert (got.r, got.c) != (16, 8) and got.surface_outlet and got.drop_m > 30
    assert got.slope_deg == pytest.approx(math.degrees(math.atan2(got.drop_m, got.run_m)))
    ways = levels(z, {(r, c) for r, c in z if r in (0, 39) or c in (0, 39)})
    assert ways[got.r, got.c] <= z[next(iter(lake))]


def test_spill_point_of_flat_ground_has_no_outlet_and_ties_go_by_place(spark):
    z = {(r, c): 100.0 for r in range(12) for c in range(12)}
    got = spill(spark, z, {(5, 5), (5, 6)})
    assert (got.r, got.c, got.surface_outlet, got.slope_deg) == (4, 4, False, 0.0)


SQUARE = [(77.10, 32.40), (77.11, 32.40), (77.11, 32.41), (77.10, 32.41), (77.10, 32.40)]
MEMBER = "struct<type:string,role:string,x:double,y:double,geometry:array<struct<x:double,y:double>>>"
ELEMENT = f"type string, id long, tags map<string,string>, x double, y double, geometry array<struct<x:double,y:double>>, members array<{MEMBER}>"


def test_elements_become_assets(spark):
    way = lambda role, *p: ("way", role, None, None, list(p))
    town = {"place": "town"}
    rows = [
        ("node", 1, {"place": "village", "name": "Sissu", "name:hi": "सिस्सू", "population": "500", "foo": "x"}, 77.12, 32.48, None, None),
        ("way", 2, {"place": "hamlet", "name": "Khoksar"}, None, None, SQUARE, None),
        ("way", 3, {"highway": "primary", "ref": "NH3"}, None, None, [(77.1, 32.45), None, (77.2, 32.47)], None),
        ("way", 4, {"highway": "primary", "bridge": "yes"}, None, None, SQUARE, None),  # a loop, not an area
        ("way", 5, {"waterway": "dam", "area": "no"}, None, None, SQUARE, None),
        ("relation", 10, town, None, None, None, [way("outer", *SQUARE[:2]), way("", *SQUARE[3:1:-1]), way("outer", SQUARE[1], SQUARE[2]), way("outer", *SQUARE[3:]), way("inner", *SQUARE[:3])]),
        ("relation", 11, town, None, None, None, [way("outer", (0.0, 0.0), (2.0, 0.0)), way("outer", (2.0, 0.0), (2.0, 2.0))]),  # never closes
        ("relation", 12, town, None, None, None, [("node", "label", 1.0, 2.0, None), ("node", "", 3.0, 6.0, None)]),
        ("relation", 13, town, None, None, None, []), ("relation", 14, town, None, None, None, None),
        ("way", 15, {"place": "village"}, None, None, None, None), ("node", 16, {"amenity": "clinic"}, None, None, None, None),
        ("node", 17, {"shop": "bakery"}, 77.1, 32.4, None, None), ("node", 18, None, 1.0, 1.0, None, None),
        ("node", 1, {"place": "village", "name": "Sissu", "name:hi": "सिस्सू", "population": "500", "foo": "x"}, 77.12, 32.48, None, None),
    ]
    got = {(x.osm_type, x.osm_id): x for x in elements.assets(spark.createDataFrame(rows, ELEMENT)).collect()}
    assert {k: (x.kind, x.subkind, x["shape"]) for k, x in got.items()} == {
        ("node", 1): ("settlement", "village", "point"), ("way", 2): ("settlement", "hamlet", "area"), ("way", 3): ("road", "primary", "line"),
        ("way", 4): ("bridge", "road_bridge", "line"), ("way", 5): ("hydro", "dam", "line"), ("relation", 10): ("settlement", "town", "area"),
        ("relation", 11): ("settlement", "town", "point"), ("relation", 12): ("settlement", "town", "point"),
    }
    assert got["node", 1].tags == {"place": "village", "name": "Sissu", "name:hi": "सिस्सू", "population": "500"} and got["node", 1].name_hi == "सिस्सू"
    ring = [(p.x, p.y) for p in got["relation", 10].rings[0]]
    assert ring[0] == ring[-1] and set(ring) == set(SQUARE) and len(ring) == 5
    assert tuple(got["relation", 11].point) == (1.5, 0.5) and tuple(got["relation", 12].point) == (2.0, 4.0)
    assert len(got["way", 3].line) == 2


def test_rings_share_no_way():
    square = lambda x: [(x, 0), (x + 1, 0), (x + 1, 1), (x, 1), (x, 0)]
    two = elements.joined([square(0)[:3], square(0)[2:], square(5), square(9)[:4]])
    assert sorted(min(r) for r in two) == [(0, 0), (5, 0)]


def test_neighbours_anywhere_on_the_globe(spark):
    rng = random.Random(46)
    places = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(150)]
    places += [(rng.choice((-179.99, 179.99, 180.0, -180.0)), rng.uniform(-90, 90)) for _ in range(60)] + [(rng.uniform(-180, 180), rng.choice((-1, 1)) * rng.uniform(88, 90)) for _ in range(60)] + [(0.0, 90.0), (10.0, -90.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "id int, lon double, lat double")
    for km in (30.0, 400.0):
        got = {(x.a_id, x.b_id) for x in spatial.within_km(df.withColumnRenamed("id", "a_id"), df.withColumnRenamed("id", "b_id"), km).collect()}
        want = set()
        for i, (x, y) in enumerate(places):
            for j, (u, v) in enumerate(places):
                east = abs(u - x)
                if 111.0 * math.hypot(v - y, min(east, 360 - east) * math.cos(math.radians(y))) <= km:
                    want.add((i, j))
        assert got == want
    assert spatial.within_km(df.select(F.col("id").alias("a_id"), "lon", "lat"), df.select(F.col("id").alias("b_id"), "lon", "lat"), 5.0).count() == len({(i, j) for i, j in want if i == j}) + sum(
        1 for i, (x, y) in enumerate(places) for j, (u, v) in enumerate(places) if i != j and 111.0 * math.hypot(v - y, min(abs(u - x), 360 - abs(u - x)) * math.cos(math.radians(y))) <= 5.0
    )
