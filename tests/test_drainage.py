"""Ways out of pits and flow paths against a plain search for the lowest barrier."""

import heapq
import math
import os
import random

import pytest
from test_operators import tile, valley

from moraine.operators import drainage, raster

NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def levels(z: dict, rim: set) -> dict:
    """The lowest height at which water of each cell reaches the rim."""
    best, todo = {}, [(z[k], k) for k in rim if k in z]
    heapq.heapify(todo)
    while todo:
        level, (r, c) = heapq.heappop(todo)
        if (r, c) in best:
            continue
        best[r, c] = level
        for a, b in NEAR:
            if (k := (r + a, c + b)) in z and k not in best:
                heapq.heappush(todo, (max(level, z[k]), k))
    return best


def rim_of(height: int, width: int) -> set:
    return {(r, c) for r in range(height) for c in range(width) if r in (0, height - 1) or c in (0, width - 1)}


def drawn(rng: random.Random, size: int, values: int, shut: float) -> tuple[dict, set]:
    z = {(r, c): float(rng.randrange(values)) for r in range(size) for c in range(size)}
    return z, {k for k in z if rng.random() < shut}


@pytest.mark.parametrize(("seed", "values", "shut"), [(2, 6, 0.0), (3, 50, 0.2)])
def test_every_cell_leaves_over_its_lowest_barrier(spark, seed, values, shut):
    rng = random.Random(seed)
    z, blocked = drawn(rng, 14, values, shut)
    known = {k: v for k, v in z.items() if k not in blocked}
    want = levels(known, rim_of(14, 14))
    to = {(x.r, x.c): None if x.to_r is None else (x.to_r, x.to_c) for x in drainage.ways_out(spark, tile(spark, z, blocked)).collect()}
    assert set(to) == set(known)
    for cell, level in want.items():
        way = [cell]
        while to[way[-1]] is not None:
            way.append(to[way[-1]])
            assert max(abs(way[-1][0] - way[-2][0]), abs(way[-1][1] - way[-2][1])) == 1
            assert len(way) <= len(known)
        assert way[-1] in rim_of(14, 14) and max(known[k] for k in way) == level
    got = {(x.r, x.c): x.level for x in drainage.filled(spark, tile(spark, z, blocked)).collect()}
    assert {k: got[k] for k in want} == want


def test_ground_without_a_rim_drains_to_its_lowest_pit(spark):
    rng = random.Random(5)
    z, _ = drawn(rng, 12, 1000, 0.0)
    wall = {k for k in z if 1 in k or 10 in k} | rim_of(12, 12)
    inside = {k: v for k, v in z.items() if k not in wall}
    lowest = min(inside, key=lambda k: (inside[k], k))
    to = {(x.r, x.c): x for x in drainage.ways_out(spark, tile(spark, z, wall)).collect()}
    assert [k for k, x in to.items() if x.to_r is None] == [lowest]
    assert {(x.r, x.c): x.level for x in drainage.filled(spark, tile(spark, z, wall)).collect()} == levels(inside, {lowest})


def walked(spark, cells, r, c, **more):
    start = spark.createDataFrame([(1, r, c)], "grid_id int, r int, c int")
    return [(p.r, p.c) for p in drainage.trace_paths(spark, cells, start, **more).orderBy("seq").collect()]


def test_path_follows_the_valley_and_leaves_pits(spark):
    z = valley()
    path = walked(spark, tile(spark, z), 30, 2, res=30.0)
    assert path[-1][1] == 59 and max(abs(r - 30) for r, _ in path) <= 1
    z[30, 20] -= 40
    for c in (21, 22, 23):
        z[30, c] += 10
    path = walked(spark, tile(spark, z), 30, 2, res=30.0)
    assert path[-1][1] == 59 and len(set(path)) == len(path) and (30, 20) in path
    z[30, 40] = None
    assert (30, 40) not in walked(spark, tile(spark, z), 30, 2, res=30.0)


def test_path_respects_blocked_cells_and_length(spark):
    lake = {(r, c) for r in range(25, 36) for c in range(10, 15)}
    path = walked(spark, tile(spark, valley(), lake), 30, 16, res=30.0, most_m=300.0)
    length = sum(30 * math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:], strict=False))
    assert not lake & set(path[1:]) and 300 <= length <= 300 + 30 * math.sqrt(2)
    ring = {(r, c) for r in range(60) for c in range(60) if max(abs(r - 30), abs(c - 16)) == 1}
    assert walked(spark, tile(spark, valley(), ring), 30, 16, res=30.0) == [(30, 16)]


def test_paths_over_tiles_equal_one_walk_over_the_whole(spark):
    """Two lakes' paths over a mosaic of five tiles, dealt as its tiles, with pits on the seams."""
    z = {(r, c): 1000.0 - 5.0 * c + 3.0 * abs(r - 9) for r in range(20) for c in range(50)}
    for c in (9, 10, 20, 29, 30):
        z[9, c] -= 30
    cells = tile(spark, z).withColumn("tile", raster.F.floor(raster.F.col("c") / 10)).repartition(5, "tile")
    starts = spark.createDataFrame([("a", 1, 9, 2), ("b", 1, 4, 5)], "path_id string, grid_id int, r int, c int")
    rows = drainage.trace_paths(spark, cells, starts, 30.0).orderBy("path_id", "seq").collect()
    level = levels(z, rim_of(20, 50))
    for name in ("a", "b"):
        path = [(x.r, x.c) for x in rows if x.path_id == name]
        assert len({c // 10 for _, c in path}) == 5 and path[-1][1] == 49 and len(set(path)) == len(path)
        assert all(max(z[k] for k in path[i:]) == level[path[i]] for i in range(len(path)))
        # Out of the pits it is the plain walk down the steepest neighbour.
        for (r, c), on in zip(path, path[1:], strict=False):
            near = [(r + a, c + b) for a, b in raster.NEIGHBOURS if (r + a, c + b) in z]
            down = max(near, key=lambda k: ((z[r, c] - z[k]) / math.hypot(k[0] - r, k[1] - c), -near.index(k)))
            assert on == down or any(level[k] > z[k] for k in ((r, c), on, down))
    assert rows[-1].along_m == pytest.approx(sum(30 * math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:], strict=False)))


def test_steps_are_removed(spark):
    """Only results are left in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    drainage.filled(spark, tile(spark, valley(8, 8))).collect()
    assert len([x for x in set(os.listdir(root)) - before if "moraine-step" in x]) <= 2


def test_no_cells(spark):
    none = tile(spark, {(0, 0): None})
    assert drainage.ways_out(spark, none).count() == drainage.filled(spark, none.limit(0)).count() == 0
