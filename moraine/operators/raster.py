"""Raster kernels over cells (grid_id, r, c, ...): windows, joins and pointer doubling.

The neighbour joins explode a cell into its eight neighbours and meet them by
equality. Chains of cells (labels, receivers) are followed by doubling, in
materialised rounds that end when nothing changes: about log of the longest chain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.operators import graph
from moraine.sources.workspace import Work

#: Neighbours in the order in which ties are broken.
NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
CELL = ["grid_id", "r", "c"]


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell once for each offset, as (grid_id, r, c) of the neighbour and (r0, c0) of itself."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in enumerate(offsets)])
    out = cells.select("grid_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(steps).alias("o"))
    return out.select("grid_id", "r0", "c0", (F.col("r0") + F.col("o.dr")).alias("r"), (F.col("c0") + F.col("o.dc")).alias("c"), F.col("o.k").alias("k"))


def slope(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Slope in degrees from central differences, one-sided at the edges."""

    def gradient(fixed: str, along: str) -> Column:
        w = Window.partitionBy("grid_id", fixed).orderBy(along)
        after, before = F.lead("z").over(w), F.lag("z").over(w)
        return F.when(before.isNull(), after - F.col("z")).when(after.isNull(), F.col("z") - before).otherwise((after - before) / 2) / res

    return cells.withColumn("gr", gradient("c", "r")).withColumn("gc", gradient("r", "c")).withColumn("slope", F.degrees(F.atan(F.hypot("gr", "gc")))).drop("gr", "gc")


def dilate(mask: DataFrame, times: int = 1, diagonal: bool = False) -> DataFrame:
    """Cells of the mask and their neighbours, ``times`` over."""
    near = [(0, 0)] + [o for o in NEIGHBOURS if diagonal or 0 in o]
    out = mask.select(*CELL)
    for _ in range(times):
        out = neighbours(out, near).select(*CELL).distinct()
    return out


def erode(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """Cells of the mask whose neighbours are all in it."""
    near = [o for o in NEIGHBOURS if diagonal or 0 in o]
    have = neighbours(mask, near).join(mask.select(*CELL), CELL).groupBy("grid_id", "r0", "c0").count()
    return have.where(F.col("count") == len(near)).select("grid_id", F.col("r0").alias("r"), F.col("c0").alias("c"))


def close(mask: DataFrame) -> DataFrame:
    """Dilation then erosion with the diamond."""
    return erode(dilate(mask))


def components(spark: SparkSession, mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """Connected components of ``mask``, labelled by their least cell in row order."""
    nodes = mask.select(*CELL).distinct()
    links = neighbours(nodes, [o for o in NEIGHBOURS if (diagonal or 0 in o) and o > (0, 0)]).join(nodes, CELL)
    links = links.select(F.struct("grid_id", F.col("r0").alias("r"), F.col("c0").alias("c")).alias("a"), F.struct(*CELL).alias("b"))
    labels = graph.connected(links).select("node.*", F.col("label.r").alias("label_r"), F.col("label.c").alias("label_c"))
    return nodes.join(labels, CELL, "left").select(*CELL, *[F.coalesce(f"label_{x}", x).alias(f"label_{x}") for x in ("r", "c")])


def _lowest(at: list[int], cost: list[float], asked: np.ndarray) -> np.ndarray:
    """Least (x - at)^2 + cost of each asked x: a lower envelope of parabolas, one pass over ``at`` in order."""
    hull: list[int] = []
    since: list[float] = []
    for k, x in enumerate(at):
        meet = -math.inf
        while hull:
            j = hull[-1]
            meet = (cost[k] + x * x - cost[j] - at[j] * at[j]) / (2 * (x - at[j]))
            if meet > since[-1]:
                break
            hull.pop()
            since.pop()
            meet = -math.inf
        hull.append(k)
        since.append(meet)
    best = np.array(hull)[np.searchsorted(since, asked, "right") - 1]
    return (asked - np.array(at)[best]) ** 2.0 + np.array(cost)[best]


def distance_to(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Euclidean distance of each cell to the nearest target of its grid, null without one.

    In two passes, linear in the cells: windows give the nearest target in the own row, then each column
    is one sweep over the rows' results, in order, as its cells arrive. Rows with a target are made whole
    first, as wide as the grid's cells, so cells may be missing.
    """
    marked = targets.select(*CELL).distinct().withColumn("target", F.col("c"))
    wide = cells.select(*CELL).unionByName(targets.select(*CELL)).groupBy("grid_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    rows = marked.select("grid_id", "r").distinct().join(wide, "grid_id").select("grid_id", "r", F.explode(F.sequence("lo", "hi")).alias("c"), F.lit(False).alias("asked"))
    every = cells.select(*CELL, F.lit(True).alias("asked")).unionByName(rows).groupBy(*CELL).agg(F.max("asked").alias("asked"))
    both = every.join(marked, CELL, "left")
    along = Window.partitionBy("grid_id", "r")
    ahead, back = (along.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("c", F.desc("c")))
    gap = F.least(F.col("c") - F.last("target", True).over(ahead), F.last("target", True).over(back) - F.col("c"))
    gaps = both.select(*CELL, "asked", gap.cast("double").alias("gap")).repartition("grid_id", "c").sortWithinPartitions("grid_id", "c", "r")

    def columns(b: pa.RecordBatch) -> np.ndarray:
        """Where the columns of sorted rows begin."""
        n = b.num_rows - 1
        same = pc.and_(pc.equal(b.column("grid_id").slice(1), b.column("grid_id").slice(0, n)), pc.equal(b.column("c").slice(1), b.column("c").slice(0, n)))
        return np.flatnonzero(np.append(True, ~same.to_numpy(zero_copy_only=False)))

    def measured(b: pa.RecordBatch, start: np.ndarray) -> pa.RecordBatch:
        r, gap = b.column("r").to_numpy().astype(np.int64), b.column("gap").to_numpy(zero_copy_only=False)
        out = np.full(b.num_rows, np.nan)
        for i, j in zip(start.tolist(), [*start[1:].tolist(), b.num_rows], strict=True):
            known = i + np.flatnonzero(~np.isnan(gap[i:j]))
            if len(known):
                out[i:j] = np.sqrt(_lowest(r[known].tolist(), (gap[known] ** 2).tolist(), r[i:j]))
        rows = pa.RecordBatch.from_arrays([*(b.column(c) for c in CELL), pa.array(out, from_pandas=True)], names=[*CELL, "distance"])
        return rows.filter(b.column("asked"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                b = b if held is None else pa.concat_batches([held, b])
                start = columns(b)
                if len(start) > 1:
                    yield measured(b.slice(0, int(start[-1])), start[:-1])
                held = b.slice(int(start[-1]))
        if held is not None:
            yield measured(held, np.array([0]))

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in CELL)
    return gaps.mapInArrow(sweep, f"{kinds}, distance double")


def receivers(cells: DataFrame) -> DataFrame:
    """Each cell's steepest lower neighbour, null at a pit; ties go to the first in order."""
    near = neighbours(cells, NEIGHBOURS).join(cells.select(*CELL, F.col("z").alias("z1")), CELL)
    own = cells.select("grid_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("z").alias("z0"))
    run = F.sqrt(F.pow(F.col("r") - F.col("r0"), 2) + F.pow(F.col("c") - F.col("c0"), 2))
    drop = near.join(own, ["grid_id", "r0", "c0"]).withColumn("drop", (F.col("z0") - F.col("z1")) / run).where("drop > 0")
    best = drop.groupBy("grid_id", "r0", "c0").agg(F.max(F.struct("drop", (-F.col("k")).alias("k"), "r", "c")).alias("b"))
    best = best.select("grid_id", F.col("r0").alias("r"), F.col("c0").alias("c"), F.col("b.r").alias("to_r"), F.col("b.c").alias("to_c"))
    return cells.select(*CELL).join(best, CELL, "left")


def _cells(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}r").alias("r"), F.col(f"{prefix}c").alias("c"))


def flow_paths(spark: SparkSession, to: DataFrame, starts: DataFrame, most: float = math.inf) -> DataFrame:
    """(grid_id, path_id, seq, r, c): cells from each of ``starts(grid_id, r, c[, path_id])`` down the receivers, in order, to where they end.

    Of a path at least ``most`` steps are followed, fewer if it ends before.

    Each round doubles what is known of a path: the cells so far, and the same cells
    taken on by as many steps as there are of them; only the new ones are written.
    """
    work = Work(spark)
    name = F.col("path_id") if "path_id" in starts.columns else F.col("grid_id").alias("path_id")
    jump = to.where("to_r is not null").select("grid_id", _cells().alias("at"), _cells("to_").alias("to"))
    parts = [work.cut(starts.select("grid_id", name, F.lit(0).alias("seq"), _cells().alias("at")))]
    steps = 1
    while True:
        path = reduce(DataFrame.unionByName, parts)
        if steps > most:
            return work.result(path.select("grid_id", "path_id", "seq", "at.r", "at.c"))
        further = path.join(jump, ["grid_id", "at"]).select("grid_id", "path_id", (F.col("seq") + steps).alias("seq"), F.col("to").alias("at"))
        further, n = work.counted(further, F.lit(True))
        if not n:
            return work.result(path.select("grid_id", "path_id", "seq", "at.r", "at.c"))
        parts.append(further)
        on = jump.select("grid_id", F.col("at").alias("to"), F.col("to").alias("next"))
        jump = work.cut(jump.join(on, ["grid_id", "to"]).select("grid_id", "at", F.col("next").alias("to")), jump)
        steps *= 2


def catchment(spark: SparkSession, to: DataFrame, outlets: DataFrame) -> DataFrame:
    """Cells that drain to ``outlets``, themselves included; a drop passes no outlet.

    Every cell's receiver is replaced by its receiver's until all stand at an end.
    """
    work = Work(spark)
    node = lambda prefix="": F.struct("grid_id", F.col(f"{prefix}r").alias("r"), F.col(f"{prefix}c").alias("c"))
    ends = outlets.select(*CELL).distinct().withColumn("outlet", F.lit(True))
    drains = F.when(F.col("outlet").isNull() & F.col("to_r").isNotNull(), node("to_")).otherwise(node())
    here = graph.roots(work, to.join(ends, CELL, "left").select(node().alias("node"), drains.alias("to")))
    return work.result(here.join(ends.select(node().alias("root")), "root").select("node.*"))


def water_level(cells: DataFrame) -> DataFrame:
    """Median height within the commonest whole-metre bin of each grid, the lowest on a tie."""
    binned = cells.withColumn("bin", F.floor("z"))
    w = Window.partitionBy("grid_id").orderBy(F.desc("count"), "bin")
    mode = binned.groupBy("grid_id", "bin").count().withColumn("k", F.row_number().over(w)).where("k = 1").select("grid_id", "bin")
    return binned.join(mode, ["grid_id", "bin"]).groupBy("grid_id").agg(F.median("z").alias("level"))


def outlet(ring: DataFrame) -> DataFrame:
    """The lowest cell of each grid's ring, the first in row order on a tie."""
    return ring.groupBy("grid_id").agg(F.min(F.struct("z", "r", "c")).alias("o")).select("grid_id", "o.r", "o.c", "o.z")


def ring_of(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells next to the mask and not in it."""
    return cells.join(dilate(mask, 1, True), CELL, "left_semi").join(mask.select(*CELL), CELL, "left_anti")


def shadow(cells: DataFrame, dr: int, dc: int, tan_sun: float, steps: int) -> DataFrame:
    """Cells from which a cell toward the sun stands above the ray."""
    sun = neighbours(cells, [(dr * k, dc * k) for k in range(1, steps + 1)]).join(cells.select(*CELL, F.col("z").alias("z1")), CELL)
    own = cells.select("grid_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("z").alias("z0"))
    run = F.hypot(F.col("r") - F.col("r0"), F.col("c") - F.col("c0"))
    hit = sun.join(own, ["grid_id", "r0", "c0"]).groupBy("grid_id", "r0", "c0").agg(F.bool_or(F.col("z1") > F.col("z0") + run * tan_sun).alias("shadow"))
    hit = hit.select("grid_id", F.col("r0").alias("r"), F.col("c0").alias("c"), "shadow")
    return cells.select(*CELL).join(hit, CELL, "left").select(*CELL, F.coalesce("shadow", F.lit(False)).alias("shadow"))


def horizon_shadow(cells: DataFrame, azimuth: Column, elevation: Column, res: float) -> DataFrame:
    """(grid_id, r, c, shadow): cells from which ground toward the sun stands above the ray, at any bearing.

    ``azimuth`` is in degrees from north, clockwise, rows counted southwards; a sun below one degree stands at one. Cells
    are sheared into lines along the bearing, one cell a step of the longer axis, and one running horizon a line decides: it is linear
    in the cells. Unknown ground hides nothing and lies in the deepest shadow.
    """
    east, south = F.sin(F.radians(azimuth)), -F.cos(F.radians(azimuth))
    flat = F.abs(east) >= F.abs(south)
    lean = F.when(flat, south / east).otherwise(east / south)
    toward = F.when(F.when(flat, east).otherwise(south) >= 0, 1).otherwise(-1)
    long, across = F.when(flat, F.col("c")).otherwise(F.col("r")), F.when(flat, F.col("r")).otherwise(F.col("c"))
    rise = F.tan(F.radians(F.greatest(elevation, F.lit(1.0)))) * F.sqrt(1 + lean * lean) * res
    ground = F.when(F.col("z").isNull() | F.isnan("z"), F.lit(-1e4)).otherwise(F.col("z"))
    rows = cells.select(*CELL, flat.alias("flat"), (across - F.rint(long * lean)).alias("line"), (long * toward).alias("at"), ground.alias("z"), rise.alias("rise"))
    sunward = Window.partitionBy("grid_id", "flat", "line").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("z") - F.col("rise") * F.col("at")
    return rows.select(*CELL, F.coalesce(F.max(own).over(sunward) > own, F.lit(False)).alias("shadow"))


def refined(mask: DataFrame, times: int) -> DataFrame:
    """The mask on a grid ``times`` as fine: each cell takes the coarse one that it lies in."""
    steps = F.sequence(F.lit(0), F.lit(times - 1))
    fine = mask.select("grid_id", "r", "c", F.explode(steps).alias("dr")).select("grid_id", (F.col("r") * times + F.col("dr")).alias("r"), "c", F.explode(steps).alias("dc"))
    return fine.select("grid_id", "r", (F.col("c") * times + F.col("dc")).alias("c"))


def relief(cells: DataFrame) -> DataFrame:
    """Highest less lowest of each grid; unknown heights say nothing."""
    known = F.when(~F.isnan("z"), F.col("z"))
    return cells.groupBy("grid_id").agg((F.max(known) - F.min(known)).alias("relief_m"))


def rim_coverage(mask: DataFrame, seen: DataFrame, least: int) -> DataFrame:
    """Share of the cells within two steps of each grid's mask, itself included, that ``seen(grid_id, r, c, n)`` at least ``least`` times."""
    rim = seen.join(dilate(mask, 2), CELL, "left_semi")
    return rim.groupBy("grid_id").agg((F.count_if(F.col("n") >= least) / F.count("*")).alias("coverage"))


def lake_extent(mask: DataFrame, res: float = 10.0) -> DataFrame:
    """Area, exposed edge and the uncertainty of half a cell along it."""
    edges = neighbours(mask, [o for o in NEIGHBOURS if 0 in o])
    inner = edges.join(mask.select(*CELL), CELL).groupBy("grid_id").agg(F.count("*").alias("shared"))
    area = mask.groupBy("grid_id").agg(F.count("*").alias("cells"))
    edge = (4 * F.col("cells") - F.coalesce("shared", F.lit(0))) * res
    return area.join(inner, "grid_id", "left").select("grid_id", (F.col("cells") * res * res).alias("area_m2"), edge.alias("perimeter_m"), (edge * res / 2).alias("uncertainty_m2"))


def fill_holes(spark: SparkSession, mask: DataFrame, cells: DataFrame) -> DataFrame:
    """The mask and the dry parts of its grid that do not reach the grid's edge."""
    dry = cells.select(*CELL).join(mask.select(*CELL), CELL, "left_anti")
    labelled = components(spark, dry, diagonal=False)
    box = cells.groupBy("grid_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("r", "c")])
    edge = labelled.join(box, "grid_id").where("r = lo_r or r = hi_r or c = lo_c or c = hi_c").select("grid_id", "label_r", "label_c").distinct()
    return mask.select(*CELL).unionByName(labelled.join(edge, ["grid_id", "label_r", "label_c"], "left_anti").select(*CELL))


def extract_lake(spark: SparkSession, cells: DataFrame, seeds: DataFrame, bridge: int = 10) -> DataFrame:
    """Lake cells from ``cells(grid_id, r, c, water, observed)``: the wettest part that meets ``seeds``.

    Unseen cells near water connect parts of a lake and seen dry ones do not; the
    lake itself is water, closed and filled. A grid whose seeds meet no water has none.
    """
    wet = cells.where("water").select(*CELL)
    unseen = cells.where("not observed").select(*CELL).join(dilate(wet, bridge), CELL, "left_semi")
    labelled = components(spark, wet.unionByName(unseen))
    label = ["grid_id", "label_r", "label_c"]
    met = labelled.join(seeds.select(*CELL), CELL, "left_semi").select(*label).distinct()
    sizes = labelled.join(wet, CELL, "left_semi").join(met, label, "left_semi").groupBy(*label).count()
    w = Window.partitionBy("grid_id").orderBy(F.desc("count"), "label_r", "label_c")
    best = sizes.withColumn("k", F.row_number().over(w)).where("k = 1").select(*label)
    lake = labelled.join(best, label, "left_semi").select(*CELL).join(wet, CELL, "left_semi")
    return fill_holes(spark, close(lake).unionByName(lake).distinct(), cells)


def spill_mask(spark: SparkSession, cells: DataFrame, lake: DataFrame, level: DataFrame, flat: float = 1.5, res: float = 1.0, steepest: float = 2.0) -> DataFrame:
    """The lake and the flat surface at its level that is connected to it.

    A surface cell is at the level and slopes less than ``steepest`` degrees, or is at
    the level beside such a cell: the bank makes a surface's own edge steep.
    """
    level_cells = slope(cells, res).join(level, "grid_id").where(F.abs(F.col("z") - F.col("level")) <= flat)
    calm = level_cells.where(F.col("slope") < steepest)
    near = level_cells.select(*CELL).join(dilate(calm, 1, True), CELL, "left_semi")
    labelled = components(spark, near.unionByName(lake.select(*CELL)))
    label = ["grid_id", "label_r", "label_c"]
    return labelled.join(labelled.join(lake.select(*CELL), CELL, "left_semi").select(*label).distinct(), label, "left_semi").select(*CELL)


def _nearest_point(cells: DataFrame, points: DataFrame, limit: float) -> DataFrame:
    """Cells with their nearest of ``points(grid_id, r, c, seq, ...)`` as ``p`` and its distance ``d``, up to about ``limit``; the first wins a tie.

    Cells and points meet in squares as wide as the limit, and the squares around.
    """
    wide = max(1, math.ceil(limit))
    square = lambda x: F.floor(F.col(x) / wide)
    rest = [c for c in points.columns if c not in ("grid_id", "seq")]
    around = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    p = points.select("grid_id", F.struct("seq", *rest).alias("p"), square("r").alias("br"), square("c").alias("bc"), F.explode(around).alias("o"))
    p = p.select("grid_id", "p", (F.col("br") + F.col("o.dr")).alias("br"), (F.col("bc") + F.col("o.dc")).alias("bc"))
    near = cells.withColumn("br", square("r")).withColumn("bc", square("c")).join(p, ["grid_id", "br", "bc"])
    d = F.hypot(F.col("r") - F.col("p.r"), F.col("c") - F.col("p.c"))
    return near.groupBy(*CELL).agg(F.min(F.struct(d.alias("d"), "p", "z")).alias("b")).select(*CELL, "b.*")


def _reached(spark: SparkSession, wet: DataFrame, path: DataFrame) -> DataFrame:
    """The components of ``wet`` that meet the path's cells."""
    labelled = components(spark, wet)
    label = ["grid_id", "label_r", "label_c"]
    return labelled.join(labelled.join(path.select(*CELL), CELL, "left_semi").select(*label).distinct(), label, "left_semi").select(*CELL)


def corridor(spark: SparkSession, cells: DataFrame, path: DataFrame, limit: float) -> DataFrame:
    """Cells below the level of their nearest path point, near enough and connected to the path.

    ``path(grid_id, seq, r, c, level)``: the first point wins a tie.
    """
    best = _nearest_point(cells, path.select("grid_id", "seq", "r", "c", "level"), limit)
    return _reached(spark, best.where((F.col("d") <= limit) & (F.col("z") < F.col("p.level"))).select(*CELL), path)


def flood_corridor(spark: SparkSession, cells: DataFrame, points: DataFrame, res: float, limit_m: float, lake: DataFrame | None = None) -> DataFrame:
    """The ground that a flood along a path reaches.

    ``points(grid_id, seq, x, y, level, tx, ty, left_m, right_m)``: places along the path in
    metres, each with the flood's level, the unit direction and how far the water reaches on the left, towards (-ty, tx), and on the right. A cell belongs if it
    is below its nearest point's level, no further from the path than ``limit_m`` and, within half a cell, than the reach of its side; not behind the
    first point nor beyond the last; not in ``lake``; and connected to the path, whose own cells all belong. The
    first point in a cell stands for it.
    """
    at = lambda v: F.rint(F.col(v) / res).cast("int")
    ends = points.groupBy("grid_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    one = points.withColumn("r", at("y")).withColumn("c", at("x")).groupBy(*CELL)
    one = one.agg(F.min_by(F.struct("seq", "x", "y", "level", "tx", "ty", "left_m", "right_m"), "seq").alias("p")).select(*CELL, "p.*")
    path = one.join(cells.select(*CELL), CELL, "left_semi")
    near = _nearest_point(cells.select(*CELL, "z"), path, limit_m / res).join(ends, "grid_id")
    dx, dy = F.col("c") * res - F.col("p.x"), F.col("r") * res - F.col("p.y")
    along, side = dx * F.col("p.tx") + dy * F.col("p.ty"), dy * F.col("p.tx") - dx * F.col("p.ty")
    tol = res / 2
    reach = F.when(side >= 0, F.col("p.left_m")).otherwise(F.col("p.right_m")) + tol
    known = F.col("z").isNotNull() & ~F.isnan("z") & (F.col("z") < F.col("p.level"))
    behind, beyond = (F.col("p.seq") == F.col("first")) & (along < -tol), (F.col("p.seq") == F.col("last")) & (along > tol)
    wet = near.where(known & (F.col("d") * res <= F.least(F.lit(limit_m), reach)) & ~behind & ~beyond).select(*CELL)
    if lake is not None:
        wet = wet.join(lake.select(*CELL).distinct(), CELL, "left_anti")
    return _reached(spark, wet.unionByName(path.select(*CELL)).distinct(), path)
