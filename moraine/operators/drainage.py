"""Ways out of pits, filled heights and flow paths over a mosaic of any size.

Cells are rows, so no tile is put together anywhere and a path crosses tiles like any
other step. A pit's basin leaves over the lowest pass of its edge: basins are joined
over their lowest passes, all at once, until each reaches the rim (minimum spanning tree in
Boruvka's rounds). Then the cells between a pit and its pass are turned round, so that
every receiver leads on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.operators import graph, raster
from moraine.sources.workspace import Work

#: The row that no cell has: all basins that reach the rim are one.
OUTSIDE = -(2**31)


def _node(prefix: str = "") -> Column:
    return F.struct("grid_id", F.col(f"{prefix}r").alias("r"), F.col(f"{prefix}c").alias("c"))


def _open(cells: DataFrame) -> DataFrame:
    shut = F.coalesce("blocked", F.lit(False)) if "blocked" in cells.columns else F.lit(False)
    return cells.where(F.col("z").isNotNull() & ~F.isnan("z") & ~shut).select(*raster.CELL, F.col("z").cast("double").alias("z"))


def _steps(cells: DataFrame) -> DataFrame:
    """(node, to, z, end): each open cell's steepest lower neighbour; cells of the rim and pits point to themselves."""
    box = cells.groupBy("grid_id").agg(*[f(x).alias(f"{n}_{x}") for n, f in (("lo", F.min), ("hi", F.max)) for x in ("r", "c")])
    open_ = _open(cells)
    to = raster.receivers(open_).join(open_, raster.CELL).join(box, "grid_id")
    rim = F.col("r").isin(F.col("lo_r"), F.col("hi_r")) | F.col("c").isin(F.col("lo_c"), F.col("hi_c"))
    leads = F.when(rim | F.col("to_r").isNull(), _node()).otherwise(_node("to_"))
    return to.select(_node().alias("node"), leads.alias("to"), "z", rim.alias("rim"))


def _passes(steps: DataFrame, basin: DataFrame) -> DataFrame:
    """(a, b, way): for each ordered pair of neighbouring basins the lowest pass from a cell u of a to a cell v of b.

    A pass has the height of its higher cell; ties go by its cells, so no two passes are equal.
    """
    rim = steps.where("rim").select(F.col("node").alias("root"), F.lit(True).alias("out"))
    label = F.when(F.col("out"), F.struct("root.grid_id", F.lit(OUTSIDE).alias("r"), F.lit(OUTSIDE).alias("c"))).otherwise(F.col("root"))
    labelled = steps.select("node", "z").join(basin, "node").join(rim, "root", "left").select("node.*", "z", label.alias("basin"))
    here = labelled.select("grid_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("z").alias("z0"), F.col("basin").alias("a"))
    met = raster.neighbours(labelled, [o for o in raster.NEIGHBOURS if o > (0, 0)]).join(labelled, raster.CELL).withColumnRenamed("basin", "b")
    met = met.join(here, ["grid_id", "r0", "c0"]).where("a <> b").select("a", "b", F.greatest("z", "z0").alias("h"), _node().alias("v"), F.struct("grid_id", F.col("r0").alias("r"), F.col("c0").alias("c")).alias("u"))
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "h", F.col("u").alias("v"), F.col("v").alias("u")))
    return both.groupBy("a", "b").agg(F.min(F.struct("h", F.least("u", "v").alias("one"), F.greatest("u", "v").alias("other"), "u", "v")).alias("way"))


def _turned(work: Work, pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """``pointers(node, to, u, v)`` with those between ``starts(node)`` and their roots turned round; the starts have none."""
    loops = pointers.select("to").join(pointers.select(F.col("node").alias("to")), "to", "left_anti").distinct()
    plain = pointers.select("node", "to").unionByName(loops.select(F.col("to").alias("node"), "to"))
    alone = starts.select("node").join(plain, "node", "left_anti")
    way = graph.on_the_way(work, work.cut(plain.unionByName(alone.select("node", F.col("node").alias("to")))), starts)
    way = work.cut(way)
    turned = pointers.join(way, "node").select(F.col("to").alias("node"), F.col("node").alias("to"), F.col("v").alias("u"), F.col("u").alias("v"))
    return pointers.join(way, "node", "left_anti").unionByName(turned)


def _basin_tree(work: Work, edges: DataFrame, heights: DataFrame) -> DataFrame:
    """(node, to, u, v): for each basin the next one on its way out, from its cell u to the next one's v.

    ``heights(node, z)`` are the pits'. Basins that no pass leads to the rim lead to the lowest pit among them.
    """
    edges = work.cut(edges.select("a", "b", "way", F.col("a").alias("from"), F.col("b").alias("into")))
    tree, outside = None, F.col("from.r") == OUTSIDE
    while True:
        best = edges.where(~outside).groupBy("from").agg(F.min(F.struct("way", "a", "b", "into")).alias("x")).select("from", "x.*")
        best, n = work.counted(best, F.lit(True))
        if not n:
            break
        # Two that choose each other share a pass: the lesser one waits.
        other = best.select(F.col("from").alias("into"), F.col("into").alias("back"))
        hooked = best.join(other, "into", "left").where("back is null or back <> `from` or `from` > `into`").drop("back")
        hooked = work.cut(hooked, best)
        new = hooked.select(F.col("a").alias("node"), F.col("b").alias("to"), "way.u", "way.v")
        if tree is not None:
            new = _turned(work, tree, hooked.select(F.col("a").alias("node"))).unionByName(new)
        tree = work.cut(new, tree)
        groups = edges.select(F.col("from").alias("node")).distinct().join(hooked.select(F.col("from").alias("node"), F.col("into").alias("to")), "node", "left")
        outer = edges.select(F.col("into").alias("node")).where(F.col("node.r") == OUTSIDE).distinct().withColumn("to", F.col("node"))
        now = graph.roots(work, work.cut(groups.select("node", F.coalesce("to", "node").alias("to")).unionByName(outer).distinct()))
        moved = edges.join(now.select(F.col("node").alias("from"), F.col("root").alias("f")), "from").join(now.select(F.col("node").alias("into"), F.col("root").alias("i")), "into")
        moved = moved.where("f <> i").groupBy(F.col("f").alias("from"), F.col("i").alias("into")).agg(F.min(F.struct("way", "a", "b")).alias("x"))
        edges = work.cut(moved.select("x.a", "x.b", "x.way", "from", "into"), edges, hooked)
    if tree is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("to"), "way.u", "way.v").limit(0)
    ends = tree.select("to").join(tree.select(F.col("node").alias("to")), "to", "left_anti").distinct()
    inner = graph.roots(work, work.cut(tree.select("node", "to").unionByName(ends.select(F.col("to").alias("node"), "to"))))
    lowest = inner.where(F.col("root.r") != OUTSIDE).join(heights, "node").groupBy("root").agg(F.min(F.struct("z", "node")).alias("x"))
    lowest, n = work.counted(lowest.where("x.node <> root").select("x.node"), F.lit(True))
    return work.cut(_turned(work, tree, lowest), tree) if n else tree


def ways_out(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """(grid_id, r, c, to_r, to_c): where each open cell of ``cells(grid_id, r, c, z[, blocked])`` drains to, pits included.

    Downhill by the steepest neighbour; from a pit over the lowest pass that leads on, at last to the
    rim, the grid's edge, where ``to_r`` is null. Blocked cells and cells of unknown height carry no water. Ground that they shut
    off drains to its lowest pit.
    """
    work = Work(spark)
    steps = work.cut(_steps(cells))
    basin = graph.roots(work, steps)
    pits = steps.where("node = to and not rim").select("node", "z")
    tree = _basin_tree(work, _passes(steps, basin), pits)
    out = work.cut(tree.select("u", "v"))
    way = work.cut(graph.on_the_way(work, steps, out.select(F.col("u").alias("node"))))
    turned = steps.join(way, "node").where("node <> to").select(F.col("to").alias("node"), F.col("node").alias("to"))
    kept = steps.select("node", "to").join(way, "node", "left_anti")
    led = kept.unionByName(turned).unionByName(out.select(F.col("u").alias("node"), F.col("v").alias("to")))
    # The pit of ground that is shut off has no way out: it is on no such way, and points to itself.
    ends = F.col("node") != F.col("to")
    return work.result(led.select("node.*", F.when(ends, F.col("to.r")).alias("to_r"), F.when(ends, F.col("to.c")).alias("to_c")))


def filled(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """(grid_id, r, c, level): the height that water must reach in each open cell to leave: the greatest on its way out."""
    work = Work(spark)
    to = ways_out(spark, cells).join(_open(cells), raster.CELL)
    here, moved = to.select(_node().alias("node"), F.when(F.col("to_r").isNull(), _node()).otherwise(_node("to_")).alias("to"), F.col("z").alias("level")), 1
    here = work.cut(here)
    while moved:
        on = here.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("level").alias("beyond"))
        new = here.join(on, "to").select("node", F.col("next").alias("to"), F.greatest("level", "beyond").alias("level"), (F.col("next") != F.col("to")).alias("moved"))
        here, moved = work.counted(new, F.col("moved"), here)
    return work.result(here.select("node.*", "level"))


def trace_paths(spark: SparkSession, cells: DataFrame, starts: DataFrame, res: float = 1.0, most_m: float = math.inf) -> DataFrame:
    """(grid_id, path_id, seq, r, c, along_m): the flow path of each of ``starts(grid_id, r, c[, path_id])`` over ``cells(grid_id, r, c, z[, blocked])``.

    A path goes down the steepest neighbour, leaves pits over their lowest pass, enters no
    blocked or unknown cell and no cell twice, and ends at the grid's edge or once it
    is ``most_m`` long. A start is open, even in a blocked lake. Without ``path_id`` it is the grid's id. A grid
    may be a mosaic of any number of tiles: paths follow cells, wherever they lie.
    """
    if "path_id" not in starts.columns:
        starts = starts.withColumn("path_id", F.col("grid_id"))
    at = starts.select(*raster.CELL).distinct().withColumn("start", F.lit(True))
    shut = F.coalesce("blocked", F.lit(False)) if "blocked" in cells.columns else F.lit(False)
    opened = cells.join(at, raster.CELL, "left").select(*raster.CELL, "z", (shut & F.col("start").isNull()).alias("blocked"))
    work = Work(spark)
    to = work.owns(ways_out(spark, opened))
    path = work.owns(raster.flow_paths(spark, to, starts, most_m / res + 1))
    order = Window.partitionBy("path_id").orderBy("seq")
    step = F.coalesce(F.hypot(F.col("r") - F.lag("r").over(order), F.col("c") - F.lag("c").over(order)) * res, F.lit(0.0))
    far = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    long = path.withColumn("step", step).withColumn("along_m", far).where((F.col("seq") == 0) | (F.col("along_m") - F.col("step") < most_m))
    return work.result(long.select("grid_id", "path_id", "seq", "r", "c", "along_m"))
