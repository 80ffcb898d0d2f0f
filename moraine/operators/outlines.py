"""Outlines of masks as rings, rings as masks, simpler lines, and lines cut at polygons.

An outline is made of the sides that a mask's cells do not share, each an edge from
corner to corner with its cell on the right. Edges know the next one by a join on corners; rings of any
length are told apart and numbered by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import geo
from moraine.operators.raster import CELL
from moraine.sources.workspace import Work

#: A cell's sides in the order in which they are walked: the neighbour beyond, and both corners, in rows and columns.
SIDES = [((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))]


def _edges(mask: DataFrame) -> DataFrame:
    """(grid_id, cell, side, r, c, r2, c2): the sides between the mask and the rest, from corner (r, c) to (r2, c2)."""
    cells = mask.select(*CELL).distinct()
    side = F.array(*[
        F.struct(F.lit(k).alias("side"), *[F.lit(x).alias(n) for n, x in zip(("nr", "nc", "ar", "ac", "br", "bc"), (*o, *a, *b), strict=True)])
        for k, (o, a, b) in enumerate(SIDES)
    ])
    at = cells.select("grid_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(side).alias("s"))
    at = at.select("grid_id", "r0", "c0", "s.side", *[(F.col(f"{x}0") + F.col(f"s.n{x}")).alias(x) for x in "rc"], *[(F.col(f"{x}0") + F.col(f"s.{p}{x}")).alias(f"{p}{x}") for p in "ab" for x in "rc"])
    shown = at.join(cells, CELL, "left_anti")
    return shown.select("grid_id", F.struct(F.col("r0").alias("r"), F.col("c0").alias("c")).alias("cell"), "side", F.col("ar").alias("r"), F.col("ac").alias("c"), F.col("br").alias("r2"), F.col("bc").alias("c2"))


def rings(spark: SparkSession, mask: DataFrame) -> DataFrame:
    """(grid_id, ring, seq, r, c): the corners of the rings around ``mask(grid_id, r, c)``, where they turn, in order.

    Outer rings run clockwise, rows counted downwards, and those of holes against it. Cells that touch at a
    corner alone have rings of their own. A ring is named by its least edge, which is in the first row it reaches.
    """
    work = Work(spark)
    edges = work.cut(_edges(mask))
    node = F.struct("cell", "side")
    ahead = edges.select("grid_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("cell").alias("cell2"), F.struct("cell", "side").alias("to"))
    # Where two rings meet at a corner, an edge is followed by the other one of its own cell.
    own = F.struct((F.col("cell") != F.col("cell2")).alias("other"), "to")
    follows = edges.join(ahead, ["grid_id", "r2", "c2"]).groupBy("grid_id", node.alias("node")).agg(F.min(own)["to"].alias("to"))
    here, steps, changed = work.cut(follows.select("grid_id", "node", "to", F.struct(F.col("node").alias("least"), F.lit(0).cast("long").alias("far")).alias("m"))), 1, 1
    while changed:
        on = here.select("grid_id", F.col("node").alias("to"), F.col("to").alias("next"), F.struct("m.least", (F.col("m.far") + steps).alias("far")).alias("beyond"))
        new = here.join(on, ["grid_id", "to"]).select("grid_id", "node", F.col("next").alias("to"), F.least("m", "beyond").alias("m"), (F.col("beyond") < F.col("m")).alias("changed"))
        here, changed = work.counted(new, F.col("changed"), here)
        steps *= 2
    size = here.groupBy("grid_id", F.col("m.least").alias("ring")).agg(F.count("*").alias("size"))
    placed = here.select("grid_id", "node", F.col("m.least").alias("ring"), "m.far").join(size, ["grid_id", "ring"])
    placed = placed.select("grid_id", "ring", "node.*", ((F.col("size") - F.col("far")) % F.col("size")).alias("seq")).join(edges, ["grid_id", "cell", "side"])
    order = Window.partitionBy("grid_id", "ring").orderBy("seq")
    last = F.last("side").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turns = placed.withColumn("before", F.coalesce(F.lag("side").over(order), last)).where("side <> before")
    return work.result(turns.select("grid_id", F.struct("ring.cell.r", "ring.cell.c", "ring.side").alias("ring"), "seq", "r", "c"))


def _closed(rings_: DataFrame) -> DataFrame:
    """Corners with the next one of their ring as (r2, c2)."""
    order = Window.partitionBy("grid_id", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rings_.select("*", *[F.coalesce(F.lead(x).over(order), F.first(x).over(whole)).alias(f"{x}2") for x in ("r", "c")])


def ring_sizes(rings_: DataFrame) -> DataFrame:
    """(grid_id, ring, area, length) in cells; the area of a hole's ring is negative."""
    area = F.sum(F.col("c") * F.col("r2") - F.col("c2") * F.col("r")) / 2
    return _closed(rings_).groupBy("grid_id", "ring").agg(area.alias("area"), F.sum(F.abs(F.col("r2") - F.col("r")) + F.abs(F.col("c2") - F.col("c"))).alias("length"))


def cells_of(rings_: DataFrame) -> DataFrame:
    """The mask that rings enclose, row by row: from each odd crossing of the row to the next one."""
    upright = _closed(rings_).where("c = c2").select("grid_id", "c", F.explode(F.sequence(F.least("r", "r2"), F.greatest("r", "r2") - 1)).alias("r"))
    row = Window.partitionBy("grid_id", "r").orderBy("c")
    spans = upright.select("grid_id", "r", F.col("c").alias("from"), F.lead("c").over(row).alias("to"), (F.row_number().over(row) % 2).alias("odd"))
    return spans.where("odd = 1 and to > `from`").select("grid_id", "r", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("c"))


def simplify(spark: SparkSession, lines: DataFrame, tolerance: float) -> DataFrame:
    """``lines(line_id, seq, x, y)`` with the points that keep every line within ``tolerance`` of what it was.

    Between two kept points the furthest one from their chord is kept too, if it is beyond the tolerance, the
    first on a tie; all gaps of all lines at once, until none has one. Ends stay.
    """
    work = Work(spark)
    whole = Window.partitionBy("line_id")
    ends = (F.col("seq") == F.min("seq").over(whole)) | (F.col("seq") == F.max("seq").over(whole))
    points, more = work.cut(lines.select("line_id", "seq", "x", "y").withColumn("kept", ends)), 1
    order = whole.orderBy("seq")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("kept"), F.struct("seq", "x", "y"))
    while more:
        gaps = points.withColumn("a", F.last(mark, True).over(before)).withColumn("b", F.first(mark, True).over(after))
        off = geo.segment_distance(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
        gaps = gaps.withColumn("off", F.when(~F.col("kept"), off))
        gap = Window.partitionBy("line_id", "a.seq").orderBy(F.desc_nulls_last("off"), "seq")
        chosen = gaps.withColumn("k", F.row_number().over(gap)).withColumn("add", F.coalesce((F.col("k") == 1) & (F.col("off") > tolerance), F.lit(False)))
        # Points of gaps without one to add are settled.
        points, more = work.counted(chosen.select("line_id", "seq", "x", "y", (F.col("kept") | F.col("add")).alias("kept"), "add"), F.col("add"), points)
    return work.result(points.where("kept").select("line_id", "seq", "x", "y"))


def length_inside(spark: SparkSession, lines: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """(line_id, area_id, inside): how much of ``lines(line_id, seq, x, y)`` lies in each of ``areas(area_id, ring)`` it meets.

    Segments are cut where they cross the ring's edges: both are dealt to squares of ``cell``, and meet
    there. A piece is in or out by turns, from where the segment begins. An edge that a segment only touches with one end
    counts for one side, so no piece is counted twice.
    """
    order = Window.partitionBy("line_id").orderBy("seq")
    seg = lines.select("line_id", "seq", "x", "y", F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).where("x2 is not null")
    seg = seg.select(F.struct("line_id", "seq").alias("id"), "x", "y", "x2", "y2")
    n = F.size("ring")
    edge = F.explode(F.sequence(F.lit(0), n - 1)).alias("k")
    edges = areas.where(n > 2).select("area_id", "ring", edge)
    end = lambda k, v: F.get("ring", k)[v]
    nxt = F.when(F.col("k") + 1 < n, F.col("k") + 1).otherwise(0)
    edges = edges.select("area_id", "k", end(F.col("k"), "x").alias("ex"), end(F.col("k"), "y").alias("ey"), end(nxt, "x").alias("ex2"), end(nxt, "y").alias("ey2"))

    def dealt(df: DataFrame, x: str, y: str) -> DataFrame:
        span = lambda v: F.sequence(F.floor(F.least(v, f"{v}2") / cell), F.floor(F.greatest(v, f"{v}2") / cell))
        return df.withColumn("bx", F.explode(span(x))).withColumn("by", F.explode(span(y)))

    met = dealt(seg, "x", "y").join(dealt(edges, "ex", "ey"), ["bx", "by"]).drop("bx", "by").distinct()
    side = lambda px, py, ax, ay, bx, by: (F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax))
    met = met.withColumn("p", side("ex", "ey", "x", "y", "x2", "y2")).withColumn("q", side("ex2", "ey2", "x", "y", "x2", "y2"))
    met = met.withColumn("s", side("x", "y", "ex", "ey", "ex2", "ey2")).withColumn("e", side("x2", "y2", "ex", "ey", "ex2", "ey2"))
    # Half open: an end on the line counts as its left, so two edges that share a corner count once.
    crossing = ((F.col("p") >= 0) != (F.col("q") >= 0)) & ((F.col("s") >= 0) != (F.col("e") >= 0))
    cuts = met.where(crossing).groupBy("id", "area_id").agg(F.array_sort(F.collect_list(F.col("s") / (F.col("s") - F.col("e")))).alias("cuts"))
    first = seg.select("id", "x", "y", "x2", "y2", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("length"))
    box = areas.where(n > 2).select("area_id", "ring", *[f(F.col(f"ring.{v}")).alias(f"{k}{v}") for v in "xy" for k, f in (("lo", F.array_min), ("hi", F.array_max))])
    tiles = box.withColumn("bx", F.explode(F.sequence(F.floor(F.col("lox") / cell), F.floor(F.col("hix") / cell)))).withColumn("by", F.explode(F.sequence(F.floor(F.col("loy") / cell), F.floor(F.col("hiy") / cell))))
    begun = first.withColumn("bx", F.floor(F.col("x") / cell)).withColumn("by", F.floor(F.col("y") / cell)).join(tiles, ["bx", "by"])
    begun = begun.where(geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("id", "area_id", F.lit(True).alias("begins"))
    both = begun.join(cuts, ["id", "area_id"], "full").join(first.select("id", "length"), "id")
    marks = F.concat(F.when(F.col("begins"), F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>")), F.coalesce("cuts", F.array().cast("array<double>")))
    whole = F.when(F.size("marks") % 2 == 1, F.concat("marks", F.array(F.lit(1.0)))).otherwise(F.col("marks"))
    share = F.aggregate(F.sequence(F.lit(0), F.size("whole") - 1), F.lit(0.0), lambda a, k: a + F.get("whole", k) * F.when(k % 2 == 1, 1.0).otherwise(-1.0))
    out = both.withColumn("marks", marks).withColumn("whole", whole).withColumn("share", share)
    return out.groupBy("id.line_id", "area_id").agg(F.sum(F.col("share") * F.col("length")).alias("inside"))


def centroid_of_lines(points: Column) -> Column:
    """Length-weighted middle of lines, an array of arrays of struct<x, y>; null without length."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"))

    def add(acc: Column, line: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            p, q = F.get(line, k), F.get(line, k + 1)
            w = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
            return F.struct((a["x"] + w * (p["x"] + q["x"]) / 2).alias("x"), (a["y"] + w * (p["y"] + q["y"]) / 2).alias("y"), (a["w"] + w).alias("w"))

        return F.when(F.size(line) > 1, F.aggregate(F.sequence(F.lit(0), F.size(line) - 2), acc, step)).otherwise(acc)

    total = F.aggregate(points, zero, add)
    return F.when(total["w"] > 0, F.struct((total["x"] / total["w"]).alias("x"), (total["y"] / total["w"]).alias("y")))
