"""Districts and states of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators import spatial

#: The administrative levels of states and districts.
STATE, DISTRICT = 4, 5


def district_states(districts: DataFrame, states: DataFrame, members: DataFrame, cell: float = 1.0) -> DataFrame:
    """``districts(area_id, x, y, is_in)`` with their state: the state around (x, y), a point inside them, else the one that lists
    the district in ``members(state, ref)`` as a subarea, else what its own tag says.

    ``states(area_id, name, ring, size, x0, y0, x1, y1)``; of several around the smallest counts.
    """
    around = spatial.in_polygon(districts.select(F.col("area_id").alias("point_id"), "x", "y"), states.drop("name"), cell)
    named = around.join(states.select("area_id", F.col("name").alias("around")), "area_id", "left").select(F.col("point_id").alias("area_id"), "around")
    listed = members.groupBy(F.col("ref").alias("area_id")).agg(F.min("state").alias("listed"))
    out = districts.join(named, "area_id", "left").join(listed, "area_id", "left")
    return out.withColumn("state", F.coalesce("around", "listed", "is_in")).drop("around", "listed")


def subareas(relations: DataFrame) -> DataFrame:
    """(state, ref) of the relations that states of ``relations(level, name, members)`` list as subareas."""
    member = F.explode("members").alias("m")
    return relations.where(F.col("level") == STATE).select(F.col("name").alias("state"), member).where("m.type = 'relation' and m.role = 'subarea'").select("state", F.col("m.ref").alias("ref"))


def assign(points: DataFrame, areas: DataFrame, cell: float = 1.0) -> DataFrame:
    """``points(point_id, x, y)`` with their district and state, null where none is around.

    ``areas(area_id, level, name, state, ring, size, x0, y0, x1, y1)``: of each level the smallest area around counts;
    outside all states a point has its district's.
    """
    out = points.select("point_id")
    for level, name in ((DISTRICT, "district"), (STATE, "around")):
        of = areas.where(F.col("level") == level)
        found = spatial.in_polygon(points, of.drop("level", "name", "state"), cell)
        more = [F.col("state").alias("of_district")] if level == DISTRICT else []
        out = out.join(found.join(of.select("area_id", F.col("name").alias(name), *more), "area_id", "left").drop("area_id"), "point_id")
    return out.select("point_id", "district", F.coalesce("around", "of_district").alias("state"))
