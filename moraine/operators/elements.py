"""Map elements as assets: what they are, and where.

Points stay points, ways are lines or areas, and a relation's outer ways are joined at their ends into rings.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import rules
from moraine.operators import outlines

#: The tags that an asset keeps.
KEPT_TAGS = (
    "name", "name:hi", "name:en", "place", "population", "highway", "bridge", "power", "plant:source", "generator:source",
    "plant:output:electricity", "waterway", "amenity", "operator", "ref", "wikidata",
)
POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"


def is_area(tags: Column) -> Column:
    """A closed way is an area, unless it says no or is a road or barrier that does not say yes."""
    area = F.try_element_at(tags, F.lit("area"))
    line = F.map_contains_key(tags, F.lit("highway")) | F.map_contains_key(tags, F.lit("barrier"))
    return F.when(F.coalesce(area == "no", F.lit(False)), False).when(line, F.coalesce(area == "yes", F.lit(False))).otherwise(True)


def joined(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings made of lines that meet at their ends, each used once; lines that close none are left out."""
    out = [line for line in lines if len(line) > 3 and line[0] == line[-1]]
    loose = {k: line for k, line in enumerate(lines) if line[0] != line[-1]}
    at = defaultdict(set)
    for k, line in loose.items():
        at[line[0]].add(k)
        at[line[-1]].add(k)
    while loose:
        first, ring = loose.popitem()
        used = [first]
        ring = list(ring)
        while ring[0] != ring[-1]:
            ways = (at[ring[-1]] & loose.keys()) - set(used)
            if not ways:
                break
            used.append(min(ways))
            line = loose.pop(used[-1])
            ring += line[1:] if line[0] == ring[-1] else line[-2::-1]
        if ring[0] == ring[-1] and len(ring) > 3:
            out.append(ring)
    return out


def outer_rings(relations: DataFrame) -> DataFrame:
    """``relations(..., lines)`` with the rings of ``lines``: array of arrays of struct<x, y>, each a way in order.

    A relation is one row, and an element of the map, whose number of members is bounded; rows are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings = [joined([[(p["x"], p["y"]) for p in line] for line in lines or []]) for lines in b.column("lines").to_pylist()]
            kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            found = pa.array([[[{"x": x, "y": y} for x, y in ring] for ring in r] for r in rings], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "rings"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in relations.schema.fields)
    return relations.mapInArrow(run, f"{fields}, rings {RINGS}")


def assets(elements: DataFrame) -> DataFrame:
    """(osm_type, osm_id, kind, subkind, name, name_hi, tags, shape, point, line, rings) of the elements that are tracked and can be placed.

    ``elements(type, id, tags, x, y, geometry, members)`` with ``geometry`` an array of struct<x, y> and ``members`` of struct<type,
    role, x, y, geometry>. A closed way that is an area has one ring, others a line. A relation has the rings
    of its outer members (role outer or none), which may be split over several ways; failing that the middle of these lines, failing
    them that of its nodes. Elements without a place go, and of rows that repeat a type and id one stays. Unknown points of a geometry are passed over.
    """
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    rows = elements.withColumn("tags", tags).withColumn("what", rules.classify_kind(F.col("tags"))).where("what is not null")
    known = lambda g: F.filter(F.coalesce(g, F.array().cast(f"array<{POINT}>")), lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    way = known(F.col("geometry"))
    members = F.coalesce("members", F.array().cast(elements.schema["members"].dataType))
    outer = F.filter(members, lambda m: (m["type"] == "way") & F.coalesce(m["role"], F.lit("")).isin("outer", ""))
    lines = F.filter(F.transform(outer, lambda m: known(m["geometry"])), lambda g: F.size(g) > 1)
    nodes = F.transform(F.filter(members, lambda m: (m["type"] == "node") & m["x"].isNotNull() & m["y"].isNotNull()), lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y")))
    none = F.lit(None)
    rows = rows.select(
        F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), "what.kind", "what.subkind", F.try_element_at("tags", F.lit("name")).alias("name"),
        F.try_element_at("tags", F.lit("name:hi")).alias("name_hi"), F.map_filter("tags", lambda k, _: k.isin(*KEPT_TAGS)).alias("kept"), "tags",
        F.when((F.col("type") == "node") & F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y")).alias("node"),
        F.when((F.col("type") == "way") & (F.size(way) > 1), way).alias("way"), F.when(F.col("type") == "relation", lines).alias("lines"), F.when(F.col("type") == "relation", nodes).alias("nodes"),
    )
    placed = outer_rings(rows.where("osm_type = 'relation'")).unionByName(rows.where("osm_type <> 'relation'").withColumn("rings", none.cast(RINGS)))
    closed = (F.size("way") > 3) & (F.get("way", F.lit(0)) == F.get("way", F.size("way") - 1)) & is_area(F.col("tags"))
    mean = lambda v: F.aggregate("nodes", F.lit(0.0), lambda a, p: a + p[v]) / F.size("nodes")
    middle = F.coalesce(outlines.centroid_of_lines(F.col("lines")), F.when((F.size("lines") == 0) & (F.size("nodes") > 0), F.struct(mean("x").alias("x"), mean("y").alias("y"))))
    placed = placed.withColumn("rings", F.when(closed, F.array("way")).otherwise(F.when(F.size("rings") > 0, F.col("rings"))))
    placed = placed.withColumn("line", F.when(F.col("rings").isNull(), F.col("way"))).withColumn("point", F.coalesce("node", F.when(F.col("rings").isNull(), middle)))
    shape = F.when(F.col("rings").isNotNull(), "area").when(F.col("line").isNotNull(), "line").when(F.col("point").isNotNull(), "point")
    out = placed.withColumn("shape", shape).where("shape is not null")
    once = F.row_number().over(Window.partitionBy("osm_type", "osm_id").orderBy("shape", F.to_json(F.struct("point", "line", "rings"))))
    return out.withColumn("k", once).where("k = 1").select("osm_type", "osm_id", "kind", "subkind", "name", "name_hi", F.col("kept").alias("tags"), "shape", "point", "line", "rings")
