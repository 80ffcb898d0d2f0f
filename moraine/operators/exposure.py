"""Assets along a flood: choice, scenario merge, counts, runs and geometry joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import rules
from moraine.operators import routing

STATUSES = ("in_flood_path", "at_risk", "outside")
KINDS = ("settlement", "school", "health", "hydro", "bridge", "road")


def first_per(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a full order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def merge_scenarios(rows: DataFrame) -> DataFrame:
    """``rows(lake_id, osm, scenario, outcome, km, kind)``, one a scenario, to one an asset."""
    of = lambda s: F.max(F.when(F.col("scenario") == s, F.col("outcome")))
    out = rows.groupBy("lake_id", "osm").agg(
        F.min(F.struct("km", "kind")).alias("near"), of("expected").alias("expected"), of("severe").alias("severe")
    )
    return out.select(
        "lake_id", "osm", F.col("near.kind").alias("kind"), F.col("near.km").alias("km"), "expected", "severe",
        rules.merged_status(F.col("expected"), F.col("severe")).alias("status"),
    )


def filter_impacts(rows: DataFrame, status: str = "", kind: str = "") -> DataFrame:
    """Comma lists of statuses and kinds; an empty list is no filter, an unknown value an error."""
    for column, given, known in (("status", status, STATUSES), ("kind", kind, KINDS)):
        wanted = [x.strip() for x in given.split(",") if x.strip()]
        if unknown := set(wanted) - set(known):
            raise ValueError(f"unknown {column}: {', '.join(sorted(unknown))}")
        if wanted:
            rows = rows.where(F.col(column).isin(wanted))
    return rows


def exposed_counts(rows: DataFrame) -> DataFrame:
    """Assets of each lake and each kind in the flood path and at risk, zero where none."""
    of = lambda status, kind: F.count_if((F.col("status") == status) & (F.col("kind") == kind))
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), *[of(s, k).alias(s) for s in STATUSES[:2]]) for k in KINDS])
    return rows.groupBy("lake_id").agg(counts.alias("counts")).select("lake_id", F.inline("counts"))


def first_exposed(rows: DataFrame) -> DataFrame:
    """The first exposed asset and settlement of each lake, by distance then id."""
    hit = F.col("status") != "outside"
    row = F.struct("km", "osm")
    return rows.groupBy("lake_id").agg(
        F.min(F.when(hit, row)).alias("a"), F.min(F.when(hit & (F.col("kind") == "settlement"), row)).alias("s")
    ).select("lake_id", F.col("a.osm").alias("first_exposed"), F.col("s.osm").alias("first_settlement"))


def merge_runs(rows: DataFrame, key: str, gap: float = 1.0) -> DataFrame:
    """Neighbours of one key within ``gap`` of the run's first row, as one row: (lake_id, run, key, from_km, to_km, n, fast_min).

    The run's first row decides, so it is a fold in order: rows come sorted, and a
    task holds one run and its lake's number of runs, however many rows a lake has.
    """
    ordered = rows.select("lake_id", F.col("km").cast("double").alias("km"), "seq", F.col(key).cast("string").alias("key"), F.col("fast_min").cast("double").alias("fast_min"))
    ordered = ordered.repartition("lake_id").sortWithinPartitions("lake_id", "km", "seq", "key", "fast_min").select("lake_id", "km", "key", "fast_min")
    names = ["lake_id", "run", "key", "from_km", "to_km", "n", "fast_min"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, kind = None, None

        def batch(done: list[list]) -> pa.RecordBatch:
            kinds = [kind, pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            kind, done = b.column("lake_id").type, []
            for lake, km, what, fast in zip(*(b.column(c).to_pylist() for c in ("lake_id", "km", "key", "fast_min")), strict=True):
                same = run is not None and run[0] == lake
                if same and run[2] == what and what is not None and km is not None and run[3] is not None and km - run[3] <= gap:
                    run[4], run[5] = km, run[5] + 1
                    run[6] = fast if run[6] is None else run[6] if fast is None else min(run[6], fast)
                else:
                    if run is not None:
                        done.append(run)
                    run = [lake, run[1] + 1 if same else 0, what, km, km, 1, fast]
            if done:
                yield batch(done)
        if run is not None:
            yield batch([run])

    kinds = f"lake_id {rows.schema['lake_id'].dataType.simpleString()}, run int, key string, from_km double, to_km double, n long, fast_min double"
    return ordered.mapInArrow(fold, kinds)


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ways(way_id, refs)`` with their points in order, ways with a missing node left out."""
    refs = ways.select("way_id", F.size("refs").alias("n"), F.posexplode("refs").alias("at", "node_id"))
    got = refs.join(nodes, "node_id").groupBy("way_id", "n").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("p"))
    return got.where(F.size("p") == F.col("n")).select("way_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


def chunk_gaps(done: DataFrame, lakes: DataFrame, width: float = 20.0) -> DataFrame:
    """Ranges of ``lakes(lake_id, path_km)`` that no row of ``done(lake_id, km)`` covers."""
    n = F.ceil(F.col("path_km") / width).cast("int")
    want = lakes.where(n > 0).select("lake_id", "path_km", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    have = done.select("lake_id", F.floor(F.col("km") / width).cast("int").alias("chunk")).distinct()
    left = want.join(have, ["lake_id", "chunk"], "left_anti")
    return left.select("lake_id", (F.col("chunk") * width).alias("from_km"), F.least((F.col("chunk") + 1) * width, F.col("path_km")).alias("to_km"))


def assess(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Status of each asset from its sample points.

    ``samples(path_id, asset_id, point, kind, km, ground_m, reached, near)`` against
    ``stations(path_id, km, wse_m)``. An asset's height is its lowest reached ground
    above the flood, else its lowest ground; heights are in tenths before their sign
    is read. Unknown ground says nothing.
    """
    keyed = samples.withColumn("asset", F.struct("asset_id", "point"))
    levels = routing.level_along(keyed.select("path_id", "km", F.col("asset").alias("asset_id")), stations).select("path_id", F.col("asset_id").alias("asset"), "level_m")
    height = rules.round_to(F.col("ground_m") - F.col("level_m"), 1)
    rows = keyed.join(levels, ["path_id", "asset"]).withColumn("h", height)
    out = rows.groupBy("path_id", "asset_id", "kind").agg(
        F.min(F.when(F.col("reached"), F.col("h"))).alias("in_reach"), F.min("h").alias("lowest"), F.bool_or("near").alias("near"), F.min("km").alias("km")
    )
    reached = F.col("in_reach").isNotNull()
    out = out.withColumn("raw", F.coalesce("in_reach", "lowest")).withColumn("status", rules.asset_status(F.col("kind"), reached, F.col("raw"), F.col("near")))
    return out.select("path_id", "asset_id", "kind", "km", "status", rules.asset_height(F.col("status"), F.col("raw")).alias("height_m"))
