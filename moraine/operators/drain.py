"""Drainage checks and river blockages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import rules
from moraine.operators import raster

NEW_MIN_LOOKS, NEW_MAX_FREQ = 2, 0.1
BLOB_MIN_M2, BLOB_MIN_WIDTH = 20_000, 60.0
#: Fixed value: cells from new water within which old water belongs to it.
JOIN = 3


def baseline(years: DataFrame, asked: DataFrame) -> DataFrame:
    """The last full season up to ``asked(lake_id, as_of_year)``."""
    full = years.where((F.col("status") == "ok") & (F.col("area_m2") > 0))
    rows = asked.join(full, "lake_id").where("year <= as_of_year")
    return rows.groupBy("lake_id", "as_of_year").agg(F.max(F.struct("year", "area_m2", "uncertainty_m2")).alias("s")).select("lake_id", "as_of_year", "s.*")


def drawn_baseline(years: DataFrame, outlines: DataFrame, asked: DataFrame) -> DataFrame:
    """The :func:`baseline` among the years whose outline is there and covers a cell: ``outlines(lake_id, year, cells)``."""
    drawn = outlines.where("cells > 0").select("lake_id", "year").distinct()
    return baseline(years.join(drawn, ["lake_id", "year"], "left_semi"), asked)


def latest_look(looks: DataFrame) -> DataFrame:
    """The deciding look of each lake, over ``looks(lake_id, day, scene_id, look)``.

    A frozen newest look ends the search; else the newest clear look; else the newest.
    """
    newest = F.max(F.struct("day", "scene_id", "look"))
    clear = F.max(F.when(F.col("look") == "ok", F.struct("day", "scene_id", "look")))
    both = looks.groupBy("lake_id").agg(newest.alias("n"), clear.alias("c"))
    chosen = F.when(F.col("n.look") == "frozen_or_snow", F.col("n")).otherwise(F.coalesce("c", "n"))
    return both.select("lake_id", chosen.alias("x")).select("lake_id", "x.*")


def verdict(rows: DataFrame) -> DataFrame:
    """``rows(look, area, unc, season_area, season_unc)`` with the guards, the drop and the verdict."""
    drop = rules.drain_drop(F.col("area"), F.col("season_area"))
    limit = rules.drain_threshold(F.col("season_area"), F.col("season_unc"), F.col("unc"))
    status = (
        F.when(F.col("season_area").isNull(), "not_found")
        .when(F.col("season_area") < rules.MIN_DRAIN_M2, "too_small")
        .when(F.col("look").isNull(), "no_clear_scene")
        .otherwise(F.col("look"))
    )
    ok = status == "ok"
    return rows.withColumn("status", status).withColumn("drop", F.when(ok, drop)).withColumn("drained", F.coalesce(ok & (drop > limit), F.lit(False)))


def new_water(cells: DataFrame) -> DataFrame:
    """Cells that are water now, were seen dry before and lie in the corridor."""
    dry = (F.col("base_obs") >= NEW_MIN_LOOKS) & (F.coalesce("base_freq", F.lit(1.0)) <= NEW_MAX_FREQ)
    return cells.withColumn("new_water", F.coalesce(F.col("now") & dry & F.col("corridor"), F.lit(False)))


def blobs(labelled: DataFrame, cell_m2: float) -> DataFrame:
    """Blobs of ``labelled(reach, label, width_m, base_freq)`` that are large and wide enough."""
    out = labelled.groupBy("reach", "label").agg(
        (F.count("*") * cell_m2).alias("area_m2"), F.max("width_m").alias("width_m"), F.avg("base_freq").alias("base_freq")
    )
    return out.where((F.col("area_m2") >= BLOB_MIN_M2) & (F.col("width_m") >= BLOB_MIN_WIDTH))


def label_blobs(spark: SparkSession, cells: DataFrame, res: float) -> DataFrame:
    """Blobs of new water in ``cells(grid_id, r, c, now, base_obs, base_freq, corridor)``: (grid_id, label_r, label_c, cells, area_m2, width_m, base_freq).

    A lake behind a fresh dam straddles its river, so water that was there before joins what is new within ``JOIN`` cells of
    it, and no further along the river. The new part alone must be large, and wide: twice the
    distance from its middle to its edge.
    """
    seen = new_water(cells)
    new = seen.where("new_water").select(*raster.CELL)
    old = seen.where("now and corridor and not new_water").select(*raster.CELL).join(raster.dilate(new, JOIN), raster.CELL, "left_semi")
    labelled = raster.components(spark, new.unionByName(old))
    around = cells.select(*raster.CELL).join(raster.dilate(new, 1, True), raster.CELL, "left_semi")
    inside = raster.distance_to(around, around.join(new, raster.CELL, "left_anti")).join(new, raster.CELL)
    rows = labelled.join(inside.select(*raster.CELL, "distance"), raster.CELL, "left").join(seen.select(*raster.CELL, "base_freq"), raster.CELL)
    blob = rows.groupBy("grid_id", "label_r", "label_c").agg(
        F.count("*").alias("cells"), F.count("distance").alias("new"), (F.count("*") * res * res).alias("area_m2"), (2 * F.max("distance") * res).alias("width_m"), F.avg("base_freq").alias("base_freq")
    )
    return blob.where((F.col("new") * res * res >= BLOB_MIN_M2) & (F.col("width_m") >= BLOB_MIN_WIDTH)).drop("new")


def dedupe_rounded(rows: DataFrame, digits: int = 3) -> DataFrame:
    """Candidates at one rounded place: the first by window and id."""
    w = Window.partitionBy(F.bround("lon", digits), F.bround("lat", digits)).orderBy("window", "id")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def fan_windows(reaches: DataFrame, every_km: float = 5.0) -> DataFrame:
    """Scan centres every ``every_km`` of ``reaches(reach, length_km)``, its ends included."""
    n = F.floor(F.col("length_km") / every_km).cast("int")
    return reaches.select("reach", F.posexplode(F.transform(F.sequence(F.lit(0), n), lambda k: k * every_km)).alias("window", "centre_km"))
