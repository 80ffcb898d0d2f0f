"""Thresholds, statuses and scores as Column expressions. Unknown stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor key, group, low end, high end, log scale, weight.
FACTORS = [
    ("volume", "size", 5.0, 8.0, True, 1.0),
    ("growth", "likelihood", 0.0, 25.0, False, 0.25),
    ("outlet_slope", "likelihood", 0.0, 10.0, False, 0.25),
    ("avalanche", "likelihood", 0.0, 0.5, False, 0.25),
    ("glacier", "likelihood", 500.0, 0.0, False, 0.25),
]
#: Least score of each level, highest first.
LEVELS = [(60, "very_high"), (40, "high"), (20, "moderate")]
MIN_GROWTH_YEARS = 3
COVERAGE_OK = 0.9
#: Settlement kinds, road classes and other tag values tracked.
PLACES = ("city", "town", "village", "hamlet", "suburb")
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary")
FOOT_WAYS = ("footway", "path", "track", "steps")
AMENITIES = {"school": "school", "college": "school", "hospital": "health", "clinic": "health"}
HYDRO_NAME = r"(?i)hydro|\bh\.?e\.?p\b"
PEOPLE = ("settlement", "school", "health")
#: Scene classes that are never or only sometimes clear, and band limits.
UNUSABLE, UNCERTAIN = (0, 1, 8, 9, 10, 11), (3, 7)
NDWI_WATER, NDWI_SURE = 0.3, 0.5
SNOW_LIMIT, DROP_FLOOR, DROP_SIGMAS, MIN_DRAIN_M2 = 0.2, 0.30, 3.0, 50_000
MARGIN_HEIGHT_M, NEARBY_M = 10.0, 2000.0
#: Millimetres in a day and in all, and degrees above the past mean.
RAIN_DAY, RAIN_TOTAL, HEAT_JUMP = (50.0, 20.0), (100.0, 40.0), 5.0


def rule_score(value: Column, lo: Column | float, hi: Column | float, log10: bool = False) -> Column:
    """Linear score from 0 at ``lo`` to 1 at ``hi``; unknown or infinite is 0."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    v = F.log10(F.greatest(value, F.lit(1e-12))) if log10 else value
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / (hi - lo)))).otherwise(F.lit(0.0))


def round_to(x: Column, digits: int) -> Column:
    """Half to even, so that the level sees what the reader sees."""
    return F.rint(x * 10**digits) / 10**digits


def level_for(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for floor, name in LEVELS:
        out = out.when(score >= floor, name)
    return out.otherwise("low")


def lake_year_status(n_used: Column, coverage: Column, area: Column, min_obs: int | Column) -> Column:
    """ok, partial, not_found or no_data of one lake and year."""
    return (
        F.when(F.coalesce(n_used, F.lit(0)) == 0, "no_data")
        .when(area.isNull(), "not_found")
        .when((coverage >= COVERAGE_OK) & (n_used >= min_obs), "ok")
        .otherwise("partial")
    )


def unclear_look(snow: Column, coverage: Column) -> Column:
    """Snow is judged before coverage."""
    return F.when(snow > SNOW_LIMIT, "frozen_or_snow").when(coverage < COVERAGE_OK, "no_clear_scene").otherwise("ok")


def drain_drop(area: Column, season_area: Column) -> Column:
    return 1 - area / season_area


def drain_threshold(season_area: Column, season_unc: Column, unc: Column) -> Column:
    return F.greatest(F.lit(DROP_FLOOR), DROP_SIGMAS * F.hypot(season_unc, unc) / season_area)


def ndwi(green: Column, nir: Column) -> Column:
    """Water index; a zero denominator is unknown."""
    return F.try_divide(green - nir, green + nir)


def reflectance(dn: Column, scale: Column, offset: Column) -> Column:
    """A stored band value as reflectance."""
    return dn * scale + offset


def mndwi(green: Column, swir: Column) -> Column:
    """Water index of the short-wave band; a zero denominator is unknown."""
    return F.try_divide(green - swir, green + swir)


def observed(scl: Column, index: Column, shadow: Column) -> Column:
    """Clear, or uncertain but surely water; never in shadow or without an index."""
    clear = ~scl.isin(*UNUSABLE, *UNCERTAIN)
    vouched = scl.isin(*UNCERTAIN) & (index > NDWI_WATER) & (index > NDWI_SURE)
    return F.coalesce((clear | vouched) & ~shadow & index.isNotNull(), F.lit(False))


def water(seen: Column, index: Column) -> Column:
    return F.coalesce(seen & (index > NDWI_WATER), F.lit(False))


def classify_kind(tags: Column) -> Column:
    """(kind, subkind) of an OSM tag map, null if untracked. The order is part of the rule."""

    def tag(name: str) -> Column:
        return F.try_element_at(tags, F.lit(name))

    def pair(kind: str | Column, sub: str | Column) -> Column:
        return F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in (("kind", kind), ("subkind", sub))])

    highway = tag("highway")
    amenity = F.create_map(*[F.lit(x) for kv in AMENITIES.items() for x in kv])
    named_hydro = F.coalesce(tag("name"), F.lit("")).rlike(HYDRO_NAME)
    return (
        F.when(tag("place").isin(*PLACES), pair("settlement", tag("place")))
        .when((tag("power") == "plant") & (F.coalesce(tag("plant:source") == "hydro", F.lit(False)) | named_hydro), pair("hydro", "hydro_plant"))
        .when((tag("power") == "generator") & (tag("generator:source") == "hydro"), pair("hydro", "hydro_plant"))
        .when(tag("waterway").isin("dam", "weir"), pair("hydro", tag("waterway")))
        .when((highway != "") & (F.coalesce(tag("bridge"), F.lit("no")) != "no"), pair("bridge", F.when(highway.isin(*FOOT_WAYS), "footbridge").otherwise("road_bridge")))
        .when(tag("man_made") == "bridge", pair("bridge", "road_bridge"))
        .when(tag("amenity").isin(*AMENITIES), pair(F.try_element_at(amenity, tag("amenity")), tag("amenity")))
        .when(highway.isin(*ROADS), pair("road", highway))
    )


def asset_status(kind: Column, reached: Column, height: Column, near: Column) -> Column:
    """flooded, margin or outside from the lowest reached ground above the flood."""
    return (
        F.when(reached & (height < 0), "flooded")
        .when((kind != "road") & near & height.isNotNull() & (height <= MARGIN_HEIGHT_M), "margin")
        .otherwise("outside")
    )


def asset_height(status: Column, height: Column) -> Column:
    """A height below the flood that the flood does not reach says nothing."""
    return F.when((height < 0) & (status != "flooded"), F.lit(None)).otherwise(height)


def merged_status(expected: Column, severe: Column) -> Column:
    hit = ("flooded", "margin")
    any_hit = F.coalesce(expected.isin(*hit), F.lit(False)) | F.coalesce(severe.isin(*hit), F.lit(False))
    return F.when(expected == "flooded", "in_flood_path").when(any_hit, "at_risk").otherwise("outside")


def affected_under(scenario: str, status: Column, has_scenarios: Column, expected: Column, severe: Column) -> Column:
    """Whether a scenario's flood reaches an asset; without detail the warning errs on yes."""
    hit = ("flooded", "margin")
    exp, sev = (F.coalesce(x.isin(*hit), F.lit(False)) for x in (expected, severe))
    under = exp if scenario == "expected" else (exp | sev) if scenario == "severe" else F.lit(False)
    return F.when(status == "outside", False).when(~has_scenarios, True).otherwise(under)


def is_people_place(kind: Column) -> Column:
    return kind.isin(*PEOPLE)
