"""Small predicates and projections of the catalogue: seasons, layers, ids, boxes and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layer names, and the season's first and last day.
LAYERS = ("outlet", "glaciers", "flood_path", "corridor_expected", "corridor_severe", "outlines")
SEASON = ((8, 15), (10, 31))
OSM_ID = r"^(node|way|relation)/[0-9]+$"


def in_season(day: Column, today: Column | None = None) -> Column:
    """Whether a day lies in its year's season, which ends today at the latest."""
    first, last = (F.make_date(F.year(day), F.lit(m), F.lit(d)) for m, d in SEASON)
    return day.between(first, last if today is None else F.least(last, today))


def in_lookback(day: Column, as_of: Column, newest: int, oldest: int) -> Column:
    """Days from ``oldest`` to ``newest`` before ``as_of``, both included."""
    return day.between(F.date_sub(as_of, oldest), F.date_sub(as_of, newest))


def in_disk(r: Column, c: Column, r0: float, c0: float, radius_m: float, res: float) -> Column:
    """Cells within the lake's radius, 500 m at least."""
    reach = max(radius_m, 500.0) / res
    return (r - r0) * (r - r0) + (c - c0) * (c - c0) <= reach * reach


def is_layer(name: Column) -> Column:
    base = F.regexp_replace(name, r"\.geojson$", "")
    return base.isin(*LAYERS) | base.rlike(r"^(19|20)\d{2}$")


def is_osm_id(x: Column) -> Column:
    return x.rlike(OSM_ID)


def flood_side(height: Column) -> Column:
    """Above or below the flood, and by how much; unknown stays unknown."""
    side = F.when(height < 0, "below").when(height >= 0, "above")
    return F.struct(side.alias("side"), F.abs(height).alias("metres"))


def minutes_to_say(fast: Column) -> Column:
    """Whole minutes, never rounded up."""
    return F.floor(fast)


def research_radius(area_m2: Column) -> Column:
    """Window radius around a lake in whole hundreds of metres, 1 to 5 km."""
    raw = F.floor((4 * F.sqrt(area_m2 / 3.141592653589793) + 700) / 100 + 0.5) * 100
    return F.least(F.lit(5000), F.greatest(F.lit(1000), raw))


def job_state(state: Column, started: Column, worker_alive: Column) -> Column:
    """A running job whose worker is gone has failed."""
    return F.when((state == "running") & ~worker_alive, "failed").otherwise(state)
