"""Numbers as people read them: grouped, with units, a dash for unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
#: Relations by key, as they are cited.
CITED = {"evans1986": "Evans 1986", "huggel2002": "Huggel et al. 2002", "popov1991": "Popov 1991"}


def number(v: Column, digits: int = 0) -> Column:
    known = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(known, F.format_number(v, digits)).otherwise(DASH)


def square_km(m2: Column, digits: int = 3) -> Column:
    """An area; one that would show as nought is less than the last digit."""
    small = (m2 > 0) & (m2 / 1e6 < 0.5 * 10**-digits)
    return F.when(m2.isNull(), DASH).when(small, F.concat(F.lit("<"), F.format_number(F.lit(10.0**-digits), digits), F.lit(" km²"))).otherwise(F.concat(F.format_number(m2 / 1e6, digits), F.lit(" km²")))


def volume(m3: Column) -> Column:
    return F.when(m3.isNull(), DASH).when(m3 >= 1e6, F.concat(F.format_number(m3 / 1e6, 2), F.lit(" million m³"))).otherwise(F.concat(F.format_number(m3, 0), F.lit(" m³")))


def discharge(m3s: Column) -> Column:
    return F.when(m3s.isNull(), DASH).otherwise(F.concat(F.format_number(m3s, 0), F.lit(" m³/s")))


def minutes(v: Column) -> Column:
    """Whole minutes, rounded down."""
    return F.when(v.isNull(), DASH).otherwise(F.format_number(F.floor(v), 0))


def arrival(fast: Column, expected: Column) -> Column:
    """The range of arrivals; one number if both show alike."""
    a, b = minutes(fast), minutes(expected)
    return F.when(fast.isNull() & expected.isNull(), DASH).when(a == b, F.concat(F.lit("~"), a, F.lit(" min"))).otherwise(F.concat(F.lit("~"), a, F.lit("–"), b, F.lit(" min")))


def signed_metres(v: Column, digits: int = 1) -> Column:
    sign = F.when(v > 0, "+").when(v < 0, "−").otherwise("")
    return F.when(v.isNull(), DASH).otherwise(F.concat(sign, F.format_number(F.abs(v), digits), F.lit(" m")))


def relation_name(relation: Column) -> Column:
    """A relation's citation, from its key or from a text that begins with it; null without one."""
    key = F.trim(F.substring_index(relation, ":", 1))
    cited = F.try_element_at(F.create_map(*[F.lit(x) for kv in CITED.items() for x in kv]), key)
    plain = F.concat(F.upper(F.substring(key, 1, 1)), F.regexp_extract(key, "(?i)^.([a-z]*)([0-9]{4})$", 1), F.lit(" "), F.right(key, F.lit(4)))
    return F.when(F.coalesce(relation, F.lit("")) != "", F.coalesce(cited, F.when(key.rlike("(?i)^[a-z]+[0-9]{4}$"), plain), F.nullif(key, F.lit(""))))
