"""Warning texts in two languages, labels and names for people."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The warning, its short form and its title. Parts in brackets stand only if their value is known; after a bar is what stands else.
WARNING = {
    "hi": "चेतावनी: {lake} से बाढ़ का खतरा। आपके गाँव[ {place}] तक पानी [लगभग {minutes} मिनट में|जल्द] पहुँच सकता है। तुरंत ऊँचे स्थान पर जाएँ।",
    "en": "WARNING: Flood danger from {lake}. Water may reach your village[ {place}] [in about {minutes} minutes|soon]. Move to high ground immediately.",
}
SHORT = {
    "hi": "बाढ़ चेतावनी: {place} में ~{minutes} मिनट में पानी। ऊँचे स्थान पर जाएँ",
    "en": "FLOOD WARNING: water may reach {place} in ~{minutes} min. Go to high ground now.",
}
TITLE = {"hi": "{sender}: बाढ़ चेतावनी", "en": "{sender}: flood warning"}
LAKE_WORD = {"hi": "झील", "en": "lake"}
HOME_STATE = "himachal pradesh"
OTHER = "hi"


def _filled(template: str, values: dict[str, Column]) -> Column:
    """A template as one concatenation; null values are empty."""

    def plain(part: str) -> list[Column]:
        return [F.coalesce(values[p[1:-1]], F.lit("")) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", part) if p]

    out: list[Column] = []
    for part in re.split(r"(\[[^\]]*\])", template):
        if part.startswith("["):
            known, _, other = part[1:-1].partition("|")
            has = F.coalesce(values[re.search(r"\{(\w+)\}", known).group(1)], F.lit("")) != ""
            out.append(F.when(has, F.concat(*plain(known))).otherwise(F.concat(F.lit(""), *plain(other))))
        else:
            out += plain(part)
    return F.concat(*out)


def _in_language(lang: Column, texts: dict[str, str], **values: Column) -> Column:
    """The text of a language; an unknown one gets the first."""
    out = _filled(texts[OTHER], values)
    for name in texts.keys() - {OTHER}:
        out = F.when(lang == name, _filled(texts[name], values)).otherwise(out)
    return out


def lake_label(lang: Column, name: Column) -> Column:
    """A lake's name with the word for lake, unless it ends with it."""
    hindi, english = LAKE_WORD["hi"], LAKE_WORD["en"]
    in_hindi = F.when(F.endswith(name, F.lit(hindi)), name).otherwise(F.concat(name, F.lit(f" {hindi}")))
    return F.when(lang == "hi", in_hindi).when(F.endswith(F.lower(name), F.lit(english)), name).otherwise(F.concat(name, F.lit(f" {english}")))


def warning(lang: Column, lake: Column, place: Column, minutes: Column) -> Column:
    """The warning of a lake with its label; an unknown arrival is soon, an unknown place is left out."""
    return _in_language(lang, WARNING, lake=lake, place=place, minutes=minutes)


def short_warning(lang: Column, place: Column, minutes: Column) -> Column:
    return _in_language(lang, SHORT, place=place, minutes=minutes)


def title(lang: Column, sender: Column) -> Column:
    return _in_language(lang, TITLE, sender=sender)


def shown_name(lang: Column, name: Column, name_hi: Column, osm: Column) -> Column:
    """The name in the language, else the other one, else the id, else a dash; empty names are none."""
    some = lambda x: F.when(x != "", x)
    first, second = (F.when(lang == "hi", x).otherwise(y) for x, y in ((name_hi, name), (name, name_hi)))
    return F.coalesce(some(first), some(second), some(osm), F.lit("—"))


def other_name(lang: Column, name: Column, name_hi: Column, osm: Column) -> Column:
    """The name in the other language, where it differs from the one that is shown."""
    alt = F.when(lang == "hi", name).otherwise(name_hi)
    return F.when((alt != "") & (alt != shown_name(lang, name, name_hi, osm)), alt)


def admin_line(district: Column, state: Column) -> Column:
    """The district, and the state if it is not the home state; null if neither is known."""
    parts = F.array_compact(F.array(
        F.when(district != "", F.concat(district, F.lit(" district"))), F.when((state != "") & (F.lower(F.trim(state)) != HOME_STATE), state)
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))


def rule_text(lo: float, hi: float, log10: bool, unit: str) -> str:
    """A score rule in words; grouped whole numbers on a log scale, short ones else."""
    if log10:
        return f"0 at {10**lo:,.0f} {unit} rising (log scale) to 1 at {10**hi:,.0f} {unit}"
    return f"0 at {lo:g} {unit} rising linearly to 1 at {hi:g} {unit}"


def request_key(query: Column) -> Column:
    """Sixteen hex digits that name a request: the same text always has the same."""
    return F.substring(F.sha1(query), 1, 16)
