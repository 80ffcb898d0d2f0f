"""Thresholds and statuses at and around their limits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import geo, hydrology, rules, text
from moraine.operators import weather


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "lo", "hi", "log", "want"),
    [(-1.0, 0.0, 10.0, False, 0.0), (5.0, 0.0, 10.0, False, 0.5), (20.0, 0.0, 10.0, False, 1.0), (None, 0.0, 10.0, False, 0.0),
     (10**6.5, 5.0, 8.0, True, 0.5), (0.0, 500.0, 0.0, False, 1.0), (250.0, 500.0, 0.0, False, 0.5), (800.0, 500.0, 0.0, False, 0.0),
     (float("inf"), 0.0, 10.0, False, 0.0), (float("nan"), 0.0, 10.0, False, 0.0)],
)
def test_rule_score(spark, value, lo, hi, log, want):
    assert one(spark, rules.rule_score(F.lit(value).cast("double"), lo, hi, log)) == pytest.approx(want)


def test_levels(spark):
    scores = {10.0: "low", 19.9: "low", 20.0: "moderate", 30.0: "moderate", 40.0: "high", 59.9: "high", 60.0: "very_high", 70.0: "very_high"}
    for score, level in scores.items():
        assert one(spark, rules.level_for(F.lit(score))) == level
    assert one(spark, rules.level_for(F.lit(None).cast("double"))) is None


def test_merged_status_truth_table(spark):
    table = {
        ("flooded", "flooded"): "in_flood_path", ("flooded", "margin"): "in_flood_path", ("flooded", "outside"): "in_flood_path",
        ("margin", "flooded"): "at_risk", ("outside", "flooded"): "at_risk", ("margin", "margin"): "at_risk",
        ("margin", "outside"): "at_risk", ("outside", "margin"): "at_risk", ("outside", "outside"): "outside", (None, "margin"): "at_risk",
    }
    df = spark.createDataFrame([(*k, v) for k, v in table.items()], "e string, s string, want string")
    assert df.where(rules.merged_status(F.col("e"), F.col("s")) != F.col("want")).count() == 0


def test_affected_under(spark):
    cases = [("in_flood_path", True, "flooded", "flooded", True, True), ("at_risk", True, "outside", "margin", False, True),
             ("at_risk", True, "margin", "margin", True, True), ("outside", True, "outside", "outside", False, False), ("at_risk", False, None, None, True, True)]
    df = spark.createDataFrame(cases, "status string, has boolean, e string, s string, exp boolean, sev boolean")
    for scenario, want in (("expected", "exp"), ("severe", "sev")):
        got = rules.affected_under(scenario, F.col("status"), F.col("has"), F.col("e"), F.col("s"))
        assert df.where(got != F.col(want)).count() == 0


def test_asset_status_and_height(spark):
    cases = [("settlement", True, -0.1, True, "flooded", -0.1), ("settlement", False, -2.0, True, "margin", None), ("bridge", False, 10.0, True, "margin", 10.0),
             ("bridge", False, 10.1, True, "outside", 10.1), ("road", False, 1.0, True, "outside", 1.0), ("school", False, None, True, "outside", None)]
    df = spark.createDataFrame(cases, "kind string, reached boolean, h double, near boolean, want string, height double")
    df = df.withColumn("got", rules.asset_status(F.col("kind"), F.col("reached"), F.col("h"), F.col("near")))
    assert df.where("got <> want").count() == 0
    assert df.where(~rules.asset_height(F.col("got"), F.col("h")).eqNullSafe(F.col("height"))).count() == 0


def test_classify_order(spark):
    cases = [({"place": "village"}, "settlement", "village"), ({"power": "plant", "name": "Seli HEP"}, "hydro", "hydro_plant"),
             ({"power": "plant", "name": "Shepherd"}, None, None), ({"highway": "primary", "bridge": "yes"}, "bridge", "road_bridge"),
             ({"highway": "path", "bridge": "yes"}, "bridge", "footbridge"), ({"highway": "primary", "bridge": "no"}, "road", "primary"),
             ({"amenity": "clinic"}, "health", "clinic"), ({"waterway": "dam"}, "hydro", "dam"), ({"man_made": "bridge"}, "bridge", "road_bridge"), ({}, None, None)]
    df = spark.createDataFrame(cases, "tags map<string,string>, kind string, sub string").withColumn("k", rules.classify_kind(F.col("tags")))
    assert df.where(~(F.col("k.kind").eqNullSafe(F.col("kind")) & F.col("k.subkind").eqNullSafe(F.col("sub")))).count() == 0


def test_looks_and_drop(spark):
    assert one(spark, rules.unclear_look(F.lit(0.6), F.lit(0.5))) == "frozen_or_snow"
    assert one(spark, rules.unclear_look(F.lit(0.2), F.lit(0.89))) == "no_clear_scene"
    assert one(spark, rules.unclear_look(F.lit(0.2), F.lit(0.9))) == "ok"
    assert one(spark, rules.drain_drop(F.lit(20_000.0), F.lit(40_000.0))) == 0.5


def test_names(spark):
    keys = {"Sissu": "sisu", "Chhatru": "chatru", "Tāndī": "tandi", "Seema": "sima", "Koot": "kut", "Wangtu": "vangtu", "Phojal": "fojal",
            "Sector 11": "sector11", "zzz": "zzz", "Seeit": "siit", "": ""}
    df = spark.createDataFrame(list(keys.items()), "name string, want string")
    assert df.where(text.latin_key(F.col("name")) != F.col("want")).count() == 0
    assert one(spark, text.transliterate(F.lit("मनाली"))) == "mnali" and one(spark, text.transliterate(F.lit("कोकसर"))) == "koksr"
    for name in ("Kyelang", "Keylong"):
        assert one(spark, text.skeleton(text.latin_key(F.lit(name)))) == "klng"
    assert one(spark, text.hindi_key(F.lit("सड़क ab"))) == "सडक" and one(spark, text.hindi_key(F.lit("चाँद"))) == "चांद"
    assert one(spark, text.mask_phone(F.lit("+919812345678"))) == "+9198******78"
    stems = {"bhrigulake": "bhrigu", "tal": "tal", "chandratal": "chandra", "abctso": "abctso"}
    for folded, want in stems.items():
        assert one(spark, text.stem_name(F.lit(folded))) == want


def test_number_grounding(spark):
    source = '{"arrival_min_fast":19.6,"km":11.53,"area_m2":1085800.0,"day":"2026-10-05","bounds":[605,123]} 10 seasons 2017-2026: +26,062'
    cases = {"19 minutes": [], "19.6, 11.53 km": [], "१९": [], "1,085,800 or 10,85,800": [], "5 of 2026": [], "112, 1077": [], "26,062 from 2017": [],
             "605 and 123": [], "none": [], "20 minutes": ["20"], "1.08": ["1.08"], "2030": ["2030"], "12 km then 12": ["12"], "6,2 m": ["6"], "2017,2026": []}
    df = spark.createDataFrame(list(cases.items()), "answer string, want array<string>")
    got = text.unsupported_numbers(F.col("answer"), text.allowed_numbers(F.lit(source)))
    assert df.where(got != F.col("want")).collect() == []


def outlook(past, rain, heat):
    rows = [("x", f"d{i}", None, float(t), False) for i, t in enumerate(past)]
    return rows + [("x", f"f{i}", None if r is None else float(r), None if t is None else float(t), True) for i, (r, t) in enumerate(zip(rain, heat, strict=True))]


@pytest.mark.parametrize(
    ("past", "rain", "heat", "level", "reasons"),
    [((4, 4, 4), (0, 1, 2), (4, 4, 4), "normal", 0), ((4, 4, 4), (19.9, 19.9, 0), (8.9, 4, 4), "normal", 0), ((4, 4, 4), (20, 0, 0), (4, 4, 4), "elevated", 1),
     ((4, 4, 4), (14, 13, 13), (4, 4, 4), "elevated", 1), ((3, 4, 5), (0, 0, 0), (4, 9, 4), "elevated", 1), ((4, 4, 4), (0, 50, 0), (4, 4, 4), "high", 2),
     ((4, 4, 4), (34, 33, 33), (4, 4, 4), "high", 2), ((4, 4, 4), (60, 45, 0), (12, 4, 4), "high", 3), ((), (None,), (30,), "normal", 0)],
)
def test_weather(spark, past, rain, heat, level, reasons):
    df = spark.createDataFrame(outlook(past, rain, heat), "lake_id string, date string, precipitation_mm double, tmax_c double, forecast boolean")
    got = weather.trigger(df).first()
    assert (got.level, len([r for r in got.reasons.split(",") if r])) == (level, reasons)


def test_attenuation_halves(spark):
    assert one(spark, hydrology.discharge_at(F.lit(42.4 * math.log(2)), F.lit(1000.0))) == pytest.approx(500)


def test_normal_depth_of_a_rectangle(spark):
    offsets = np.arange(-200.0, 210.0, 10.0)
    ground = np.where(np.abs(offsets) <= 35, 0.0, 300.0)
    width, depth, slope, n = 70.0, 5.0, 0.01, 0.07
    area, wet = width * depth, width + 2 * depth
    q = area * (area / wet) ** (2 / 3) * math.sqrt(slope) / n
    flows = [(i, offsets.tolist(), ground.tolist(), float(x), slope) for i, x in enumerate((q, 10.0, 100.0, 1000.0))]
    ridge = ground.copy()
    ridge[10] = -50.0  # a deeper channel behind a ridge
    flows += [(4, offsets.tolist(), ridge.tolist(), float(q), slope), (2**60 + 1, None, None, 1.0, slope), (None, [], [], 1.0, slope)]
    schema = "id long, offsets array<double>, ground array<double>, discharge double, slope double"
    rows = {r.id: r for r in hydrology.section_flow(spark.createDataFrame(flows, schema).coalesce(1), n).collect()}
    assert abs(rows[0].wse - depth) < 0.3 and not rows[0].capped and rows[0].width == 60 and rows[0].left_m == rows[0].right_m == 35
    assert rows[1].wse < rows[2].wse < rows[3].wse < rows[0].wse
    assert rows[4].wse == rows[0].wse
    assert rows[2**60 + 1].wse is None and rows[None].capped is None


def test_normal_depth_of_a_wedge(spark):
    # a V of side slope 1: area is depth squared, the wetted sides are 2 * sqrt(2) * depth
    offsets = np.arange(-500.0, 501.0, 0.5)
    depth, slope, n = 40.0, 0.004, 0.05
    q = depth**2 * (depth / (2 * math.sqrt(2))) ** (2 / 3) * math.sqrt(slope) / n
    df = spark.createDataFrame([(offsets.tolist(), np.abs(offsets).tolist(), q, slope)], "offsets array<double>, ground array<double>, discharge double, slope double")
    got = hydrology.section_flow(df, n).first()
    assert got.wse == pytest.approx(depth, rel=0.01) and got.width == pytest.approx(2 * depth, rel=0.02)


def test_utm_of_known_points(spark):
    # the equator on a central meridian, and the same latitude mirrored in the zone
    east, north = geo.utm(F.lit(75.0), F.lit(0.0))
    assert one(spark, east) == pytest.approx(500_000) and one(spark, north) == pytest.approx(0, abs=1e-6)
    a, b = (one(spark, geo.utm(F.lit(75 + d), F.lit(32.0))[0]) for d in (-1.0, 1.0))
    assert a + b == pytest.approx(1_000_000)
    quarter = one(spark, geo.utm(F.lit(75.0), F.lit(90.0 - 1e-9))[1])
    assert quarter == pytest.approx(0.9996 * 10_001_965.729, abs=0.01)
