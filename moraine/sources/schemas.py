"""Explicit schemas of the hazard tables; missing fields become null, unknown ones are ignored."""

from __future__ import annotations

LAKES = "id string, name string, name_hi string, lat double, lon double, aoi_radius_m double, district string, basin string, kind string, notes string, sources array<string>"
SERIES = "lake_id string, year int, status string, area_m2 double, uncertainty_m2 double, coverage double, scenes_clear int, last_day date, scene_ids array<string>, scene_days array<string>"
SCENES = "item_id string, day date, cloud double, baseline string, azimuth double, elevation double, boa_offset_applied boolean, hrefs map<string,string>, scale map<string,double>, offset map<string,double>, bbox struct<x0:double,y0:double,x1:double,y1:double>"
OUTCOME = "struct<status:string,height_above_flood_m:double,flood_depth_m:double,road_km_flooded:double>"
IMPACTS = f"lake_id string, osm string, name string, name_hi string, kind string, subkind string, lon double, lat double, km double, lateral_m double, arrival_min_expected double, arrival_min_fast double, scenarios struct<expected:{OUTCOME},severe:{OUTCOME}>, status string"
STATIONS = "lake_id string, scenario string, km double, lon double, lat double, bed_m double, slope double, discharge_m3s double, wse_m double, depth_m double, width_m double, arrival_min_expected double, arrival_min_fast double, section_capped boolean, left_m double, right_m double"
PLACES = "osm string, name string, name_hi string, place string, lon double, lat double, district string, state string"
SUBSCRIPTIONS = "id string, place_osm string, lake_id string, phone string, channel string, lang string, created_at timestamp"
EVENTS = "event_id string, lake_id string, scenario string, source string, dry_run boolean, note string, created_at timestamp"
READINGS = "lake_id string, sensor_id string, kind string, value double, observed_at timestamp"
WEATHER = "lake_id string, time array<string>, precipitation_mm array<double>, tmax_c array<double>, tmin_c array<double>, snowfall_cm array<double>"
JOBS = "id string, kind string, state string, created_at timestamp, started_at timestamp, finished_at timestamp, error string, log string"
OSM = "type string, id bigint, lat double, lon double, refs array<bigint>, tags map<string,string>, bbox struct<x0:double,y0:double,x1:double,y1:double>"
