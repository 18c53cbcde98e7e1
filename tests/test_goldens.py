"""Published values: drift end points, the vessel ranking, confidence, metrics; and the readers and writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import incidents, learning, raster
from tidemark.plans.queries import CURRENT, WIND, hindcast_points
from tidemark.sources import files

ORIGIN = (4.035, 55.243)


@pytest.mark.parametrize("mode,last", [("hindcast", (3.836424, 55.170681)), ("forecast", (4.23393, 55.315318))])
def test_drift(spark, mode, last):
    start = spark.sql(f"SELECT 0 AS id, {ORIGIN[0]}D AS lon, {ORIGIN[1]}D AS lat, timestamp_ntz'2026-09-16 12:00:00' AS ts, '{mode}' AS mode")
    e = incidents.endpoints(incidents.drift(start, 12, CURRENT, WIND), ["id"]).first()
    assert e.n_points == 49 and (e.last_lon, e.last_lat) == last


def test_drift_refuses_other_modes(spark):
    start = spark.sql("SELECT 4.0D AS lon, 55.0D AS lat, timestamp_ntz'2026-09-16 12:00:00' AS ts, 'sideways' AS mode")
    with pytest.raises(Exception, match="hindcast or forecast"):
        incidents.drift(start, 1, CURRENT, WIND).collect()


def test_vessel_ranking(spark):
    vessels, synthetic = files.load_ais(spark, None, *ORIGIN)
    assert synthetic
    rows = incidents.vessel_candidates(vessels, ORIGIN, hindcast_points(), synthetic=True).orderBy(F.desc("attribution_score"), "ordinal").collect()
    assert [r.attribution_score for r in rows] == [98.2, 96.5, 73.6, 47.4]
    assert [(r.distance_to_spill_km, r.distance_to_drift_track_km) for r in rows] == [(2.1, 0.73), (4.19, 1.45), (8.38, 8.38), (14.64, 14.64)]
    assert rows[0].evidence_summary == "[SYNTHETIC_TEST_DATA] Proximity 0.7km, Category Crude Oil Tanker, SOG 11.4 kts"


def test_confidence_and_metrics(spark):
    t, f = F.lit(True), F.lit(False)
    assert spark.range(1).select(incidents.confidence(t, t, f)).first()[0] == 0.8
    cells = [(0, 0, 5730686), (0, 1, 2595402), (1, 0, 58982), (1, 1, 3538)]
    rows = spark.createDataFrame([(y, p, n // 1000) for y, p, n in cells], "y int, pred int, n int").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n"))))
    m = learning.metrics(rows).first()
    assert (round(m.precision, 3), round(m.recall, 2), round(m.accuracy, 2)) == (0.001, 0.05, 0.68)
    nothing = learning.metrics(rows.limit(0)).first()
    assert (nothing.precision, nothing.recall, nothing.f1, nothing.iou) == (0, 0, 0, 0)


def test_dossier_and_report(spark):
    """The published incident: its detection figures, tracks from the fixed origin, and the synthetic vessels."""
    one = spark.sql("SELECT 0L AS incident_id")
    origin = spark.sql(f"SELECT 0L AS incident_id, {ORIGIN[0]}D AS lon, {ORIGIN[1]}D AS lat, timestamp_ntz'2026-09-16 12:00:00' AS ts")
    sites = incidents.incident_tracks(origin, 12, CURRENT, WIND)
    vessels, _ = files.load_ais(spark, None, *ORIGIN)
    ranked = incidents.incident_candidates(sites, vessels, synthetic=True)
    ends = lambda m: incidents.endpoints(incidents.drift(origin.withColumn("mode", F.lit(m)), 12, CURRENT, WIND), ["incident_id"])
    summary = spark.sql("SELECT 0L AS incident_id, 1222L AS n_spills, 91.7612D AS total_area_km2")
    first = spark.sql("SELECT 0L AS incident_id, 1 AS component_id, 1288312L AS pixel_count, 73.6176D AS area_km2, 4.035D AS centroid_x, 55.243D AS centroid_y, 3.9D AS bbox_min_x, 55.1D AS bbox_min_y, 4.1D AS bbox_max_x, 55.3D AS bbox_max_y")
    ships = incidents.attribution_summary(sites, ranked, synthetic=True)
    d = incidents.dossier(one, summary, first, ends("hindcast"), ends("forecast"), ships, F.lit("2026-09-17 15:48:50.684998").cast("timestamp")).first().asDict(True)
    assert d["dossier_id"] == "INCIDENT-20260917-154850" and d["generated_utc"] == "2026-09-17T15:48:50.684998Z"
    assert d["sar_detection_summary"] == {"status": None, "total_slick_components": 1222, "total_estimated_area_km2": 91.76, "primary_slick": {"component_id": 1, "pixel_count": 1288312, "area_km2": 73.6176, "centroid_lon_lat": [4.035, 55.243], "bounding_box": [[3.9, 55.1], [4.1, 55.3]]}}
    assert d["drift_analysis"] == {"hindcast_available": True, "estimated_origin_coords": [3.836424, 55.170681], "hindcast_duration_hours": 12.0, "forecast_available": True, "projected_impact_coords_12h": [4.23393, 55.315318]}
    v = d["vessel_attribution_summary"]
    assert v["evaluated_candidates_count"] == 4 and v["real_ais_verified"] is False and [x["mmsi"] for x in v["priority_vessels"]] == [244123000, 219001000, 211987000]
    assert v["priority_vessels"][0]["distance_to_drift_track_km"] == 0.73 and v["priority_vessels"][0]["cog_degrees"] == 45.0
    assert d["fusion_confidence"]["overall_confidence_score"] == 0.8 and len(d["fusion_confidence"]["data_gaps"]) == 2
    report = incidents.attribution_report(sites, ranked, synthetic=True).first().report
    assert list(report.spill_origin) == list(ORIGIN) and report.hindcast_track_points == 49 and not report.real_ais_data_present
    assert [x.attribution_score for x in report.candidates_ranked] == [98.2, 96.5, 73.6, 47.4]
    nothing = incidents.dossier(one, summary.limit(0), first.limit(0), ends("hindcast").limit(0), ends("forecast").limit(0), ships.limit(0)).first()
    assert nothing.sar_detection_summary.status == "DATA_NOT_FOUND" and nothing.vessel_attribution_summary.status == "NO_ATTRIBUTION_DATA"
    assert nothing.fusion_confidence.overall_confidence_score == 0.05 and nothing.drift_analysis.estimated_origin_coords is None
    bare = incidents.dossier(one, summary.withColumn("n_spills", F.lit(0).cast("long")), first.limit(0), ends("hindcast"), ends("forecast"), ships).first()
    assert bare.sar_detection_summary.primary_slick.pixel_count == 0 and bare.fusion_confidence.overall_confidence_score == 0.3


@pytest.mark.parametrize("most", [incidents.BROADCAST_SEGMENTS, 0])
def test_vessels_near_many_incidents(spark, monkeypatch, most):
    """The grid join against all pairs, its segments broadcast or shuffled: places at the date line and near a pole, tracks that are missing or empty."""
    monkeypatch.setattr(incidents, "BROADCAST_SEGMENTS", most)
    rng = np.random.default_rng(5)
    sites = [(0, 179.95, 10.0, [(179.99, 10.1), (-179.95, 10.2)]), (1, -179.99, -10.0, None), (2, 30.0, 89.9, []), (3, 4.0, 55.0, [(4.0 + k / 50, 55.0) for k in range(40)]), (4, 4.0, 55.0, [(4.1, 55.1)]), (5, 0.0, 0.0, [])]
    centres = [(s[1], s[2]) for s in sites] + [p for s in sites for p in (s[3] or [])]
    ships = []
    for i in range(1500):
        x, y = centres[rng.integers(len(centres))]
        y = float(np.clip(y + rng.normal(0, 0.25), -90, 90))
        x = x + rng.normal(0, 0.25) / max(0.02, np.cos(np.radians(y)))
        ships.append((i, i, float((x + 180) % 360 - 180), y))
    frame = spark.createDataFrame(sites, "incident_id long, lon double, lat double, track array<struct<lon:double,lat:double>>")
    ais = spark.createDataFrame(ships, "ordinal long, mmsi long, lon double, lat double")
    found = incidents.incident_distances(frame, ais)
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (most > 0)
    got = {(r.incident_id, r.ordinal): (r.dist_centroid, r.dist_track) for r in found.collect()}

    def km(x1, y1, x2, y2):
        x1, y1, x2, y2 = map(np.radians, (x1, y1, x2, y2))
        a = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
        return 6371.0 * 2 * np.arctan2(np.sqrt(a), np.sqrt(max(0, 1 - a)))

    want = {}
    for s, x, y, t in sites:
        for o, _, a, b in ships:
            c, d = km(a, b, x, y), min((km(a, b, *p) for p in t or []), default=None)
            if min(c, 1e9 if d is None else d) <= 25:
                want[s, o] = (c, d)
    assert got.keys() == want.keys() and len(want) > 500
    bad = {k: (got[k], want[k]) for k in want if abs(got[k][0] - want[k][0]) > 1e-6 or (want[k][1] is None) != (got[k][1] is None)}
    assert not bad
    for site in sites:
        one = incidents.vessel_distances(ais, site[1:3], site[3] or [], 25.0).collect()
        assert {r.ordinal for r in one} == {o for s, o in want if s == site[0]}


def test_scenes_of_any_name_and_size(spark):
    """Components of scenes named by text, of equal shapes, with places beyond 20 bits."""
    far = 1 << 22
    rows = [(s, far + r, far + c) for s in ("S1A", "S1B", "é") for r, c in ((0, 0), (0, 1), (1, 1), (3, 0), (3, 2), (4, 2))]
    runs = raster.labelled(spark.createDataFrame(rows, "scene string, row int, col int"))
    stats = raster.component_stats(runs, 1).orderBy("scene", "component_id").collect()
    assert [(r.scene, r.component_id, r.pixel_count) for r in stats] == [(s, k + 1, n) for s in ("S1A", "S1B", "é") for k, n in enumerate((3, 1, 2))]


def test_edges(spark):
    flat = spark.createDataFrame([("s", r, c, 1.0, 2.0) for r in range(6) for c in range(6)], "scene string, row int, col int, vv double, vh double")
    assert {(r.vv, r.vh) for r in raster.lee(flat, ["vv", "vh"]).collect()} == {(1.0, 2.0)}
    x = spark.sql("SELECT double('NaN') AS a, CAST(NULL AS DOUBLE) AS b").select(S.clip_db(F.col("a")).alias("a"), S.clip_db(F.col("b")).alias("b")).first()
    assert np.isnan(x.a) and x.b is None
    empty = spark.createDataFrame([], "scene long, row int, col int")
    assert raster.component_stats(raster.labelled(empty), 1).count() == 0
    with pytest.raises(ValueError):
        S.band_math("b1; drop")


def test_files(spark, tmp_path):
    (tmp_path / "a.f32").write_bytes(np.arange(24, dtype="<f4").tobytes())
    got = files.read_rasters(spark, str(tmp_path / "a.f32"), 3, 4).where("row = 1 and col = 2").first()
    assert (got.vv, got.vh) == (6.0, 18.0)
    start = spark.sql("SELECT 0 AS id, 4.0D AS lon, 55.0D AS lat, timestamp_ntz'2026-09-16 12:00:00' AS ts, 'hindcast' AS mode")
    track = incidents.drift(start, 1, CURRENT, WIND)
    text = files.track_geojson(track.drop("ts"), ["id", "mode"]).first().value
    (tmp_path / "t.geojson").write_text(text)
    back = [(r.step, r.lon, r.lat) for r in files.read_track(spark, str(tmp_path / "t.geojson")).orderBy("step").collect()]
    assert back == [(r.step, r.lon, r.lat) for r in track.orderBy("step").collect()] and json.loads(text)["type"] == "FeatureCollection"
    (tmp_path / "ais.csv").write_text("mmsi,vessel_name,vessel_type,lon,lat,sog_knots,cog\n1,a,Tanker,4.0,55.0,9,1\n")
    vessels, synthetic = files.load_ais(spark, str(tmp_path / "ais.csv"), *ORIGIN)
    assert vessels.count() == 1 and not synthetic
    # ordinals follow files by name and lines, whatever order they are read in
    (tmp_path / "many.csv").mkdir()
    for k in (2, 0, 1):
        (tmp_path / "many.csv" / f"p{k}.csv").write_text("mmsi,vessel_name,vessel_type,lon,lat,sog_knots,cog\n" + "".join(f"{10 * k + i},a,Tanker,4.0,55.0,9,1\n" for i in range(3 + k)))
    many, _ = files.load_ais(spark, str(tmp_path / "many.csv"), *ORIGIN)
    assert [r.mmsi for r in many.orderBy("ordinal").collect()] == [0, 1, 2, 10, 11, 12, 13, 20, 21, 22, 23, 24] and {r.ordinal for r in many.collect()} == set(range(12))
    assert files.read_json_safe(spark, str(tmp_path / "none.json"), "a int").count() == 0
