"""Positions against track steps in place and time, in tables and streams, against all pairs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incidents
from tidemark.streaming import approaches

DAY = dt.datetime(2024, 3, 31)  # clocks change in Europe
STEP = "incident_id int, step int, ts {}, lon double, lat double"
SHIP = "ordinal int, mmsi long, ts {}, lon double, lat double, vessel_type string, sog_knots double"


def km(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 6371.0 * 2 * math.asin(min(1.0, math.sqrt(h)))


def rows(seed=3):
    r = random.Random(seed)
    around = [(179.9, 10.0), (-0.1, 55.2), (12.0, 89.8), (30.0, -71.0)]
    near = lambda i: (around[i][0] + r.uniform(-0.6, 0.6), around[i][1] + r.uniform(-0.3, 0.19))
    fold = lambda x: (x + 180) % 360 - 180
    steps, ships = [], []
    for i in range(4):
        for k in range(12):
            lon, lat = near(i)
            steps.append((i, k, DAY + dt.timedelta(minutes=15 * k), fold(lon), lat))
    for n in range(400):
        lon, lat = near(n % 4)
        ships.append((n, n % 50, DAY + dt.timedelta(seconds=r.randrange(-3600, 5 * 3600)), fold(lon), lat, "Tanker", 9.0))
    i, k, ts, lon, lat = steps[0]
    ships += [(900, 90, ts + dt.timedelta(minutes=30), lon, lat, None, None), (901, 91, ts - dt.timedelta(minutes=30), lon, lat, None, None), (902, 92, ts - dt.timedelta(minutes=30, microseconds=1), lon, lat, None, None)]
    ships += [ships[0], ships[0], (903, None, ts, lon, lat, None, None), (904, 94, None, lon, lat, None, None), (905, 95, ts, None, lat, None, None), (906, 96, ts, lon, None, None, None)]
    steps += [(9, 0, None, 0.0, 0.0), (9, 1, DAY, None, 0.0), (9, 2, DAY, 0.0, None)]
    return steps, ships


def plain(steps, ships, minutes=30, reach=25.0):
    for s in steps:
        for p in ships:
            if None in s or None in p[2:5] or abs((s[2] - p[2]).total_seconds()) > minutes * 60:
                continue
            if (d := km(s[3:5], p[3:5])) <= reach:
                yield s[0], s[1], p, d


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_pairs_are_all_pairs(spark, kind):
    steps, ships = rows()
    a, b = spark.createDataFrame(steps, STEP.format("timestamp_ntz")), spark.createDataFrame(ships, SHIP.format("timestamp_ntz"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        a, b = (x.withColumn("ts", F.col("ts").cast(kind)) for x in (a, b))
        if kind == "timestamp":  # written as instants first, then read in a zone whose clock is changed that night
            a, b = (spark.createDataFrame(x.toArrow()) for x in (a, b))
            spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = incidents.timed_pairs(a, b).select("incident_id", "step", "ordinal").collect()
        best = incidents.timed_candidates(a, b).select("incident_id", "ordinal", "step", "distance_km").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = list(plain(steps, ships))
    assert sorted(map(tuple, got)) == sorted((i, k, p[0]) for i, k, p, _ in want)
    assert {900, 901} <= {p[0] for _, _, p, _ in want} and 902 not in {r.ordinal for r in got if r.step == 0 and r.incident_id == 0}
    assert len({i for i, *_ in want}) == 4
    nearest = {}
    for i, k, p, d in want:
        nearest[i, p[0]] = min(nearest.get((i, p[0]), (math.inf, 0)), (d, k))
    assert {(r.incident_id, r.ordinal): (round(r.distance_km, 2), r.step) for r in best} == {k: (round(d, 2), s) for k, (d, s) in nearest.items()}
    assert len(best) == len(nearest) + 2 * sum(n == 0 for _, n in nearest)  # repeated positions stay rows of their own


def test_no_rows(spark):
    steps, ships = rows()
    a, b = spark.createDataFrame(steps, STEP.format("timestamp_ntz")), spark.createDataFrame(ships, SHIP.format("timestamp_ntz"))
    assert incidents.timed_pairs(a.limit(0), b).count() == incidents.timed_candidates(a, b.limit(0)).count() == 0


def _put(spark, ships, path):
    spark.createDataFrame(ships, SHIP.format("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)


def _run(spark, folder, out, steps):
    stream = spark.readStream.schema(SHIP.format("timestamp_ntz")).option("maxFilesPerTrigger", 1).parquet(folder)
    approaches.start(stream, steps, f"{out}/out", f"{out}/checkpoint").awaitTermination()
    return {tuple(r)[:5] + (r.closest_step,) for r in approaches.current(spark, f"{out}/out").withColumn("closest_km", F.round("closest_km", 6)).select("window_start", "incident_id", "mmsi", "n_pairs", "closest_km", "closest_step").collect()}


def _table(spark, ships, steps):
    df = incidents.closest_approaches(incidents.timed_pairs(steps, spark.createDataFrame(ships, SHIP.format("timestamp_ntz"))))
    return {tuple(r) for r in df.select("window_start", "incident_id", "mmsi", "n_pairs", F.round("closest_km", 6), "closest_step").collect()}


def test_stream_equals_table_across_runs_and_drops_what_is_late(spark, tmp_path):
    steps, ships = rows()
    steps = spark.createDataFrame(steps, STEP.format("timestamp_ntz"))
    ships = sorted((s for s in ships if s[2]), key=lambda s: s[2])
    parts = [ships[k : k + 100] for k in range(0, len(ships), 100)]
    parts[1][:10], parts[0][-10:] = parts[0][-10:], parts[1][:10]  # out of order, but within the delay's windows
    folder, out = str(tmp_path / "in"), str(tmp_path / "run")
    for p in parts[:2]:
        _put(spark, p, folder)
    assert _run(spark, folder, out, steps) == _table(spark, parts[0] + parts[1], steps)
    for p in parts[2:]:
        _put(spark, p, folder)
    whole = _table(spark, [s for p in parts for s in p], steps)
    assert _run(spark, folder, out, steps) == whole  # a second run goes on where the first one ended
    assert any(n > 1 for *_, n, _, _ in whole)
    _put(spark, [(0, 7777, DAY + dt.timedelta(minutes=5), -0.1, 55.2, None, None)], folder)
    assert _run(spark, folder, out, steps) == whole  # hours after its window has closed


@pytest.mark.parametrize("bundle, crowd", [(16, 200_000), (3, 5)])
def test_bundled_steps_give_what_all_pairs_give(spark, monkeypatch, bundle, crowd):
    """Dense steps and crowded cells too; with whole bundles the candidates' pairs are not grouped."""
    monkeypatch.setattr(incidents, "BUNDLE", bundle)
    monkeypatch.setattr(incidents, "CROWD", crowd)
    steps, ships = rows(5)
    a, b = spark.createDataFrame(steps, STEP.format("timestamp_ntz")), spark.createDataFrame(ships, SHIP.format("timestamp_ntz"))
    best = incidents.timed_candidates(a, b)
    pairs = incidents.timed_pairs(a, b)
    near = pairs.groupBy("incident_id", "ordinal").agg(F.min(F.struct("_squared", "step")).alias("m")).select("incident_id", "ordinal", "m.step")
    assert {tuple(r) for r in best.select("incident_id", "ordinal", "step").collect()} == {tuple(r) for r in near.collect()}
    for window in ("1 hour", "10 minutes", "3 hours"):
        shown = lambda df: sorted(map(tuple, df.withColumn("closest_km", F.round("closest_km", 6)).select("window_start", "incident_id", "mmsi", "n_pairs", "closest_km", "closest_step").collect()), key=str)
        assert shown(incidents.timed_approaches(a, b, window)) == shown(incidents.closest_approaches(pairs, window))
    if bundle == 16:
        text = best._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in text.split("Join")[0]


def test_incidents_of_one_track_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(incidents, "SHARED", 2)
    steps, ships = rows(7)
    steps = [s for s in steps if None not in s and s[0] != 9]
    steps += [(10 * c + i, *rest) for c in (1, 2, 3, 4) for i, *rest in steps if i < 2]  # five incidents each of two tracks
    a, b = spark.createDataFrame(steps, STEP.format("timestamp_ntz")), spark.createDataFrame(ships, SHIP.format("timestamp_ntz"))
    bundles = incidents._bundles(a, 25.0, 1_800_000_000, 3_600_000_000)[0]
    assert [(r._lead, [x.incident_id for x in r._shared]) for r in bundles.select("_lead", "_shared").distinct().orderBy("_lead").collect()] == [(0, [0, 10]), (1, [1, 11]), (2, [2]), (3, [3]), (20, [20, 30]), (21, [21, 31]), (40, [40]), (41, [41])]
    pairs = incidents.timed_pairs(a, b)
    near = pairs.groupBy("incident_id", "ordinal").agg(F.min(F.struct("_squared", "step")).alias("m")).select("incident_id", "ordinal", "m.step")
    best = incidents.timed_candidates(a, b).select("incident_id", "ordinal", "step").distinct()
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, near.collect()))
    shown = lambda df: sorted(map(tuple, df.withColumn("closest_km", F.round("closest_km", 6)).select("window_start", "incident_id", "mmsi", "n_pairs", "closest_km", "closest_step").collect()), key=str)
    assert shown(incidents.timed_approaches(a, b)) == shown(incidents.closest_approaches(pairs))


def test_a_vessel_with_one_position_in_a_window_is_not_grouped(spark):
    steps, ships = rows(11)
    a, b = spark.createDataFrame(steps, STEP.format("timestamp_ntz")), spark.createDataFrame(ships, SHIP.format("timestamp_ntz"))
    found = incidents.timed_approaches(a, b, shown="yyyy-MM-dd HH:mm")
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # the first of two branches
    shown = lambda df: sorted(map(tuple, df.withColumn("closest_km", F.round("closest_km", 6)).select("window_start", "incident_id", "mmsi", "n_pairs", "closest_km", "closest_step").collect()), key=str)
    want = incidents.closest_approaches(incidents.timed_pairs(a, b)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))
    got = shown(found)
    assert got == shown(want)
    at = {(str(p[2])[:13], p[1]) for p in ships if p[2]}
    several = {k for k in at if sum(p[2] is not None and (str(p[2])[:13], p[1]) == k for p in ships) > 1}
    assert {(w[:13], m) in several for w, _, m, *_ in got} == {True, False}  # both kinds are there


def test_the_streams_folder_grows_with_positions_not_with_pairs(spark, tmp_path):
    import pyarrow.parquet as pq

    steps, ships = rows(13)
    steps = [(10 * c + i, *rest) for c in range(9) for i, *rest in steps if i < 4]
    steps, ships = spark.createDataFrame(steps, STEP.format("timestamp_ntz")), [s for s in ships if s[2]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "run")
    _put(spark, ships, folder)
    stream = spark.readStream.schema(SHIP.format("timestamp_ntz")).parquet(folder)
    approaches.start(stream, steps, f"{out}/out", f"{out}/checkpoint", reach=20.0, minutes=20, window="30 minutes").awaitTermination()
    shown = lambda df: sorted(map(tuple, df.withColumn("closest_km", F.round("closest_km", 6)).select("window_start", "incident_id", "mmsi", "n_pairs", "closest_km", "closest_step").collect()), key=str)
    want = shown(incidents.closest_approaches(incidents.timed_pairs(steps, spark.createDataFrame(ships, SHIP.format("timestamp_ntz")), 20.0, 20), "30 minutes"))
    assert shown(approaches.current(spark, f"{out}/out")) == want
    kept = sum(pq.read_metadata(f).num_rows for f in (tmp_path / "run" / "out").glob("**/batch=*/*.parquet"))
    assert 0 < kept <= len(ships) < len(want)


def test_a_track_is_folded_once(spark):
    """No filter that Spark infers from the generator folds it too (before the origins are dealt)."""
    origins = spark.createDataFrame([(1, DAY, 4.0, 55.0, "hindcast")], "incident_id int, ts timestamp_ntz, lon double, lat double, mode string")
    plan = incidents.drift(incidents.spread(origins, "incident_id"), 12, (0.2, 0.1), (5.0, 5.0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "size(" not in plan
