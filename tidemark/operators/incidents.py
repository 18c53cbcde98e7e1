"""Drift tracks, vessel attribution and the incident dossier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.plans.lineage import written


def drift(origins: DataFrame, hours: float, current: tuple[float, float], wind: tuple[float, float], leeway: float = S.LEEWAY, deflection: float = S.DEFLECTION, minutes: int = 15) -> DataFrame:
    """Track points of every origin (lon, lat, ts, mode in hindcast or forecast): step, ts, lon, lat, step_hours.

    Each step depends on the latitude before it, so a track is a fold over its steps; its length is hours over minutes.
    """
    u, v = S.drift_velocity(*current, *wind, leeway, deflection)
    steps = int(hours * 60 / minutes)
    sign = F.when(F.col("mode") == "hindcast", -1.0).when(F.col("mode") == "forecast", 1.0).otherwise(F.raise_error(F.lit("mode is hindcast or forecast")).cast("double"))
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))

    def step(a, _):
        p = F.element_at(a, -1)
        north, east = S.metres_per_degree_short(p["lat"])
        move = minutes * 60 * F.col("_sign")
        return F.concat(a, F.array(point(p["lon"] + u * move / east, p["lat"] + v * move / north)))

    df = origins.withColumn("_sign", sign)
    start = F.array(point(F.col("lon").cast("double"), F.col("lat").cast("double")))
    track = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step) if steps > 0 else start
    keep = [c for c in origins.columns if c not in ("lon", "lat", "ts")]
    df = df.select(*keep, "ts", "_sign", F.posexplode(track).alias("step", "p"))  # of a column Spark would infer a filter on its size, and fold again for that
    rounded = lambda c: F.when(F.col("step") == 0, F.col(f"p.{c}")).otherwise(F.round(f"p.{c}", 6)).alias(c)
    ts = F.col("ts") + F.make_dt_interval(mins=(F.col("step") * F.col("_sign") * minutes).cast("int"))
    return df.select(*keep, "step", ts.alias("ts"), rounded("lon"), rounded("lat"), F.round(F.col("step") * minutes / 60, 2).alias("step_hours"))


def endpoints(track: DataFrame, by: list[str]) -> DataFrame:
    """Number of points, first and last point and duration of each track."""
    p = F.struct("lon", "lat")
    df = track.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"), F.min_by(p, "step").alias("a"), F.max_by(p, "step").alias("b"), F.max("step_hours").alias("duration_hours"))
    return df.select(*by, "n_points", F.col("a.lon").alias("first_lon"), F.col("a.lat").alias("first_lat"), F.col("b.lon").alias("last_lon"), F.col("b.lat").alias("last_lat"), "duration_hours")


def _at_once(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with further columns that a later filter does not compute a second time (it can't pass a generator)."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _padding(reach: float, most_lat: Column) -> tuple[float, Column]:
    """Degrees of latitude and of longitude that a distance of `reach` km spans at most, up to the latitude most_lat (north or south)."""
    r = reach / S.EARTH_KM * 1.0001
    wide = F.sin(F.lit(r)) / F.greatest(F.cos(F.radians(most_lat)), F.lit(1e-9))
    return math.degrees(r), F.when((most_lat >= 89.0) | (wide >= 1.0), 180.0).otherwise(F.degrees(F.asin(F.least(wide, F.lit(1.0)))))


def vessel_distances(ais: DataFrame, centroid: tuple[float, float], track: list[tuple[float, float]], reach: float | None = None) -> DataFrame:
    """Distances to the centroid and to the nearest track point, and the lesser; with `reach` only vessels within it.

    A track has at most a few hundred points: they go as constants, not as a join. A box around them is compared first, and
    the nearest point found by squared chords, so a row costs three products a point. An empty track gives no distance to it.
    """
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    df = ais
    if reach is not None:
        xs, ys = zip(*[centroid, *track])
        most = max(map(abs, ys)) + math.degrees(reach / S.EARTH_KM)
        high, wide = _padding(reach, F.lit(float(most)))
        df = df.where(lat.between(min(ys) - high, max(ys) + high))
        if min(xs) > -90 and max(xs) < 90 and most < 80:  # away from where longitudes begin again
            df = df.where(lon.between(F.lit(float(min(xs))) - wide, F.lit(float(max(xs))) + wide))
    df = df.withColumns(dict(zip(("_x", "_y", "_z"), S.unit_vector(lon, lat))))

    def squared(place) -> str:
        x, y = (math.radians(v) for v in place)
        p = (math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y))
        return " + ".join(f"({c} - {v!r}D) * ({c} - {v!r}D)" for c, v in zip(("_x", "_y", "_z"), p))

    # one expression as text: built call by call, hundreds of points would take seconds on the driver
    nearest = ", ".join(map(squared, track))
    nearest = F.expr(f"least({nearest})" if len(track) > 1 else nearest or "CAST(NULL AS DOUBLE)")
    df = _at_once(df, dist_centroid=S.chord_km(F.expr(squared(centroid))), dist_track=S.chord_km(nearest)).drop("_x", "_y", "_z")
    df = df.withColumn("effective", F.least("dist_centroid", "dist_track"))
    return df if reach is None else df.where(F.col("effective") <= reach)


#: Points of a track that go through the join side by side, as columns of one row.
SEGMENT = 8
#: Rows of segments and cells (some thirty numbers each, about 25 MB in all) that may go to every task.
BROADCAST_SEGMENTS = 100_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all shuffle partitions: few rows that later steps multiply must not be put together for their small size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _most(reach: float) -> float:
    """The squared chord of a distance of `reach` km, rounded up."""
    return (2 * math.sin(min(reach / S.EARTH_KM, math.pi) / 2)) ** 2 * (1 + 1e-9) + 1e-18


def _cells(points: Column, reach: float, cell: float) -> Column:
    """The grid cells (r, c) where something within reach of any of the points (an array of lon and lat) may lie; without a place none."""
    across = round(360 / cell)
    of = lambda f: F.transform(points, lambda p: p[f])
    low, high = F.array_min(of("lat")), F.array_max(of("lat"))
    up, wide = _padding(reach, F.greatest(F.abs(low), F.abs(high)) + math.degrees(reach / S.EARTH_KM))
    rows = F.sequence(F.floor((low - up) / cell), F.floor((high + up) / cell))
    west, east = F.floor((F.array_min(of("lon")) - wide) / cell), F.floor((F.array_max(of("lon")) + wide) / cell)
    cols = F.sequence(west, F.least(east, west + across - 1))
    found = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("r"), F.pmod(c, F.lit(across)).alias("c")))))
    return F.coalesce(found, F.filter(F.array(F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"))), lambda x: F.lit(False)))


def _segments(incidents: DataFrame, reach: float, cell: float) -> DataFrame:
    """Segments of up to SEGMENT points of every incident's track in the cells where a ship may need them: incident_id, the centroid's and the points' unit vectors, _row and _col.

    A ship needs a segment within reach of it, and all segments if it is within reach of the centroid (the distance to the track
    counts there however far it is). An incident without a track is one segment of null points.
    """
    pair = lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat"))
    here = F.array(F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")))
    track = F.coalesce(F.transform("track", pair), F.array_except(here, here))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_track") - 1, F.lit(0)), F.lit(SEGMENT))
    parts = incidents.select("incident_id", here.alias("_here"), track.alias("_track")).withColumn("_from", F.explode(starts))
    parts = spread(parts, "incident_id", "_from").select("incident_id", "_here", F.slice("_track", F.col("_from") + 1, F.lit(SEGMENT)).alias("_p"))

    vector = lambda p: dict(zip("xyz", S.unit_vector(p["lon"], p["lat"])))
    centre = {f"_c{k}": v for k, v in vector(F.col("_here")[0]).items()}
    points = {f"_p{i}{k}": v for i in range(SEGMENT) for k, v in vector(F.get("_p", F.lit(i))).items()}
    near = F.array_distinct(F.concat(_cells(F.col("_p"), reach, cell), _cells(F.col("_here"), reach, cell)))
    df = parts.select("incident_id", *(v.alias(k) for k, v in {**centre, **points}.items()), F.explode(near).alias("_at"))
    return df.select("*", F.col("_at.r").alias("_row"), F.col("_at.c").alias("_col")).drop("_at")


def incident_distances(incidents: DataFrame, ais: DataFrame, reach: float = S.REACH_KM, cell: float = 0.25) -> DataFrame:
    """Vessels within reach of each incident, with their distances; a row per incident and vessel position.

    incidents: incident_id, lon, lat (centroid) and track, an array of lon and lat (null or empty: the centroid alone counts).
    Tracks are cut into segments, and each goes to the cells of a grid where a position may need it; a position lies in one
    cell, so the join is an equality. Squared chords to a segment's points are one generated expression; pairs out of reach of
    both go before the minimum over segments is taken, and only what is left costs an arc. Cells wrap round at 180 degrees.

    Segments with their cells are written and counted. Up to BROADCAST_SEGMENTS of them go to all tasks: positions, dealt by a
    number of their own, stay where they are, so crowded cells are spread, and the minimum needs no further shuffle.
    More are joined by a shuffle on the cells, where crowded ones are left to Spark's splitting of skewed joins.
    """
    across = round(360 / cell)
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    segments = written(_segments(incidents, reach, cell), "segments")
    few = segments.count() <= BROADCAST_SEGMENTS
    ships = ais.withColumn("_id", F.monotonically_increasing_id())
    ships = spread(ships, "_id") if few else ships
    ships = ships.withColumns({"_row": F.floor(lat / cell), "_col": F.pmod(F.floor(lon / cell), F.lit(across)), **dict(zip(("_x", "_y", "_z"), S.unit_vector(lon, lat)))})
    squared = lambda p: " + ".join(f"(_{k} - {p}{k}) * (_{k} - {p}{k})" for k in "xyz")
    both = ships.join(segments.hint("broadcast" if few else "merge"), ["_row", "_col"])
    both = both.select(*ais.columns, "_id", "incident_id", F.expr(squared("_c")).alias("_centre"), F.expr("least(" + ", ".join(squared(f"_p{i}") for i in range(SEGMENT)) + ")").alias("_track"))
    both = both.where((F.col("_centre") <= _most(reach)) | (F.col("_track") <= _most(reach)))
    least = both.groupBy("_id", "incident_id", *(f"`{c}`" for c in ais.columns)).agg(F.min("_centre").alias("_centre"), F.min("_track").alias("_track"))
    least = least.select("incident_id", *(f"`{c}`" for c in ais.columns), S.chord_km(F.col("_centre")).alias("dist_centroid"), S.chord_km(F.col("_track")).alias("dist_track"))
    return least.withColumn("effective", F.least("dist_centroid", "dist_track")).where(F.col("effective") <= reach)


def _minute(df: DataFrame, name: str) -> Column:
    """Whole minutes since 1970: a time without zone counts as it is written, one with a zone by its instant (hours that a clock repeats too)."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.datediff(c, F.lit("1970-01-01")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return F.floor(F.unix_seconds(c) / 60)


def timed_pairs(steps: DataFrame, ais: DataFrame, reach: float = S.REACH_KM, minutes: int = 30, cell: float = 0.5) -> DataFrame:
    """Positions that lie within reach of a track step and within `minutes` of its time: ais's columns, incident_id, step and _squared (of the chord).

    An extension: the ranking by place alone does not look at times. steps: incident_id, step, ts, lon, lat, as drift() gives them
    for one mode; ais: lon, lat, ts and more. Both bounds count as within. A step goes to the few cells and spans of time where a
    position may need it, a position lies in one of each, so the join is an equality on cell and span, and Spark splits crowded
    ones of positions at runtime. Rows without a time or place meet nothing. Both sides may have repeated rows. `ais` may be a stream.
    """
    across, span = round(360 / cell), 2 * minutes
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    here = F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    at = _minute(steps, "ts")
    place = {f"_p{k}": v for k, v in zip("xyz", S.unit_vector(lon, lat))}
    spans = F.sequence(F.floor((at - minutes) / span), F.floor((at + minutes) / span))
    own = spread(steps, "incident_id", "step").select("incident_id", "step", F.col("ts").alias("_at"), *(v.alias(k) for k, v in place.items()), _cells(here, reach, cell).alias("_cells"), spans.alias("_spans"))
    own = own.withColumn("_span", F.explode("_spans")).select("*", F.inline("_cells").alias("_row", "_col")).drop("_cells", "_spans")
    key = {"_row": F.floor(lat / cell), "_col": F.pmod(F.floor(lon / cell), F.lit(across)), "_span": F.floor(_minute(ais, "ts") / span)}
    ships = ais.withColumns({**key, **dict(zip(("_x", "_y", "_z"), S.unit_vector(lon, lat)))})
    both = ships.join(own.hint("merge"), list(key))  # never broadcast: Spark does not count what the generators add to the steps
    near = F.make_dt_interval(mins=F.lit(minutes))
    both = both.where((F.col("ts") >= F.col("_at") - near) & (F.col("ts") <= F.col("_at") + near))
    squared = " + ".join(f"(_{k} - _p{k}) * (_{k} - _p{k})" for k in "xyz")
    both = both.select(*(f"`{c}`" for c in ais.columns), "incident_id", "step", F.expr(squared).alias("_squared"))
    return both.where((F.col("_squared") <= _most(reach)) & (S.chord_km(F.col("_squared")) <= reach))


#: Steps of a track that go through a timed join side by side, as columns of one row, at most.
BUNDLE = 16
#: Incidents of one and the same track that go through a timed join as one row, at most.
SHARED = 64
#: Positions of one cell and span that one task takes; more are dealt over several, and the steps there copied to each.
CROWD = 200_000


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970, counted as in _minute()."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return _minute(df, name) * 60000000 + (F.date_part(F.lit("SECOND"), c) * 1000000).cast("long")
    return F.unix_micros(c)


def _spans(at: Column, near: int, span: int) -> tuple[Column, Column]:
    """The first and the last number of the spans (of `span` microseconds) that lie within `near` of a time."""
    number = lambda t: ((t - F.pmod(t, F.lit(span))) / span).cast("long")
    return number(at - near), number(at + near)


def _tracks(steps: DataFrame) -> DataFrame:
    """Every distinct track (_track: step, _at in microseconds, lon and lat, in order) with up to SHARED of the incidents that have it (_shared); _lead is the first of those.

    Incidents at one place and time drift alike: what is near them is found once. More than SHARED are several rows, numbered by a window that spills.
    """
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    own = spread(steps, "incident_id").select("incident_id", "step", _micros(steps, "ts").alias("_at"), lon.alias("lon"), lat.alias("lat")).where("_at IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    own = own.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("step", "_at", "lon", "lat"))).alias("_track"))
    alike = Window.partitionBy("_like").orderBy("incident_id")
    own = own.withColumn("_like", F.xxhash64("_track")).withColumn("_part", F.floor((F.row_number().over(alike) - 1) / SHARED))
    shared = own.groupBy("_like", "_part", "_track").agg(F.sort_array(F.collect_list(F.struct("incident_id"))).alias("_shared"))
    return shared.select("_shared", F.col("_shared")[0]["incident_id"].alias("_lead"), "_track")


def _bundles(steps: DataFrame, reach: float, near: int, span: int) -> tuple[DataFrame, int, bool]:
    """Tracks by span where a position may need them, up to BUNDLE steps in a row, in the steps' order: _shared, _lead, _span, _points (lon, lat), and by number i
    _s (the step), _a (its microseconds), _px, _py, _pz; _far bounds the squared chord from the first point to what is near any. Also their number
    of slots, and whether no track has two rows in a span. Slots that are left have points out of any reach. Tracks by span are written, so they are made once.
    """
    point = _tracks(steps).select("_shared", "_lead", F.inline("_track")).withColumn("_span", F.explode(F.sequence(*_spans(F.col("_at"), near, span))))
    rows = point.groupBy("_lead", "_span").agg(F.first("_shared").alias("_shared"), F.sort_array(F.collect_list(F.struct("step", "_at", "lon", "lat"))).alias("_all"))
    rows = written(rows, "bundles")
    most = rows.agg(F.max(F.size("_all"))).first()[0] or 1
    slots = min(most, BUNDLE)
    if most > BUNDLE:
        rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(1), F.size("_all"), F.lit(BUNDLE)))).withColumn("_all", F.slice("_all", F.col("_from"), BUNDLE))
    one = lambda i, f: F.get("_all", F.lit(i))[f]
    columns = {}
    for i in range(slots):
        columns |= {f"_s{i}": F.coalesce(one(i, "step"), F.lit(-1)), f"_a{i}": F.coalesce(one(i, "_at"), F.lit(0).cast("long"))}
        columns |= {f"_p{i}{k}": F.coalesce(v, F.lit(1e9)) for k, v in zip("xyz", S.unit_vector(one(i, "lon"), one(i, "lat")))}
    points = F.transform("_all", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("_points")
    rows = rows.select("_shared", "_lead", "_span", points, *(v.alias(k) for k, v in columns.items()))
    apart = F.greatest(*(F.when(F.col(f"_s{i}") != -1, F.expr(" + ".join(f"(_p0{k} - _p{i}{k}) * (_p0{k} - _p{i}{k})" for k in "xyz"))).otherwise(0.0) for i in range(slots)), F.lit(0.0))
    far = F.pow(F.sqrt(apart) + math.sqrt(_most(reach)), 2) * (1 + 1e-9)
    return rows.withColumn("_far", F.coalesce(far, F.lit(5.0))), slots, most <= BUNDLE


def _greatest(spark: SparkSession, reach: float) -> float:
    """The greatest squared chord whose chord_km() is within `reach`: that function rises, so comparing with this bound is the same as comparing distances."""
    import numpy as np

    asin = spark.sparkContext._jvm.java.lang.Math.asin  # as Spark takes it
    low, high = 0, int(np.float64(_most(reach)).view(np.int64))
    while low < high:
        at = (low + high + 1) // 2
        x = float(np.int64(at).view(np.float64))
        low, high = (at, high) if x <= 4 and S.EARTH_KM * 2 * asin(math.sqrt(x) / 2) <= reach else (low, at - 1)
    return float(np.int64(low).view(np.float64)) if reach < S.EARTH_KM * math.pi else 5.0


def _vector(lon: Column, lat: Column) -> dict[str, Column]:
    """A position's _x, _y and _z, out of any reach where it has no place."""
    return {k: F.coalesce(v, F.lit(-1e9)) for k, v in zip(("_x", "_y", "_z"), S.unit_vector(lon, lat))}


def _measured(both: DataFrame, keep: list[str], slots: int, near: int) -> DataFrame:
    """Positions (_x, _y, _z, _m) beside the bundles that they may be near to: keep and, by slot, _d: the squared chord, 1e18 where times are too far apart."""
    squared = lambda i: " + ".join(f"(_{k} - _p{i}{k}) * (_{k} - _p{i}{k})" for k in "xyz")
    found = [f"IF(abs(_m - _a{i}) <= {near}L, {squared(i)}, 1e18D) AS _d{i}" for i in range(slots)]
    return both.where(F.expr(f"{squared(0)} <= _far")).selectExpr(*keep, *(f"_s{i}" for i in range(slots)), *found)


def _nearest(df: DataFrame, keep: list[str], slots: int, most: float) -> DataFrame:
    """What _measured() has found, by row: keep, n_pairs (slots within most), _squared of the nearest step, and its number, the earlier of equals. Rows out of reach are still there."""
    d = [f"_d{i}" for i in range(slots)]
    df = df.withColumn("_squared", F.least(*d) if slots > 1 else F.col(d[0]))
    count = F.expr(" + ".join(f"IF({n} <= {most!r}D, 1L, 0L)" for n in d))
    step = F.coalesce(*(F.when(F.col(n) == F.col("_squared"), F.col(f"_s{i}")) for i, n in enumerate(d)))
    return df.select(*keep, count.alias("n_pairs"), "_squared", step.alias("step"))


def _incidents(df: DataFrame, most: float, *columns: Column | str) -> DataFrame:
    """A row for each incident of a pair's track, with columns made once a pair; none where the pair is out of reach (a filter would be computed before the join lets the pair go)."""
    return df.select(*columns, F.inline(F.when(F.col("_squared") <= most, F.col("_shared"))))


def timed_candidates(steps: DataFrame, ais: DataFrame, reach: float = S.REACH_KM, minutes: int = 30, cell: float = 0.5) -> DataFrame:
    """Every position near a track in place and time, once per incident: ais's columns, incident_id, the nearest step (the earlier number of equals), distance_km and attribution_score.

    The steps that a position of one cell and span may need of a track lie in one row, so the nearest is found where the
    two meet: pairs are neither shuffled nor grouped (save where steps are denser than BUNDLE in a span). What depends on the
    position alone is made before they meet, and what incidents of one track have in common once for all of them.
    """
    near, across = minutes * 60000000, round(360 / cell)
    span, most = 2 * near or 60000000, _greatest(ais.sparkSession, reach)
    bundles, slots, whole = _bundles(steps, reach, near, span)
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    key = ["_row", "_col", "_span", "_deal"]
    kind, sog = S.type_score(F.coalesce("vessel_type", F.lit("Unknown"))), S.speed_score(F.coalesce(F.col("sog_knots").cast("double"), F.lit(10.0)))
    ships = ais.withColumns({"_id": F.monotonically_increasing_id(), "_m": _micros(ais, "ts"), "_row": F.floor(lat / cell), "_col": F.pmod(F.floor(lon / cell), F.lit(across)), **_vector(lon, lat), "_kind": kind, "_sog": sog})
    ships = ships.withColumn("_span", _spans(F.col("_m"), 0, span)[0]).where("_m IS NOT NULL AND _row IS NOT NULL AND _col IS NOT NULL")
    crowds = ships.groupBy(*key[:3]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowds = F.broadcast(crowds.select(*key[:3], F.ceil(F.col("n") / CROWD).alias("_tasks")))  # a row per CROWD positions at most
    tasks = F.coalesce("_tasks", F.lit(1).cast("long"))
    ships = ships.join(crowds, key[:3], "left").withColumn("_deal", F.pmod(F.col("_id"), tasks)).drop("_tasks")
    bundles = bundles.withColumn("_at", F.explode(_cells(F.col("_points"), reach, cell))).withColumns({"_row": F.col("_at.r"), "_col": F.col("_at.c")}).drop("_at", "_points")
    bundles = bundles.join(crowds, key[:3], "left").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("_tasks")
    names = [f"`{c}`" for c in ais.columns]
    keep = [*names, "_id", *key, "_kind", "_sog", "_lead", "_shared"]
    found = _nearest(_measured(spread(ships, *key).join(spread(bundles, *key).hint("merge"), key), keep, slots, near), keep, slots, most)
    if not whole:
        found = found.where(F.col("_squared") <= most).groupBy(*keep[:-1]).agg(F.first("_shared").alias("_shared"), F.min(F.struct("_squared", "step")).alias("_best")).select(*names, "_kind", "_sog", "_shared", "_best.*")
    found = found.withColumn("_km", S.chord_km(F.col("_squared")))
    score = S.attribution_score(S.distance_score(F.col("_km"), reach), F.col("_kind"), F.col("_sog"))
    return _incidents(found, most, *names, "step", S.rounded(F.col("_km"), 2).alias("distance_km"), S.rounded(score, 1).alias("attribution_score")).select("incident_id", *names, "step", "distance_km", "attribution_score")


#: Parts that the vessels of a window are dealt over; the steps near the window go to each.
DEALS = 4


def timed_approaches(steps: DataFrame, ais: DataFrame, window: str = "1 hour", reach: float = S.REACH_KM, minutes: int = 30, shown: str | None = None) -> DataFrame:
    """What closest_approaches() makes of timed_pairs(), without a shuffle of pairs: a vessel's positions of a window and all steps near that window meet in one task.

    A vessel with one position in a window is not grouped; of others a task groups the rows of its windows' result. A chord to a bundle's
    first step leaves out most others. With `shown`, a pattern of date_format(), window_start is text, made once a position instead of once a pair.
    """
    spark, near, most = ais.sparkSession, minutes * 60000000, _greatest(ais.sparkSession, reach)
    span = spark.range(1).select(F.expr(f"unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {window})")).first()[0]
    bundles, slots, whole = _bundles(steps, reach, near, span)
    key = ["_span", "_deal"]
    deal = F.pmod(F.hash("mmsi"), F.lit(DEALS))
    place = _vector(F.col("lon").cast("double"), F.col("lat").cast("double"))
    start = F.window("ts", window)["start"]
    ships = ais.select("mmsi", (F.date_format(start, shown) if shown else start).alias("window_start"), _micros(ais, "ts").alias("_m"), *(v.alias(k) for k, v in place.items()), deal.alias("_deal"))
    ships = spread(ships.withColumn("_span", _spans(F.col("_m"), 0, span)[0]).where("_m IS NOT NULL"), *key)
    ships = ships.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key, "mmsi")))
    bundles = spread(bundles.drop("_points").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))), *key)
    keep = [*key, "window_start", "mmsi", "_lead", "_shared"]
    measured = lambda of: _nearest(_measured(ships.where(of).join(bundles.hint("merge"), key), keep, slots, near), keep, slots, most)
    again = measured("_n > 1" if whole else "true").where(F.col("_squared") <= most).groupBy(*keep[:-1])
    again = again.agg(F.first("_shared").alias("_shared"), F.sum("n_pairs").alias("n_pairs"), F.min(F.struct("_squared", "step")).alias("_best")).select("window_start", "mmsi", "_shared", "n_pairs", "_best.*")
    once = [measured("_n = 1").select(again.columns)] if whole else []
    out = [_incidents(x, most, "window_start", "mmsi", "n_pairs", S.chord_km(F.col("_squared")).alias("closest_km"), F.col("step").alias("closest_step")) for x in [*once, again]]
    out = [x.select("window_start", "incident_id", "mmsi", "n_pairs", "closest_km", "closest_step") for x in out]
    return out[0].unionByName(out[1]) if whole else out[0]



def closest_approaches(pairs: DataFrame, window: str = "1 hour") -> DataFrame:
    """What timed_pairs() found, by window of the positions' times, incident and vessel: n_pairs, closest_km and the step of it. For tables and streams."""
    best = F.min(F.struct("_squared", "step")).alias("_best")
    df = pairs.groupBy(F.window("ts", window).alias("_w"), "incident_id", "mmsi").agg(F.count(F.lit(1)).alias("n_pairs"), best)
    return df.select(F.col("_w.start").alias("window_start"), "incident_id", "mmsi", "n_pairs", S.chord_km(F.col("_best._squared")).alias("closest_km"), F.col("_best.step").alias("closest_step"))


CANDIDATE = ("mmsi", "vessel_name", "vessel_type", "distance_to_spill_km", "distance_to_drift_track_km", "sog_knots", "cog_degrees", "attribution_score", "data_provenance", "evidence_summary")


def scored(near: DataFrame, reach: float = S.REACH_KM, synthetic: bool = False) -> DataFrame:
    """Vessels with distances as candidates with scores; columns of near other than a vessel's come first."""
    kind, sog = F.coalesce("vessel_type", F.lit("Unknown")), F.coalesce(F.col("sog_knots").cast("double"), F.lit(10.0))
    score = S.attribution_score(S.distance_score(F.col("effective"), reach), S.type_score(kind), S.speed_score(sog))
    label = "SYNTHETIC_TEST_DATA" if synthetic else "REAL_AIS_OBSERVATION"
    text = F.concat(F.lit(f"[{label}] Proximity "), F.round("effective", 1).cast("string"), F.lit("km, Category "), kind, F.lit(", SOG "), sog.cast("string"), F.lit(" kts"))
    keep = [c for c in ("incident_id", "ordinal") if c in near.columns]
    return near.select(
        *keep, "mmsi", F.coalesce("vessel_name", F.lit("Unknown")).alias("vessel_name"), kind.alias("vessel_type"), F.round("dist_centroid", 2).alias("distance_to_spill_km"),
        F.round("dist_track", 2).alias("distance_to_drift_track_km"), sog.alias("sog_knots"), F.coalesce(F.col("cog").cast("double"), F.lit(0.0)).alias("cog_degrees"),
        F.round(score, 1).alias("attribution_score"), F.lit(label).alias("data_provenance"), text.alias("evidence_summary"),
    )


def vessel_candidates(ais: DataFrame, centroid, track, reach: float = S.REACH_KM, synthetic: bool = False) -> DataFrame:
    """Candidates of one incident; the order is by attribution_score, then by the input's ordinal."""
    return scored(vessel_distances(ais, centroid, track, reach), reach, synthetic)


def incident_candidates(incidents: DataFrame, ais: DataFrame, reach: float = S.REACH_KM, synthetic: bool = False) -> DataFrame:
    """Candidates of every incident of a table, by incident_id."""
    return scored(incident_distances(incidents, ais, reach), reach, synthetic)


def top_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    return candidates.orderBy(F.desc("attribution_score"), "ordinal").limit(n)


def attribution_summary(incidents: DataFrame, candidates: DataFrame, n: int = 3, synthetic: bool = False) -> DataFrame:
    """incident_id, n_candidates, real_ais and priority (the n best): a row per incident, without candidates too."""
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("attribution_score"), "ordinal"))
    best = candidates.withColumn("place", place).where(F.col("place") <= n)
    best = best.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*CANDIDATE).alias("x")))).alias("p"))
    counts = candidates.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    none = F.from_json(F.lit("[]"), best.schema["p"].dataType)
    df = incidents.select("incident_id").join(counts, "incident_id", "left").join(best, "incident_id", "left")
    return df.select("incident_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_candidates"), F.lit(not synthetic).alias("real_ais"), F.transform(F.coalesce("p", none), lambda x: x["x"]).alias("priority"))


def near_summary(incidents: DataFrame, ais: DataFrame, n: int = 3, reach: float = S.REACH_KM) -> DataFrame:
    """attribution_summary() of incident_candidates(), without a row per candidate.

    Incidents of one place and track are one site, positions of one place one row, with their number and the n first (by ordinal)
    of every class that scores alike there (of type and speed, eight at most). Sites meet places; a site's candidates are the
    sum of those numbers, its best are among the first ones of its best places. So the work grows with sites times places
    within reach, not with incidents times positions.
    """
    kind, sog = F.coalesce("vessel_type", F.lit("Unknown")), F.coalesce(F.col("sog_knots").cast("double"), F.lit(10.0))
    place = Window.partitionBy("lon", "lat", "track")
    sites = written(incidents.select("incident_id", "lon", "lat", "track").withColumn("_site", F.min("incident_id").over(place)), "sites")
    one = sites.where("incident_id = _site").drop("_site")
    ships = ais.withColumns({"_t": S.type_score(kind), "_v": S.speed_score(sog), "lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")})
    alike = Window.partitionBy("lon", "lat", "_t", "_v").orderBy("ordinal")
    first = written(ships.withColumn("_place", F.row_number().over(alike)).where(F.col("_place") <= n).withColumn("_id", F.monotonically_increasing_id()), "first-vessels")
    scored_by = lambda far, of: F.round(S.attribution_score(S.distance_score(far, reach), F.col(f"{of}_t"), F.col(f"{of}_v")), 1)
    likeliest = F.max(F.struct(S.attribution_score(F.lit(0.0), F.col("_t"), F.col("_v")).alias("s"), "_t", "_v")).alias("_top")
    counts = ships.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("_n"), likeliest).where("lon IS NOT NULL AND lat IS NOT NULL")
    places = written(counts.select("lon", "lat", "_n", F.col("_top._t").alias("_top_t"), F.col("_top._v").alias("_top_v")).withColumn("_spot", F.monotonically_increasing_id()), "places")
    near = incident_distances(one, places, reach).withColumn("_most", scored_by(F.col("effective"), "_top"))
    near = written(near.select("incident_id", "_spot", "lon", "lat", "_n", "_most", "dist_centroid", "dist_track", "effective"), "near")
    total = near.groupBy("incident_id").agg(F.sum("_n").alias("n"))
    # the n-th best of the places' best scores: no place whose best is below it has one of the n best
    high = near.withColumn("place", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("_most"), "_spot"))).where(F.col("place") <= n)
    cut = high.groupBy("incident_id").agg(F.when(F.count(F.lit(1)) == n, F.min("_most")).otherwise(-1.0).alias("_cut"))
    left = near.join(cut, "incident_id").where("_most >= _cut").select("incident_id", "lon", "lat", "dist_centroid", "dist_track", "effective")
    best = left.join(first.select("lon", "lat", "_t", "_v", "ordinal", "_id"), ["lon", "lat"]).drop("lon", "lat").withColumn("_score", scored_by(F.col("effective"), ""))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("_score"), "ordinal"))).where(F.col("place") <= n)
    best = best.drop("_t", "_v", "ordinal")
    rows = first.drop("lon", "lat", "_place", "_t", "_v", "ordinal").join(best, "_id")
    best = scored(rows.withColumn("ordinal", F.col("place")), reach)
    top = best.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*CANDIDATE).alias("x")))).alias("p"))
    none = F.from_json(F.lit("[]"), top.schema["p"].dataType)
    found = one.select("incident_id").join(total, "incident_id", "left").join(top, "incident_id", "left").withColumnRenamed("incident_id", "_site")
    found = found.select("_site", F.coalesce("n", F.lit(0).cast("long")).alias("n_candidates"), F.lit(True).alias("real_ais"), F.transform(F.coalesce("p", none), lambda x: x["x"]).alias("priority"))
    return sites.select("incident_id", "_site").join(found, "_site").drop("_site")


# Fixed values of the documents.
LEGAL = "Attribution ranking represents geometric & kinematic correlation for investigation triage; does not constitute legal proof of liability."
AIS_NOTE = "Real AIS feeds require external NMEA/Spire/AisStream integration. Synthetic records are strictly labeled as SYNTHETIC_TEST_DATA."
PROVENANCE = {
    "sar_imagery": "Sentinel-1 C-band SAR IW Mode (Real)",
    "detection_algorithm": "Supervised Random Forest (4-band Polarimetric Features)",
    "drift_model": "2D Lagrangian Particle Transport with Coriolis Deflection (Simulated Engine)",
    "drift_forcings": "Standard Regional Marine Climatology (Simulated / Non-real-time)",
    "ais_data": "Synthetic Test Corridor Traffic (External Real AIS Feed Blocked/Pending)",
}
SCALE = "0.0 (Uncertain) to 1.0 (Highly Confident / Multi-sensor Verified)"
DATA_GAPS = ("Real-world dynamic ocean current & wind observation feeds pending integration", "Live/archive AIS transponder stream pending external API key / provider access")


def attribution_report(incidents: DataFrame, candidates: DataFrame, synthetic: bool = False) -> DataFrame:
    """incident_id and report (a struct): origin, track points and all candidates in order. A report holds one incident's candidates."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("attribution_score")).alias("s"), "ordinal", F.struct(*CANDIDATE).alias("x")))), lambda r: r["x"])
    ranked = candidates.groupBy("incident_id").agg(ranked.alias("ranked"))
    none = F.from_json(F.lit("[]"), ranked.schema["ranked"].dataType)
    df = incidents.join(ranked, "incident_id", "left")
    report = F.struct(
        F.array("lon", "lat").alias("spill_origin"), F.coalesce(F.size("track"), F.lit(0)).alias("hindcast_track_points"), F.lit(not synthetic).alias("real_ais_data_present"),
        F.lit(AIS_NOTE).alias("provenance_disclaimer"), F.lit(LEGAL).alias("legal_disclaimer"), F.coalesce("ranked", none).alias("candidates_ranked"),
    )
    return df.select("incident_id", report.alias("report"))


def report_pieces(incidents: DataFrame, candidates: DataFrame, synthetic: bool = False) -> DataFrame:
    """The JSON texts of attribution_report() line by line, a candidate a line: incident_id, part, at and value, for any number of candidates."""
    from tidemark.sources.files import pieces

    whole = attribution_report(incidents, candidates.limit(0), synthetic)
    text = F.to_json(F.struct(*(F.col(f"report.{f}").alias(f) for f in whole.schema["report"].dataType.names if f != "candidates_ranked")), {"ignoreNullFields": "false"})
    heads = whole.select("incident_id", F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"candidates_ranked":[')).alias("value"))
    rows = candidates.select("incident_id", "attribution_score", "ordinal", F.to_json(F.struct(*CANDIDATE), {"ignoreNullFields": "false"}).alias("value"))
    return pieces(rows, "incident_id", [-F.col("attribution_score"), F.col("ordinal")], heads, "]}")


def report_readings(lines: DataFrame, head: str, row: str) -> tuple[DataFrame, DataFrame]:
    """What a reader gets from report_pieces(), line by line: heads (incident_id, r, by the schema `head`) and candidates (incident_id, at, x, by the schema `row`)."""
    heads = lines.where(F.col("part") == 0).select("incident_id", F.from_json(F.concat("value", F.lit("]}")), head).alias("r"))
    rows = lines.where(F.col("part") == 1).select("incident_id", "at", F.from_json(F.regexp_replace("value", "^,", ""), row).alias("x"))
    return heads, rows


def joined_in_order(rows: DataFrame, by: str, at: str, text: Column, first: Column) -> DataFrame:
    """by, n, joined (the texts in the order of `at`, comma-joined) and first (that of the least `at`).

    Rows are cut by ranges of that order, a range's texts are joined where they lie, and only those pieces meet: a task holds a
    range, and what meets for one key is no more than its text.
    """
    cut = rows.select(by, F.col(at).alias("at"), text.alias("text"), first.alias("first")).repartitionByRange(by, "at").withColumn("_range", F.spark_partition_id())
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda r: r["text"]), ",")
    parts = cut.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("n"), texts.alias("text"), F.min("at").alias("at"), F.min_by("first", "at").alias("first"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_range", "text"))), lambda r: r["text"]), ",")
    return parts.groupBy(by).agg(F.sum("n").alias("n"), texts.alias("joined"), F.min_by("first", "at").alias("first"))


def spill_summary(spills: DataFrame, by: list[str]) -> DataFrame:
    """Number of spills and total area (unknown areas count 0) per incident."""
    return spills.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spills"), F.coalesce(F.sum(F.coalesce("area_km2", F.lit(0.0))), F.lit(0.0)).alias("total_area_km2"))


def primary_spill(spills: DataFrame, by: list[str]) -> DataFrame:
    """The largest spill of each incident with all its columns, the first of equals."""
    rest = [c for c in spills.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("pixel_count"), F.col("component_id"))).alias("x")
    return spills.groupBy(*by).agg(best).select(*by, "x.*")


def incident_tracks(origins: DataFrame, hours: float, current, wind, mode: str = "hindcast", minutes: int = 15) -> DataFrame:
    """incident_id, lon, lat and track of each origin (incident_id, lon, lat, ts): the form that incident_candidates() takes."""
    points = drift(origins.withColumn("mode", F.lit(mode)), hours, current, wind, minutes=minutes)
    line = F.transform(F.array_sort(F.collect_list(F.struct("step", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return origins.select("incident_id", "lon", "lat").join(points.groupBy("incident_id").agg(line.alias("track")), "incident_id")


def confidence(has_spill: Column, has_hindcast: Column, real_ais: Column) -> Column:
    return F.round(F.when(has_spill, 0.5).otherwise(0.0) + F.when(has_hindcast, 0.25).otherwise(0.0) + F.when(real_ais, 0.25).otherwise(0.05), 2)


def dossier(incidents: DataFrame, spills: DataFrame, primary: DataFrame, hindcast: DataFrame, forecast: DataFrame, attribution: DataFrame, now: Column | None = None, prefix: str = "INCIDENT", version: str = "v1.0") -> DataFrame:
    """One nested document per incident_id; missing parts stay null or say so in their status.

    spills: n_spills and total_area_km2; primary: primary_spill() of the same (an incident may be in the former alone, with no
    spill); hindcast, forecast: endpoints() with duration_hours; attribution: attribution_summary(). now: the clock, for tests.
    """
    df = incidents.select("incident_id")
    for other, name in ((spills, "spill"), (primary, "first"), (hindcast, "back"), (forecast, "ahead"), (attribution, "ships")):
        df = df.join(other.select("incident_id", F.struct(*(c for c in other.columns if c != "incident_id")).alias(name)), "incident_id", "left")
    has = lambda c: F.col(c).isNotNull()
    end = lambda c: F.when(has(c), F.array(f"{c}.last_lon", f"{c}.last_lat"))
    now = F.current_timestamp() if now is None else now
    n, known = F.coalesce("spill.n_spills", F.lit(0).cast("long")), has("spill")
    slick = F.struct(
        F.col("first.component_id").alias("component_id"), F.coalesce("first.pixel_count", F.lit(0).cast("long")).alias("pixel_count"),
        F.when(has("first"), F.col("first.area_km2")).otherwise(0.0).alias("area_km2"), F.when(has("first"), F.array("first.centroid_x", "first.centroid_y")).alias("centroid_lon_lat"),
        F.when(has("first"), F.array(F.array("first.bbox_min_x", "first.bbox_min_y"), F.array("first.bbox_max_x", "first.bbox_max_y"))).alias("bounding_box"),
    )
    score = confidence(n > 0, has("back"), F.coalesce("ships.real_ais", F.lit(False)))
    return df.select(
        "incident_id",
        F.concat(F.lit(f"{prefix}-"), F.date_format(now, "yyyyMMdd-HHmmss")).alias("dossier_id"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("generated_utc"), F.lit(version).alias("pipeline_version"),
        F.struct(*(F.lit(v).alias(k) for k, v in PROVENANCE.items())).alias("data_provenance"),
        F.struct(F.when(~known, "DATA_NOT_FOUND").alias("status"), F.when(known, n).alias("total_slick_components"), F.when(known, F.round("spill.total_area_km2", 2)).alias("total_estimated_area_km2"), F.when(known, slick).alias("primary_slick")).alias("sar_detection_summary"),
        F.struct(has("back").alias("hindcast_available"), end("back").alias("estimated_origin_coords"), F.col("back.duration_hours").alias("hindcast_duration_hours"), has("ahead").alias("forecast_available"), end("ahead").alias("projected_impact_coords_12h")).alias("drift_analysis"),
        F.struct(F.when(~has("ships"), "NO_ATTRIBUTION_DATA").alias("status"), F.col("ships.n_candidates").alias("evaluated_candidates_count"), F.col("ships.real_ais").alias("real_ais_verified"), F.when(has("ships"), LEGAL).alias("legal_disclaimer"), F.col("ships.priority").alias("priority_vessels")).alias("vessel_attribution_summary"),
        F.struct(score.alias("overall_confidence_score"), F.lit(SCALE).alias("scale"), F.array(*map(F.lit, DATA_GAPS)).alias("data_gaps")).alias("fusion_confidence"),
    )


def flat(dossiers: DataFrame) -> DataFrame:
    return dossiers.select(
        "incident_id", F.coalesce("sar_detection_summary.total_slick_components", F.lit(0).cast("long")).alias("n_spills"), F.col("sar_detection_summary.total_estimated_area_km2").alias("area_km2"),
        F.col("drift_analysis.hindcast_available").alias("has_hindcast"), F.col("vessel_attribution_summary.evaluated_candidates_count").alias("n_candidates"), F.col("fusion_confidence.overall_confidence_score").alias("confidence"),
    )


def renumbered(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
