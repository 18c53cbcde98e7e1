"""Every operator as a query on the given tables, with the same rows in SQL where SQL can say it."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import forest, incidents, learning, raster
from tidemark.sources import files
from tidemark.streaming import approaches

from . import surrogates as T
from .lineage import run_dir, written
from .surrogates import AIS_SQL, MASK_SQL, PIXELS_SQL

CURRENT, WIND = (0.12, 0.10), (4.5, 4.0)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


CLIP = "least(greatest({0}, -50e0), 5e0)"
UNIT = "least(greatest({0}, 0e0), 1e0)"
VV, VH = CLIP.format("vv"), CLIP.format("vh")
NORM = f"SELECT scene, \"row\", col, {UNIT.format(f'({VV} + 45e0) / 45e0')} AS vv_norm, {UNIT.format(f'({VH} + 45e0) / 45e0')} AS vh_norm, {UNIT.format(f'({VV} - {VH} + 10e0) / 25e0')} AS diff_norm FROM pixels"


@query(f"WITH {PIXELS_SQL} SELECT scene, \"row\", col, round(vv_norm, 6) AS vv_norm, round(vh_norm, 6) AS vh_norm, round(diff_norm, 6) AS diff_norm FROM ({NORM})")
def sar_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pixels(spark, sf_dir)
    vv, vh = S.clip_db(F.col("vv")), S.clip_db(F.col("vh"))
    df = p.select(*raster.KEY, S.normalise(vv).alias("vv_norm"), S.normalise(vh).alias("vh_norm"), S.difference(vv, vh).alias("diff_norm"))
    return df.select(*raster.KEY, *_r("vv_norm", "vh_norm", "diff_norm"))


def _stencil_sql(source: str, columns: str, radius: int = 2) -> str:
    """Means over mirrored neighbours: every pixel meets its (2 radius + 1)^2 offsets by place."""
    n = 2 * radius + 1
    return f"""WITH {PIXELS_SQL}, src AS ({source}), dim AS (SELECT scene, max("row") + 1 AS h, max(col) + 1 AS w FROM src GROUP BY scene),
off AS (SELECT CAST(i // {n} AS INTEGER) - {radius} AS dr, CAST(i % {n} AS INTEGER) - {radius} AS dc FROM range({n * n}) t(i)),
near AS (SELECT s.scene, s."row", s.col, CASE WHEN s."row" + dr < 0 THEN -1 - s."row" - dr WHEN s."row" + dr >= h THEN 2 * h - 1 - s."row" - dr ELSE s."row" + dr END AS nr,
  CASE WHEN s.col + dc < 0 THEN -1 - s.col - dc WHEN s.col + dc >= w THEN 2 * w - 1 - s.col - dc ELSE s.col + dc END AS nc FROM src s JOIN dim USING (scene) CROSS JOIN off),
means AS (SELECT near.scene, near."row", near.col, {columns} FROM near JOIN src n ON n.scene = near.scene AND n."row" = nr AND n.col = nc GROUP BY ALL) """


_BANDS = f'SELECT scene, "row", col, {VV} AS vv, {VH} AS vh FROM pixels'


@query(_stencil_sql(_BANDS, "avg(n.vv) AS vv, avg(n.vh) AS vh") + 'SELECT scene, "row", col, round(vv, 6) AS vv, round(vh, 6) AS vh FROM means')
def box_mean_5x5(spark, sf_dir):
    p = T.pixels(spark, sf_dir).withColumns({b: S.clip_db(F.col(b)) for b in ("vv", "vh")})
    return raster.box_mean(p, ["vv", "vh"]).select(*raster.KEY, *_r("vv", "vh"))


_LEE = "round(m{0} + greatest(s{0} - m{0} * m{0}, 0) / (greatest(s{0} - m{0} * m{0}, 0) + t{0}) * (src.{0} - m{0}), 5) AS {0}"


@query(
    _stencil_sql(_BANDS, "avg(n.vv) AS mvv, avg(n.vh) AS mvh, avg(n.vv * n.vv) AS svv, avg(n.vh * n.vh) AS svh")
    + f', tot AS (SELECT scene, var_pop(vv) AS tvv, var_pop(vh) AS tvh FROM src GROUP BY scene) SELECT src.scene, src."row", src.col, {_LEE.format("vv")}, {_LEE.format("vh")} FROM means JOIN src USING (scene, "row", col) JOIN tot USING (scene)'
)
def lee_despeckle(spark, sf_dir):
    p = T.pixels(spark, sf_dir).withColumns({b: S.clip_db(F.col(b)) for b in ("vv", "vh")})
    return raster.lee(p, ["vv", "vh"]).select(*raster.KEY, *_r("vv", "vh", places=5))


@query(
    _stencil_sql(_BANDS, "avg(n.vv) AS mvv, avg(n.vh) AS mvh, avg(n.vv * n.vv) AS svv, avg(n.vh * n.vh) AS svh", 3)
    + f', tot AS (SELECT scene, var_pop(vv) AS tvv, var_pop(vh) AS tvh FROM src GROUP BY scene) SELECT src.scene, src."row", src.col, {_LEE.format("vv")}, {_LEE.format("vh")} FROM means JOIN src USING (scene, "row", col) JOIN tot USING (scene)'
)
def lee_despeckle_7x7(spark, sf_dir):
    p = T.pixels(spark, sf_dir).withColumns({b: S.clip_db(F.col(b)) for b in ("vv", "vh")})
    return raster.lee(p, ["vv", "vh"], 7).select(*raster.KEY, *_r("vv", "vh", places=5))


def _looks_sql(band: str, looks: int) -> str:
    v = f"greatest(s{band} - m{band} * m{band}, 0)"
    return f"round(CASE WHEN m{band} = 0 THEN 0 ELSE m{band} + {v} / ({v} + m{band} * m{band} / {looks}e0) * (src.{band} - m{band}) END, 5) AS {band}"


_EDGES = _stencil_sql(_BANDS, "avg(n.vv) AS mvv, avg(n.vh) AS mvh, avg(n.vv * n.vv) AS svv, avg(n.vh * n.vh) AS svh", 3)
_EDGES = _EDGES[: _EDGES.index("near AS")] + f"""near AS (SELECT s.scene, s."row", s.col, least(greatest(s."row" + dr, 0), h - 1) AS nr, least(greatest(s.col + dc, 0), w - 1) AS nc FROM src s JOIN dim USING (scene) CROSS JOIN off),
""" + _EDGES[_EDGES.index("means AS") :]


@query(_EDGES + f'SELECT src.scene, src."row", src.col, {_looks_sql("vv", 4)}, {_looks_sql("vh", 4)} FROM means JOIN src USING (scene, "row", col)')
def despeckle_looks(spark, sf_dir):
    """Speckle of four looks filtered over 7 x 7 pixels."""
    p = T.pixels(spark, sf_dir).withColumns({b: S.clip_db(F.col(b)) for b in ("vv", "vh")})
    return raster.despeckle(p, ["vv", "vh"], 3, 4).select(*raster.KEY, *_r("vv", "vh", places=5))


def _lee_sql() -> str:
    """Despeckled bands, unrounded: scene, row, col, vv, vh."""
    exact = "CASE WHEN t{0} = 0 THEN src.{0} ELSE m{0} + greatest(s{0} - m{0} * m{0}, 0) / (greatest(s{0} - m{0} * m{0}, 0) + t{0}) * (src.{0} - m{0}) END AS {0}"
    return (
        _stencil_sql(_BANDS, "avg(n.vv) AS mvv, avg(n.vh) AS mvh, avg(n.vv * n.vv) AS svv, avg(n.vh * n.vh) AS svh")
        + f', tot AS (SELECT scene, var_pop(vv) AS tvv, var_pop(vh) AS tvh FROM src GROUP BY scene) SELECT src.scene, src."row", src.col, {exact.format("vv")}, {exact.format("vh")} FROM means JOIN src USING (scene, "row", col) JOIN tot USING (scene)'
    )


_LEE_NORM = f"SELECT scene, \"row\", col, {UNIT.format('(vv + 45e0) / 45e0')} AS vv_norm, {UNIT.format('(vh + 45e0) / 45e0')} AS vh_norm, {UNIT.format('(vv - vh + 10e0) / 25e0')} AS diff_norm FROM ({_lee_sql()})"

_STD = UNIT.format("sqrt(greatest(s - m * m, 0e0)) / 0.15e0")


@query(_stencil_sql(NORM, "avg(n.vv_norm) AS m, avg(n.vv_norm * n.vv_norm) AS s") + f'SELECT src.scene, src."row", src.col, round(vv_norm, 5) AS vv_norm, round(vh_norm, 5) AS vh_norm, round(diff_norm, 5) AS diff_norm, round({_STD}, 5) AS vv_std_norm FROM means JOIN src USING (scene, "row", col)')
def texture_std(spark, sf_dir):
    return raster.features(T.pixels(spark, sf_dir)).select(*raster.KEY, *_r(*learning.FEATURES, places=5))


@query(_stencil_sql(_LEE_NORM, "avg(n.vv_norm) AS m, avg(n.vv_norm * n.vv_norm) AS s") + f'SELECT src.scene, src."row", src.col, round(vv_norm, 5) AS vv_norm, round(vh_norm, 5) AS vh_norm, round(diff_norm, 5) AS diff_norm, round({_STD}, 5) AS vv_std_norm FROM means JOIN src USING (scene, "row", col)')
def features_despeckled(spark, sf_dir):
    return raster.features(T.pixels(spark, sf_dir), despeckle=True).select(*raster.KEY, *_r(*learning.FEATURES, places=5))


@query(f'SELECT scene, "row", col, round(vv_norm, 5) AS vv_norm, round(vh_norm, 5) AS vh_norm FROM ({_LEE_NORM})')
def preprocess_scene(spark, sf_dir):
    return raster.preprocess(T.pixels(spark, sf_dir)).select(*raster.KEY, *_r("vv_norm", "vh_norm", places=5))


def _tiles_sql(patch: int, stride: int) -> str:
    return f"""WITH {PIXELS_SQL}, dim AS (SELECT scene, max("row") + 1 AS h, max(col) + 1 AS w FROM pixels GROUP BY scene)
SELECT scene, CAST(a.i AS INTEGER) AS patch_r, CAST(b.i AS INTEGER) AS patch_c, count(*) AS n, round(sum(vv), 4) AS vv, CAST(min("row" - a.i * {stride}) AS BIGINT) AS in_r, CAST(max(col - b.i * {stride}) AS BIGINT) AS in_c
FROM pixels JOIN dim USING (scene) JOIN range(64) a(i) ON "row" BETWEEN a.i * {stride} AND a.i * {stride} + {patch - 1} AND a.i * {stride} + {patch} <= h
JOIN range(64) b(i) ON col BETWEEN b.i * {stride} AND b.i * {stride} + {patch - 1} AND b.i * {stride} + {patch} <= w GROUP BY ALL"""


def _tiles(spark, sf_dir, patch, stride):
    t = raster.tiles(T.pixels(spark, sf_dir), patch, stride).groupBy("scene", "patch_r", "patch_c")
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("vv"), 4).alias("vv"), F.min("in_r").cast("long").alias("in_r"), F.max("in_c").cast("long").alias("in_c"))


@query(_tiles_sql(8, 8))
def tile_patches(spark, sf_dir):
    return _tiles(spark, sf_dir, 8, 8)


@query(_tiles_sql(10, 4))
def tile_patches_overlap(spark, sf_dir):
    return _tiles(spark, sf_dir, 10, 4)


_MANIFEST = "SELECT doc_id AS ordinal, CASE lang WHEN 'en' THEN 'oil_spill' WHEN 'de' THEN 'look_alike' ELSE 'no_oil' END AS class, n_chars BETWEEN 50 AND 20000 AS valid FROM documents"


@query(f"""SELECT ordinal, class, CASE WHEN class = 'oil_spill' THEN CASE WHEN n <= 6 THEN 'train' WHEN n <= 8 THEN 'validation' ELSE 'test' END WHEN n <= 1 THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ordinal) AS n FROM ({_MANIFEST}) WHERE valid AND class <> 'no_oil')""")
def scene_split(spark, sf_dir):
    return learning.scene_split(T.manifest(spark, sf_dir)).select("ordinal", "class", "split")


_MASKED = f"{PIXELS_SQL}, masked AS (SELECT *, CAST((event_id * 7919) % 1009 < 420 AS INTEGER) AS y FROM pixels)"


@query(f'WITH {_MASKED} SELECT scene, "row", col, round(vv, 6) AS vv, y FROM masked')
def pixel_mask_join(spark, sf_dir):
    return raster.with_mask(T.pixels(spark, sf_dir), T.masks(spark, sf_dir)).select(*raster.KEY, F.round("vv", 6).alias("vv"), "y")


@query(f"WITH {_MASKED} SELECT scene, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, min(vv) AS lo, max(vv) AS hi, FALSE AS any_nan, FALSE AS any_inf, round(avg(y) * 100, 6) AS pos_pct FROM masked GROUP BY scene")
def split_quality(spark, sf_dir):
    df = learning.split_quality(raster.with_mask(T.pixels(spark, sf_dir), T.masks(spark, sf_dir)), ["scene"], "vv", "y")
    return df.withColumn("pos_pct", F.round("pos_pct", 6))


@query(f"""WITH {_MASKED}, ranked AS (SELECT scene, "row", col, y, row_number() OVER (PARTITION BY y ORDER BY (event_id * 48271) % 2147483647, event_id) AS n FROM masked), pos AS (SELECT least(count(*), 300) AS k FROM masked WHERE y = 1)
SELECT scene, "row", col, y FROM ranked, pos WHERE (y = 1 AND n <= 300) OR (y = 0 AND n <= greatest(3 * k, 500))""")
def stratified_sample_n(spark, sf_dir):
    df = raster.with_mask(T.pixels(spark, sf_dir), T.masks(spark, sf_dir)).withColumn("_id", F.col("scene") * 1000 + F.col("row") * 40 + F.col("col"))
    keys = [F.expr("(_id * 48271) % 2147483647"), F.col("_id")]
    return learning.stratified_sample(written(df, "masked"), "y", keys, 300, 500).select(*raster.KEY, "y")


_TRUTH = "t AS (SELECT quality AS y, 1 - toxic AS pred FROM labels)"
_CELLS = "c AS (SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM t)"


@query(f"WITH {_TRUTH} SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS pred, count(t.y) AS n FROM range(2) a(i) CROSS JOIN range(2) b(i) LEFT JOIN t ON t.y = a.i AND t.pred = b.i GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return learning.confusion(T.truth(spark, sf_dir))


def _div(a, b):
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"


@query(f"WITH {_TRUTH}, {_CELLS} SELECT tn, fp, fn, tp, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1, {_div('tp', 'tp + fp + fn')} AS iou, {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy FROM c")
def prf_iou(spark, sf_dir):
    return learning.metrics(T.truth(spark, sf_dir)).select("tn", "fp", "fn", "tp", *_r("precision", "recall", "f1", "iou", "accuracy"))


@query(f"""WITH {_TRUTH}, {_CELLS}, r AS (SELECT '0' AS label, tn / nullif(tn + fn, 0) AS p, tn / nullif(tn + fp, 0) AS r, 2 * tn / nullif(2 * tn + fn + fp, 0) AS f, tn + fp AS s FROM c
UNION ALL SELECT '1', tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), 2 * tp / nullif(2 * tp + fn + fp, 0), tp + fn FROM c), z AS (SELECT label, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(f, 0) AS f, s FROM r)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM (SELECT * FROM z UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM z
UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM z)""")
def classification_report(spark, sf_dir):
    return learning.report(T.truth(spark, sf_dir)).select("label", *_r("precision", "recall", "f1"), "support")


_COMPONENTS = f"""{MASK_SQL}, runs AS (SELECT scene, "row", min(col) AS c0, max(col) AS c1, scene * 1000000 + "row" * 1000 + min(col) AS node FROM (SELECT *, col - row_number() OVER (PARTITION BY scene, "row" ORDER BY col) AS g FROM mask) GROUP BY scene, "row", g),
edges AS (SELECT a.node AS u, b.node AS v FROM runs a JOIN runs b ON a.scene = b.scene AND abs(a."row" - b."row") = 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1),
reach(node, other) AS (SELECT node, node FROM runs UNION SELECT reach.node, edges.v FROM reach JOIN edges ON edges.u = reach.other), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
stats AS (SELECT scene, root, CAST(sum(c1 - c0 + 1) AS BIGINT) AS pixel_count, min("row") AS r_min, max("row") AS r_max, min(c0) AS c_min, max(c1) AS c_max,
  sum(CAST("row" AS DOUBLE) * (c1 - c0 + 1)) / sum(c1 - c0 + 1) AS cy, sum(CAST(c0 + c1 AS DOUBLE) * (c1 - c0 + 1)) / 2 / sum(c1 - c0 + 1) AS cx FROM runs JOIN roots USING (node) GROUP BY scene, root)"""
_KEPT = 'kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY scene ORDER BY root) AS INTEGER) AS component_id FROM stats WHERE pixel_count >= {})'


@query(f"WITH RECURSIVE {_COMPONENTS}, {_KEPT.format(1)} SELECT scene, component_id, pixel_count, r_min, r_max, c_min, c_max, round(cy, 6) AS cy, round(cx, 6) AS cx FROM kept")
def components(spark, sf_dir):
    df = raster.component_stats(raster.labelled(T.mask(spark, sf_dir)), 1)
    return df.select("scene", "component_id", "pixel_count", "r_min", "r_max", "c_min", "c_max", *_r("cy", "cx"))


@query(f"WITH RECURSIVE {_COMPONENTS}, {_KEPT.format(12)} SELECT scene, component_id, pixel_count FROM kept")
def components_min_px(spark, sf_dir):
    return raster.component_stats(raster.labelled(T.mask(spark, sf_dir)), 12).select("scene", "component_id", "pixel_count")


def _spills(spark, sf_dir, least=12):
    stats = raster.component_stats(raster.labelled(T.mask(spark, sf_dir)), least)
    return raster.polygons(stats, T.scenes(stats))


_G = T.GEO
_X, _Y = (lambda c: f"({_G['ox']}e0 + {c} * {_G['rx']}e0)"), (lambda r: f"({_G['oy']}e0 + {r} * {_G['ry']}e0)")
_LAT = f"radians({_Y('cy')})"
_AREA = f"pixel_count * ({abs(_G['rx'])}e0 * (111412.84e0 * cos({_LAT}) - 93.5e0 * cos(3 * {_LAT})) * {abs(_G['ry'])}e0 * (111132.92e0 - 559.82e0 * cos(2 * {_LAT}) + 1.17e0 * cos(4 * {_LAT}))) / 1e6"
_SPILLS = f"""spills AS (SELECT scene, component_id, pixel_count, CASE WHEN geo THEN {_X('cx')} ELSE cx END AS centroid_x, CASE WHEN geo THEN {_Y('cy')} ELSE cy END AS centroid_y,
  CASE WHEN geo THEN {_X('c_min')} ELSE c_min END AS bbox_min_x, CASE WHEN geo THEN {_Y('r_max')} ELSE r_min END AS bbox_min_y, CASE WHEN geo THEN {_X('c_max')} ELSE c_max END AS bbox_max_x,
  CASE WHEN geo THEN {_Y('r_min')} ELSE r_max END AS bbox_max_y, CASE WHEN geo THEN round({_AREA}, 4) END AS area_km2, geo AS georeferenced FROM (SELECT *, scene % 7 <> 3 AS geo FROM kept))"""
_BOX = ("centroid_x", "centroid_y", "bbox_min_x", "bbox_min_y", "bbox_max_x", "bbox_max_y")


@query(f"WITH RECURSIVE {_COMPONENTS}, {_KEPT.format(12)}, {_SPILLS} SELECT scene, component_id, pixel_count, {', '.join(f'round({b}, 6) AS {b}' for b in _BOX)}, area_km2, georeferenced FROM spills")
def spill_polygons(spark, sf_dir):
    return _spills(spark, sf_dir).select("scene", "component_id", "pixel_count", *_r(*_BOX), "area_km2", "georeferenced")


@query(f"WITH RECURSIVE {_COMPONENTS}, {_KEPT.format(12)}, {_SPILLS} SELECT scene, count(*) AS n_spills, round(coalesce(sum(coalesce(area_km2, 0)), 0), 4) AS total_area_km2 FROM spills GROUP BY scene")
def spill_summary(spark, sf_dir):
    return incidents.spill_summary(_spills(spark, sf_dir), ["scene"]).withColumn("total_area_km2", F.round("total_area_km2", 4))


@query(f"WITH RECURSIVE {_COMPONENTS}, {_KEPT.format(12)} SELECT scene, component_id, pixel_count FROM kept QUALIFY row_number() OVER (PARTITION BY scene ORDER BY pixel_count DESC, component_id) = 1")
def primary_spill(spark, sf_dir):
    return incidents.primary_spill(_spills(spark, sf_dir), ["scene"]).select("scene", "component_id", "pixel_count")


def _origins(spark, sf_dir):
    r = T.table(spark, sf_dir, "region").select("r_regionkey")
    modes = F.explode(F.array(F.lit("hindcast"), F.lit("forecast"))).alias("mode")
    return r.select(F.col("r_regionkey").alias("spill_id"), F.expr("4.035e0 + r_regionkey * 0.1e0").alias("lon"), F.expr("55.243e0 + r_regionkey * 0.05e0").alias("lat"), F.expr("timestamp_ntz'2026-09-16 12:00:00'").alias("ts"), modes)


_U, _V = S.drift_velocity(*CURRENT, *WIND)
_TRACK = f"""track(spill_id, mode, sgn, step, lon, lat) AS (SELECT r_regionkey, m, CASE m WHEN 'hindcast' THEN -1e0 ELSE 1e0 END, 0, 4.035e0 + r_regionkey * 0.1e0, 55.243e0 + r_regionkey * 0.05e0 FROM region, (VALUES ('hindcast'), ('forecast')) v(m)
UNION ALL SELECT spill_id, mode, sgn, step + 1, lon + {_U!r}e0 * 900 * sgn / (111412.84e0 * cos(radians(lat))), lat + {_V!r}e0 * 900 * sgn / (111132.92e0 - 559.82e0 * cos(2 * radians(lat))) FROM track WHERE step < 48)"""
_POINTS = "CASE step WHEN 0 THEN lon ELSE round(lon, 6) END"


@query(f"""WITH RECURSIVE {_TRACK} SELECT spill_id, mode, step, strftime(TIMESTAMP '2026-09-16 12:00:00' + to_minutes(CAST(step * sgn * 15 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS ts, round(lon, 6) AS lon, round(lat, 6) AS lat, round(step * 15 / 60e0, 2) AS step_hours FROM track""")
def drift_track(spark, sf_dir):
    t = incidents.drift(_origins(spark, sf_dir), 12, CURRENT, WIND)
    return t.select("spill_id", "mode", "step", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), *_r("lon", "lat"), "step_hours")


@query(f"""WITH RECURSIVE {_TRACK} SELECT spill_id, mode, count(*) AS n_points, round(arg_min(lon, step), 6) AS first_lon, round(arg_min(lat, step), 6) AS first_lat, round(arg_max(lon, step), 6) AS last_lon, round(arg_max(lat, step), 6) AS last_lat FROM track GROUP BY ALL""")
def track_endpoints(spark, sf_dir):
    e = incidents.endpoints(incidents.drift(_origins(spark, sf_dir), 12, CURRENT, WIND), ["spill_id", "mode"])
    return e.select("spill_id", "mode", "n_points", *_r("first_lon", "first_lat", "last_lon", "last_lat"))


def hindcast_points(hours: float = 12) -> list[tuple[float, float]]:
    """The hindcast from the fixed origin, as the few constants that a distance needs."""
    lon, lat = T.ORIGIN
    points = [(lon, lat)]
    for _ in range(int(hours * 4)):
        p = math.radians(lat)
        lon, lat = lon - _U * 900 / (111412.84 * math.cos(p)), lat - _V * 900 / (111132.92 - 559.82 * math.cos(2 * p))
        points.append((round(lon, 6), round(lat, 6)))
    return points


_POINTS_SQL = "pts(x, y) AS (VALUES " + ", ".join(f"({x!r}e0, {y!r}e0)" for x, y in hindcast_points()) + ")"


def _hav(x, y):
    a = f"(pow(sin(radians({y} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({y})) * pow(sin(radians({x} - lon) / 2), 2))"
    return f"(6371e0 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


_DIST = f"{AIS_SQL}, {_POINTS_SQL}, near AS (SELECT ordinal, mmsi, vessel_type, sog_knots, {_hav('4.035e0', '55.243e0')} AS dc, min({_hav('x', 'y')}) AS dt FROM ais CROSS JOIN pts GROUP BY ALL)"
_SCORE = "round(((greatest(0, 1 - least(dc, dt) / 25)) * 0.60e0 + (CASE WHEN lower(vessel_type) LIKE '%tanker%' OR lower(vessel_type) LIKE '%oil%' THEN 1.0e0 WHEN lower(vessel_type) LIKE '%cargo%' OR lower(vessel_type) LIKE '%container%' THEN 0.75e0 WHEN lower(vessel_type) LIKE '%fishing%' THEN 0.5e0 ELSE 0.3e0 END) * 0.25e0 + (CASE WHEN sog_knots BETWEEN 5 AND 18 THEN 1.0e0 ELSE 0.5e0 END) * 0.15e0) * 100, 1)"
_RANKED = f"ranked AS (SELECT ordinal, mmsi, vessel_type, round(dc, 2) AS distance_to_spill_km, round(dt, 2) AS distance_to_drift_track_km, {_SCORE} AS attribution_score FROM near WHERE least(dc, dt) <= 25)"
_CANDIDATE = ["ordinal", "mmsi", "vessel_type", "distance_to_spill_km", "distance_to_drift_track_km", "attribution_score"]


@query(f"WITH {_DIST} SELECT ordinal, mmsi, round(dc, 4) AS dist_centroid, round(dt, 4) AS dist_track, round(least(dc, dt), 4) AS effective FROM near")
def vessel_distance(spark, sf_dir):
    return incidents.vessel_distances(T.ais(spark, sf_dir), T.ORIGIN, hindcast_points()).select("ordinal", "mmsi", *_r("dist_centroid", "dist_track", "effective", places=4))


@query(f"WITH {_DIST}, {_RANKED} SELECT * FROM ranked")
def vessel_rank(spark, sf_dir):
    return incidents.vessel_candidates(T.ais(spark, sf_dir), T.ORIGIN, hindcast_points()).select(*_CANDIDATE)


@query(f"WITH {_DIST}, {_RANKED} SELECT * FROM ranked ORDER BY attribution_score DESC, ordinal LIMIT 3")
def vessel_top3(spark, sf_dir):
    return incidents.top_candidates(incidents.vessel_candidates(T.ais(spark, sf_dir), T.ORIGIN, hindcast_points())).select(*_CANDIDATE)


def _cross(points: str) -> str:
    """near: a row per incident and vessel, with distances to the centroid (ox, oy) and to the nearest of `points` (incident_id, x, y)."""
    return f"""near AS (SELECT incident_id, ordinal, mmsi, vessel_type, sog_knots, {_hav('ox', 'oy')} AS dc, min({_hav('x', 'y')}) AS dt FROM ais CROSS JOIN ({points}) GROUP BY ALL),
ranked AS (SELECT incident_id, ordinal, mmsi, vessel_type, sog_knots, round(dc, 2) AS distance_to_spill_km, round(dt, 2) AS distance_to_drift_track_km, {_SCORE} AS attribution_score,
  '[REAL_AIS_OBSERVATION] Proximity ' || round(least(dc, dt), 1) || 'km, Category ' || vessel_type || ', SOG ' || sog_knots || ' kts' AS evidence_summary FROM near WHERE least(dc, dt) <= 25)"""


_MANY = f"""{AIS_SQL}, {_TRACK}, {_cross("SELECT spill_id AS incident_id, x, y, ox, oy FROM (SELECT spill_id, CASE step WHEN 0 THEN lon ELSE round(lon, 6) END AS x, CASE step WHEN 0 THEN lat ELSE round(lat, 6) END AS y, first(lon ORDER BY step) OVER (PARTITION BY spill_id ORDER BY step) AS ox, first(lat ORDER BY step) OVER (PARTITION BY spill_id ORDER BY step) AS oy FROM track WHERE mode = 'hindcast')")}"""


def _many(spark, sf_dir):
    o = _origins(spark, sf_dir).where("mode = 'hindcast'").select(F.col("spill_id").alias("incident_id"), "lon", "lat", "ts")
    return incidents.incident_tracks(o, 12, CURRENT, WIND)


@query(f"WITH RECURSIVE {_MANY} SELECT incident_id, ordinal, mmsi, vessel_type, distance_to_spill_km, distance_to_drift_track_km, attribution_score, evidence_summary FROM ranked")
def vessel_rank_many(spark, sf_dir):
    return incidents.incident_candidates(_many(spark, sf_dir), T.ais(spark, sf_dir)).select("incident_id", *_CANDIDATE, "evidence_summary")


@query(f"""WITH RECURSIVE {_MANY} SELECT incident_id, min(ox) AS lon, min(oy) AS lat, CAST(49 AS INTEGER) AS track_points, TRUE AS real_ais, '{incidents.LEGAL}' AS legal_disclaimer, '{incidents.AIS_NOTE}' AS provenance_disclaimer, count(mmsi) AS n_candidates,
string_agg(CAST(mmsi AS VARCHAR), ',' ORDER BY attribution_score DESC, ordinal) AS ranked, arg_min(evidence_summary, (-attribution_score, ordinal)) AS first_evidence
FROM (SELECT DISTINCT spill_id AS incident_id, 4.035e0 + spill_id * 0.1e0 AS ox, 55.243e0 + spill_id * 0.05e0 AS oy FROM track) LEFT JOIN ranked USING (incident_id) GROUP BY incident_id""")
def attribution_report(spark, sf_dir):
    """The report as JSON text line by line, and what a reader gets from it: no row but the last one's text grows with the candidates."""
    sites = _many(spark, sf_dir)
    lines = incidents.report_pieces(sites, incidents.incident_candidates(sites, T.ais(spark, sf_dir)))
    head = "spill_origin array<double>, hindcast_track_points int, real_ais_data_present boolean, provenance_disclaimer string, legal_disclaimer string"
    heads, rows = incidents.report_readings(lines, head, "mmsi long, evidence_summary string")
    ranked = incidents.joined_in_order(rows, "incident_id", "at", F.col("x.mmsi").cast("string"), F.col("x.evidence_summary"))
    return heads.join(ranked, "incident_id", "left").select(
        "incident_id", F.col("r.spill_origin")[0].alias("lon"), F.col("r.spill_origin")[1].alias("lat"), F.col("r.hindcast_track_points").alias("track_points"), F.col("r.real_ais_data_present").alias("real_ais"),
        F.col("r.legal_disclaimer").alias("legal_disclaimer"), F.col("r.provenance_disclaimer").alias("provenance_disclaimer"), F.coalesce("n", F.lit(0).cast("long")).alias("n_candidates"),
        F.coalesce("joined", F.lit("")).alias("ranked"), F.col("first").alias("first_evidence"),
    )


# --- positions against track steps in place and time, as a table and as a stream (extensions)

_PAIRS = f"""{T.TIMED_SQL}, steps(incident_id, step, ts, lon, lat) AS (SELECT incident_id, 0, ts, lon, lat FROM origins
UNION ALL SELECT incident_id, step + 1, ts - INTERVAL 15 MINUTE, lon - {_U!r}e0 * 900 / (111412.84e0 * cos(radians(lat))), lat - {_V!r}e0 * 900 / (111132.92e0 - 559.82e0 * cos(2 * radians(lat))) FROM steps WHERE step < 48),
places AS (SELECT incident_id, step, ts AS due, {_POINTS} AS x, {_POINTS.replace('lon', 'lat')} AS y FROM steps),
pairs AS (SELECT * FROM (SELECT incident_id, step, ordinal, mmsi, vessel_type, sog_knots, ts, {_hav('x', 'y')} AS d FROM places JOIN fixes ON ts >= due - INTERVAL 30 MINUTE AND ts <= due + INTERVAL 30 MINUTE) WHERE d <= 25)"""
_APPROACHES = f"""WITH RECURSIVE {_PAIRS} SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%dT%H:%M:%S') AS window_start, incident_id, mmsi, count(*) AS n_pairs, round(min(d), 4) AS closest_km, arg_min(step, (d, step)) AS closest_step FROM pairs GROUP BY ALL"""


def _steps(spark, sf_dir) -> DataFrame:
    origins = T.timed_origins(spark, sf_dir).withColumn("mode", F.lit("hindcast"))
    return incidents.drift(incidents.spread(origins, "incident_id"), 12, CURRENT, WIND)


@query(f"""WITH RECURSIVE {_PAIRS} SELECT incident_id, ordinal, mmsi, step, round(dc, 2) AS distance_km, {_SCORE} AS attribution_score
FROM (SELECT incident_id, ordinal, mmsi, vessel_type, sog_knots, arg_min(step, (d, step)) AS step, min(d) AS dc, min(d) AS dt FROM pairs GROUP BY ALL)""")
def timed_rank_many(spark, sf_dir):
    """Vessels near each incident's track when the spill was there, give or take half an hour (an extension: the reference has no time predicate)."""
    c = incidents.timed_candidates(_steps(spark, sf_dir), T.timed_ais(spark, sf_dir))
    return c.select("incident_id", "ordinal", "mmsi", "step", "distance_km", "attribution_score")


HOUR = "yyyy-MM-dd'T'HH:mm:ss"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("closest_km", S.rounded(F.col("closest_km"), 4))


@query(_APPROACHES)
def closest_approaches(spark, sf_dir):
    """Closest approaches by hour, incident and vessel (an extension)."""
    return _shown(incidents.timed_approaches(_steps(spark, sf_dir), T.timed_ais(spark, sf_dir), shown=HOUR))


@query(_APPROACHES)
def stream_approaches(spark, sf_dir):
    """The same from the events as a stream (an extension): all that is there now, then what the state that is left in the folder gives."""
    where = f"{run_dir(spark)}/approaches-{uuid.uuid4().hex}"
    positions = T.timed_ais(spark, sf_dir, T.event_stream(spark, sf_dir))
    approaches.start(positions, _steps(spark, sf_dir), f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return _shown(approaches.current(spark, f"{where}/out", HOUR))



def dossiers(spark, sf_dir) -> DataFrame:
    """A dossier per scene: its spills, tracks from its primary spill where that is georeferenced, and vessels near those."""
    spills = _spills(spark, sf_dir)
    first = incidents.primary_spill(spills, ["scene"]).withColumnRenamed("scene", "incident_id")
    first = written(first, "primary-spills")
    origins = first.where("georeferenced").select("incident_id", F.col("centroid_x").alias("lon"), F.col("centroid_y").alias("lat"), F.expr("timestamp_ntz'2026-09-16 12:00:00'").alias("ts"))
    ends = lambda mode: incidents.endpoints(incidents.drift(origins.withColumn("mode", F.lit(mode)), 12, CURRENT, WIND), ["incident_id"])
    sites = incidents.incident_tracks(origins, 12, CURRENT, WIND)
    ships = incidents.near_summary(sites, T.ais(spark, sf_dir))
    summary = incidents.spill_summary(spills, ["scene"]).withColumnRenamed("scene", "incident_id")
    scenes = T.pixels(spark, sf_dir).select(F.col("scene").alias("incident_id")).distinct()
    return incidents.dossier(scenes, summary, first, ends("hindcast"), ends("forecast"), ships, F.lit("2026-09-17 15:48:50.684998").cast("timestamp"))


_PRIMARY = f"""prim AS (SELECT * FROM spills QUALIFY row_number() OVER (PARTITION BY scene ORDER BY pixel_count DESC, component_id) = 1),
track(incident_id, mode, sgn, step, lon, lat, ox, oy) AS (SELECT scene, m, CASE m WHEN 'hindcast' THEN -1e0 ELSE 1e0 END, 0, centroid_x, centroid_y, centroid_x, centroid_y FROM prim, (VALUES ('hindcast'), ('forecast')) v(m) WHERE georeferenced
UNION ALL SELECT incident_id, mode, sgn, step + 1, lon + {_U!r}e0 * 900 * sgn / (111412.84e0 * cos(radians(lat))), lat + {_V!r}e0 * 900 * sgn / (111132.92e0 - 559.82e0 * cos(2 * radians(lat))), ox, oy FROM track WHERE step < 48),
ends AS (SELECT incident_id, mode, round(arg_max(lon, step), 6) AS x, round(arg_max(lat, step), 6) AS y FROM track GROUP BY ALL)"""
_NEAR_PRIMARY = _cross("SELECT incident_id, ox, oy, CASE step WHEN 0 THEN lon ELSE round(lon, 6) END AS x, CASE step WHEN 0 THEN lat ELSE round(lat, 6) END AS y FROM track WHERE mode = 'hindcast'")
_DOSSIERS = f"""WITH RECURSIVE {_COMPONENTS}, {_KEPT.format(12)}, {_SPILLS}, {AIS_SQL}, {_PRIMARY}, {_NEAR_PRIMARY}, s AS (SELECT scene, count(*) AS n_spills, sum(coalesce(area_km2, 0)) AS area FROM spills GROUP BY scene),
r AS (SELECT incident_id, count(*) AS n FROM ranked GROUP BY incident_id), t AS (SELECT incident_id, string_agg(CAST(mmsi AS VARCHAR), ',' ORDER BY place) AS priority, min(evidence_summary) FILTER (place = 1) AS evidence
  FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY attribution_score DESC, ordinal) AS place FROM ranked) WHERE place <= 3 GROUP BY incident_id),
d AS (SELECT i.scene AS incident_id, n_spills, area, p.*, h.x AS hx, h.y AS hy, f.x AS fx, f.y AS fy, CASE WHEN h.x IS NOT NULL THEN coalesce(r.n, 0) END AS n_candidates, priority, evidence,
  round(CASE WHEN n_spills > 0 THEN 0.5e0 ELSE 0 END + CASE WHEN h.x IS NOT NULL THEN 0.5e0 ELSE 0.05e0 END, 2) AS confidence
FROM (SELECT DISTINCT event_id // 1000 AS scene FROM events) i LEFT JOIN s ON s.scene = i.scene LEFT JOIN prim p ON p.scene = i.scene LEFT JOIN ends h ON h.incident_id = i.scene AND h.mode = 'hindcast'
LEFT JOIN ends f ON f.incident_id = i.scene AND f.mode = 'forecast' LEFT JOIN r ON r.incident_id = i.scene LEFT JOIN t ON t.incident_id = i.scene)"""


@query(f"{_DOSSIERS} SELECT incident_id, coalesce(n_spills, 0) AS n_spills, round(area, 2) AS area_km2, hx IS NOT NULL AS has_hindcast, n_candidates, confidence FROM d")
def dossier_flat(spark, sf_dir):
    return incidents.flat(dossiers(spark, sf_dir))


@query(f"""{_DOSSIERS} SELECT incident_id, 'INCIDENT-20260917-154850' AS dossier_id, '2026-09-17T15:48:50.684998Z' AS generated_utc, 'v1.0' AS pipeline_version, '{incidents.PROVENANCE["drift_model"]}' AS drift_model, CASE WHEN n_spills IS NULL THEN 'DATA_NOT_FOUND' END AS spill_status,
n_spills AS components, round(area, 2) AS area_km2, component_id, pixel_count, area_km2 AS primary_area_km2, round(centroid_x, 6) AS centroid_lon, round(centroid_y, 6) AS centroid_lat, round(bbox_min_x, 6) AS west, round(bbox_max_y, 6) AS north,
hx IS NOT NULL AS hindcast_available, hx AS origin_lon, hy AS origin_lat, CASE WHEN hx IS NOT NULL THEN 12e0 END AS duration_hours, fx AS impact_lon, fy AS impact_lat, CASE WHEN hx IS NULL THEN 'NO_ATTRIBUTION_DATA' END AS vessel_status, n_candidates,
CASE WHEN hx IS NOT NULL THEN TRUE END AS real_ais, CASE WHEN hx IS NOT NULL THEN '{incidents.LEGAL}' END AS disclaimer, CASE WHEN hx IS NOT NULL THEN coalesce(priority, '') END AS priority, evidence, confidence, '{incidents.SCALE}' AS scale, CAST(2 AS INTEGER) AS n_gaps FROM d""")
def dossier_document(spark, sf_dir):
    """The documents as JSON text, and what a reader gets from them."""
    d = dossiers(spark, sf_dir)
    body = F.struct(*(c for c in d.columns if c != "incident_id"))
    schema = d.select(body.alias("x")).schema["x"].dataType
    j = d.select("incident_id", F.from_json(F.to_json(body, {"ignoreNullFields": "false"}), schema).alias("j"))
    s, t, v, f = (F.col(f"j.{n}") for n in ("sar_detection_summary", "drift_analysis", "vessel_attribution_summary", "fusion_confidence"))
    p, r = s["primary_slick"], lambda c, n: F.round(c, 6).alias(n)
    return j.select(
        "incident_id", "j.dossier_id", "j.generated_utc", "j.pipeline_version", F.col("j.data_provenance.drift_model").alias("drift_model"), s["status"].alias("spill_status"),
        s["total_slick_components"].alias("components"), s["total_estimated_area_km2"].alias("area_km2"), p["component_id"].alias("component_id"), p["pixel_count"].alias("pixel_count"), p["area_km2"].alias("primary_area_km2"),
        r(p["centroid_lon_lat"][0], "centroid_lon"), r(p["centroid_lon_lat"][1], "centroid_lat"), r(p["bounding_box"][0][0], "west"), r(p["bounding_box"][1][1], "north"), t["hindcast_available"].alias("hindcast_available"),
        r(t["estimated_origin_coords"][0], "origin_lon"), r(t["estimated_origin_coords"][1], "origin_lat"), t["hindcast_duration_hours"].alias("duration_hours"), r(t["projected_impact_coords_12h"][0], "impact_lon"), r(t["projected_impact_coords_12h"][1], "impact_lat"),
        v["status"].alias("vessel_status"), v["evaluated_candidates_count"].alias("n_candidates"), v["real_ais_verified"].alias("real_ais"), v["legal_disclaimer"].alias("disclaimer"),
        F.array_join(F.transform(v["priority_vessels"], lambda x: x["mmsi"].cast("string")), ",").alias("priority"), F.try_element_at(v["priority_vessels"], F.lit(1))["evidence_summary"].alias("evidence"),
        f["overall_confidence_score"].alias("confidence"), f["scale"].alias("scale"), F.size(f["data_gaps"]).alias("n_gaps"),
    )


@query(f"""WITH RECURSIVE {_TRACK} SELECT spill_id, mode, 'FeatureCollection' AS type, '{files.CRS}' AS crs, 'LineString' AS geometry, CAST(count(*) AS INTEGER) AS n_points, strftime(TIMESTAMP '2026-09-16 12:00:00', '%Y-%m-%dT%H:%M:%S') AS start_time,
strftime(TIMESTAMP '2026-09-16 12:00:00' + to_minutes(CAST(max(step) * min(sgn) * 15 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS end_time, round(max(step) * 15 / 60e0, 2) AS duration_hours,
round(arg_min(lon, step), 6) AS origin_lon, round(arg_min(lat, step), 6) AS origin_lat, round(arg_max(lon, step), 6) AS terminal_lon, round(arg_max(lat, step), 6) AS terminal_lat FROM track GROUP BY ALL""")
def geojson_tracks(spark, sf_dir):
    """The collections as text, and what a reader gets from them."""
    g = files.track_geojson(incidents.drift(_origins(spark, sf_dir), 12, CURRENT, WIND), ["spill_id", "mode"])
    schema = "type string, crs struct<properties:struct<name:string>>, features array<struct<geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<mode:string,start_time:string,end_time:string,duration_hours:double,origin_coords:array<double>,terminal_coords:array<double>>>>"
    g = g.select("spill_id", F.from_json("value", schema).alias("j")).select("spill_id", "j.type", F.col("j.crs.properties.name").alias("crs"), F.col("j.features")[0].alias("f"))
    p, r = F.col("f.properties"), lambda c, n: F.round(c, 6).alias(n)
    return g.select(
        "spill_id", p["mode"].alias("mode"), "type", "crs", F.col("f.geometry.type").alias("geometry"), F.size("f.geometry.coordinates").alias("n_points"), p["start_time"].alias("start_time"), p["end_time"].alias("end_time"),
        p["duration_hours"].alias("duration_hours"), r(p["origin_coords"][0], "origin_lon"), r(p["origin_coords"][1], "origin_lat"), r(p["terminal_coords"][0], "terminal_lon"), r(p["terminal_coords"][1], "terminal_lat"),
    )


@query(f"""WITH RECURSIVE {_COMPONENTS}, {_KEPT.format(12)}, {_SPILLS} SELECT scene, CAST(component_id AS BIGINT) AS component_id, pixel_count, {', '.join(f'round({b}, 6) AS {b}' for b in _BOX)}, area_km2, georeferenced, CAST(5 AS INTEGER) AS corners, TRUE AS closed, round(bbox_min_x, 6) AS left_x, round(bbox_max_y, 6) AS top_y, round(bbox_max_x, 6) AS right_x, round(bbox_min_y, 6) AS bottom_y FROM spills""")
def geojson_polygons(spark, sf_dir):
    """One collection per scene as text, and what a reader gets from it."""
    g = files.polygons_collection(_spills(spark, sf_dir), raster.ring())
    g = g.select("scene", F.explode(F.from_json("value", files.POLYGONS)["features"]).alias("f")).select("scene", "f.properties.*", F.col("f.geometry.coordinates")[0].alias("c"))
    at = lambda i, k, n: F.round(F.col("c")[i][k], 6).alias(n)
    return g.select("scene", "component_id", "pixel_count", *_r(*_BOX), "area_km2", "georeferenced", F.size("c").alias("corners"), (F.col("c")[0] == F.col("c")[4]).alias("closed"), at(0, 0, "left_x"), at(0, 1, "top_y"), at(2, 0, "right_x"), at(2, 1, "bottom_y"))


@query("SELECT lang AS class, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM documents GROUP BY ROLLUP (lang)")
def class_totals_rollup(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").rollup(F.col("lang").alias("class"))
    return d.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("n_bytes"))


@query("SELECT host, url, CAST(n AS INTEGER) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, url, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY url, page_id) AS n FROM pages WHERE contains(url, '/')) WHERE n <= 50")
def archive_topn(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages").select("page_id", "url").where(F.col("url").contains("/")).withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    return incidents.renumbered(p, ["host"], ["url", "page_id"], "n").where("n <= 50").select("host", "url", "n")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def missing_files(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id").join(T.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT page_id, regexp_extract(url, '([^/\\\\]+?)(\\.[^./\\\\]*)?$', 1) AS name FROM pages")
def base_names(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", S.base_name(F.col("url")).alias("name"))


@query(f'WITH {PIXELS_SQL} SELECT scene, "row", col, round((vv - vh) * 0.5e0 + 1, 6) AS v FROM pixels')
def band_math(spark, sf_dir):
    p = T.pixels(spark, sf_dir).withColumnsRenamed({"vv": "b1", "vh": "b2"})
    return p.select(*raster.KEY, F.round(S.band_math("(b1 - b2) * 0.5 + 1"), 6).alias("v"))


@query(f"WITH {PIXELS_SQL} SELECT scene, round(avg(vv), 6) AS vv_avg, round(stddev_samp(vv), 6) AS vv_std, round(min(vv), 6) AS vv_min, round(max(vv), 6) AS vv_max, round(avg(vh), 6) AS vh_avg, round(stddev_samp(vh), 6) AS vh_std, round(min(vh), 6) AS vh_min, round(max(vh), 6) AS vh_max FROM pixels GROUP BY scene")
def band_stats(spark, sf_dir):
    agg = [x for b in ("vv", "vh") for x in (F.round(F.avg(b), 6).alias(f"{b}_avg"), F.round(F.stddev_samp(b), 6).alias(f"{b}_std"), F.round(F.min(b), 6).alias(f"{b}_min"), F.round(F.max(b), 6).alias(f"{b}_max"))]
    return T.pixels(spark, sf_dir).groupBy("scene").agg(*agg)


def _sample(df: DataFrame) -> DataFrame:
    """The training rows, by a hash of the pixel."""
    return learning.stratified_sample(df, "y", [F.xxhash64(*raster.KEY, F.lit(42))])


@query()
def rf_fit_score(spark, sf_dir):
    df = written(raster.with_mask(raster.features(T.pixels(spark, sf_dir)), T.masks(spark, sf_dir)), "features")
    nodes = written(forest.train_balanced_forest(_sample(df), raster.KEY), "forest")
    return forest.score_balanced_forest(nodes, df).select(*raster.KEY, "y", "proba", "pred", "hard")
