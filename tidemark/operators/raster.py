"""Relational rasters (scene, row, col, bands): stencils, despeckling, features, tiles, masks, components, polygons.

Stencils run on tiles that know their neighbours' nearest lines; components are found inside tiles and joined across their
borders. No task holds a scene.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions import scalar as S
from tidemark.plans.lineage import written

from .graph import components

KEY = ("scene", "row", "col")

#: Rows and columns of the tiles that one task takes at a time.
TILE = 512


def _moving_sum(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size windows of a padded array, by sums of columns and then of lines."""
    h, w = a.shape[0] - size + 1, a.shape[1] - size + 1
    across = sum(a[:, i : i + w] for i in range(size))
    return sum(across[i : i + h] for i in range(size))


def _with_edges(a: np.ndarray, before: tuple[int, int], after: tuple[int, int], mode: str) -> np.ndarray:
    return np.pad(a, tuple(zip(before, after)), mode={"mirror": "symmetric", "edge": "edge"}[mode])


def box_mean(df: DataFrame, values: list[str], size: int = 5, mode: str = "mirror", tile: int = TILE) -> DataFrame:
    """The columns `values` replaced by their size x size means, as doubles.

    Pixels go once to their tiles, those near a border to the neighbours' too, and a tile is one array in one task: a single
    exchange of at most (tile + size)^2 pixels a task. Beyond the scene's edge lines are mirrored (c b a | a b c), or the last one
    repeated (mode "edge"). Missing pixels and nulls are not counted; NaN spreads over its windows. Of pixels in one place all get
    the mean in which the last one counts.
    """
    r = size // 2
    kinds = StructType([StructField(f.name, DoubleType() if f.name in values else f.dataType) for f in df.schema])
    inner = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kinds)])
    at = {c: df.columns.index(c) for c in (*KEY, *values)}

    def run(key, table):
        _, tr, tc = (k.as_py() for k in key)
        table = table.drop_columns(["_tr", "_tc"])
        row, col = (table.column(at[c]).to_numpy().astype(np.int64) for c in ("row", "col"))
        core = (row // tile == tr) & (col // tile == tc)
        if not core.any():
            return table.slice(0, 0)
        r0, c0 = int(row.min()), int(col.min())
        shape = int(row.max()) - r0 + 1, int(col.max()) - c0 + 1
        top, left = int(row[core].min()), int(col[core].min())
        bottom, right = int(row[core].max()), int(col[core].max())
        before = max(0, r - (top - r0)), max(0, r - (left - c0))
        after = max(0, r - (r0 + shape[0] - 1 - bottom)), max(0, r - (c0 + shape[1] - 1 - right))
        shift = r0 - before[0] + r, c0 - before[1] + r  # the first place whose window is whole
        here = row[core] - shift[0], col[core] - shift[1]
        out = table.filter(pa.array(core))
        for v in values:
            known = table.column(at[v]).is_valid().to_numpy(zero_copy_only=False)
            a, n = np.zeros(shape), np.zeros(shape)
            a[row[known] - r0, col[known] - c0] = table.column(at[v]).to_numpy()[known]
            n[row[known] - r0, col[known] - c0] = 1
            total = _moving_sum(_with_edges(a, before, after, mode), size)[here]
            count = float(size * size) if n.all() else _moving_sum(_with_edges(n, before, after, mode), size)[here]
            mean = total / np.maximum(count, 1)
            out = out.set_column(at[v], f"c{at[v]}", pa.array(mean, pa.float64(), mask=np.broadcast_to(np.asarray(count) == 0, mean.shape)))
        return out

    def near(c: str):
        t = F.floor(F.col(f"c{at[c]}") / tile)
        place = F.pmod(F.col(f"c{at[c]}"), F.lit(tile))
        return F.array_compact(F.array(t, F.when(place < r, t - 1), F.when(place >= tile - r, t + 1)))

    placed = df.select(*(F.col(f"`{f.name}`").cast(kinds[i].dataType).alias(f"c{i}") for i, f in enumerate(df.schema)))
    placed = placed.withColumn("_tr", F.explode(near("row"))).withColumn("_tc", F.explode(near("col")))
    return placed.groupBy(f"c{at['scene']}", "_tr", "_tc").applyInArrow(run, inner).toDF(*df.columns)


def lee(df: DataFrame, bands: list[str], size: int = 5) -> DataFrame:
    """Lee's filter: m + v / (v + V) (x - m) with local mean m and variance v, and V the scene's variance; V = 0 leaves the band."""
    squares = df.select("*", *(F.col(b).alias(f"_m_{b}") for b in bands), *((F.col(b) * F.col(b)).alias(f"_s_{b}") for b in bands))
    local = box_mean(squares, [f"_{k}_{b}" for b in bands for k in "ms"], size)
    whole = df.groupBy("scene").agg(*(F.var_pop(b).alias(f"_v_{b}") for b in bands))
    out = local.join(whole, "scene")
    for b in bands:
        m, x, total = F.col(f"_m_{b}"), F.col(b), F.col(f"_v_{b}")
        v = F.greatest(F.col(f"_s_{b}") - m * m, F.lit(0.0))
        out = out.withColumn(b, F.when(total == 0, x).otherwise(m + v / (v + total) * (x - m)))
    return out.select(df.columns)


def despeckle(df: DataFrame, bands: list[str], radius: int = 3, looks: int = 1) -> DataFrame:
    """Lee's filter for multiplicative noise of so many looks: m + b (x - m), b = c / (c + 1 / looks), with local mean m, variance v and c = v / m^2.

    Edges repeat their last line. Where the mean is 0 there is no signal to keep: the value is 0.
    """
    if looks < 1 or radius < 1:
        raise ValueError("a filter has a radius and looks of at least 1")
    squares = df.select("*", *(F.col(b).cast("double").alias(f"_m_{b}") for b in bands), *((F.col(b) * F.col(b)).alias(f"_s_{b}") for b in bands))
    out = box_mean(squares, [f"_{k}_{b}" for b in bands for k in "ms"], 2 * radius + 1, "edge")
    for b in bands:
        m, x = F.col(f"_m_{b}"), F.col(b)
        v = F.greatest(F.col(f"_s_{b}") - m * m, F.lit(0.0))
        out = out.withColumn(b, F.when(m == 0, F.lit(0.0)).otherwise(m + v / (v + m * m / looks) * (x - m)))
    return out.select(df.columns)


def local_std(df: DataFrame, value: str, out: str, size: int = 5) -> DataFrame:
    """Local standard deviation of a column."""
    wide = df.select("*", F.col(value).alias("_m"), (F.col(value) * F.col(value)).alias("_s"))
    wide = box_mean(wide, ["_m", "_s"], size)
    return wide.withColumn(out, F.sqrt(F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0)))).drop("_m", "_s")


def clipped(pixels: DataFrame, despeckle: bool = False, size: int = 5) -> DataFrame:
    """Clipped bands, despeckled if wanted."""
    df = pixels.withColumns({b: S.clip_db(F.col(b)) for b in ("vv", "vh")})
    return lee(df, ["vv", "vh"], size) if despeckle else df


def normalised(df: DataFrame) -> DataFrame:
    """Normalised bands of those of clipped()."""
    return df.select(*KEY, S.normalise(F.col("vv")).alias("vv_norm"), S.normalise(F.col("vh")).alias("vh_norm"))


def described(df: DataFrame) -> DataFrame:
    """Features of the bands of clipped()."""
    df = df.select(*KEY, S.normalise(F.col("vv")).alias("vv_norm"), S.normalise(F.col("vh")).alias("vh_norm"), S.difference(F.col("vv"), F.col("vh")).alias("diff_norm"))
    return local_std(df, "vv_norm", "_std").withColumn("vv_std_norm", S.texture(F.col("_std"))).drop("_std")


def preprocess(pixels: DataFrame, despeckle: bool = True, size: int = 5) -> DataFrame:
    """Clipped, despeckled if wanted, and normalised bands."""
    return normalised(clipped(pixels, despeckle, size))


def features(pixels: DataFrame, despeckle: bool = False) -> DataFrame:
    """vv_norm, vh_norm, diff_norm and vv_std_norm; training leaves despeckling out, inference applies it."""
    return described(clipped(pixels, despeckle))


def tiles(df: DataFrame, patch: int = 256, stride: int = 256) -> DataFrame:
    """patch_r, patch_c and the place in the patch of every pixel; partial patches at the edge are dropped, overlaps repeat pixels."""
    size = df.groupBy("scene").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    df = df.join(size, "scene")

    def places(at: Column, n: Column) -> Column:
        last = F.least(F.floor(at / stride), F.floor((n - patch) / stride)).cast("int")
        first = F.greatest(F.lit(0), F.ceil((at - patch + 1) / stride)).cast("int")
        return F.when((n >= patch) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    if stride == patch:
        df = df.withColumns({"patch_r": F.floor(F.col("row") / patch).cast("int"), "patch_c": F.floor(F.col("col") / patch).cast("int")})
        df = df.where((F.col("patch_r") < F.floor(F.col("_h") / patch)) & (F.col("patch_c") < F.floor(F.col("_w") / patch)))
    else:
        df = df.withColumn("patch_r", F.explode(places(F.col("row"), F.col("_h")))).withColumn("patch_c", F.explode(places(F.col("col"), F.col("_w"))))
    return df.drop("_h", "_w").withColumns({"in_r": F.col("row") - F.col("patch_r") * stride, "in_c": F.col("col") - F.col("patch_c") * stride})


def with_mask(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Pixels and their truth y (any positive mask value is 1), joined by place.

    A mask is as large as its pixels, but Spark takes one that is decoded from files for as small as their packed blocks: it is never broadcast.
    """
    return pixels.join(masks.select(*KEY, (F.col("y") > 0).cast("int").alias("y")).hint("merge"), list(KEY))


def _tile_runs(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of a tile's pixels (row, c0, c1) in order, and for each the run that comes first in its component. Pixels may repeat."""
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (col[1:] > col[:-1] + 1)])
    r, c0, c1 = row[starts], col[starts], col[np.r_[starts[1:], len(row)] - 1]
    wide = int(c1.max() - c0.min()) + 2
    at, left, right = (r - r[0] + 1) * wide, c0 - c0.min(), c1 - c0.min()
    low = np.searchsorted(at + right, at - wide + left)  # runs of the row above that overlap
    high = np.searchsorted(at + left, at - wide + right, side="right")
    many = np.maximum(high - low, 0)
    below = np.repeat(np.arange(len(r)), many)
    above = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    first = np.arange(len(r))
    while True:
        x, y = first[below], first[above]
        apart = x != y
        if not apart.any():
            return r, c0, c1, first
        np.minimum.at(first, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (first[first] != first).any():
            first = first[first]


def labelled(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """The runs (scene, row, c0, c1) of a mask's pixels with the component of each: its first pixel's row and column.

    Tiles are labelled each in one task, which holds at most tile x tile pixels; a run ends at its tile's border. A tile's
    components are nodes, named by their first pixel (a struct, so scenes may have any type and rasters any size); those that meet
    across a border (four neighbours) are joined, by the runs along borders alone, and closed by star rounds. Masks whose
    components stay in their tiles need no round.
    """
    kind = mask.schema["scene"].dataType
    schema = StructType([StructField("scene", kind), *(StructField(c, LongType()) for c in ("row", "c0", "c1", "first_row", "first_c0"))])

    def run(table: pa.Table) -> pa.Table:
        r, c0, c1, first = _tile_runs(*(table.column(c).to_numpy().astype(np.int64) for c in ("row", "col")))
        scene = table.column("scene").combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(r), np.int64)))
        return pa.table({"scene": scene, "row": r, "c0": c0, "c1": c1, "first_row": r[first], "first_c0": c0[first]})

    placed = mask.select(*KEY).where(F.col("row").isNotNull() & F.col("col").isNotNull())
    found = placed.groupBy("scene", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)).applyInArrow(run, schema)
    whole = [F.col(c).cast(mask.schema[k].dataType).alias(c) for c, k in (("row", "row"), ("c0", "col"), ("c1", "col"))]
    runs = written(found.select("scene", *whole, F.struct("scene", F.col("first_row").alias("row"), F.col("first_c0").alias("c0")).alias("node")), "runs")
    edge = lambda c, at: F.pmod(F.col(c), F.lit(tile)) == at
    above = runs.where(edge("row", tile - 1)).select("scene", (F.col("row") + 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("b"))
    down = runs.where(edge("row", 0)).join(above, ["scene", "row"]).where("c0 <= d1 and d0 <= c1").select(F.col("node").alias("a"), "b")
    before = runs.where(edge("c1", tile - 1)).select("scene", "row", (F.col("c1") + 1).alias("c0"), F.col("node").alias("b"))
    across = runs.where(edge("c0", 0)).join(before, ["scene", "row", "c0"]).select(F.col("node").alias("a"), "b")
    edges = written(down.union(across).distinct(), "borders")
    if edges.isEmpty():
        named = runs.withColumn("component", F.col("node"))
    else:
        named = runs.join(components(edges), "node", "left").withColumn("component", F.coalesce("root", "node"))
    return named.select("scene", "row", "c0", "c1", F.struct(F.col("component.row").alias("row"), F.col("component.c0").alias("c0")).alias("component"))


def component_stats(runs: DataFrame, min_pixels: int = 50) -> DataFrame:
    """A row per component of at least min_pixels: component_id (by first pixel), pixel_count, index bounds and centroid."""
    n = F.col("c1") - F.col("c0") + 1
    stats = runs.groupBy("scene", "component").agg(
        F.sum(n).cast("long").alias("pixel_count"), F.min("row").alias("r_min"), F.max("row").alias("r_max"), F.min("c0").alias("c_min"), F.max("c1").alias("c_max"),
        (F.sum(F.col("row") * n) / F.sum(n)).alias("cy"), (F.sum((F.col("c0") + F.col("c1")) * n) / 2 / F.sum(n)).alias("cx"),
    )
    kept = stats.where(F.col("pixel_count") >= min_pixels)
    return kept.withColumn("component_id", F.row_number().over(Window.partitionBy("scene").orderBy("component")))


def polygons(stats: DataFrame, scenes: DataFrame) -> DataFrame:
    """Centroid, bounding box and area of each component: geographic where the scene has a geotransform, else in pixels."""
    df = stats.join(scenes.select("scene", "gt"), "scene", "left")
    geo = F.col("gt").isNotNull()
    lon, lat = S.pixel_to_geo(F.col("cy"), F.col("cx"), "gt")
    x0, y0 = S.pixel_to_geo(F.col("r_min"), F.col("c_min"), "gt")
    x1, y1 = S.pixel_to_geo(F.col("r_max"), F.col("c_max"), "gt")
    north, east = S.metres_per_degree(lat)
    area = F.col("pixel_count") * (F.abs(F.col("gt.rx")) * east * F.abs(F.col("gt.ry")) * north) / 1e6
    pick = lambda a, b: F.when(geo, a).otherwise(b.cast("double"))
    return df.select(
        "scene", "component_id", "pixel_count", pick(lon, F.col("cx")).alias("centroid_x"), pick(lat, F.col("cy")).alias("centroid_y"),
        pick(F.least(x0, x1), F.col("c_min")).alias("bbox_min_x"), pick(F.least(y0, y1), F.col("r_min")).alias("bbox_min_y"),
        pick(F.greatest(x0, x1), F.col("c_max")).alias("bbox_max_x"), pick(F.greatest(y0, y1), F.col("r_max")).alias("bbox_max_y"),
        F.when(geo & (area != 0), F.round(area, 4)).alias("area_km2"), geo.alias("georeferenced"),
    )


def ring() -> Column:
    """The closed five-point rectangle of a bounding box, from its top left on."""
    p = lambda x, y: F.array(F.col(f"bbox_{x}_x"), F.col(f"bbox_{y}_y"))
    return F.array(F.array(p("min", "max"), p("max", "max"), p("max", "min"), p("min", "min"), p("min", "max")))
