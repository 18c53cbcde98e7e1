"""The model's entry points as compositions of operators: data sets, evaluation, detection from scene to polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import learning, raster
from tidemark.sources import files, tiff

from .lineage import written


def build_dataset(pixels: DataFrame, masks: DataFrame, manifest: DataFrame, patch: int = 256, stride: int = 256) -> DataFrame:
    """Features and truth of the pixels of valid scenes, in patches, with their split. manifest: scene beside its columns."""
    splits = learning.scene_split(manifest).select("scene", "split")
    df = raster.with_mask(raster.features(pixels.join(splits.select("scene"), "scene", "left_semi")), masks)
    return raster.tiles(df, patch, stride).join(splits, "scene")


def dataset_counts(dataset: DataFrame) -> DataFrame:
    """Scenes, patches, pixels and positives per split."""
    patch = F.struct("scene", "patch_r", "patch_c")
    return dataset.groupBy("split").agg(F.count_distinct("scene").alias("n_scenes"), F.count_distinct(patch).alias("n_patches"), F.count(F.lit(1)).alias("n_pixels"), F.count_if(F.col("y") == 1).alias("n_pos"))


def evaluate(model, dataset: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics, confusion and per-class report of hard predictions."""
    rows = learning.score_forest(model, dataset).select("y", F.col("hard").alias("pred"))
    return learning.metrics(rows), learning.confusion(rows), learning.report(rows)


def infer(model, pixels: DataFrame, threshold: float = 0.3, despeckle: bool = True) -> DataFrame:
    """scene, row, col, proba and pred of every pixel."""
    return learning.score_forest(model, raster.features(pixels, despeckle), threshold).select(*raster.KEY, "proba", "pred")


def write_inference(found: DataFrame, path: str, lines: int = 64) -> None:
    """The mask (bytes) and the probabilities (floats, named with _proba) of infer() as TIFFs beside each other, one of each per scene.

    found is read several times: give it written.
    """
    tiff.write_rasters(found, ["pred"], path, "u1", lines=lines)
    tiff.write_rasters(found, ["proba"], path, "f4", lines=lines, suffix="_proba")


def polygonise(mask: DataFrame, scenes: DataFrame, min_pixels: int = 50) -> DataFrame:
    """Polygons of a mask (scene, row, col, pred). scenes: scene and gt, null without a geotransform."""
    return raster.polygons(raster.component_stats(raster.labelled(mask.where(F.col("pred") == 1)), min_pixels), scenes)


def detect(model, pixels: DataFrame, scenes: DataFrame, threshold: float = 0.3, min_pixels: int = 50, despeckle: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, polygons, and a row per scene with their number and total area (scenes without a polygon count 0)."""
    mask = infer(model, pixels, threshold, despeckle)
    found = polygonise(mask, scenes, min_pixels)
    per = found.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sum("area_km2").alias("a"))
    summary = scenes.select("scene").join(per, "scene", "left").select("scene", F.coalesce("n", F.lit(0).cast("long")).alias("n_polygons"), F.coalesce("a", F.lit(0.0)).alias("total_area_km2"))
    return mask, found, summary


def run_scenes(spark: SparkSession, images: str, model, out: str, threshold: float = 0.3, min_pixels: int = 50, shape: tuple[int, int] = (2048, 2048)) -> DataFrame:
    """From rasters to outputs under `out`: preprocessed and features (Parquet by scene), mask, spills (a collection a scene, as text), and rasters (mask and probabilities as TIFF).

    Returns the run's summary per scene: its shape, whether that is as expected, number of polygons, total area, and the
    outputs' folders. Scenes are the files' names. Files are decoded, despeckled and inferred once, each kept in the shared folder
    for what follows: the outputs by scene are many small files, and slow to read again.
    """
    found = tiff.files(spark, images)
    known = written(tiff.info(found).withColumnRenamed("name", "scene"), "shapes")
    pixels = written(tiff.pixels(found).withColumnRenamed("name", "scene"), "pixels")
    smooth = written(raster.clipped(pixels, despeckle=True), "despeckled")
    folders = {k: f"{out.rstrip('/')}/{k}" for k in ("preprocessed", "features", "mask", "spills", "rasters")}
    raster.normalised(smooth).write.partitionBy("scene").parquet(folders["preprocessed"])
    raster.features(pixels).write.partitionBy("scene").parquet(folders["features"])
    mask = written(learning.score_forest(model, raster.described(smooth), threshold).select(*raster.KEY, "proba", "pred"), "inference")
    mask.write.partitionBy("scene").parquet(folders["mask"])
    write_inference(mask, folders["rasters"])
    spills = written(polygonise(mask, known.select("scene", "gt"), min_pixels), "spills")
    files.write_text(files.polygons_collection(spills, raster.ring()), folders["spills"])
    per = spills.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sum("area_km2").alias("a"))
    sized = known.select("scene", "height", "width", ((F.col("height") == shape[0]) & (F.col("width") == shape[1])).alias("as_expected")).join(per, "scene", "left")
    return sized.select("scene", "height", "width", "as_expected", F.coalesce("n", F.lit(0).cast("long")).alias("n_polygons"), F.coalesce("a", F.lit(0.0)).alias("total_area_km2"), *(F.lit(v).alias(k) for k, v in folders.items()))
