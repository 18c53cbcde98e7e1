"""Sources and sinks: manifest, vessel positions, GeoJSON tracks and polygons, documents, packed rasters, models."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import written

MANIFEST = "filename string, class string, image_path string, mask_path string, dimensions string, channels int, VV_available boolean, VH_available boolean, georeferenced boolean, valid string, notes string"
AIS = "mmsi long, vessel_name string, vessel_type string, lon double, lat double, sog_knots double, cog double"
TRACK = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:map<string,string>>>"
RANKED = "mmsi long, vessel_name string, vessel_type string, distance_to_spill_km double, distance_to_drift_track_km double, sog_knots double, cog_degrees double, attribution_score double, data_provenance string, evidence_summary string"
RASTER = "path string, row int, col int, vv float, vh float"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with their ordinal (a manifest is one small file, so ids follow its lines)."""
    return spark.read.csv(path, header=True, schema=MANIFEST).coalesce(1).withColumn("ordinal", F.monotonically_increasing_id())


# The four synthetic vessels (number, name, type, offsets from the origin in degrees, speed, course).
SYNTHETIC = (
    (244123000, "SYNTHETIC_TANKER_ALPHA", "Crude Oil Tanker", -0.02, -0.015, 11.4, 45.0),
    (219001000, "SYNTHETIC_CHEM_BETA", "Chemical Tanker", -0.04, -0.03, 12.1, 50.0),
    (211987000, "SYNTHETIC_CARGO_GAMMA", "General Cargo", 0.08, 0.06, 13.8, 60.0),
    (257456000, "SYNTHETIC_SUPPLY_DELTA", "Offshore Supply", 0.15, -0.10, 8.2, 210.0),
)


def synthetic_vessels(spark: SparkSession, lon: float, lat: float) -> DataFrame:
    return spark.createDataFrame([(m, name, kind, lon + x, lat + y, speed, course) for m, name, kind, x, y, speed, course in SYNTHETIC], AIS)


def synthetic_around(incidents: DataFrame) -> DataFrame:
    """The synthetic vessels around every incident (incident_id, lon, lat), with an ordinal in each: for incidents without positions."""
    one = lambda i, v: F.struct(*(F.lit(x).alias(n) for n, x in zip(("mmsi", "vessel_name", "vessel_type"), v)), (F.col("lon") + v[3]).alias("lon"), (F.col("lat") + v[4]).alias("lat"), F.lit(v[5]).alias("sog_knots"), F.lit(v[6]).alias("cog"), F.lit(i).cast("long").alias("ordinal"))
    ships = incidents.select("incident_id", F.explode(F.array(*(one(i, v) for i, v in enumerate(SYNTHETIC)))).alias("v"))
    return ships.select("incident_id", F.col("v.mmsi").cast("long").alias("mmsi"), *(f"v.{c}" for c in ("vessel_name", "vessel_type", "lon", "lat", "sog_knots", "cog", "ordinal")))


def load_ais(spark: SparkSession, path: str | None, lon: float, lat: float) -> tuple[DataFrame, bool]:
    """Vessel positions (CSV if the name ends so, else a JSON array) and whether they are synthetic, for want of a file."""
    if not path or not exists(spark, path):
        df, made = synthetic_vessels(spark, lon, lat), True
    elif path.endswith(".csv"):
        df, made = spark.read.csv(path, header=True, schema=AIS), False
    else:
        df, made = spark.read.schema(AIS).option("multiLine", True).json(path), False
    return df.withColumn("ordinal", F.monotonically_increasing_id()) if made else _numbered(df), made


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with an ordinal that follows the input: files by name, then blocks of a file, then rows, however files are dealt to tasks."""
    place = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    at = written(place, "vessels")
    blocks = at.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_o"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per block of a file
    blocks = blocks.select("_f", "_b", "_o", before.alias("_before"))
    return at.join(blocks, ["_f", "_b"]).withColumn("ordinal", F.col("_before") + F.col("_i") - F.col("_o")).drop("_f", "_b", "_i", "_o", "_before")


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """step, lon, lat of the first feature of GeoJSON tracks (one a file), after the columns that folders like mode=hindcast name."""
    docs = spark.read.schema(TRACK).option("multiLine", True).json(path)
    by = [c for c in docs.columns if c not in ("type", "features")]
    points = docs.select(*by, F.posexplode(F.col("features")[0]["geometry"]["coordinates"]).alias("step", "p"))
    return points.select(*by, "step", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


# Fixed value of the format: the reference system that feature collections name.
CRS = "urn:ogc:def:crs:OGC:1.3:CRS84"


def _collection(features: Column) -> Column:
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit(CRS).alias("name")).alias("properties"))
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), features.alias("features")), {"ignoreNullFields": "false"}).alias("value")


def track_geojson(track: DataFrame, by: list[str]) -> DataFrame:
    """One feature collection (text) per track; `by` has its mode, times are properties where the track has ts."""
    times = ["ts"] if "ts" in track.columns else []
    points = F.array_sort(F.collect_list(F.struct("step", "lon", "lat", "step_hours", *times)))
    df = track.groupBy(*by).agg(points.alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    place = lambda p: F.array(p["lon"], p["lat"])
    iso = lambda p: F.date_format(p["ts"], "yyyy-MM-dd'T'HH:mm:ss")
    when = [iso(first).alias("start_time"), iso(last).alias("end_time")] if times else []
    properties = F.struct(*by, *when, last["step_hours"].alias("duration_hours"), place(first).alias("origin_coords"), place(last).alias("terminal_coords"))
    line = F.struct(F.lit("LineString").alias("type"), F.transform("p", place).alias("coordinates"))
    return df.select(*by, _collection(F.array(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), properties.alias("properties")))))


def _polygon(polygons: DataFrame, ring: Column) -> Column:
    names = [c for c in polygons.columns if c != "scene"]
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"), F.struct(*names).alias("properties"))


def polygons_geojson(polygons: DataFrame, ring: Column) -> DataFrame:
    """One feature (text) per polygon; null properties are kept. Lines of features scale where one collection would not."""
    return polygons.select("scene", "component_id", F.to_json(_polygon(polygons, ring), {"ignoreNullFields": "false"}).alias("value"))


def polygons_collection(polygons: DataFrame, ring: Column) -> DataFrame:
    """One feature collection (text) per scene, its features in the components' order."""
    features = F.array_sort(F.collect_list(F.struct("component_id", _polygon(polygons, ring).alias("f"))))
    return polygons.groupBy("scene").agg(features.alias("f")).select("scene", _collection(F.transform("f", lambda x: x["f"])))


def pieces(rows: DataFrame, by: str, order: list[Column], heads: DataFrame, tail: str) -> DataFrame:
    """Documents line by line: `by`, part (0 head, 1 row, 2 tail), at (a row's place in the order, as a struct) and value.

    rows: by, value and what `order` needs; heads: by and value, of documents without rows too. The first row of a document has no
    comma before it, so the lines one after the other are the document. No row holds more than one of its rows; rows that tie go
    in any order.
    """
    from tidemark.plans.lineage import written

    # a row's number decides ties and must be the same wherever it is read
    placed = written(rows.select(by, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.monotonically_increasing_id().alias("n")).alias("at"), "value"), "pieces")
    first = placed.groupBy(by).agg(F.min("at").alias("_first"))
    body = placed.join(first, by).select(by, F.lit(1).alias("part"), "at", F.when(F.col("at") == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    ends = lambda part, value: heads.select(by, F.lit(part).alias("part"), F.lit(None).cast(placed.schema["at"].dataType).alias("at"), value.alias("value"))
    return body.union(ends(0, F.col("value"))).union(ends(2, F.lit(tail)))


def write_pieces(lines: DataFrame, by: str, path: str) -> None:
    """The lines of pieces() in order over the folder's files, cut by range: a document may go on in the next file."""
    lines.repartitionByRange(by, "part", "at").sortWithinPartitions(by, "part", "at").select("value").write.text(path)


def polygon_pieces(polygons: DataFrame, ring: Column) -> DataFrame:
    """polygons_collection() in pieces, for scenes of any number of features."""
    head = json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": CRS}}, "features": []}, separators=(",", ":"))[:-2]
    scenes = polygons.select("scene").distinct().withColumn("value", F.lit(head))
    return pieces(polygons_geojson(polygons, ring), "scene", [F.col("component_id")], scenes, "]}")


POLYGONS = "type string, crs struct<type:string,properties:struct<name:string>>, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<component_id:long,pixel_count:long,centroid_x:double,centroid_y:double,bbox_min_x:double,bbox_min_y:double,bbox_max_x:double,bbox_max_y:double,area_km2:double,georeferenced:boolean>>>"


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """The features of polygon collections (one document a line, or one a file): properties and coordinates."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n(?=\\{\"type\")")).alias("value"))
    f = docs.select(F.explode(F.from_json("value", POLYGONS)["features"]).alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.coordinates").alias("coordinates"))


def read_json_safe(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The document, or no row where the file is missing."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_rasters(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """Pixels of raw little-endian float32 rasters, two bands one after the other (.f32 files): path, row, col, vv, vh."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                vv, vh = np.frombuffer(content, "<f4").reshape(2, height, width)
                for r in range(height):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * width), pa.array(np.full(width, r, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(vv[r]), pa.array(vh[r])], names=["path", "row", "col", "vv", "vh"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RASTER)


def write_features(df: DataFrame, path: str) -> None:
    df.write.partitionBy("scene").parquet(path)


def write_ranked_csv(df: DataFrame, path: str) -> None:
    df.orderBy(F.desc("attribution_score"), "ordinal").drop("ordinal").coalesce(1).write.csv(path, header=True)


def read_ranked_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RANKED)


def write_dataset(df: DataFrame, path: str) -> None:
    """The patches of a data set, a folder per split, so that reading one split reads nothing of the others."""
    df.write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, such as reports: path, value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def save_model(model, path: str) -> None:
    """A Spark ML model, or a forest's nodes as Parquet."""
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str):
    """What save_model() saved: Spark ML's folders have metadata, a forest's have rows."""
    from pyspark.ml.classification import RandomForestClassificationModel

    spark = SparkSession.getActiveSession()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/metadata")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return RandomForestClassificationModel.load(path)
    return spark.read.parquet(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path)
