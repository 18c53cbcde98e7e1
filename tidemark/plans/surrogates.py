"""The pixel, mask, vessel, manifest and truth relations, derived from the given tables by integer arithmetic.

Each is given as a frame and as the SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = (4.035, 55.243)
GEO = {"ox": 3.9, "rx": 0.001, "kx": 0.0, "oy": 55.4, "ky": 0.0, "ry": -0.001}

PIXELS_SQL = """pixels AS (SELECT event_id // 1000 AS scene, CAST((event_id % 1000) // 40 AS INTEGER) AS "row", CAST(event_id % 40 AS INTEGER) AS col,
  -60e0 + ((event_id * 7919) % 7001) / 100e0 AS vv, -45e0 + ((event_id * 7919) % 7001) / 100e0 - ((event_id * 104729) % 4001) / 100e0 AS vh, event_id FROM events)"""
MASK_SQL = """mask AS (SELECT event_id // 1000 AS scene, CAST((event_id % 1000) // 40 AS INTEGER) AS "row", CAST(event_id % 40 AS INTEGER) AS col FROM events WHERE (event_id * 7919) % 1009 < 420)"""
AIS_SQL = """ais AS (SELECT event_id AS ordinal, 200000000 + user_id AS mmsi, 4.035e0 + ((event_id * 7919) % 401 - 200) / 200e0 AS lon,
  55.243e0 + ((event_id * 10007) % 301 - 150) / 200e0 AS lat, value - 25 * floor(value / 25) AS sog_knots,
  CASE event_type WHEN 'purchase' THEN 'Crude Oil Tanker' WHEN 'view' THEN 'General Cargo' WHEN 'click' THEN 'Fishing' WHEN 'signup' THEN 'Container Ship' ELSE 'Offshore Supply' END AS vessel_type FROM events)"""

TIMED_SQL = f"""{AIS_SQL}, fixes AS (SELECT ais.*, ts FROM ais JOIN events ON event_id = ordinal),
origins AS (SELECT s_suppkey AS incident_id, 4.035e0 + ((s_suppkey * 37) % 101 - 50) / 100e0 AS lon, 55.243e0 + ((s_suppkey * 53) % 101 - 50) / 150e0 AS lat, TIMESTAMP '2024-01-02 00:00:00' + to_hours((s_suppkey * 7919) % 672) AS ts FROM supplier)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(e):
    return {"scene": F.expr("event_id div 1000"), "row": F.expr("cast((event_id % 1000) div 40 as int)"), "col": F.expr("cast(event_id % 40 as int)")}


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    v = F.expr("((event_id * 7919) % 7001) / 100e0")
    return e.withColumns({**_place(e), "vv": v - 60.0, "vh": v - 45.0 - F.expr("((event_id * 104729) % 4001) / 100e0")}).drop("event_id")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id").where("(event_id * 7919) % 1009 < 420")
    return e.select(*(c.alias(n) for n, c in _place(e).items()))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel with its mask value 0 or 255."""
    e = table(spark, sf_dir, "events").select("event_id")
    return e.select(*(c.alias(n) for n, c in _place(e).items()), F.expr("if((event_id * 7919) % 1009 < 420, 255, 0)").alias("y"))


def _positions(e: DataFrame, *more: str) -> DataFrame:
    kind = F.expr("case event_type when 'purchase' then 'Crude Oil Tanker' when 'view' then 'General Cargo' when 'click' then 'Fishing' when 'signup' then 'Container Ship' else 'Offshore Supply' end")
    return e.select(
        F.col("event_id").alias("ordinal"), (F.col("user_id") + 200000000).alias("mmsi"), F.expr("4.035e0 + ((event_id * 7919) % 401 - 200) / 200e0").alias("lon"),
        F.expr("55.243e0 + ((event_id * 10007) % 301 - 150) / 200e0").alias("lat"), F.expr("value - 25 * floor(value / 25)").alias("sog_knots"), kind.alias("vessel_type"),
        F.lit(None).cast("string").alias("vessel_name"), F.lit(None).cast("double").alias("cog"), *more,
    )


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(table(spark, sf_dir, "events"))


def timed_ais(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The positions with the times of their events; `events` may be a stream of that table."""
    e = table(spark, sf_dir, "events") if events is None else events
    return _positions(e, "ts")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files. (A path with a pattern, since a stream takes a single file only so.)"""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def timed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An origin per supplier, in the place and the month of the positions."""
    place = "4.035e0 + ((s_suppkey * 37) % 101 - 50) / 100e0 AS lon", "55.243e0 + ((s_suppkey * 53) % 101 - 50) / 150e0 AS lat"
    ts = F.expr("timestamp_ntz'2024-01-02 00:00:00'") + F.make_dt_interval(hours=((F.col("s_suppkey") * 7919) % 672).cast("int"))
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS incident_id", *place, "s_suppkey").withColumn("ts", ts).drop("s_suppkey")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    kind = F.expr("case lang when 'en' then 'oil_spill' when 'de' then 'look_alike' else 'no_oil' end")
    return d.select(F.col("doc_id").alias("ordinal"), kind.alias("class"), F.when(F.col("n_chars").between(50, 20000), "True").otherwise("false").alias("valid"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("pred"))


def scenes(df: DataFrame) -> DataFrame:
    """A geotransform for every scene of df but those divisible by 7, which have none."""
    gt = F.struct(*(F.lit(v).alias(k) for k, v in GEO.items()))
    return df.select("scene").distinct().withColumn("gt", F.when(F.col("scene") % 7 != 3, gt))
