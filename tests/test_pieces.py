"""Documents written line by line against the same documents made whole, and the lines of reports."""

import json
import os

from pyspark.sql import functions as F

from tidemark.operators import incidents, learning, raster
from tidemark.sources import files


def joined(path):
    return "".join(open(f"{path}/{n}").read().replace("\n", "") for n in sorted(os.listdir(path)) if n.startswith("part-"))


def test_collections(spark, tmp_path):
    rows = [("s", r, c) for r in range(0, 40, 2) for c in range(0, 40, 2)] + [("t", 1, 1), ("u", 0, 0), ("u", 5, 5)]
    stats = raster.component_stats(raster.labelled(spark.createDataFrame(rows, "scene string, row int, col int")), 1)
    gt = F.struct(*(F.lit(v).alias(k) for k, v in (("ox", 4.0), ("rx", 0.001), ("kx", 0.0), ("oy", 55.0), ("ky", 0.0), ("ry", -0.001))))
    spills = raster.polygons(stats, spark.createDataFrame([("s",), ("t",), ("u",)], "scene string").withColumn("gt", F.when(F.col("scene") != "t", gt))).cache()
    files.write_pieces(files.polygon_pieces(spills, raster.ring()), "scene", str(tmp_path / "p"))
    whole = [r.value for r in files.polygons_collection(spills, raster.ring()).orderBy("scene").collect()]
    assert joined(tmp_path / "p") == "".join(whole) and len(whole) == 3
    files.write_pieces(files.polygon_pieces(spills.limit(0), raster.ring()), "scene", str(tmp_path / "none"))
    assert joined(tmp_path / "none") == ""


def test_attribution_reports(spark, tmp_path):
    sites = spark.createDataFrame([(1, 4.0, 55.0, [(4.0, 55.0)]), (2, 100.0, 0.0, None)], "incident_id long, lon double, lat double, track array<struct<lon:double,lat:double>>")
    ais = spark.createDataFrame([(i, i, 4.0 + i / 1000, 55.0, 9.0, "Tanker", None, None) for i in range(60)] + [(5, 5, 4.005, 55.0, 9.0, "Tanker", None, None)], "ordinal long, mmsi long, lon double, lat double, sog_knots double, vessel_type string, vessel_name string, cog double")
    found = incidents.incident_candidates(sites, ais).cache()
    assert incidents.attribution_summary(sites, found).where("incident_id = 2").first().priority == []
    files.write_pieces(incidents.report_pieces(sites, found), "incident_id", str(tmp_path / "r"))
    whole = incidents.attribution_report(sites, found).select("incident_id", F.to_json("report", {"ignoreNullFields": "false"}).alias("v")).orderBy("incident_id").collect()
    got, end = json.JSONDecoder().raw_decode(joined(tmp_path / "r"))
    assert len(got["candidates_ranked"]) == 61 and joined(tmp_path / "r")[end:] == whole[1].v and whole[1].v.endswith('"candidates_ranked":[]}')
    scores = [c["attribution_score"] for c in got["candidates_ranked"]]
    assert scores == sorted(scores, reverse=True)
    once = found.dropDuplicates(["incident_id", "ordinal"])
    files.write_pieces(incidents.report_pieces(sites, once), "incident_id", str(tmp_path / "q"))
    whole = incidents.attribution_report(sites, once).select("incident_id", F.to_json("report", {"ignoreNullFields": "false"}).alias("v")).orderBy("incident_id").collect()
    assert joined(tmp_path / "q") == "".join(r.v for r in whole)


def test_report_lines(spark):
    rows = spark.createDataFrame([(1, 1), (0, 0), (0, 1), (1, 0), (0, 0)], "y int, pred int")
    lines = [r.value for r in learning.report_lines(rows, ["head"]).orderBy("line").collect()]
    assert lines[0] == "head" and "Pixels evaluated: 5" in lines and "Positive in truth: 2 (40.00%)" in lines and "  - Accuracy: 0.6000" in lines and len(lines) == 18
    assert [r.value for r in learning.report_lines(rows.limit(0), []).orderBy("line").collect()][0] == "Pixels evaluated: 0"


def test_texts_joined_over_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("incident_id"), F.struct((-(F.col("id") % 7)).alias("o0"), F.col("id").alias("o1")).alias("at"), F.concat(F.lit("m"), "id").alias("m"))
    got = {r.incident_id: r for r in incidents.joined_in_order(rows, "incident_id", "at", F.col("m"), F.col("m")).collect()}
    for k in (0, 1):
        want = [f"m{i}" for i in sorted(range(k, 3000, 2), key=lambda i: (-(i % 7), i))]
        assert got[k].joined == ",".join(want) and got[k].n == 1500 and got[k].first == want[0]


def test_report_is_read_line_by_line(spark):
    """The report query joins texts range by range, not all candidates in one row."""
    from tidemark.plans import queries

    plan = queries.attribution_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_near_summary_is_that_of_all_candidates(spark):
    """Places and incidents that repeat, ties of scores, nulls, an incident without a vessel."""
    shape = "incident_id long, lon double, lat double, track array<struct<lon:double,lat:double>>"
    sites = spark.createDataFrame([(i, 4.0 + (i % 3) / 10, 55.0, [(4.0 + (i % 3) / 10, 55.0), (4.1, 55.05)]) for i in range(9)] + [(20, 4.0, 55.0, None), (21, 100.0, 0.0, None)], shape)
    kinds = ("Tanker", "Cargo", None, "Fishing", "Oil")
    rows = [(i, 100 + i, 4.0 + (i % 17) / 50, 55.0 + (i % 5) / 50, None if i % 11 == 0 else float(i % 23), kinds[i % 5], None, None) for i in range(900)] + [(900, 1, None, 55.0, 9.0, "Tanker", None, None)]
    ais = spark.createDataFrame(rows, "ordinal long, mmsi long, lon double, lat double, sog_knots double, vessel_type string, vessel_name string, cog double")
    want = incidents.attribution_summary(sites, incidents.incident_candidates(sites, ais)).orderBy("incident_id").collect()
    got = incidents.near_summary(sites, ais)
    assert got.columns == ["incident_id", "n_candidates", "real_ais", "priority"]
    assert got.orderBy("incident_id").collect() == want and want[-1].priority == [] and len(want[0].priority) == 3


def test_training_report_counts_all_pixels(spark, tmp_path):
    """More positives than a forest's sample takes."""
    import duckdb

    from tidemark.plans import exchange
    from tidemark.plans.queries import SQL

    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS event_id FROM range(280000)) TO '{tmp_path}/events.parquet'")
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/labels.parquet') TO '{tmp_path}/labels.parquet'")
    for t in ("events", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert exchange.training_report_file(spark, str(tmp_path)).first().value == con.execute(SQL["training_report_file"]).fetchall()[0][0]
