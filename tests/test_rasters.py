"""Raster files by blocks: packings against plain encoders, lines left out, scenes over several tasks, and the committing sink."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import raster
from tidemark.sources import tiff


def lzw(data):
    """A plain encoder: codes as text of bits."""
    bits, table, width, now = ["100000000"], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    for i in range(len(data)):
        x = data[i : i + 1]
        if now + x in table:
            now += x
            continue
        bits.append(format(table[now], f"0{width}b"))
        table[now + x] = size
        size += 1
        if size == 4095:
            bits.append(format(256, f"0{width}b"))
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        elif size >= 1 << width:
            width += 1
        now = x
    if now:
        bits.append(format(table[now], f"0{width}b"))
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    bits.append(format(257, f"0{width}b"))
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


@pytest.mark.parametrize("kind", ["text", "same", "noise", "short"])
def test_lzw(kind):
    r = random.Random(1)
    data = {"text": b"the same words again and again " * 900, "same": b"\0" * 50_000, "noise": bytes(r.randrange(256) for _ in range(20_000)), "short": b"a"}[kind]
    assert tiff.unpacked_lzw(lzw(data)) == data


def tiled(a, wide, high, packing, predictor):
    """A TIFF of (bands, height, width) in tiles, bands apart."""
    n, height, width = a.shape
    parts = []
    for b in range(n):
        for r in range(0, height, high):
            for c in range(0, width, wide):
                t = np.zeros((high, wide), a.dtype)
                t[: min(high, height - r), : min(wide, width - c)] = a[b, r : r + high, c : c + wide]
                if predictor == 3:
                    raw = np.ascontiguousarray(t.astype(">f4")).view(np.uint8).reshape(high, wide, 4)
                    raw = np.moveaxis(raw, 2, 1).reshape(high, -1)
                    raw = np.concatenate([raw[:, :1], np.diff(raw, axis=1)], 1).astype(np.uint8).tobytes()
                else:
                    raw = t.astype("<f4").tobytes()
                parts.append(lzw(raw) if packing == 5 else zlib.compress(raw) if packing == 8 else raw)
    offsets = (8 + np.cumsum([0, *map(len, parts)])[:-1]).tolist()
    fields = [(256, "I", [width]), (257, "I", [height]), (258, "H", [32] * n), (259, "H", [packing]), (277, "H", [n]), (284, "H", [2]), (317, "H", [predictor]), (322, "I", [wide]), (323, "I", [high]), (324, "I", offsets), (325, "I", [len(p) for p in parts]), (339, "H", [3] * n)]
    at = 8 + sum(map(len, parts))
    entries, far = b"", b""
    for tag, code, values in fields:
        raw = struct.pack(f"<{len(values)}{code}", *values)
        entries += struct.pack("<HHI", tag, {"H": 3, "I": 4}[code], len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + 6 + 12 * len(fields) + len(far)))
        far += raw if len(raw) > 4 else b""
    return b"II" + struct.pack("<HI", 42, at) + b"".join(parts) + struct.pack("<H", len(fields)) + entries + bytes(4) + far


@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize("predictor", [1, 3])
def test_tiles(packing, predictor):
    a = np.random.default_rng(1).normal(0, 50, (2, 21, 13)).astype("f4")
    assert (tiff.decode(tiled(a, 8, 16, packing, predictor)) == a).all()


def test_lines_of_one_scene_in_many_tasks(spark, tmp_path):
    a = np.random.default_rng(2).normal(0, 9, (2, 300, 11)).astype("f4")
    (tmp_path / "s.tif").write_bytes(tiff.encode(a, lines=4))
    got = tiff.read_pixels(spark, str(tmp_path)).collect()
    assert {(r.row, r.col): (r.vv, r.vh) for r in got} == {(i, j): (a[0, i, j], a[1, i, j]) for i in range(300) for j in range(11)}
    some = tiff.read_pixels(spark, str(tmp_path), rows=(101, 103)).collect()
    assert sorted((r.row, r.col) for r in some) == [(i, j) for i in (101, 102, 103) for j in range(11)] and all(r.vv == a[0, r.row, r.col] for r in some)
    assert tiff.stored_blocks(tiff.files(spark, str(tmp_path)), (101, 103)).count() == 1
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "s.tif").write_bytes(tiff.encode(np.random.default_rng(3).normal(0, 9, (2, 1500, 600)).astype("f4"), lines=8))
    tasks = tiff.read_pixels(spark, str(tmp_path / "big")).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2 and sum(t["count"] for t in tasks) == 900_000


@pytest.mark.parametrize("dtype,lines", [("f4", 5), ("u1", 64), ("i2", 1)])
def test_sink(spark, tmp_path, dtype, lines):
    """Scenes of several sizes, with missing pixels, out through the sink and in again."""
    r = random.Random(3)
    shapes = {"a": (17, 9), "b": (1, 1), "é": (40, 30)}
    rows = [(s, i, j, float(r.randint(0, 250)), 1.0) for s, (h, w) in shapes.items() for i in range(h) for j in range(w) if (i, j) == (h - 1, w - 1) or r.random() < 0.9]
    df = spark.createDataFrame(rows, "scene string, row int, col int, x double, y double").repartition(4)
    gt = spark.createDataFrame([("a", (4.0, 0.1, 0.0, 55.0, 0.0, -0.1)), ("b", None)], "scene string, gt struct<ox:double,rx:double,kx:double,oy:double,ky:double,ry:double>")
    tiff.write_rasters(df, ["x", "y"], str(tmp_path / "out"), dtype, gt, lines, "_v")
    assert sorted(os.listdir(tmp_path / "out")) == ["a_v.tif", "b_v.tif", "é_v.tif"]
    want = {(s, i, j): (x, y) for s, i, j, x, y in rows}
    for s, (h, w) in shapes.items():
        data = (tmp_path / "out" / f"{s}_v.tif").read_bytes()
        a = tiff.decode(data)
        assert a.shape == (2, h, w) and a.dtype == np.dtype(dtype)
        assert all((a[0, i, j], a[1, i, j]) == want.get((s, i, j), (0, 0)) for i in range(h) for j in range(w))
        assert tiff.geotransform(tiff.tags(data)[1]) == ((4.0, 0.1, 0.0, 55.0, 0.0, -0.1) if s == "a" else None)
    again = tiff.bands(tiff.files(spark, str(tmp_path / "out")), 2)
    assert again.where("b2 = 1").count() == len(rows)


def test_failed_job_leaves_no_file(spark, tmp_path):
    tiff.write_rasters(spark.createDataFrame([("ok", 0, 0, 1.0)], "scene string, row int, col int, x double"), ["x"], str(tmp_path / "out"))
    spark.dataSource.register(tiff.TiffSink)
    strip = tiff.packed_strip(np.zeros((1, 1, 1), "f4"))
    rows = [(f"s{i}", 0, 1, 1, strip, len(strip), None) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, strip int, height int, width int, content binary, total long, gt array<double>").repartition(4)
    bad = df.withColumn("strip", F.when(F.col("name") == "s7", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("strip")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("tidemark_tiff").option("dtype", "f4").option("bands", 1).option("lines", 64).mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["ok.tif"]


def test_plain_files_are_dealt_by_pixels(spark, tmp_path):
    """Small files that pack to nothing: tasks follow the pixels, and decoded pixels don't go to every task."""
    (tmp_path / "in").mkdir()
    plain = tiff.encode(np.ones((2, 60, 60), "f4"), lines=60)
    for i in range(160):
        (tmp_path / "in" / f"s{i}.tif").write_bytes(plain)
    p = tiff.read_pixels(spark, str(tmp_path / "in")).withColumnRenamed("name", "scene")
    tasks = p.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 3 and sum(t["count"] for t in tasks) == 160 * 3600
    y = tiff.read_masks(spark, str(tmp_path / "in")).withColumnRenamed("name", "scene")
    both = raster.with_mask(p, y)
    assert both.agg(F.count("y"), F.sum("y"), F.sum("vv")).first()[:] == (576_000, 576_000, 576_000.0)
    sent = both.groupBy("scene").count()
    assert len(sent.collect()) == 160 and "Broadcast" not in sent._jdf.queryExecution().executedPlan().toString()
    tiff.write_rasters(both, ["y"], str(tmp_path / "out"), "u1")
    assert len(os.listdir(tmp_path / "out")) == 160
    again = tiff.masks(tiff.files(spark, str(tmp_path / "out")))
    assert again.where("y = 1").count() == 576_000


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_strips_of_sparse_scenes(spark, tmp_path, batch):
    """Strips without a pixel, strips over several batches, and a pixel outside its scene."""
    want = {"a": np.zeros((1, 31, 9), "f4"), "b": np.zeros((1, 4, 5), "f4")}
    rows = [("a", 0, 3, 1.0), ("a", 13, 8, 2.0), ("a", 30, 0, 3.0), *(("b", i, j, float(i * 5 + j)) for i in range(4) for j in range(5))]
    for s, i, j, v in rows:
        want[s][0, i, j] = v
    df = spark.createDataFrame(rows, "scene string, row int, col int, x double").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        tiff.write_rasters(df, ["x"], str(tmp_path / "out"), lines=3)
        with pytest.raises(Exception, match="no place"):
            tiff.strips(df.union(df.limit(1).withColumn("row", F.lit(-4))), ["x"], lines=3).collect()
    finally:
        spark.conf.set(key, was)
    for s, a in want.items():
        assert (tiff.decode((tmp_path / "out" / f"{s}.tif").read_bytes()) == a).all()
