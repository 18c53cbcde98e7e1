"""TIFF decoding against hand-made files, and the entry points from rasters to polygons."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest, learning, raster
from tidemark.plans import flows
from tidemark.sources import files, tiff


def made(a: np.ndarray, order="<", apart=False, deflate=False, rows=3, predictor=1, gt=None) -> bytes:
    """A TIFF of (bands, height, width) in strips of `rows` lines."""
    bands, height, width = a.shape
    planes = [a[b : b + 1] for b in range(bands)] if apart else [a]
    strips = []
    for p in planes:
        for r in range(0, height, rows):
            block = np.moveaxis(p[:, r : r + rows], 0, 2)
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], 1)
            raw = block.astype(a.dtype.newbyteorder(order)).tobytes()
            strips.append(zlib.compress(raw) if deflate else raw)
    at = 8
    offsets = []
    for s in strips:
        offsets.append(at)
        at += len(s)
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    fields = [(256, "I", [width]), (257, "I", [height]), (258, "H", [a.dtype.itemsize * 8] * bands), (259, "H", [8 if deflate else 1]), (273, "I", offsets), (277, "H", [bands]), (278, "I", [rows])]
    fields += [(279, "I", [len(s) for s in strips]), (284, "H", [2 if apart else 1]), (317, "H", [predictor]), (339, "H", [kind] * bands)]
    if gt:
        ox, rx, kx, oy, ky, ry = gt
        fields.append((34264, "d", [rx, kx, 0, ox, ky, ry, 0, oy, 0, 0, 0, 0, 0, 0, 0, 1]))
    entries, extra, far = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, code, values in fields:
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[code], len(values))
        entries += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", far + len(extra))
        extra += raw if len(raw) > 4 else b""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + b"".join(strips) + struct.pack(order + "H", len(fields)) + entries + bytes(4) + extra


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("dtype,predictor", [("f4", 1), ("u1", 2), ("i2", 1)])
def test_decode(order, apart, dtype, predictor):
    a = (np.random.default_rng(1).normal(0, 50, (2, 7, 5))).astype("i2").astype(dtype)
    for deflate in (False, True):
        assert (tiff.decode(made(a, order, apart, deflate, predictor=predictor)) == a).all()


def test_refusals():
    with pytest.raises(ValueError, match="classic"):
        tiff.decode(b"PK\x03\x04" + bytes(20))


@pytest.mark.parametrize("dtype", ["f4", "u1", "i2"])
def test_encode(dtype):
    a = np.random.default_rng(2).normal(0, 50, (3, 6, 5)).astype("i2").astype(dtype)
    gt = (4.0, 0.001, 0.0, 55.0, 0.0, -0.001)
    data = tiff.encode(a, gt)
    assert (tiff.decode(data) == a).all() and tiff.geotransform(tiff.tags(data)[1]) == gt
    assert tiff.geotransform(tiff.tags(tiff.encode(a))[1]) is None


def test_geotransform_of_scale_and_tie_point():
    assert tiff.geotransform({33550: (0.5, 0.25, 0.0), 33922: (2.0, 4.0, 0.0, 10.0, 50.0, 0.0)}) == (9.0, 0.5, 0.0, 51.0, 0.0, -0.25)
    assert tiff.geotransform({33550: (0.5, 0.25, 0.0)}) is None and tiff.geotransform({34264: (1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)}) is None


def test_run_from_files_to_outputs(spark, tmp_path):
    (tmp_path / "img").mkdir()
    rng = np.random.default_rng(3)
    truth = np.zeros((24, 24), np.uint8)
    truth[4:14, 6:16] = 1
    for k in range(2):
        on = truth > 0 if k == 0 else np.zeros_like(truth, bool)
        db = np.stack([np.where(on, -30, -12), np.where(on, -35, -20)]) + rng.normal(0, 0.3, (2, 24, 24))
        (tmp_path / "img" / f"S1_{k}.tif").write_bytes(tiff.encode(db.astype("f4"), (4.0, 0.001, 0.0, 55.0, 0.0, -0.001)))
    pixels = tiff.read_pixels(spark, str(tmp_path / "img")).withColumnRenamed("name", "scene")
    masks = pixels.select("scene", "row", "col", ((F.col("scene") == "S1_0") & F.col("row").between(4, 13) & F.col("col").between(6, 15)).cast("int").alias("y"))
    model = learning.train_forest(raster.with_mask(raster.features(pixels, True), masks), trees=5, depth=5)
    out = {r.scene: r for r in flows.run_scenes(spark, str(tmp_path / "img"), model, str(tmp_path / "out"), 0.5, 20, (24, 24)).collect()}
    assert (out["S1_0"].n_polygons, out["S1_1"].n_polygons) == (1, 0) and out["S1_0"].total_area_km2 > 0 and out["S1_0"].as_expected
    for k in ("preprocessed", "features", "mask"):
        assert spark.read.parquet(out["S1_0"][k]).groupBy("scene").count().collect()[0]["count"] == 576
    (p,) = files.read_polygons(spark, out["S1_0"].spills).collect()
    assert abs(p.pixel_count - 100) <= 40 and p.georeferenced and p.coordinates[0][0] == p.coordinates[0][4]


def test_scene_to_polygons(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "mask").mkdir()
    rng, gt = np.random.default_rng(3), (4.0, 0.001, 0.0, 55.0, 0.0, -0.001)
    truth = np.zeros((2, 24, 24), np.uint8)
    truth[0, 4:14, 6:16] = 255
    for k in range(2):
        db = np.stack([np.where(truth[k] > 0, -30, -12), np.where(truth[k] > 0, -35, -20)]) + rng.normal(0, 0.3, (2, 24, 24))
        (tmp_path / "img" / f"s{k}.tif").write_bytes(made(db.astype("f4"), gt=gt if k == 0 else None))
        (tmp_path / "mask" / f"s{k}.tif").write_bytes(made(truth[k : k + 1]))
    ids = spark.createDataFrame([("s0", 0), ("s1", 1)], "name string, scene long")
    pixels = tiff.read_pixels(spark, str(tmp_path / "img")).join(ids, "name").drop("name")
    masks = tiff.read_masks(spark, str(tmp_path / "mask")).join(ids, "name").drop("name")
    info = tiff.read_info(spark, str(tmp_path / "img")).join(ids, "name")
    got = {r.scene: r for r in info.collect()}
    assert (got[0].height, got[0].width, got[0].bands, got[0].dtype) == (24, 24, 2, "f32") and tuple(got[0].gt) == gt and "transformation" in got[0].tags
    assert got[1].gt is None
    manifest = spark.createDataFrame([(0, "oil_spill", "True", 0), (1, "look_alike", "true", 1)], "scene long, class string, valid string, ordinal long")
    data = flows.build_dataset(pixels, masks, manifest, 12, 12)
    counts = flows.dataset_counts(data).collect()
    assert [(r.split, r.n_scenes, r.n_patches, r.n_pixels, r.n_pos) for r in counts] == [("train", 2, 8, 1152, 100)]
    model = learning.train_forest(data, trees=5, depth=5)
    m, _, _ = flows.evaluate(model, data)
    assert m.first().f1 > 0.9
    _, found, summary = flows.detect(model, pixels, info.select("scene", "gt"), threshold=0.5, min_pixels=20, despeckle=False)
    (p,) = found.collect()
    assert p.scene == 0 and p.georeferenced and abs(p.pixel_count - 100) <= 40 and abs(p.centroid_x - 4.0105) < 0.002
    assert [(r.scene, r.n_polygons, r.total_area_km2 > 0) for r in summary.orderBy(F.col("scene")).collect()] == [(0, 1, True), (1, 0, False)]


def test_run_despeckles_once(spark, tmp_path, monkeypatch):
    """Bands are despeckled once for the preprocessed ones and the inference, and give what each gives alone."""
    (tmp_path / "img").mkdir()
    db = np.random.default_rng(5).normal(-20, 4, (2, 24, 24)).astype("f4")
    (tmp_path / "img" / "s.tif").write_bytes(tiff.encode(db))
    model = spark.createDataFrame([(0, 0, 0, 0.5, 1, 2, 0.5, 2), (0, 1, -1, 0.0, -1, -1, 0.75, 1), (0, 2, -1, 0.0, -1, -1, 0.125, 1)], forest.NODES)
    seen = []
    monkeypatch.setattr(raster, "lee", lambda *a, f=raster.lee: (seen.append(1), f(*a))[1])
    (out,) = flows.run_scenes(spark, str(tmp_path / "img"), model, str(tmp_path / "out"), 0.3, 3, (24, 24)).collect()
    assert len(seen) == 1
    pixels = tiff.read_pixels(spark, str(tmp_path / "img")).withColumnRenamed("name", "scene")
    for folder, alone in ((out.preprocessed, raster.preprocess(pixels)), (out.features, raster.features(pixels)), (out.mask, flows.infer(model, pixels))):
        columns = [c for c in alone.columns if c != "scene"]
        got, want = (sorted(df.select(*columns).collect()) for df in (spark.read.parquet(folder), alone))
        assert len(got) == 576 and np.allclose(got, want, rtol=0, atol=1e-9)
