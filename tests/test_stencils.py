"""Means over tiles against plain means, at borders of tiles and edges of scenes."""

import numpy as np
import pytest

from tidemark.operators import raster


@pytest.mark.parametrize("tile,size,mode", [(8, 5, "mirror"), (7, 7, "edge"), (512, 5, "edge"), (5, 3, "mirror")])
def test_box_mean(spark, tile, size, mode):
    rng, r = np.random.default_rng(1), size // 2
    scenes = {"a": rng.normal(size=(23, 31)), "b": rng.normal(size=(8, 9)), "c": rng.normal(size=(1, 40)), "far": rng.normal(size=(16, 16))}
    off = {"far": 4000}
    rows = [(s, i + off.get(s, 0), j + off.get(s, 0), float(a[i, j]), "kept") for s, a in scenes.items() for i in range(a.shape[0]) for j in range(a.shape[1])]
    df = spark.createDataFrame(rows, "scene string, row int, col int, x double, `a.b` string").repartition(3)
    got = raster.box_mean(df, ["x"], size, mode, tile)
    assert got.columns == df.columns
    found = {(x[0], x[1], x[2]): x[3] for x in got.collect()}
    assert len(found) == len(rows)
    for s, a in scenes.items():
        p = np.pad(a, r, mode="symmetric" if mode == "mirror" else "edge")
        for i in range(a.shape[0]):
            for j in range(a.shape[1]):
                assert abs(found[s, i + off.get(s, 0), j + off.get(s, 0)] - p[i : i + size, j : j + size].mean()) < 1e-9


def test_gaps_and_nulls(spark):
    rows = [("s", i, j, None if (i, j) == (2, 2) else 1.0 + (i == 4)) for i in range(6) for j in range(6) if (i, j) != (3, 3)] + [("t", 0, 0, None)]
    got = {(x.scene, x.row, x.col): x.x for x in raster.box_mean(spark.createDataFrame(rows, "scene string, row int, col int, x double"), ["x"], 3).collect()}
    assert len(got) == len(rows) and got["t", 0, 0] is None and got["s", 2, 2] == 1.0 and abs(got["s", 4, 4] - 11 / 8) < 1e-12
    assert raster.box_mean(spark.createDataFrame([], "scene string, row int, col int, x double"), ["x"]).count() == 0


def test_looks(spark):
    flat = spark.createDataFrame([("s", i, j, 3.0, 0.0) for i in range(9) for j in range(9)], "scene string, row int, col int, vv double, vh double")
    assert {(x.vv, x.vh) for x in raster.despeckle(flat, ["vv", "vh"]).collect()} == {(3.0, 0.0)}
    with pytest.raises(ValueError, match="looks"):
        raster.despeckle(flat, ["vv"], looks=0)
