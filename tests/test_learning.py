"""Exact samples against sorting, and the balanced forest against a plain tree, its own arithmetic and separable truth."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest, learning
from tidemark.sources import files


def taken(df, keys, n):
    return sorted(tuple(-(1 << 63) if v is None else v for v in r) for r in learning.first_rows(df, keys, n).select("a", "b").collect())


@pytest.mark.parametrize("kind", ["wide", "ties", "one", "extreme"])
def test_first_rows_equal_sorting(spark, kind, monkeypatch):
    r = random.Random(kind)
    value = {"wide": lambda: r.randint(-(10**12), 10**12), "ties": lambda: r.randint(0, 3), "one": lambda: 7, "extreme": lambda: r.choice([-(1 << 63), (1 << 63) - 1, 0, None])}[kind]
    rows = [(value(), r.randint(0, 50)) for _ in range(700)]
    df = spark.createDataFrame(rows, "a long, b int").repartition(5).cache()
    order = sorted((-(1 << 63) if a is None else a, b) for a, b in rows)
    monkeypatch.setattr(learning, "RANGES", 16)
    for ranked in (1, 1 << 14):  # few keys are ranked late, or at once
        monkeypatch.setattr(learning, "RANKED", ranked)
        for n in (0, 1, 350, 699, 900):
            assert taken(df, [F.col("a"), F.col("b")], n) == order[:n], (ranked, n)


def test_sample_stays_in_its_partitions(spark, tmp_path):
    spark.range(40_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y")).repartition(6).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    out = learning.stratified_sample(df, "y", [F.xxhash64("id"), F.col("id")], 1000, 500)
    assert {(x.y, x["count"]) for x in out.groupBy("y").count().collect()} == {(1, 1000), (0, 3000)}
    plan = out._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "Exchange" not in plan
    assert out.rdd.getNumPartitions() > 1
    assert learning.stratified_sample(df.where("y = 0"), "y", [F.col("id")], 10, 20).count() == 20
    assert learning.stratified_sample(df.limit(0), "y", [F.col("id")]).count() == 0


def test_tree_is_the_best_split():
    """A tree of one split against trying every split, with weights of the bootstrap."""
    rng = np.random.default_rng(4)
    x, y, n = rng.integers(0, 9, (300, 3)) / 9, rng.integers(0, 10, 300), rng.poisson(1, 300)
    y = ((y == 0) | ((x[:, 1] > 0.6) & (y < 4))).astype(int)
    x, y, n = x[n > 0], y[n > 0], n[n > 0]
    tree = forest.grow(x, y, n, 1, 3, np.random.default_rng(0))
    total = np.array([n[y == c].sum() for c in (0, 1)])
    w = n * (total.sum() / (2 * total))[y]
    gini = lambda m: 2 * w[m & (y == 1)].sum() * w[m & (y == 0)].sum() / max(w[m].sum(), 1e-9)
    best = min(gini(x[:, j] <= v) + gini(x[:, j] > v) for j in range(3) for v in np.unique(x[:, j])[:-1])
    j, v = tree["feature"][0], tree["threshold"][0]
    assert abs(gini(x[:, j] <= v) + gini(x[:, j] > v) - best) < 1e-9 and abs(tree["share"][0] - 0.5) < 1e-12
    low = x[:, j] <= v
    assert abs(tree["share"][tree["left"][0]] - w[low & (y == 1)].sum() / w[low].sum()) < 1e-12
    assert tree["n_rows"][0] == n.sum() and tree["n_rows"][tree["left"][0]] == n[low].sum()
    deep = forest.grow(x, y, n, 15, 2, np.random.default_rng(0))
    assert len(deep["feature"]) % 2 == 1 and (deep["left"][deep["feature"] >= 0] > 0).all()


def test_bootstrap_counts(spark):
    c = spark.range(20_000).select(forest.bootstrap_count([F.col("id")], F.lit(3), 42).alias("n"))
    got = {r.n: r["count"] / 20_000 for r in c.groupBy("n").count().collect()}
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613, 0.0153)):
        assert abs(got[k] - share) < 0.012
    assert abs(sum(k * s for k, s in got.items()) - 1) < 0.03


def test_forest_balances_every_bootstrap(spark, tmp_path):
    """Three positives among 400: a tree has any number of them, and all weigh as much as the others together."""
    rows = [(i, -9.0 if i in (40, 80, 120) else float(i % 40), 0.0, 0.0, float(i % 7), int(i in (40, 80, 120))) for i in range(400)] + [(1000, None, 0.0, 0.0, 0.0, 1), (1001, float("nan"), 0.0, 0.0, 0.0, 1), (1002, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, vv_norm double, vh_norm double, diff_norm double, vv_std_norm double, y int")
    nodes = forest.train_balanced_forest(df, ["id"], trees=12, depth=6)
    one = sorted(map(tuple, nodes.collect()))
    assert one == sorted(map(tuple, forest.train_balanced_forest(df.repartition(7), ["id"], trees=12, depth=6).collect()))
    roots = {r[0]: r for r in one if r[1] == 0}
    assert len(roots) == 12 and {round(r[6], 9) for r in roots.values()} <= {0.5, 0.0}
    assert len({r[7] for r in roots.values()}) > 3  # bootstraps differ
    files.save_model(nodes, str(tmp_path / "forest"))
    out = learning.score_forest(files.load_model(str(tmp_path / "forest")), df, 0.3).collect()
    by = {r.id: r for r in out}
    assert by[1000].proba is None and by[1000].hard is None and by[1001].pred is None and len(out) == len(rows)
    assert all(by[i].proba > 0.5 and by[i].hard == 1 for i in (40, 80, 120)) and by[5].proba < 0.3
    assert forest.train_balanced_forest(df.limit(0), ["id"]).count() == 0
    assert forest.score_balanced_forest(nodes.limit(0), df).where("proba is not null").count() == 0
    only = forest.train_balanced_forest(df.where("y = 0"), ["id"], trees=2).collect()
    assert [(r.node, r.feature, r.share) for r in only] == [(0, -1, 0.0)] * 2
