"""A random forest whose trees have class weights of their own bootstrap, grown side by side and kept as a table.

Every row joins a tree's bootstrap as often as a Poisson count says, which is a hash of the row's key, the tree and the seed: the
same rows give the same forest however they are dealt. Rows go to their trees by a shuffle, and a task grows one tree at a time from its
bootstrap, level by level from histograms. The sample that is fitted is bounded (see learning.stratified_sample), so a tree's
bootstrap is too. The forest is a table of nodes; scoring sends it to the tasks behind a check of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import FEATURES, by_threshold

NODES = "tree int, node int, feature int, threshold double, left int, right int, share double, n_rows long"
_NODES = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("left", pa.int32()), ("right", pa.int32()), ("share", pa.float64()), ("n_rows", pa.int64())])
#: Limits of a feature that splits are looked for at, and nodes whose histograms are held at a time.
BINS, NODES_AT_ONCE = 256, 1024
#: Nodes that go to every task for scoring: 30 bytes each.
MOST_NODES = 8_000_000


def bootstrap_count(keys: list[Column], tree: Column, seed: int) -> Column:
    """How often a row is in a tree's bootstrap: Poisson with mean 1, by a hash."""
    u = F.shiftrightunsigned(F.xxhash64(*keys, tree, F.lit(seed)), 11) / float(1 << 53)
    left, term, found = 1.0, float(np.exp(-1.0)), F.lit(0)
    total = 0.0
    for k in range(1, 20):  # beyond it less than 1 in 10^17
        total += term
        found = found + (u >= min(total, left)).cast("int")
        term /= k
    return found


def _limits(x: np.ndarray) -> np.ndarray:
    """Places between values to split at: between all distinct values, or at equal shares of the rows."""
    v = np.unique(x)
    if len(v) > BINS:
        v = np.unique(np.quantile(x, np.linspace(0, 1, BINS), method="nearest"))
    return (v[1:] + v[:-1]) / 2


def grow(x: np.ndarray, y: np.ndarray, count: np.ndarray, depth: int, tried: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree of rows x with labels y (0, 1) that count `count` times each, by Gini impurity with balanced weights of these rows.

    A node tries `tried` features in random order, and goes on to the others only while none of those has a split.
    """
    per = np.array([(count * (y == c)).sum() for c in (0, 1)], np.float64)
    weight = count * np.where(per > 0, per.sum() / ((per > 0).sum() * np.maximum(per, 1)), 0)[y]
    limits = [_limits(x[:, j]) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(limits[j], x[:, j], side="left") for j in range(x.shape[1])], 1)
    most = max(len(v) for v in limits) + 1
    feature, threshold, left, right, share, rows = [-1], [0.0], [-1], [-1], [0.0], [0]
    at = np.zeros(len(y), np.int64)
    alive, level = np.array([0]), np.arange(len(y))  # rows that are in open nodes
    for deep in range(depth + 1):
        first, n = alive[0], len(alive)
        here = at[level] - first
        sums = np.bincount(here * 2 + y[level], weight[level], minlength=2 * n).reshape(n, 2)
        counts = np.bincount(here, count[level], minlength=n)
        for i in range(n):
            share[first + i], rows[first + i] = float(sums[i, 1] / max(sums[i].sum(), 1e-300)), int(counts[i])
        open_nodes = np.flatnonzero((sums.min(1) > 0) & (counts > 1)) if deep < depth else np.array([], int)
        if not len(open_nodes):
            break
        best = np.full((n, x.shape[1]), np.inf)
        where = np.zeros((n, x.shape[1]), np.int64)
        place = np.full(n, -1)
        for a in range(0, len(open_nodes), NODES_AT_ONCE):
            some = open_nodes[a : a + NODES_AT_ONCE]
            place[:] = -1
            place[some] = np.arange(len(some))
            of = place[here]
            inside = of >= 0
            base = (of[inside] * 2 + y[level][inside]) * most
            w = weight[level][inside]
            for j in range(x.shape[1]):
                h = np.bincount(base + bins[level, j][inside], w, minlength=len(some) * 2 * most).reshape(len(some), 2, most)
                low = np.cumsum(h, 2)[:, :, :-1]
                high = sums[some][:, :, None] - low
                size_low, size_high = low.sum(1), high.sum(1)
                gini = 2 * low[:, 0] * low[:, 1] / np.maximum(size_low, 1e-300) + 2 * high[:, 0] * high[:, 1] / np.maximum(size_high, 1e-300)
                tiny = 1e-9 * sums[some].sum(1)[:, None]
                gini[(size_low <= tiny) | (size_high <= tiny)] = np.inf
                where[some, j] = np.argmin(gini, 1)
                best[some, j] = gini[np.arange(len(some)), where[some, j]]
        split_of, limit_of, child = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
        start = len(feature)
        following = 0
        for i in open_nodes.tolist():
            order = rng.permutation(x.shape[1])
            usable = [j for j in order if np.isfinite(best[i, j])]
            if not usable:
                continue
            among = [j for j in order[:tried] if np.isfinite(best[i, j])] or usable[:1]
            j = min(among, key=lambda f: best[i, f])
            split_of[i], limit_of[i], child[i] = j, where[i, j], start + following
            feature[first + i], threshold[first + i] = int(j), float(limits[j][where[i, j]])
            left[first + i], right[first + i] = start + following, start + following + 1
            following += 2
        if not following:
            break
        for values, empty in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (share, 0.0), (rows, 0)):
            values.extend([empty] * following)
        stays = split_of[here] >= 0
        level, here = level[stays], here[stays]
        at[level] = child[here] + (bins[level, split_of[here]] > limit_of[here])
        alive = np.arange(start, start + following)
    return {"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "right": np.array(right), "share": np.array(share), "n_rows": np.array(rows)}


def train_balanced_forest(sample: DataFrame, keys: list[str], label: str = "y", features: list[str] = FEATURES, trees: int = 100, depth: int = 15, seed: int = 42) -> DataFrame:
    """The nodes of a forest (tree, node, feature, threshold, left, right, share, n_rows): node 0 is the root, feature -1 a leaf.

    share is that of class 1 by the balanced weights of the tree's bootstrap; a value up to the threshold goes left. keys name
    a row; rows of one key join the same bootstraps. Rows with a null or NaN feature or another label than 0 and 1 are left out. An
    empty sample gives no node. A tree whose bootstrap has one class is a leaf.
    """
    columns = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    known = sample.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), *columns, F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    for i in range(len(features)):
        known = known.where(F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}"))
    dealt = known.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    dealt = dealt.withColumn("n", bootstrap_count([F.col(f"k{i}") for i in range(len(keys))], F.col("tree"), seed)).where("n > 0")
    names = [f"x{i}" for i in range(len(features))]
    tried = max(1, int(np.sqrt(len(features))))

    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        x = np.stack([table.column(c).to_numpy() for c in names], 1)
        order = np.lexsort((table.column("n").to_numpy(), table.column("y").to_numpy(), *x.T))  # sums don't depend on how rows came
        found = grow(x[order], table.column("y").to_numpy()[order], table.column("n").to_numpy()[order], depth, tried, np.random.default_rng([seed, tree]))
        n = len(found["feature"])
        return pa.table({"tree": np.full(n, tree), "node": np.arange(n), **found}, schema=_NODES)

    return dealt.select("tree", *names, "y", "n").repartition(trees, "tree").groupBy("tree").applyInArrow(run, NODES)


def _packed(nodes: DataFrame) -> list[dict[str, np.ndarray]]:
    """The forest as arrays, a dictionary a tree."""
    n = nodes.count()
    if n > MOST_NODES:
        raise ValueError(f"a forest of {n} nodes does not go to every task")
    table = nodes.toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    at = {c: table.column(c).to_numpy() for c in ("tree", "feature", "threshold", "left", "right", "share")}
    cuts = np.flatnonzero(np.diff(at["tree"])) + 1
    parts = {c: np.split(v, cuts) for c, v in at.items()}
    return [{c: parts[c][i].astype(np.float64 if c in ("threshold", "share") else np.int32) for c in parts if c != "tree"} for i in range(len(cuts) + 1 if n else 0)]


def leaves(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    at = np.zeros(len(x), np.int32)
    open_rows = np.flatnonzero(tree["feature"][at] >= 0)
    while len(open_rows):
        node = at[open_rows]
        low = x[open_rows, tree["feature"][node]] <= tree["threshold"][node]
        at[open_rows] = np.where(low, tree["left"][node], tree["right"][node])
        open_rows = open_rows[tree["feature"][at[open_rows]] >= 0]
    return at


def score_balanced_forest(nodes: DataFrame, df: DataFrame, threshold: float = 0.3, features: list[str] = FEATURES) -> DataFrame:
    """df with proba (mean share of the trees' leaves), votes (trees whose leaf has a share over 0.5), pred by the threshold and hard (proba over 0.5).

    A row with a null or NaN feature gets nulls. A forest without trees gives nulls.
    """
    from pyspark.sql.functions import pandas_udf

    forest = _packed(nodes)
    sent = df.sparkSession.sparkContext.broadcast(forest)

    @pandas_udf("struct<proba double, votes int>")
    def judged(*columns):
        import pandas as pd

        x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns], 1)
        total, votes = np.zeros(len(x)), np.zeros(len(x), np.int32)
        for tree in sent.value:
            share = tree["share"][leaves(tree, x)]
            total += share
            votes += share > 0.5
        broken = np.isnan(x).any(1) | (len(sent.value) == 0)
        total /= max(1, len(sent.value))
        return pd.DataFrame({"proba": pd.Series(total).mask(broken), "votes": pd.Series(votes, dtype="Int32").mask(broken)})

    out = df.withColumn("_judged", judged(*(F.col(f"`{f}`").cast("double") for f in features)))
    p = F.col("_judged.proba")
    return out.withColumns({"proba": p, "votes": F.col("_judged.votes"), "pred": by_threshold(p, threshold), "hard": (p > 0.5).cast("int")}).drop("_judged")
