"""Splits, samples, classification metrics and the random-forest pixel classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["vv_norm", "vh_norm", "diff_norm", "vv_std_norm"]


def scene_split(manifest: DataFrame) -> DataFrame:
    """valid scenes of oil_spill and look_alike with their split by position in the manifest; other classes are unused.

    Only the first eight ordinals (which are distinct) of a class decide: they alone are ranked, every other scene is compared with them.
    """
    valid = manifest.where((F.lower("valid") == "true") & F.col("class").isin("oil_spill", "look_alike"))
    n = F.row_number().over(Window.partitionBy("class").orderBy("ordinal"))
    first = valid.select("class", "ordinal", n.alias("n")).where(F.col("n") <= 8).groupBy("class").agg(F.array_sort(F.collect_list("ordinal")).alias("_o"))
    df = valid.join(F.broadcast(first), "class")  # two rows
    until = lambda k: F.col("ordinal") <= F.element_at("_o", F.least(F.lit(k), F.size("_o")))
    oil = F.when(until(6), "train").when(until(8), "validation").otherwise("test")
    return df.withColumn("split", F.when(F.col("class") == "oil_spill", oil).otherwise(F.when(until(1), "train").otherwise("test"))).select(*manifest.columns, "split")


def split_quality(df: DataFrame, by: list[str], value: str, label: str) -> DataFrame:
    """Rows, positives and their share, range and broken values per group."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("any_nan"), F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("any_inf"), (F.avg(F.col(label)) * 100).alias("pos_pct"),
    )


#: Ranges that a count over keys is taken in, and keys that are ranked on the driver once one range holds no more.
RANGES, RANKED = 1 << 14, 1 << 14


def _cut(df: DataFrame, key: Column, n: int) -> tuple[int, int, int]:
    """The key that the n-th row in order has, the number of rows with lesser keys, and of rows with that key. 0 < n <= rows; keys are long.

    Keys are counted in ranges, and the range where the n-th row lies is cut again until it holds few keys or one: a pass
    over the keys each time, whose result is at most RANGES rows.
    """
    keys = df.select(key.cast("long").alias("k"))
    ends = keys.agg(F.min("k").alias("a"), F.max("k").alias("b")).first()
    below, shift, prefix = 0, max(0, (ends["b"] - ends["a"]).bit_length() - (RANGES.bit_length() - 1)), None
    while True:
        part = keys if prefix is None else keys.where(F.shiftright("k", prefix[0]) == prefix[1])
        ranges = sorted(part.groupBy(F.shiftright("k", shift).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["r"])
        for r in ranges:
            if below + r["n"] >= n:
                break
            below += r["n"]
        if shift == 0:
            return r["r"], below, r["n"]
        prefix = (shift, r["r"])
        if r["n"] <= RANKED:
            few = keys.where(F.shiftright("k", shift) == r["r"]).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
            for x in sorted(few, key=lambda x: x["k"]):
                if below + x["n"] >= n:
                    return x["k"], below, x["n"]
                below += x["n"]
        shift = max(0, shift - (RANGES.bit_length() - 1))


def first_rows(df: DataFrame, keys: list[Column], n: int, rows: int | None = None) -> DataFrame:
    """Exactly the n rows (all, if fewer) that come first by keys, columns of whole numbers, nulls first; a filter of df, in its partitions.

    The cutting key is found by counts of ranges; the next key decides among rows that tie with it. Rows that tie in all keys are
    alike in the order: of those any are taken, so many as are wanted. df is read several times: give it written.
    """
    n = min(n, df.count() if rows is None else rows)
    if n <= 0:
        return df.limit(0)
    taken, tied = F.lit(False), F.lit(True)
    part, rest = df, n
    for i, key in enumerate(keys):
        key = F.coalesce(key.cast("long"), F.lit(-(1 << 63)))
        value, below, same = _cut(part, key, rest)
        taken = taken | (tied & (key < value))
        tied = tied & (key == value)
        rest -= below
        if rest == same:
            return df.where(taken | tied)
        part = df.where(tied)
    return df.where(taken).unionByName(part.limit(rest))


def stratified_sample(df: DataFrame, label: str, keys: list[Column], positives: int = 100_000, least_negatives: int = 200_000) -> DataFrame:
    """min(n1, positives) rows of label 1 and min(n0, max(3 times those, least_negatives)) of label 0, exactly, the first in the keys' order.

    Classes are cut by thresholds (first_rows), so rows stay where they are and no class meets in one task. df is read several
    times: give it written.
    """
    sizes = {r["y"]: r["n"] for r in df.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    taken = min(n1, positives)
    some = lambda y, n, rows: first_rows(df.where(F.col(label) == y), keys, n, rows)
    return some(1, taken, n1).unionByName(some(0, max(3 * taken, least_negatives), n0))


def confusion(df: DataFrame) -> DataFrame:
    """y, pred and n for all four cells."""
    counts = df.agg(*(F.count_if((F.col("y") == y) & (F.col("pred") == p)).alias(f"n{y}{p}") for y in (0, 1) for p in (0, 1)))
    cell = lambda y, p: F.struct(F.lit(y).alias("y"), F.lit(p).alias("pred"), F.col(f"n{y}{p}").alias("n"))
    return counts.select(F.inline(F.array(*(cell(y, p) for y in (0, 1) for p in (0, 1)))))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, f1, iou and accuracy of class 1; a division by zero counts 0."""
    c = df.agg(*(F.count_if((F.col("y") == y) & (F.col("pred") == p)).alias(n) for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tn", "fp", "fn", "tp", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp + fn).alias("iou"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def report(df: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class, with macro and support-weighted means."""
    c = df.agg(*(F.count_if((F.col("y") == y) & (F.col("pred") == p)).alias(f"n{y}{p}") for y in (0, 1) for p in (0, 1)))
    hit = lambda k: F.col(f"n{k}{k}")
    said = lambda k: F.col(f"n0{k}") + F.col(f"n1{k}")
    true = lambda k: F.col(f"n{k}0") + F.col(f"n{k}1")
    row = lambda k: F.struct(F.lit(str(k)).alias("label"), _ratio(hit(k), said(k)).alias("precision"), _ratio(hit(k), true(k)).alias("recall"), _ratio(2 * hit(k), said(k) + true(k)).alias("f1"), true(k).cast("long").alias("support"))
    wide = c.select(row(0).alias("a"), row(1).alias("b"))
    total = F.col("a.support") + F.col("b.support")
    names = ("precision", "recall", "f1")
    macro = F.struct(F.lit("macro avg").alias("label"), *(((F.col(f"a.{n}") + F.col(f"b.{n}")) / 2).alias(n) for n in names), total.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("label"), *(_ratio(F.col(f"a.{n}") * F.col("a.support") + F.col(f"b.{n}") * F.col("b.support"), total).alias(n) for n in names), total.alias("support"))
    return wide.select(F.inline(F.array(F.col("a"), F.col("b"), macro, weighted)))


def label_values(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The distinct labels of each group in order, as an array; labels are classes, so there are few."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(label)).alias("values"))


def report_text(found: DataFrame, head: str) -> DataFrame:
    """A text report (one row, `value`) of the rows of metrics(): the head's lines, scores to four places, the confusion matrix."""
    four = lambda c: F.format_string("%.4f", c)
    lines = [F.lit(head), *(F.concat(F.lit(f"  - {name}: "), four(c)) for name, c in (("Precision", "precision"), ("Recall", "recall"), ("F1-Score", "f1"), ("IoU", "iou"), ("Accuracy", "accuracy")))]
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    counts = [F.concat(F.lit("Pixels: "), n), F.concat(F.lit("Positive: "), F.col("fn") + F.col("tp")), F.concat(F.lit("Predicted positive: "), F.col("fp") + F.col("tp"))]
    cells = [F.concat(F.lit("[["), F.col("tn"), F.lit(" "), F.col("fp"), F.lit("] ["), F.col("fn"), F.lit(" "), F.col("tp"), F.lit("]]"))]
    return found.select(F.concat_ws("\n", *lines, *counts, *cells).alias("value"))


def report_lines(rows: DataFrame, head: list[str]) -> DataFrame:
    """A whole report of rows (y, pred) as lines in order (line, value): the head's, numbers of pixels with shares, scores, the confusion matrix and the classes' rows."""
    four = lambda c: F.format_string("%.4f", c)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    share = lambda c: F.format_string("%d (%.2f%%)", c, _ratio(c, n) * 100)
    scores = [F.concat(F.lit(f"  - {t}: "), four(F.col(c))) for t, c in (("Precision", "precision"), ("Recall", "recall"), ("F1-Score", "f1"), ("IoU", "iou"), ("Accuracy", "accuracy"))]
    matrix = [F.format_string("[[%d %d]", "tn", "fp"), F.format_string(" [%d %d]]", "fn", "tp")]
    values = [*map(F.lit, head), F.concat(F.lit("Pixels evaluated: "), n), F.concat(F.lit("Positive in truth: "), share(F.col("fn") + F.col("tp"))), F.concat(F.lit("Predicted positive: "), share(F.col("fp") + F.col("tp")))]
    values += [F.lit("Metrics of the positive class:"), *scores, F.lit("Confusion matrix (TN, FP / FN, TP):"), *matrix, F.lit("Classes (precision, recall, f1, support):")]
    text = metrics(rows).select(F.posexplode(F.array(*values)).alias("line", "value"))
    order = F.element_at(F.create_map(*(x for i, k in enumerate(("0", "1", "macro avg", "weighted avg")) for x in (F.lit(k), F.lit(len(values) + i)))), F.col("label"))
    return text.unionByName(class_text(report(rows)).select(order.alias("line"), "value"))


def training_head(model: str, features: list[str], positives: int, negatives: int, made: str) -> list[str]:
    """The head's lines of a training report."""
    return ["Pixel classifier training report", f"Generated: {made}", f"Model: {model}", f"Features: {len(features)} channels ({', '.join(features)})", f"Training samples: {positives + negatives} pixels (positive: {positives}, other: {negatives})", "Validation:"]


def class_text(rows: DataFrame) -> DataFrame:
    """Text lines (label, value) of the rows of report()."""
    return rows.select("label", F.format_string("%12s %.4f %.4f %.4f %d", "label", "precision", "recall", "f1", "support").alias("value"))


def train_forest(df: DataFrame, label: str = "y", trees: int = 100, depth: int = 15, seed: int = 42):
    """A random forest of Spark ML with class weights balanced over all rows, for samples of any size; forest.py balances each bootstrap."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    weight = F.coalesce(*(F.when(F.col(label) == k, F.lit(total / (len(n) * v))) for k, v in n.items()))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df.withColumn("weight", weight))
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(rows)


def by_threshold(proba: Column, threshold: float) -> Column:
    """1 where the probability reaches the threshold."""
    return (proba >= threshold).cast("int")


def score_forest(model, df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """proba (of class 1), pred by the threshold (reached counts) and hard (by 0.5). model: a Spark ML model, or a forest's nodes (forest.py)."""
    if isinstance(model, DataFrame):
        from .forest import score_balanced_forest

        return score_balanced_forest(model, df, threshold).drop("votes")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df))
    p = vector_to_array("probability")[1]
    return out.withColumns({"proba": p, "pred": by_threshold(p, threshold), "hard": F.col("prediction").cast("int")}).drop("features", "rawPrediction", "probability", "prediction")
