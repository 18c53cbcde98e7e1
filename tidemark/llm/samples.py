"""Bounded, reproducible samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int, most_lines: int | None = None) -> tuple[list[bytes], list[int], dict[int, int]]:
    """Texts and labels of at most `per_class` rows of either label, in a fixed pseudo-random order, and the classes' sizes.

    Rows with crc32(doc_id) mod 3 = 1 are held out and never used. Texts over most_bytes or most_lines aren't sampled; of several rows with one
    doc_id the least text is. Several labels of one document count as one (the greatest).
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")).where("y in (0, 1)")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # at most 2 * per_class rows of two numbers: a bounded broadcast
    lines = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("\n")), F.lit(0)) + 1
    texts = as_bytes(docs, lines.alias("lines")).withColumn("doc_id", F.col("doc_id").cast("long")).where(F.length("body") <= most_bytes)
    texts = (texts if most_lines is None else texts.where(F.col("lines") <= most_lines)).join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("body").alias("body"), F.first("y").alias("y")).select("doc_id", "body", "y").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [bytes(r["body"]) for r in rows], [r["y"] for r in rows], sizes
