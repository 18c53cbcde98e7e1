"""Quality rules whose cutoffs are risk-controlled: they may reject few good documents, with stated confidence.

Fixed base rules come first. Each learned rule rejects a document whose measure is above a cutoff, and a document that any
rule rejects is rejected, so it is the verdict of all rules together that is tested on labelled holdout rows, per stratum
(language): it may be used if the exact binomial test rejects "more than `risk` of the good documents of this stratum would
be rejected" at level `delta` / strata. The verdicts are a path: from the mildest cutoff on, each rule in turn takes the
cutoff if more bad documents are rejected then. Good documents have no say in the path, so testing along it until the first
verdict that fails needs no further correction; the last one before is used. A stratum with too few labelled good documents
for any certificate keeps what the base rules keep.

All labelled rows are counted by stratum and the places of their measures among the cutoffs; a stratum has at most
(cutoffs + 1)^rules of these, however many rows it has. Cutoffs join back as a small table.
Rows with crc32(doc_id) mod 3 = 1 are never used as labels.

Defined results: texts of any length are measured whole; a measure equal to a cutoff passes; of verdicts that reject as many
bad documents the mildest holds; null text has no words and fails the base rules, as do texts under 50 words; null lang is a stratum of
its own; several labels of one document count as one (the greatest); repeated rows are judged alike; an empty table gives
an empty result; without labels only the base rules hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, held_out, session, written

RISK, DELTA = 0.01, 0.1
#: Measures (each a share of words, lines or letters) and the cutoffs to be tested, from the mildest on.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
}
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)
_MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bangs long"
_UPPER = bytes(range(65, 91))


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of `size` words that are found twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        at = first.setdefault(w, i)
        if at != i:
            covered[at : at + size] = covered[i : i + size] = b"\1" * size
    return sum(covered)


def measure(body: bytes) -> tuple[int, ...]:
    """The measures of a text, in the order of _MEASURES."""
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    glued = b"".join(words)
    return (
        len(words), len(glued.decode("utf-8", "replace")), len(body) - len(body.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), len(body) - len(body.translate(None, _UPPER)), body.count(b"!"),
    )


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the measures of every whole text."""
    session(docs)
    names = [x.split()[0] for x in _MEASURES.split(", ")]

    def run(batches):
        for batch in batches:
            rows = list(zip(*map(measure, batch.column("body").to_pylist()))) or [()] * (len(names) - 2)
            yield arrow(_MEASURES, doc_id=batch.column("doc_id").to_pylist(), lang=batch.column("lang").to_pylist(), **dict(zip(names[2:], map(list, rows))))

    lang = F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return as_bytes(docs, lang).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _MEASURES)


def too_many(k: int, n: int, risk: float, level: float) -> bool:
    """Whether k rejected of n good documents fail to show, at `level`, a rejection rate of at most `risk`: P(Bin(n, risk) <= k) > level."""
    total = 0.0
    for i in range(k + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk))
        if total > level:
            return True
    return n == 0


def certified(good: int, good_out: list[int], bad_out: list[int], risk: float, level: float, steps=CUTOFFS):
    """Of the steps, which reject ever more, the one to use in one stratum, or None; lists by steps."""
    best, gain = None, 0
    for cutoff, g, b in zip(steps, good_out, bad_out):
        if g > good or too_many(g, good, risk, level):
            break
        if b > gain:
            best, gain = cutoff, b
    return best


def path(places: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[list[tuple], list[int], list[int]]:
    """Verdicts from the mildest on (a cutoff or None per rule), and how many good and bad documents each rejects.

    A row of `places` has per rule the number of cutoffs that are not exceeded.
    """
    steps, good_out, bad_out = [], [], []
    now: list[float | None] = [None] * places.shape[1]
    out = np.zeros(len(places), bool)
    for i, cutoff in enumerate(CUTOFFS):
        for r in range(places.shape[1]):
            after = out | (places[:, r] <= i)
            if bad[after].sum() > bad[out].sum():
                out, now[r] = after, cutoff
                steps.append(tuple(now))
                good_out.append(int(good[out].sum()))
                bad_out.append(int(bad[out].sum()))
    return steps, good_out, bad_out


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row per stratum: lang and each rule's cutoff (null: the rule is not certified there)."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality")).where("quality is not null")
    base = measured.where(~_failed())
    places = F.array(*(sum(F.expr(f"int({m} <= {c}D)") for c in CUTOFFS) for m in RULES.values()))
    counts = base.join(known, "doc_id").groupBy("lang", places.alias("places")).agg(*(F.count_if(F.col("quality") == q).alias(n) for q, n in ((1, "good"), (0, "bad"))))
    table = written(counts.groupBy("lang").agg(F.collect_list(F.struct("places", "good", "bad")).alias("counts")), "rule-counts")
    level = delta / max(1, table.count())
    names = list(RULES)

    def pick(counts):
        where, good, bad = (np.array([x[k] for x in counts]) for k in ("places", "good", "bad"))
        steps, *out = path(where, good, bad)
        return certified(int(good.sum()), *out, risk, level, steps) or (None,) * len(names)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            picked = [pick(x["counts"]) for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x["lang"] for x in rows], pa.string()), *(pa.array([p[i] for p in picked], pa.float64()) for i in range(len(names)))], names=["lang", *names])

    return table.mapInArrow(run, "lang string, " + ", ".join(f"{r} double" for r in names))


def _failed():
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the measures, base_failed, failed_rules (names) and kept."""
    measured = written(measures(docs), "rule-measures")
    cut = written(cutoffs(measured, labels, risk, delta), "rule-cutoffs").select(F.col("lang").alias("stratum"), *(F.col(r).alias(f"cut_{r}") for r in RULES))
    both = measured.join(cut, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    failed = F.array_compact(F.array(*(F.when(F.expr(f"{m} > cut_{r}"), F.lit(r)) for r, m in RULES.items())))
    out = both.withColumn("base_failed", _failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("stratum", *(f"cut_{r}" for r in RULES))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    r = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
