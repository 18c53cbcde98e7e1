"""Mixing sources to target weights, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at three
times its source's size and the excess is shared again by weight. Documents fall into hashed, so randomly permuted, blocks
per source, with exact word counts. A source's target is a number of whole passes over its blocks, then whole blocks
in order, then whole documents of the next block in the order of a hash, the last of them in part: an exact quota of block
draws.

A multivariate-hypergeometric splitting tree deals these quotas among the output shards: each node gives its left child half of
its draws, every source's part drawn from the hypergeometric law given what earlier sources took (as the largest of
log-probabilities with Gumbel noise from a hash), its right child the rest. A leaf's quota of a source is a range of
that source's draws, from where the leaves before it end; a draw is a pass over a block, so shards take disjoint permuted
blocks, and what a document gives is what the leaves were dealt. Shards order their rows by a hash. All is a function of
the rows and the seed, so reruns agree.

The tree has at least eight leaves and as many as it takes for a leaf to have SHARD_WORDS words at most on average. All blocks
together are sixteen a leaf, 4,096 at least; a source has as many of them as its share of all words asks for, 4,096 at least, but
never more than it has documents with words, so draws and the plan have a few rows a document at most. Sources are dealt in groups of GROUP: a node's draws first
among groups, then within each, so no array grows with the sources but that of the groups' sums. The blocks' table
(source, block, its draws) is broadcast only when it has at most BROADCAST_ROWS rows, else joined by a shuffle, where a
source is spread over its blocks.

Defined results: null text has size 0; a null source is a source; sources without words have target 0; repeated rows (equal
id, source and size) share a block and are each taken as often (the last document, if repeated, in equal parts); texts may
have any length, a document is never split over shards; an empty table gives an empty result; columns of other names are
kept by mixed().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS, LIMIT = (5, 2, 1), 3.0
BLOCKS, SEED = 4096, 20240607
#: Words of a shard on average, at most; the least depth of the tree; sources that a node's array holds.
SHARD_WORDS, LEAST_DEPTH, GROUP = 1 << 22, 3, 256
BROADCAST_SOURCES, BROADCAST_ROWS, MOST_PARTITIONS = 10_000, 200_000, 1 << 16
#: Parts in which rows of one source meet its row where sources are too many to go to every task.
SALTS = 64
#: Blocks whose words are summed together before the block at a source's cut is looked for.
SUPERBLOCK = 1024
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _block(seed: int, blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "source", "size", F.lit(seed)), F.lit(blocks)).cast("int")


def _place(seed: int) -> Column:
    """A document's place within its block; equal only for repeated rows."""
    return F.xxhash64("doc_id", "source", "size", F.lit(seed + 2))


def targets(sized: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """A row per source: number (by code point, null last), source, source_size, texts (documents with words) and target."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("texts")).orderBy(F.col("source").asc_nulls_last())
    # a sorted row's number: its place in its partition and the rows of the partitions before
    totals = written(totals.withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    number = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    rows = totals.withColumn("part", part).join(parts, "part").select(number.alias("number"), "source", "source_size", "texts")
    rows = written(rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))), "mix-weights")
    cap = F.col("source_size") * limit / F.col("weight")
    size, weight = (x or 0 for x in rows.agg(F.sum("source_size"), F.sum("weight")).first())
    level, capped = (size / weight if weight else 0.0), 0
    while True:  # sources above their cap take it and leave; the level of the others only rises, so no source comes back
        n, words, w = rows.where(cap < F.lit(float(level))).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
        if n == capped:
            break
        capped, left = n, weight - w
        level = (size - limit * words) / left if left > 0 else math.inf  # where every source is capped each target is its cap
    return rows.select("number", "source", "source_size", "texts", F.least(F.col("source_size") * limit, F.col("weight") * F.lit(float(level))).alias("target"))


def hypergeometric(total: Column, good: Column, draws: Column, *salt: Column) -> Column:
    """How many of `draws` out of `total` are among the `good`: one draw, a function of the salt.

    Values farther than 12 standard deviations (and 12) from the mean, of probability under 1e-30, are not weighed.
    """
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    high = F.least(good, draws)
    mean = draws.cast("double") * good / F.greatest(total, F.lit(1))
    spread = 12 + 12 * F.sqrt(mean * (1 - good / F.greatest(total, F.lit(1))) * (total - draws) / F.greatest(total - 1, F.lit(1)))
    first, last = F.greatest(low, F.floor(mean - spread).cast("long")), F.least(high, F.ceil(mean + spread).cast("long"))

    def gumbel(k):
        u = (F.pmod(F.xxhash64(*salt, k), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return -F.log(-F.log(u))

    def step(a, k):
        value = a["weight"] + gumbel(k)
        ratio = (good - k).cast("double") * (draws - k) / ((k + 1).cast("double") * (total - good - draws + k + 1))
        after = a["weight"] + F.coalesce(F.log(ratio), F.lit(0.0))
        return F.struct(after.alias("weight"), F.greatest(a["best"], value).alias("best"), F.when(value > a["best"], k).otherwise(a["k"]).alias("k"))

    zero = F.struct(F.lit(0.0).alias("weight"), F.lit(float("-inf")).alias("best"), low.alias("k"))
    return F.when(low >= high, low).otherwise(F.aggregate(F.sequence(first, last), zero, step, lambda a: a["k"]))


def _dealt(items: Column, draws: Column, *salt: Column) -> Column:
    """Of the quotas `items` (an array), how many of each are among `draws` draws out of all."""
    total = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)
    numbered = F.transform(items, lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("q")))
    start = F.struct(total.alias("total"), draws.alias("draws"), F.array().cast("array<bigint>").alias("left"))

    def deal(a, x):
        got = hypergeometric(a["total"], x["q"], a["draws"], *salt, x["i"])
        # `got` is bound as the element of a one-element array, so it is evaluated once
        after = lambda g: F.struct((a["total"] - x["q"]).alias("total"), (a["draws"] - g).alias("draws"), F.concat(a["left"], F.array(g)).alias("left"))
        return F.element_at(F.transform(F.array(got), after), 1)

    return F.aggregate(numbered, start, deal, lambda a: a["left"])


def split(quotas: DataFrame, depth: int, seed: int, groups: int = 1) -> DataFrame:
    """Quotas (rows `group`, array `quota` by source) dealt to 2^depth shards: rows (node, group, quota, start).

    start: of each source, the draws that nodes before this one have.
    """
    total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)
    now = quotas.select(F.lit(0).cast("long").alias("node"), F.col("group").cast("long").alias("group"), "quota", F.transform("quota", lambda x: F.lit(0).cast("long")).alias("start"))
    for level in range(depth):
        if groups == 1:
            now = now.withColumn("draws", F.floor(total / 2).cast("long"))
        else:
            sums = now.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("group", total.alias("n")))).alias("s"))
            every = F.transform("s", lambda x: x["n"])
            half = F.floor(F.aggregate(every, F.lit(0).cast("long"), lambda a, x: a + x) / 2).cast("long")
            given = sums.withColumn("g", _dealt(every, half, F.lit(seed), F.lit(level), F.col("node"), F.lit(-1).cast("long")))
            given = given.select("node", F.explode(F.arrays_zip(F.transform("s", lambda x: x["group"]).alias("group"), F.col("g").alias("draws"))).alias("x"))
            now = now.join(given.select("node", F.col("x.group").alias("group"), F.col("x.draws").alias("draws")), ["node", "group"])
        now = now.withColumn("left", _dealt(F.col("quota"), F.col("draws"), F.lit(seed), F.lit(level), F.col("node"), F.col("group")))
        right = F.zip_with("quota", "left", lambda q, g: q - g)
        ahead = F.zip_with("start", "left", lambda s, g: s + g)
        child = lambda bit, q, s: F.struct((F.col("node") * 2 + bit).alias("node"), "group", q.alias("quota"), s.alias("start"))
        now = now.select(F.explode(F.array(child(0, F.col("left"), F.col("start")), child(1, right, ahead))).alias("x")).select("x.*")
        if level % 6 == 5 or groups > 1:  # nodes double with every level: they are spread again, and the plan is cut
            now = written(now.repartition("node"), "mix-nodes")
    return now


def _crossing(rows: DataFrame, by: str) -> DataFrame:
    """Where, in the order of `by`, the words of a source (rows: number, by, words, left) come to more than `left`: number, by, left there."""
    order = Window.partitionBy("number").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    return running.where("left > 0 and before <= left and before + words > left").drop("words").withColumn("left", F.col("left") - F.col("before")).drop("before")


def _by_source(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with their source's number and blocks; a source's rows never meet in one task.

    Up to BROADCAST_SOURCES sources go to every task; more are joined on source and one of SALTS parts.
    """
    if names.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    parts = names.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return salted.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("_salt") == F.col("_part"))).drop("of", "_part", "_salt")


def mix_plan(sized: DataFrame, weights=WEIGHTS, limit: float = LIMIT, blocks: int = BLOCKS, seed: int = SEED, shard_words: int = SHARD_WORDS, group: int = GROUP) -> tuple[DataFrame, DataFrame, int]:
    """A row per source and block, the sources (number, of, blocks), and the depth of the tree.

    source_size, target, draws (of the block: pass and shard), and for the block at a source's cut, whose last draw is
    partial: edge and part (documents placed before the edge are taken, of that at the edge `part` words).
    """
    goal = targets(sized, weights, limit).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = written(goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))), "mix-targets")
    words, sources = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("number") + 1, F.lit(0))).first()
    depth = max(LEAST_DEPTH, math.ceil(math.log2(max(1.0, words / shard_words))))
    share = F.ceil(F.col("source_size") * F.lit(max(blocks, 16 << depth) / max(1, words)))
    goal = goal.withColumn("blocks", F.greatest(F.lit(1), F.least("texts", F.greatest(F.lit(blocks), share))).cast("long")).drop("texts")
    names = goal.select("number", F.col("source").alias("of"), "blocks")
    named = _by_source(sized, names).withColumn("block", _block(seed, F.col("blocks"))).drop("blocks")
    per_block = written(named.groupBy("number", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    big = F.expr(f"block div {SUPERBLOCK}").alias("big")
    coarse = _crossing(per_block.groupBy("number", big).agg(F.sum("words").alias("words")).join(goal.select("number", F.col("rest").alias("left")), "number"), "big")
    cut = written(_crossing(per_block.withColumn("big", big).join(coarse, ["number", "big"]).drop("big"), "block"), "mix-cuts")
    # only rows of the cut blocks, a row per place, are put in order
    inside = named.join(F.broadcast(cut) if sources <= BROADCAST_SOURCES else cut, ["number", "block"])
    inside = inside.groupBy("number", _place(seed).alias("edge")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"), F.floor(F.first("left")).alias("left"))
    inside = _crossing(inside, "edge").select("number", "edge", F.expr("left div copies").alias("part"))
    cut = cut.select("number", F.col("block").alias("cut")).join(inside, "number", "left")
    # no block was cut: the rest is nothing, or all words by a rounding error
    plan = goal.join(cut, "number", "left").withColumn("cut", F.coalesce("cut", F.when(F.col("rest") > 0, F.col("blocks")).otherwise(F.lit(0))))
    plan = written(plan.withColumn("quota", (F.col("passes") * F.col("blocks") + F.col("cut") + F.when(F.col("edge").isNotNull(), 1).otherwise(0)).cast("long")), "mix-quotas")
    quotas = plan.groupBy(F.expr(f"number div {group}").alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "quota"))), lambda x: x["quota"]).alias("quota"))
    leaves = split(quotas, depth, seed, -(-sources // group) or 1)
    of = leaves.select("node", "group", F.posexplode(F.arrays_zip("quota", "start")).alias("i", "x")).select((F.col("group") * group + F.col("i")).alias("number"), F.col("node").alias("shard"), "x.quota", "x.start").where("quota > 0")
    draws = of.join(names.select("number", "blocks"), "number").select("number", "shard", "blocks", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("draw"))
    draws = draws.groupBy("number", F.pmod("draw", "blocks").cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.expr("draw div blocks").alias("pass"), "shard"))).alias("draws"))
    none = F.array().cast("array<struct<pass:bigint,shard:bigint>>")
    table = per_block.select("number", "block").join(draws, ["number", "block"], "left").join(plan, "number")
    edge = F.col("block") == F.col("cut")
    table = table.select("number", "source", "block", "source_size", "target", F.coalesce("draws", none).alias("draws"), F.when(edge, F.col("edge")).alias("edge"), F.when(edge, F.col("part")).alias("part"))
    return written(table, "mix-plan"), names, depth


def _with_plan(sized: DataFrame, plan: DataFrame, names: DataFrame, seed: int) -> DataFrame:
    """Rows with their block's columns; draws: those that take a word of the row; extra: words that a partial draw takes."""
    plan = plan.drop("source")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    rows = _by_source(sized, names).withColumn("block", _block(seed, F.col("blocks"))).drop("blocks")
    rows = rows.join(plan, ["number", "block"])
    place = _place(seed)
    extra = F.when(place < F.col("edge"), F.col("size")).when(place == F.col("edge"), F.least("size", "part")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("whole", F.size("draws") - F.when(F.col("edge").isNotNull(), 1).otherwise(0)).withColumn("extra", F.when(F.col("edge").isNotNull(), extra).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("draws", F.slice("draws", F.lit(1), F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)))


def taken(docs: DataFrame, blocks: int = BLOCKS, seed: int = SEED, shard_words: int = SHARD_WORDS, group: int = GROUP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and the shard of each draw."""
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size")), "mix-sizes")
    plan, names, _ = mix_plan(sized, blocks=blocks, seed=seed, shard_words=shard_words, group=group)
    rows = _with_plan(sized, plan, names, seed)
    shards = F.transform("draws", lambda x: x["shard"])
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), shards.alias("shards"))


def mixed(docs: DataFrame, blocks: int = BLOCKS, seed: int = SEED, shard_words: int = SHARD_WORDS, group: int = GROUP) -> DataFrame:
    """The mix itself: the columns of docs, a row per draw, shards together and in random order.

    The document at a source's cut, one at most (and its repeats), gives its first words, joined by one space (n_chars
    follows). Documents without a word are taken with the whole draws of their block.
    """
    columns = docs.columns
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"),
    )
    plan, names, depth = mix_plan(written(rows.select("doc_id", "source", "size"), "mix-sizes"), blocks=blocks, seed=seed, shard_words=shard_words, group=group)
    rows = _with_plan(rows, plan, names, seed).select("_doc", "size", "whole", "extra", F.posexplode("draws").alias("_nth", "_draw"))
    part = (F.col("_nth") >= F.col("whole")) & (F.col("extra") < F.col("size"))
    words = F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int"))
    rows = rows.withColumn("_text", F.when(part, F.array_join(words, " ")).otherwise(F.col("_doc.text"))).withColumn("_shard", F.col("_draw.shard"))
    rows = rows.withColumn("_order", F.xxhash64("_doc.doc_id", "_draw.pass", F.lit(seed + 1)))
    # a partition per shard, so it holds about SHARD_WORDS words at most; beyond MOST_PARTITIONS neighbours share one
    together = max(0, depth - MOST_PARTITIONS.bit_length() + 1)
    rows = rows.repartitionById(1 << (depth - together), F.shiftright("_shard", together).cast("int")).sortWithinPartitions("_shard", "_order")
    replaced = {"text": F.col("_text")} | ({"n_chars": F.when(part, F.char_length("_text")).otherwise(F.col("_doc.n_chars"))} if "n_chars" in columns else {})
    return rows.select(*(replaced.get(c, F.col("_doc").getField(c)).alias(c) for c in columns))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
