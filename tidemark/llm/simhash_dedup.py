"""SimHash near-dedup with BK-trees.

Fingerprints over three-word shingles are counted per value first, so copies cost one row. Two fingerprints that differ in
at most two of 64 bits agree on at least two of four 16-bit quarters, so each value goes, under six keys (a pair of quarters
and their 32 bits), to the shards in which all its partners meet; no link is lost. A shard of more than HOT values is cut
by the same rule once more: of the four bytes that its key leaves open two agree, so six finer keys bring partners
together, and a key that fixes 48 bits has at most 65,536 values: no task holds a group that grows with the corpus. In a
shard every key has a BK-tree: children are keyed by their integer Hamming distance to the parent, and a query follows only
edges within the radius. Of the links in a tree a spanning forest is kept, so a group of n values gives less than n rows.
Components are the fixed point of alternating large-star and small-star rounds, each written to the shared folder. A
shard's trees go to the tasks of that shard only, since trees of all shards would grow with the corpus.

Defined results: texts of any length are hashed whole; a bit set in exactly half the hashes is 0; null and empty texts have fingerprint zero and link like any other; rows with null doc_id have a
component, the smallest known doc_id in it (null if there is none); repeated rows share fingerprint and component; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components

from .common import arrow, as_bytes, session, written

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Values of a shard above which it is cut once more; hot keys up to which they are broadcast.
HOT, BROADCAST_HOT = 1 << 14, 100_000


def fingerprint(body: bytes) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = body.lower().split()  # of bytes: A-Z only
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(text, SEED)]
    else:
        data = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero(data == 32)
        first = [0, *(gaps[: len(gaps) - SHINGLE + 1] + 1).tolist()]
        end = [*gaps[SHINGLE - 1 :].tolist(), len(text)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], SEED) for a, b in zip(first, end)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        part = np.array(hashes[at : at + (1 << 18)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    session(docs)

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(b) for b in batch.column("body").to_pylist()], np.uint64).view(np.int64)
            yield arrow("doc_id long, fp long", doc_id=batch.column("doc_id").to_pylist(), fp=prints)

    return as_bytes(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Integers under Hamming distance; every edge is keyed by the distance of child and parent."""

    def __init__(self, root: int):
        self.value, self.edges = [root], [{}]

    def add(self, x: int) -> None:
        at = 0
        while True:
            d = (self.value[at] ^ x).bit_count()
            after = self.edges[at].get(d)
            if after is None:
                self.edges[at][d] = len(self.value)
                self.value.append(x)
                self.edges.append({})
                return
            at = after

    def within(self, x: int, radius: int) -> list[int]:
        """Numbers of the nodes whose value is within the radius."""
        out, todo = [], [0]
        while todo:
            at = todo.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                out.append(at)
            todo += [n for e, n in self.edges[at].items() if d - radius <= e <= d + radius]
        return out


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (value, smaller value of its group) that join exactly what chains of near values join; values are distinct."""
    mask = (1 << 64) - 1
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    tree = BkTree(values[0] & mask)
    for i in range(1, len(values)):
        for j in tree.within(values[i] & mask, radius):
            a, b = top(i), top(j)
            if a != b:
                up[max(a, b)] = min(a, b)
        tree.add(values[i] & mask)
    return [(values[i], values[t]) for i in range(len(values)) if (t := top(i)) != i]


def _pairs(parts: list, bits: int) -> list:
    """Numbered keys of every pair of parts (columns of `bits` bits): both parts, then the pair's number in the last byte."""
    both = [(i, j) for i in range(4) for j in range(i)]
    return [F.shiftleft(parts[i], bits + 8).bitwiseOR(F.shiftleft(parts[j], 8)).bitwiseOR(F.lit(n)) for n, (i, j) in enumerate(both)]


def _shards(prints: DataFrame, hot: int) -> DataFrame:
    """key, fp: the shards in which values meet, hot ones cut once more by pairs of the bytes that their key leaves open."""
    quarters = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keyed = prints.select("fp", F.explode(F.array(*_pairs(quarters, 16))).alias("key"))
    over = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "simhash-hot")
    n = over.count()
    if not n:
        return keyed
    other = F.broadcast(over) if n <= BROADCAST_HOT else over.hint("merge")
    marked = keyed.join(other.withColumn("hot", F.lit(True)), "key", "left")
    # the two quarters that pair number n = 0..5 leaves open, as four bytes
    rest = [[q for q in range(4) if q not in (i, j)] for i in range(4) for j in range(i)]
    shift = lambda k: F.element_at(F.array(*(F.lit(16 * r[k]) for r in rest)), F.col("key").bitwiseAND(0xFF).cast("int") + 1)
    open_bytes = [F.call_function("shiftrightunsigned", F.col("fp"), shift(k) + low).bitwiseAND(0xFF) for k in range(2) for low in (0, 8)]
    finer = F.transform(F.array(*_pairs(open_bytes, 8)), lambda x: F.shiftleft(x + 1, 40).bitwiseOR(F.col("key")))
    return marked.select("fp", F.explode(F.when(F.col("hot"), finer).otherwise(F.array("key"))).alias("key"))


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links a, b between distinct fingerprints fp, fewer than there are values in each shard."""
    if radius > 2:
        raise ValueError("four quarters find all links of a radius of 2 at most")
    shards = _shards(prints, hot).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        last_key, held = None, []
        for batch in batches:
            keys, values = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "fp"))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != last_key:
                    if len(held) > 1:
                        out += forest(held, radius)
                    last_key, held = keys[a], []
                held = held + values[a:b].tolist() if held else values[a:b].tolist()
            yield arrow("a long, b long", a=[x for x, _ in out], b=[y for _, y in out])
        if len(held) > 1:
            out = forest(held, radius)
            yield arrow("a long, b long", a=[x for x, _ in out], b=[y for _, y in out])

    return shards.mapInArrow(run, "a long, b long")


def _components(prints: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """fp and component_id of each distinct fingerprint of prints (doc_id, fp)."""
    values = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-values")
    roots = components(links(values.select("fp"), radius, hot))
    rooted = values.join(roots, values.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(rooted.join(ids, "root").select("fp", "root", "component_id"), "simhash-components")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fp (signed long) and component_id (the smallest doc_id reachable), a row per input row."""
    prints = written(fingerprints(docs), "simhash")
    return prints.join(_components(prints, radius, hot), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each component one row with all its columns: that with the smallest doc_id, nulls last, the first read of several."""
    session(docs)
    # a row's number must not depend on how files are dealt to tasks, so numbered rows are written once
    numbered = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "simhash-rows")

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(b) for b in batch.column("body").to_pylist()], np.uint64).view(np.int64)
            yield arrow("doc_id long, row long, fp long", doc_id=batch.column("doc_id").to_pylist(), row=batch.column("row").to_pylist(), fp=prints)

    bodies = as_bytes(numbered.select("doc.doc_id", "doc.text", "row"), "row").withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = written(bodies.mapInArrow(run, "doc_id long, row long, fp long"), "simhash")
    of = prints.join(_components(prints, radius).select("fp", "root"), "fp")
    first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("x"))
    keep = written(first.select(F.col("x.row").alias("row")), "simhash-kept")
    # a merge join at every size: a broadcast of the kept rows would grow with the corpus
    return numbered.join(keep.hint("merge"), "row", "left_semi").select("doc.*")


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    r = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
