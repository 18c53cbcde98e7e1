"""Ranked lexical search: postings traversed in fixed doc_id windows, scattered into small arrays, harvested into heaps.

Documents become packed postings of the queries' terms (one row a document), dealt to tasks by doc_id window and written. A task goes
through its windows in doc_id order: the window's postings are grouped by term, every item's contributions are added into an array of
a slot a document, a bitset marks the slots that were met, and only those are read for the item's heap of the best k. Tasks
give k rows an item; the last ranking is among those.

Odd rows: a null text has no term; a document without a term is in no count and no result. Documents that repeat, ids included, are
documents each; a null doc_id comes after all ids among equal scores. Rows that share an item_id (null too) are one item of all
their terms; items without a term have no result. Texts of any length are read whole. Empty tables give no rows; columns other
than doc_id, text and item_id are left behind.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, as_bytes, session, written

K = 10
#: Documents of a window (a slot each) and postings that are scattered at a time.
WINDOW = 4096
POSTINGS = 1 << 20
#: Bytes of query texts whose terms go to every task; more queries are read in blocks, each against all documents.
QUERY_BYTES = 16 << 20
#: Parts that an item's candidates are ranked in before they are ranked together.
PARTS = 64

#: Letters and digits of ASCII and every byte of other characters belong to terms; all else divides them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(body: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return body.translate(_FOLD).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (of the vocabulary), for documents with a term."""
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"

    def run(batches):
        for batch in batches:
            ids, sizes, found, counts = [], [], [], []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                words = terms(body)
                if words:
                    met = Counter(map(vocabulary.get, words))
                    met.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    found.append(list(met.keys()))
                    counts.append(list(met.values()))
            yield arrow(schema, doc_id=ids, n=sizes, terms=found, tfs=counts)

    return as_bytes(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)


class _Heaps:
    """The best k (score, doc_id) of every item; equal scores go by ascending doc_id, a null one last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]

    def least(self, item: int) -> int:
        heap = self.heaps[item]
        return heap[0][0] if len(heap) == self.k else 1

    def push(self, item: int, score: int, doc_id: int | None) -> None:
        heap, entry = self.heaps[item], (score, doc_id is not None, -(doc_id or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)


def _scatter(ids: list, n: np.ndarray, of: np.ndarray, slots: np.ndarray, tfs: np.ndarray, weights: np.ndarray, queries: list, total: tuple[int, int], heaps: _Heaps) -> None:
    """One window: ids (in order) and n by slot, postings (term, slot, tf); queries: term ids and their repeats of every item."""
    documents, length = total
    m = 25 + (75 * documents * n) // length
    gain = weights[of] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[slots]))
    order = np.argsort(of, kind="stable")
    of, slots, gain = of[order], slots[order], gain[order]
    here, first = np.unique(of, return_index=True)
    ends = np.append(first[1:], len(of))
    words, bits = slots >> 6, np.uint64(1) << (slots & 63).astype(np.uint64)
    score = np.zeros(len(ids), np.int64)
    occupied = np.zeros(-(-len(ids) // 64), np.uint64)
    for item, (wanted, repeats) in enumerate(queries):
        at = np.searchsorted(here, wanted)
        at[at == len(here)] = 0
        met = np.flatnonzero(here[at] == wanted)
        if not len(met):
            continue
        for j in met:
            part = slice(first[at[j]], ends[at[j]])
            score[slots[part]] += repeats[j] * gain[part]  # a slot is met once by a term
            np.bitwise_or.at(occupied, words[part], bits[part])
        touched = np.flatnonzero(np.unpackbits(occupied.view(np.uint8), bitorder="little"))
        reached = score[touched]
        good = touched[reached >= heaps.least(item)]
        if len(good) > heaps.k:
            good = good[np.argsort(-score[good], kind="stable")[: heaps.k]]
        for slot in good.tolist():
            heaps.push(item, int(score[slot]), ids[slot])
        score[touched] = 0
        occupied[:] = 0


def _ranked(index: DataFrame, weights: np.ndarray, queries: list, item_ids: list, total: tuple[int, int], k: int, window: int) -> DataFrame:
    """item_id, doc_id and score of every task's best k of every item."""
    schema = "item_id long, doc_id long, score long"

    def run(batches):
        heaps = _Heaps(len(queries), k)
        ids, sizes, found, counts, met, now = [], [], [], [], 0, None

        def harvest():
            if met:
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                join = lambda x: np.concatenate([np.asarray(a, np.int64) for a in x])
                _scatter(ids, np.array(sizes, np.int64), join(found), np.repeat(np.arange(len(ids)), lengths), join(counts), weights, queries, total, heaps)

        for batch in batches:
            for doc_id, n, term, tf in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs"))):
                of = None if doc_id is None else doc_id // window
                if ids and (of != now or len(ids) == window or met > POSTINGS):
                    harvest()
                    ids, sizes, found, counts, met = [], [], [], [], 0
                now = of
                ids.append(doc_id)
                sizes.append(n)
                found.append(term)
                counts.append(tf)
                met += len(term)
        harvest()
        best = [(item_ids[i], -d if known else None, s) for i, heap in enumerate(heaps.heaps) for s, known, d in heap]
        yield arrow(schema, item_id=[x[0] for x in best], doc_id=[x[1] for x in best], score=[x[2] for x in best])

    return index.sortWithinPartitions(F.col("doc_id").asc_nulls_last()).mapInArrow(run, schema)


def _block(docs: DataFrame, items: list, k: int, window: int) -> DataFrame | None:
    """The ranking of some items (item_id, text), whose terms every task gets."""
    wanted: dict = {}
    for r in items:
        wanted.setdefault(r["item_id"], Counter()).update(terms(bytes(r["text"])))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
    if not vocabulary:
        return None
    rows = postings(docs, vocabulary).withColumn("window", F.floor(F.col("doc_id") / window))
    index = written(rows.hint("rebalance", "window").drop("window"), "lexical-postings")
    count = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not count["n"]:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    # a row per term of the block's queries at most
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * count["n"] + 2) / (2 * r["df"] + 1)))
    ids = list(wanted)
    queries = []
    for i in ids:
        of = sorted((vocabulary[t], c) for t, c in wanted[i].items())
        queries.append((np.array([t for t, _ in of], np.int64), np.array([c for _, c in of], np.int64)))
    return _ranked(index, weights, queries, ids, (count["n"], count["l"]), k, window)


def search(docs: DataFrame, items: DataFrame, k: int = K, window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of every item's k best documents with a score above 0."""
    spark = session(docs)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / query_bytes))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # query_bytes by expectation
        best = _block(docs, part, k, window)
        if best is not None:
            found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    parted = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    some = parted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(documents, benchmark).withColumn("item_id", F.col("item_id").cast(benchmark.schema["item_id"].dataType))


OP11_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
  c AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM d WHERE len(ts) > 0),
  p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
  q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, r, doc_id)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
