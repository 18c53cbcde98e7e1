"""Suffix-array dedup: a collection's Burrows-Wheeler transform built column by column, with common prefixes.

Each byte covered by a 400-byte string that also starts anywhere else (the same document included) goes. Candidate chunks
(see repeats.py) meet in shards of bounded size; in a shard every distinct chunk is a document of the collection, twice if
it has copies (further copies are the same text and get the same verdict). From the documents' ends on, every round inserts
one byte of each document, to the left, sorts the new suffixes by this letter and by the order of the suffixes they
lengthen, and updates the lengths that neighbours share. The order and the common prefixes lie in two pairs of files, in the
folder that driver and executors share, of which a round reads one and writes the other from front to end. A window is
repeated if its suffix shares 400 bytes with a neighbour; nothing else decides.

The transform is kept by column (its positional form): documents are aligned at their anchors, equal windows have their
anchor at the same place, and so a suffix need only be compared with suffixes of its own round; earlier rounds' rows are
given up. A document leaves once none of its windows can still be repeated: a letter adds at most one to what it shares.

Defined results: null text is empty; empty texts and texts under 400 bytes lose nothing; all copies of a repeated string
go, in rows that share a doc_id (or have none) too; very long texts are cut into chunks like any other; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import io
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import scratch_dir

from .repeats import MOST_CHUNKS, Chunk, Units, removed

WINDOW, GRAM = 400, 200
#: Bytes of distinct candidate text in a shard, about.
SHARD_BYTES = 1 << 19


class Columns:
    """Order (documents) and common prefixes of the newest suffixes, in files that are read and written from front to end.

    folder: where they lie; None (a store that only Spark reads): in memory, a few bytes per chunk of a bounded shard.
    """

    def __init__(self, folder: str | None):
        self.names = [os.path.join(folder, f"{uuid.uuid4().hex}-{k}") for k in range(2)] if folder else []
        self.files = [open(n, "w+b", buffering=0) for n in self.names] or [io.BytesIO(), io.BytesIO()]  # noqa: SIM115
        self.rows = 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for f in self.files:
            f.close()
        for n in self.names:
            os.unlink(n)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        f = self.files[0]
        f.seek(0)
        return np.frombuffer(f.read(4 * self.rows), "<i4"), np.frombuffer(f.read(2 * self.rows), "<u2")

    def write(self, order: np.ndarray, common: np.ndarray) -> None:
        """The next column; the one read before is given up."""
        self.files.reverse()
        f = self.files[0]
        f.seek(0)
        f.write(order.astype("<i4").tobytes())
        f.write(common.astype("<u2").tobytes())
        self.rows = len(order)


def without(order: np.ndarray, common: np.ndarray, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column less some suffixes: what two suffixes share is the least of what lay between them."""
    at = np.flatnonzero(stays)
    if not len(at):
        return order[:0], common[:0]
    least = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
    least[0] = 0
    return order[at], least


def insert(order: np.ndarray, common: np.ndarray, letters: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Put letters (in the column's order) before its suffixes: the next column's order and common prefixes, these up to cap."""
    by = np.argsort(letters, kind="stable")
    sorted_ = letters[by]
    shared = np.zeros(len(by), np.uint16)
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
    if len(same):
        low, high = by[same - 1] + 1, by[same] + 1
        near = np.flatnonzero(high - low == 1)
        far = np.flatnonzero(high - low > 1)
        least = np.empty(len(same), np.int64)
        least[near] = common[low[near]]
        if len(far):
            far = far[np.argsort(-low[far], kind="stable")]  # so that reduceat does not read from one range on to the next
            bounds = np.empty(2 * len(far), np.int64)
            bounds[0::2], bounds[1::2] = low[far], high[far]
            least[far] = np.minimum.reduceat(np.append(common, np.uint16(0)), bounds)[0::2]
        shared[same] = np.minimum(least + 1, cap)
    return order[by], shared


def judge(chunks: list[Chunk], window: int = WINDOW, folder: str | None = None) -> list[bytes | None]:
    """For each chunk, the bits of its repeated windows; None where there are none."""
    of = np.array([i for i, x in enumerate(chunks) for _ in range(2 if x.copies > 1 else 1)])
    left = np.array([x.left for x in chunks])
    right = np.array([len(x.body) - x.left for x in chunks])
    n = np.array([x.n for x in chunks])
    wide, high = int(left.max()), int(right.max())
    # letters[p]: the byte of every chunk at place p, counted from the ends so that anchors lie at one place
    letters = np.zeros((wide + high, len(chunks)), np.uint8)
    for i, x in enumerate(chunks):
        letters[wide - x.left : wide + right[i], i] = np.frombuffer(x.body, np.uint8)
    repeated = np.zeros((wide + 1, len(chunks)), bool)  # by bytes before the anchor
    left_of, right_of = left[of], right[of]
    with Columns(folder) as columns:
        for place in range(high - 1, -wide - 1, -1):
            order, common = columns.read()
            joins = np.flatnonzero(right_of == place + 1)
            if len(joins):  # documents that end here: empty suffixes come first and share nothing
                order, common = np.concatenate([joins, order]), np.concatenate([np.zeros(len(joins), np.uint16), common])
            if not len(order):
                continue
            order, common = insert(order, common, letters[wide + place, of[order]], window)
            best = np.maximum(common, np.append(common[1:], np.uint16(0))).astype(np.int64)
            if place <= 0:
                repeated[-place, of[order[best >= window]]] = True
            rest = left_of[order] + place  # letters still to come
            stays = (rest > 0) & (best + rest >= window)
            if not stays.all():
                order, common = without(order, common, stays)
            columns.write(order, common)
    out = []
    for i in range(len(chunks)):
        bits = repeated[left[i] - n[i] + 1 : left[i] + 1, i][::-1]
        out.append(np.packbits(bits).tobytes() if bits.any() else None)
    return out


def goes(verdict: bytes, n: int, doc_id: int | None) -> np.ndarray:
    """Which windows are repeated, whatever the document."""
    return np.unpackbits(np.frombuffer(verdict, np.uint8), count=n).astype(bool)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, most: int = MOST_CHUNKS) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans (maximal removed runs), kept (null where nothing goes), sha (of the whole text)."""
    folder = scratch_dir(docs.sparkSession)
    return removed(docs, Units(False, window, gram), lambda chunks: judge(chunks, window, folder), goes, True, shard_bytes, "suffix", most)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    r = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), "sha").alias("kept_sha256"))
