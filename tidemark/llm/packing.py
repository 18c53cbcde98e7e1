"""Packing token sequences by non-negative least squares over shallow length combinations.

Documents become token ids with an end id. Whole windows of `window` ids come off a document's front and are sequences of
their own; what remains of it is a length of the histogram. Combinations of two lengths that fill a window, and of three
with a frequent one among them, are enumerated; non-negative least squares finds how often to repeat each so that the
histogram is used up; counts are rounded down, then up while lengths last; the residual is packed greedily (the largest
that fits, and where none does the next is cut to fit). What is left at the end is cut into sequences whose lengths are
powers of two, so nothing is padded.

Each partition packs its rows in blocks of about BLOCK ids, one solution per block: no shuffle, memory bounded by the block
and the longest document, and a lost task repeats its own rows only. The price is at most a dozen short sequences a block.
Sequence ids are the partition's number times 2^40 plus a counter.

Defined results: null text is empty and has the end id alone; repeated rows are packed each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, session

WINDOW, END = 2048, 1
BLOCK = 1 << 21
#: Words whose ids a worker remembers.
CACHE = 400_000
FREQUENT, STEPS = 24, 80


#: Marks that the tokenizer always parts from a letter or digit before them.
MARKS = b".,!?;:#$%&*"


class WordIds:
    """Ids of whole texts by the tokenizer, one word at a time: it drops white space and never joins across it.

    Words are lower-cased (A-Z) and trailing marks parted from them first, as the tokenizer does, so that fewer are new.
    New words of letters are encoded many to a text; the tokenizer's word-end ids tell them apart again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for body in bodies:
            words = body.split()
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
                continue
            except KeyError:
                pass
            self._learn(words)
            out.append(b"".join(map(self.known.__getitem__, words)))
            if len(self.known) > CACHE:
                self.known.clear()
                self.parts.clear()
        return out

    def _learn(self, words: list[bytes]) -> None:
        known, parts = self.known, self.parts
        split = {}
        for w in words:
            if w in known or w in split:
                continue
            low = w if b"<|" in w else w.lower()  # special tokens are spelled in one case only
            stem = low.rstrip(MARKS)
            if len(stem) == len(low) or not stem or not _ends_plainly(stem):
                split[w] = (low,)
            else:
                split[w] = (stem, low[len(stem) :])
        fresh = {p for x in split.values() for p in x if p not in parts}
        plain, other = [], []
        for p in fresh:
            (plain if p.isalpha() or _letters(p) else other).append(p)
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.array(batch([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, cuts = ids.tobytes(), (cuts * 4).tolist()
                parts.update(zip(some, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
            else:
                other += some
        for at in range(0, len(other), 1000):
            some = other[at : at + 1000]
            for p, e in zip(some, batch([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)):
                parts[p] = np.array(e.ids, "<u4").tobytes()
        for w, x in split.items():
            known[w] = parts[x[0]] if len(x) == 1 else parts[x[0]] + parts[x[1]]


def _ends_plainly(stem: bytes) -> bool:
    """Whether the last character is a letter or digit that lower-casing keeps one character."""
    if stem[-1] < 128:
        return stem[-1:].isalnum()
    last = stem[-8:].decode("utf-8", "ignore")[-1:]
    return last.isalpha() and len(last.lower()) == 1


def _letters(p: bytes) -> bool:
    try:
        return p.decode().isalpha()
    except UnicodeDecodeError:
        return False


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (the first 0 in pairs) that fill the window, of lengths that occur."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    low = lengths[lengths <= window - lengths]
    pairs = low[have[window - low]]
    rows = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    frequent = np.sort(lengths[np.argsort(-counts, kind="stable")[:FREQUENT]])
    for a in frequent.tolist():
        b = lengths[2 * lengths <= window - a]
        c = window - a - b
        ok = have[c]
        rows.append(np.sort(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1), 1))
    return np.unique(np.concatenate(rows), axis=0)


def repeats(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares |A x - histogram|, column k of A counting the lengths of rows[k]; by multiplicative steps."""
    size = len(histogram)
    target = histogram.astype(float)
    target[0] = 0

    def back(v):
        v = v.copy()
        v[0] = 0
        return v[rows[:, 0]] + v[rows[:, 1]] + v[rows[:, 2]]

    goal = back(target)
    x = goal / np.maximum(back(np.bincount(rows.ravel(), minlength=size).astype(float)), 1e-9)
    for _ in range(steps):
        made = np.bincount(rows[:, 0], x, size) + np.bincount(rows[:, 1], x, size) + np.bincount(rows[:, 2], x, size)
        x *= goal / np.maximum(back(made), 1e-12)
    return x


def rounded(rows: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts that the histogram can pay for: rounded down, then up in the order of what rounding lost."""
    left = histogram.copy()
    left[0] = np.iinfo(np.int64).max // 2
    n = np.floor(x + 1e-9).astype(np.int64)
    used = np.bincount(rows.ravel(), np.repeat(n, 3), len(histogram)).astype(np.int64)
    over = (used > left) & (np.arange(len(left)) > 0)
    if over.any():  # least squares may overshoot
        n[over[rows].any(1)] = 0
        used = np.bincount(rows.ravel(), np.repeat(n, 3), len(histogram)).astype(np.int64)
    left[1:] -= used[1:]
    open_ = left.tolist()
    for k in np.argsort(-(x - n), kind="stable").tolist():
        if x[k] - n[k] < 1e-3:
            break
        a, b, c = rows[k].tolist()
        while True:
            open_[a] -= 1
            open_[b] -= 1
            open_[c] -= 1
            if min(open_[a], open_[b], open_[c]) < 0:
                open_[a] += 1
                open_[b] += 1
                open_[c] += 1
                break
            n[k] += 1
            if n[k] >= x[k]:
                break
    return n


def plan(totals: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given numbers of ids."""
    out, sequence = [], 0
    rest: list[list[int]] = [[] for _ in range(window)]
    for d, t in enumerate(totals):
        for start in range(0, t - window + 1, window):
            out.append((d, start, window, sequence, 0))
            sequence += 1
        if t % window:
            rest[t % window].append(d)
    histogram = np.array([len(r) for r in rest], np.int64)
    lengths = np.flatnonzero(histogram)
    rows = combinations(lengths, histogram[lengths], window) if len(lengths) else np.zeros((0, 3), np.int64)
    place = lambda d, length: totals[d] - length
    if len(rows):
        n = rounded(rows, repeats(rows, histogram), histogram)
        for k in np.flatnonzero(n).tolist():
            for _ in range(int(n[k])):
                offset = 0
                for length in rows[k].tolist():
                    if length:
                        d = rest[length].pop()
                        out.append((d, place(d, length), length, sequence, offset))
                        offset += length
                sequence += 1
    # the residual: (ids left, document), ascending
    left = [(length, d) for length in range(window) for d in rest[length]]
    space, offset, tail = window, 0, []
    pieces: list[tuple[int, int, int, int]] = []  # document, start, length, offset
    while left:
        i = bisect_right(left, (space, len(totals)))
        length, d = left.pop(i - 1 if i else 0)
        take = min(length, space)
        pieces.append((d, place(d, length), take, offset))
        offset, space = offset + take, space - take
        if take < length:  # none fitted: the smallest is cut
            left.insert(bisect_right(left, (length - take, d)), (length - take, d))
        if not space:
            out += [(d, s, n, sequence, o) for d, s, n, o in pieces]
            sequence, space, offset, pieces = sequence + 1, window, 0, []
    # the last window is not full: powers of two need no padding
    bounds = []
    at = 0
    while at < offset:
        size = 1 << ((offset - at).bit_length() - 1)
        bounds.append((at, at + size))
        at += size
    for low, high in bounds:
        for d, s, n, o in pieces:
            a, b = max(o, low), min(o + n, high)
            if a < b:
                out.append((d, s + a - o, b - a, sequence, a - low))
        sequence += 1
    return out


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, block: int = BLOCK, ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit; null if not asked for), ids_crc32, doc_tokens, sequence_id, offset."""
    session(docs)
    schema = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        words = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        held_ids: list = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal base
            pieces = plan([len(x) // 4 for x in held], window)
            for at in range(0, len(pieces), 20_000):
                part = pieces[at : at + 20_000]
                cut = [held[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in part]
                yield arrow(
                    schema, doc_id=[held_ids[p[0]] for p in part], start=[p[1] for p in part], length=[p[2] for p in part], ids=cut if ids else [None] * len(part),
                    ids_crc32=[zlib.crc32(x) for x in cut], doc_tokens=[len(held[p[0]]) // 4 for p in part], sequence_id=[base + p[3] for p in part], offset=[p[4] for p in part],
                )
            base += max((p[3] for p in pieces), default=-1) + 1

        for batch in batches:
            names, bodies = batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()
            for at in range(0, len(bodies), 200):
                for name, x in zip(names[at : at + 200], words.encode(bodies[at : at + 200])):
                    held_ids.append(name)
                    held.append(x + last)
                    size += len(x) // 4 + 1
                if size >= block:
                    yield from flush()
                    held_ids.clear()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return as_bytes(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), ids=False).drop("ids")
