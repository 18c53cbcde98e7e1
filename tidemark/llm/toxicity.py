"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5 bytes, with word ends, and the word itself), each with an embedding in a
hashed table; words average their n-grams, windows of WORDS words average their words, and a softmax of two classes
follows. Embeddings and softmax are trained together, so unseen misspellings share the vectors of the n-grams they keep.
Training starts with every window under its document's label and then goes over to each document's worst window (the hard
form of multiple-instance learning). The softmax speaks of windows; a document's score pools what it says of them, by a
logistic function of the worst windows' logits and of the expected number of toxic windows: one ambiguous word is weaker
evidence than several. As the model is linear up to the softmax,
scoring needs one number per n-gram.

It is fitted on the driver on at most PER_CLASS labelled rows of either class, none over MOST_BYTES, never held-out ones; classes
are weighted back to their share in the labels.

Defined results: texts of any length are scored whole; equal logits are pooled alike; texts without a word (null and empty ones too) score the share of toxic labels; without labels of both classes every score is the
share of toxic labels (0 if none); repeated rows get equal scores; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, held_out, map_rows, session
from .samples import labelled_sample

BUCKETS, DIMENSIONS = 1 << 16, 6
#: Words of a window, chosen among 1, 2, 3, 4 and 6 by folds of the training rows alone.
WORDS = 1
PER_CLASS, MOST_BYTES = 1200, 12_000
THRESHOLD = 0.7
FOLDS = 5
GRAMS = (3, 4, 5)


def grams(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """n-gram buckets of the words of a normalised text (words joined by one space), the word of each, and the number of words."""
    padded = np.frombuffer(b" " + text + b" " + bytes(max(GRAMS)), np.uint8).astype(np.uint32)
    data = padded[: len(text) + 2]
    gaps = np.flatnonzero(data == 32)
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    word = np.repeat(np.arange(len(gaps) - 1), np.diff(gaps))  # of each byte, a word's leading space included
    until = np.repeat(gaps[1:], np.diff(gaps))
    at = np.arange(len(word))
    cols, rows = [], []
    h = np.zeros(len(word), np.uint32)
    for k in range(max(GRAMS)):
        h = h * np.uint32(16777619) ^ (padded[k : k + len(word)] + np.uint32(131 * (k + 1)))
        if k + 1 in GRAMS:
            ok = np.flatnonzero(at + k <= until)
            cols.append(_mix(h[ok] + np.uint32(k), buckets))
            rows.append(word[ok])
    total = np.zeros(len(data), np.uint64)
    np.cumsum((data[:-1] + np.uint32(7)).astype(np.uint64) * _weights(len(data) - 1), out=total[1:])
    whole = (total[gaps[1:]] - total[gaps[:-1] + 1]) * _inverse(gaps[:-1] + 1)
    cols.append(_mix((whole ^ (whole >> np.uint64(32))).astype(np.uint32), buckets))
    rows.append(np.arange(len(gaps) - 1))
    cols, rows = np.concatenate(cols), np.concatenate(rows)
    return cols, rows, len(gaps) - 1


def _mix(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(12))) & np.uint32(buckets - 1)).astype(np.int64)


_PRIME = 0x100000001B3
_UP, _DOWN = [np.ones(1, np.uint64)], [np.ones(1, np.uint64)]


def _weights(n: int) -> np.ndarray:
    if len(_UP[0]) < n:
        for box, base in ((_UP, _PRIME), (_DOWN, pow(_PRIME, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            box[0] = np.cumprod(p)
    return _UP[0][:n]


def _inverse(at: np.ndarray) -> np.ndarray:
    _weights(int(at.max()) + 1 if len(at) else 1)
    return _DOWN[0][at]


def normal(body: bytes) -> bytes:
    """Lower case (A-Z), words joined by one space."""
    return b" ".join(body.lower().split())


class Model:
    """The gram table (buckets x dimensions), softmax weights (dimensions x 2) and biases."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: np.ndarray, words: int = WORDS):
        self.words, self.buckets, self.pool, self.prior = words, len(table), None, 0.0
        self.gram = (table @ (weights[:, 1] - weights[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])

    def windows(self, texts: list[bytes]) -> np.ndarray:
        """Of each text the logits of its three worst windows, and two measures of how many are toxic."""
        out = np.repeat(np.array([[self.bias, self.bias, self.bias, 0.0, 0.0]]), len(texts), 0)
        bodies = [normal(t) for t in texts]
        for part in _blocks(bodies, 1 << 19):
            some = [i for i in part if bodies[i]]
            if not some:
                continue
            joined = b" ".join(bodies[i] for i in some)
            cols, rows, n = grams(joined, self.buckets)
            word = np.bincount(rows, self.gram[cols], n) / np.bincount(rows, minlength=n)
            counts = np.array([bodies[i].count(b" ") + 1 for i in some])
            starts = np.concatenate([[0], np.cumsum(counts)])
            windows = -(-counts // self.words)
            first = np.concatenate([[0], np.cumsum(windows)])[:-1]
            step = np.arange(len(np.repeat(first, windows))) - np.repeat(first, windows)
            edges = np.repeat(starts[:-1], windows) + step * self.words
            ends = np.minimum(edges + self.words, np.repeat(starts[1:], windows))
            logit = np.add.reduceat(word, edges) / (ends - edges) + self.bias
            owner = np.repeat(np.arange(len(some)), windows)
            worst = np.lexsort((-logit, owner))
            for k in range(3):
                has = windows > k
                out[np.array(some)[has], k] = logit[worst[first[has] + k]]
            expected = np.add.reduceat(1 / (1 + np.exp(-np.clip(logit, -40, 40))), first)
            out[some, 3] = np.log1p(expected)
            out[some, 4] = expected / np.sqrt(windows)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The toxicity of each text."""
        f = self.windows(texts)
        z = f[:, 0] if self.pool is None else np.where(f[:, 3] > 0, _pooled(f) @ self.pool, self.prior)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pooled(f: np.ndarray) -> np.ndarray:
    return np.concatenate([np.clip(f[:, :3], -8, 8) / 4, f[:, 3:], np.ones((len(f), 1))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; the last column is the constant."""
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    penalty = np.diag([decay] * (x.shape[1] - 1) + [1e-9])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        d = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + penalty @ w)
        w = w - d * min(1.0, 2.0 / max(1e-12, np.abs(d).max()))
        if np.abs(d).max() < 1e-8:
            break
    return w


def _blocks(bodies: list[bytes], size: int):
    part, total = [], 0
    for i, b in enumerate(bodies):
        if part and total + len(b) > size:
            yield part
            part, total = [], 0
        part.append(i)
        total += len(b) + 1
    if part:
        yield part


class Bags:
    """Windows of WORDS words of many texts as sparse rows: gram buckets, their weights in the average, each window's start and text."""

    def __init__(self, texts: list[bytes], buckets: int, words: int):
        cols, values, lengths, owner = [], [], [], []
        for d, text in enumerate(texts):
            c, rows, n = grams(normal(text), buckets)
            if not n:
                continue
            order = np.argsort(rows, kind="stable")
            c, rows = c[order], rows[order]
            first = np.arange(0, n, words)
            size = np.minimum(first + words, n) - first
            cols.append(c.astype(np.int32))
            values.append((1.0 / (np.bincount(rows, minlength=n)[rows] * size[rows // words])).astype(np.float32))
            lengths.append(np.bincount(rows // words, minlength=len(first)))
            owner.append(np.full(len(first), d))
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.cols, self.values = joined(cols, np.int32), joined(values, np.float32)
        self.lengths, self.owner = joined(lengths, np.int64), joined(owner, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, weights and lengths of the chosen windows, one after the other."""
        lengths = self.lengths[chosen]
        at = np.repeat(self.starts[chosen] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        return self.cols[at], self.values[at].astype(np.float64), lengths

    def dot(self, linear: np.ndarray, chosen: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        out = np.zeros(len(chosen))
        for a in range(0, len(chosen), block):
            cols, values, lengths = self.rows(chosen[a : a + block])
            out[a : a + block] = np.add.reduceat(linear[cols] * values, np.cumsum(lengths) - lengths)
        return out


def fit(texts: list[bytes], labels: list[int], share: float, seed: int = 11, folds: int = FOLDS, buckets: int = BUCKETS, words: int = WORDS, **sizes) -> Model:
    """The mean of `folds` models, each trained without one part of the sample; share: of toxic documents among all labelled ones.

    The pooling of windows is fitted on what each model says of the part that it has not seen.
    """
    y = np.array(labels)
    bias = np.log(np.clip([1 - share, share], 1e-6, 1))
    if len(set(labels)) < 2:
        return Model(np.zeros((buckets, 1)), np.zeros((1, 2)), bias, words)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    part = np.random.default_rng(seed).permutation(len(y)) % folds
    bags = Bags(texts, buckets, words)
    models, seen = [], np.zeros((len(y), 5))
    for k in range(folds):
        models.append(_train(bags, part != k, y, weight, bias, seed + k, buckets, words, **sizes))
        own = np.flatnonzero(part == k)
        if len(own):
            seen[own] = models[-1].windows([texts[i] for i in own])
    mean = models[0]
    mean.gram = sum(m.gram for m in models) / folds
    mean.bias = sum(m.bias for m in models) / folds
    mean.pool, mean.prior = _logistic(_pooled(seen), y, weight), float(bias[1] - bias[0])
    return mean


def _train(bags: Bags, inside: np.ndarray, y_doc, weight_doc, bias, seed, buckets, words, dimensions=DIMENSIONS, rounds=8, rate=0.3, ridge=1e-2) -> Model:
    """Embeddings and softmax, jointly by AdaGrad, over the windows of the documents inside."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (dimensions, buckets))
    weights = rng.normal(0, 0.5, (dimensions, 2))
    bias = bias.copy()
    flat = np.flatnonzero(inside[bags.owner])
    if not len(flat):
        return Model(table.T, weights, bias, words)
    squares = [np.full((dimensions, buckets), ridge), np.full((dimensions, 2), ridge), np.full(2, ridge)]

    def step(chosen, importance):
        cols, vals, lengths = bags.rows(chosen)
        starts = np.cumsum(lengths) - lengths
        h = np.stack([np.add.reduceat(table[k][cols] * vals, starts) for k in range(dimensions)], 1)
        z = h @ weights + bias
        g = np.exp(z - z.max(1, keepdims=True))
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(chosen)), y_doc[bags.owner[chosen]]] -= 1
        g *= importance[:, None]
        dh = g @ weights.T
        met = np.unique(cols)  # other buckets have no gradient
        place = np.searchsorted(met, cols) if len(met) < buckets // 4 else None
        for k in range(dimensions):
            pull = vals * np.repeat(dh[:, k], lengths)
            got = np.bincount(cols, pull, buckets)[met] if place is None else np.bincount(place, pull, len(met))
            squares[0][k][met] += got * got
            table[k][met] -= rate * got / np.sqrt(squares[0][k][met])
        for value, got, sq in ((weights, h.T @ g, squares[1]), (bias, g.sum(0), squares[2])):
            sq += got * got
            value -= rate * got / np.sqrt(sq)

    owner = bags.owner[flat]
    n_of = np.bincount(owner, minlength=len(inside))
    for _ in range(2):
        for part in np.array_split(rng.permutation(flat), max(1, len(flat) // 4000)):
            step(part, weight_doc[bags.owner[part]] / n_of[bags.owner[part]] * n_of[inside].mean())
    for _ in range(rounds):
        logit = bags.dot((weights[:, 1] - weights[:, 0]) @ table, flat)
        best = np.lexsort((-logit, owner))
        best = flat[best[np.concatenate([[True], owner[best][1:] != owner[best][:-1]])]]
        for _ in range(3):
            for part in np.array_split(rng.permutation(best), max(1, len(best) // 300)):
                step(part, weight_doc[bags.owner[part]])
    return Model(table.T, weights, bias, words)


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    texts, y, sizes = labelled_sample(docs, labels, "toxic", per_class, most_bytes)
    total = sum(sizes.values())
    return fit(texts, y, sizes.get(1, 0) / total if total else 0.0)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches):
        for batch in batches:
            s = shared.value.scores(batch.column("body").to_pylist())
            yield arrow("doc_id long, score double, predicted int", doc_id=batch.column("doc_id").to_pylist(), score=s, predicted=(s >= threshold).astype(np.int32))

    return as_bytes(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    shared = session(docs).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            bodies = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            yield batch.take(np.flatnonzero(shared.value.scores(bodies) < threshold))

    return map_rows(docs, run)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    r = scored(docs, toxicity_model(docs, labels))
    return r.select("doc_id", held_out().alias("held_out"), "score", "predicted")
