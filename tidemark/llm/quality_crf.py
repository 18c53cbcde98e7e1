"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad; its features and those of the lines before and after it give its emission, and pairs of
neighbouring labels a transition. Lines of a labelled document carry its label in training (likelihood by forward-backward,
gradient steps in numpy). A document's quality is the mean of its lines' marginals for "good", weighted by their lengths, put
through a logistic calibration on the same sample.

It is fitted on the driver on at most PER_CLASS labelled rows of either class, none over MOST_BYTES or MOST_LINES, never held-out
ones: 1.2 million lines of BASE single-precision numbers at most, about 330 MB.

Defined results: null and empty texts are one empty line; a line may have any length; without labels of both classes every score
is the share of good labels (0.5 if there are none); repeated rows get equal scores; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, held_out, session
from .samples import labelled_sample

PER_CLASS, MOST_BYTES, MOST_LINES = 1200, 20_000, 500
THRESHOLD = 0.5
#: Classes of bytes that are counted in a line (a byte counts for the last that has it), and the shares of its bytes at which a feature sets in.
_CLASSES = {
    "symbol": b"#*$%&|<>", "bang": b"!", "upper": bytes(range(65, 91)), "digit": b"0123456789", "stop": b".,;:?", "space": b" \t\r\x0b\x0c",
    "vowel": b"aeiouAEIOU", "high": bytes(range(128, 256)), "slash": b"/@=_+{}[]()\\~^`\"'",
}
_STEPS = (0.004, 0.02, 0.05, 0.1, 0.2, 0.35)
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _set in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_set)] = _i
_LENGTHS = (1, 8, 30, 80, 200, 600)
BASE = len(_CLASSES) * len(_STEPS) + len(_LENGTHS) + 4 + 4
FEATURES = 3 * BASE + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts (their own), the lines' lengths in bytes, and the number of lines of each text."""
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    flat = [x for ls in lines for x in ls]
    lengths = np.array([len(x) for x in flat])
    data = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    kinds = len(_CLASSES) + 1
    owner = np.repeat(np.arange(len(flat), dtype=np.int64) * kinds, lengths + 1)
    owner += _CLASS_OF[data]
    share = np.bincount(owner, minlength=len(flat) * kinds).reshape(-1, kinds)[:, :-1].astype(np.float32)
    share /= np.maximum(lengths, 1)[:, None]
    out = np.zeros((len(flat), BASE), np.float32)
    n = 0
    for c in range(len(_CLASSES)):
        for s in _STEPS:
            out[:, n] = share[:, c] > s
            n += 1
    for s in _LENGTHS:
        out[:, n] = lengths >= s
        n += 1
    again = np.zeros(len(flat), bool)
    words = np.zeros(len(flat))
    fresh = np.ones(len(flat))
    at = 0
    for ls in lines:
        seen = set()
        for x in ls:
            w = x.split()
            if w:
                if x in seen:
                    again[at] = True
                seen.add(x)
                words[at] = len(w)
                fresh[at] = len(set(w)) / len(w)
            at += 1
    out[:, n] = again
    out[:, n + 1] = words == 1
    out[:, n + 2] = words >= 40
    out[:, n + 3] = (words > 0) & (lengths > 12 * words)
    for k, s in enumerate((0.75, 0.55, 0.4, 0.25)):
        out[:, n + 4 + k] = (fresh < s) & (words >= 4)
    return out, lengths, counts


def _inner(counts: np.ndarray) -> np.ndarray:
    """Lines that have one before them in their text."""
    inner = np.ones(int(counts.sum()), bool)
    inner[np.concatenate([[0], np.cumsum(counts)[:-1]])] = False
    return np.flatnonzero(inner)


def emissions(own: np.ndarray, weights: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Log odds of every line from its own features, those of the lines before and after it, and a constant."""
    here, before, after = (own @ weights[k * BASE : (k + 1) * BASE].astype(np.float32) for k in range(3))
    out = here.astype(np.float64) + weights[-1]
    out[inner] += before[inner - 1]
    out[inner - 1] += after[inner]
    return out


def gradient(own: np.ndarray, d: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The weights' gradient, given that of the emissions; no line's features are copied to its neighbours."""
    before, after = np.zeros_like(d), np.zeros_like(d)
    before[inner - 1], after[inner] = d[inner], d[inner - 1]
    sums = np.stack([d, before, after], 1).astype(np.float32)
    return np.concatenate([(own.T @ sums).T.ravel().astype(np.float64), [d.sum()]])


def marginals(emission: np.ndarray, transition: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, summed pair marginals (2 x 2), and each text's log partition; label 1 is good, emission its log odds."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # texts that have a line t
    T = np.exp(transition)
    e = np.clip(emission, -30, 30)
    score = np.stack([np.ones_like(e), np.exp(e)], 1)
    alpha = np.zeros((len(e), 2))
    norm = np.zeros(len(e))
    for t in range(steps):
        at = first[order[: active[t]]] + t
        a = score[at] if t == 0 else (alpha[at - 1] @ T) * score[at]
        s = a.sum(1)
        alpha[at], norm[at] = a / s[:, None], s
    beta = np.ones((len(e), 2))
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = first[order[: active[t + 1]]] + t
        right = score[at + 1] * beta[at + 1] / norm[at + 1][:, None]
        beta[at] = right @ T.T
        pairs += T * (alpha[at].T @ right)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, np.add.reduceat(np.log(norm), first) if len(first) else np.zeros(0)


class Model:
    """Emission weights, transitions (bad/good x bad/good) and the calibration of document scores."""

    def __init__(self, weights, transition, scale=1.0, shift=0.0, constant=None):
        self.weights, self.transition, self.scale, self.shift, self.constant = weights, transition, scale, shift, constant

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        own, lengths, counts = line_features(texts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        good, _, _ = marginals(emissions(own, self.weights, _inner(counts)), self.transition, counts)
        weight = lengths + 1.0
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def parted(self, texts: list[bytes]) -> np.ndarray:
        """raw() of parts of about two million bytes."""
        out = []
        part, size = [], 0
        for t in [*texts, None]:
            if part and (t is None or size + len(t) > 1 << 21):
                out.append(self.raw(part))
                part, size = [], 0
            if t is not None:
                part.append(t)
                size += len(t)
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        r = self.parted(texts)
        return 1 / (1 + np.exp(-(self.scale * _logit(r) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[bytes], labels: list[int], share: float, steps: int = 150, rate: float = 0.08, decay: float = 2e-3) -> Model:
    """Maximum likelihood with a quadratic penalty; share: of good documents among all labelled ones."""
    if len(set(labels)) < 2:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), constant=share)
    y = np.array(labels)
    class_weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    # the gradient wants pair counts of texts weighted alike, so each class is one batch
    parts = []
    for c in (0, 1):
        own, _, n = line_features([t for t, k in zip(texts, labels) if k == c])
        parts.append((c, own, _inner(n), n, float(class_weight[y == c][0])))
    w, trans = np.zeros(FEATURES), np.zeros((2, 2))
    m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, steps + 1):
        gw, gt = decay * w, decay * trans
        for c, own, inner, n, weight in parts:
            good, pairs, _ = marginals(emissions(own, w, inner), trans, n)
            # long texts would drown short ones: the sum over lines is shared by the mean number of lines
            scale = weight / max(1.0, n.mean())
            gw = gw + scale * gradient(own, good - c, inner)
            seen = np.zeros((2, 2))
            seen[c, c] = (n - 1).sum()
            gt = gt + scale * (pairs - seen)
        g = np.concatenate([gw, gt.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w - move[:FEATURES], trans - move[FEATURES:].reshape(2, 2)
    model = Model(w, trans)
    r = _logit(model.parted(texts))
    weight = class_weight / class_weight.sum()
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps on two numbers
        p = 1 / (1 + np.exp(-(a * r + b)))
        g = np.array([(weight * (p - y) * r).sum() + 1e-4 * (a - 1), (weight * (p - y)).sum()])
        k = weight * p * (1 - p)
        H = np.array([[(k * r * r).sum() + 1e-4, (k * r).sum()], [(k * r).sum(), k.sum() + 1e-6]])
        d = np.linalg.solve(H, g)
        d *= min(1.0, 0.5 / max(1e-12, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return Model(w, trans, max(float(a), 0.05), float(b))


def quality_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES) -> Model:
    texts, y, sizes = labelled_sample(docs, labels, "quality", per_class, most_bytes, most_lines)
    total = sum(sizes.values())
    return fit(texts, y, sizes.get(1, 0) / total if total else 0.5)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    shared = session(docs).sparkContext.broadcast(model)  # FEATURES numbers, whatever the corpus

    def run(batches):
        for batch in batches:
            s = shared.value.scores(batch.column("body").to_pylist())
            yield arrow("doc_id long, score double, predicted int", doc_id=batch.column("doc_id").to_pylist(), score=s, predicted=(s >= threshold).astype(np.int32))

    return as_bytes(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double, predicted int")


def op5_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    r = scored(docs, quality_model(docs, labels))
    return r.select("doc_id", held_out().alias("held_out"), "score", "predicted")
