"""Finding long repeated strings: the candidate stage that substring and suffix-array deduplication share.

Every window of `window` consecutive units (bytes, or words) is labelled by its anchor: the `gram`-unit string inside it
whose hash is least, the leftmost of several. Equal windows have equal anchors, so equal windows always meet in the group
of their anchor's hash; no repeat is lost. A run of windows with the same anchor occurrence is a chunk, and a chunk holds
all units of its windows. Only groups whose anchor occurs again carry text any further. Equal chunks travel once, with the
number of their copies, so thousands of copies cost one text. The groups then go, in shards of bounded size, to an index
builder (suffix automaton or column-wise Burrows-Wheeler transform), which alone decides for every window.

A hot anchor, one with more than MOST_CHUNKS distinct chunks, is never one group: its chunks are cut into cells. A window
that begins o units before the anchor lies in cell o // step, and all windows of a cell share a core; equal windows have
equal o, cell and core, so the cores' hashes are finer keys that lose no repeat. Cells whose core occurs once are dropped,
equal ones counted, and those still hot are cut again by a smaller step; at step 1 a cell is one window and a group has one
distinct text. So no task holds more than MOST_CHUNKS texts of one key, however common a passage is.

The plan: one pass over the texts (documents written once, compressed, with their anchors), an aggregation of anchor
hashes, a semi-join that AQE splits where an anchor is hot, and from there on only documents with a candidate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, session, written

#: Units of text that numpy works on at once, and bytes likewise.
BLOCK = 1 << 20
#: Distinct chunks of one key in a task, at most.
MOST_CHUNKS = 512
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass(frozen=True)
class Units:
    """What a repeat is measured in."""

    words: bool
    window: int
    gram: int

    @property
    def steps(self) -> tuple[int, ...]:
        """Sizes of the cells that chunks of a hot anchor are cut into, one after the other."""
        return tuple(sorted({max(1, self.window // 6), max(1, self.window // 50), 1}, reverse=True))

    def normal(self, body: bytes) -> bytes:
        """The text as its units see it: words are joined by one space."""
        return b" ".join(body.split()) if self.words else body

    def bounds(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each unit."""
        if not self.words:
            at = np.arange(len(text) + 1, dtype=np.int64)
            return at[:-1], at[1:]
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gaps = np.flatnonzero(text == 32)
        return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(text)]])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_MULT, _BACK)):
            p = np.full(max(n, BLOCK + (BLOCK >> 2)), base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def _hashes(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text[first:end], from one prefix sum."""
    up, down = _powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_TABLE[text] * up[: len(text)], out=total[1:])
    h = (total[end] - total[first]) * down[first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(text: bytes, units: Units, lengths: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and (absolute) anchor unit of each chunk; `lengths`: texts that lie end to end, in units."""
    data = np.frombuffer(text, np.uint8)
    first, end = units.bounds(data)
    n = len(first)
    if n < units.window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _hashes(data, first[: n - units.gram + 1], end[units.gram - 1 :])
    keyed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    at = (_least(keyed, units.window - units.gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    if lengths is None:
        index = np.arange(len(at))
    else:
        ends = np.repeat(np.cumsum(lengths), lengths)[: len(at)]
        index = np.flatnonzero(np.arange(len(at)) + units.window <= ends)
        at = at[index]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[new]], index[new], at[new]


def _scan_one(text: bytes, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors() of one text of any length, in blocks that overlap by a window less one."""
    data = np.frombuffer(text, np.uint8)
    first, end = units.bounds(data)
    parts, at = [], 0
    while at + units.window <= len(first):
        stop = min(len(first), max(at + units.window, int(np.searchsorted(end, first[at] + BLOCK, "right"))))
        h, s, a = anchors(text[first[at] : end[stop - 1]], units)
        parts.append((h, s + at, a + at))
        at = stop - units.window + 1
    if not parts:
        return anchors(b"", units)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


_SCAN = "rid long, doc_id long, n_units long, sha string, windows long, blob binary, h array<long>, s array<int>, a array<int>"


def _scan(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
            texts = [units.normal(b) for b in batch.column("body").to_pylist()]
            counts = [(t.count(b" ") + 1 if t else 0) if units.words else len(t) for t in texts]
            found: list = [None] * len(texts)
            group: list[int] = []
            size = 0
            for i in [*range(len(texts)), -1]:
                if i < 0 or size + len(texts[i]) > BLOCK:
                    if group:
                        h, s, a = anchors((b" " if units.words else b"").join(texts[j] for j in group), units, [counts[j] for j in group])
                        base = np.cumsum([0, *(counts[j] for j in group)])
                        cut = np.searchsorted(s, base)
                        for k, j in enumerate(group):
                            part = slice(cut[k], cut[k + 1])
                            found[j] = h[part], s[part] - base[k], a[part] - base[k]
                    group, size = [], 0
                if i >= 0 and counts[i] >= units.window:
                    if len(texts[i]) > BLOCK:
                        found[i] = _scan_one(texts[i], units)
                    else:
                        group.append(i)
                        size += len(texts[i]) + 1
            none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            found = [none if f is None or (units.words and ids[i] is None) else f for i, f in enumerate(found)]
            ends = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
            lists = [np.concatenate([f[k] for f in found]) for k in range(3)]
            columns = [
                pa.array(rids, pa.int64()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([max(0, c - units.window + 1) for c in counts], pa.int64()),
                pa.array([squeeze(t) for t in texts], pa.binary()),
                pa.ListArray.from_arrays(ends, pa.array(lists[0].view(np.int64))),
                *(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in lists[1:]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCAN.split(", ")])

    return run


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    grow = zstandard.ZstdDecompressor().decompress
    for i, blob in enumerate(batch.column("blob").to_pylist()):
        yield i, grow(blob)


def _spans(text: bytes, units: Units):
    return units.bounds(np.frombuffer(text, np.uint8)) if units.words else None


def _piece(text: bytes, bounds, first: int, last: int) -> bytes:
    """The units first..last (end exclusive) of a text."""
    return text[first:last] if bounds is None else text[bounds[0][first] : bounds[1][last - 1]]


_CHUNKS = "h long, c long, doc_id long, rid long, i int"


def _chunks(units: Units):
    """Of each candidate document, its candidate chunks' hashes."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in _CHUNKS.split(", ")}
            h, s, idx = (batch.column(x).to_pylist() for x in ("h", "s", "idx"))
            ids, rids, windows = (batch.column(x).to_pylist() for x in ("doc_id", "rid", "windows"))
            for k, text in _texts(batch):
                bounds, ends = _spans(text, units), [*s[k][1:], windows[k]]
                for i in idx[k]:
                    out["h"].append(h[k][i])
                    out["c"].append(xxhash.xxh3_64_intdigest(_piece(text, bounds, s[k][i], ends[i] + units.window - 1)) - (1 << 63))
                    out["doc_id"].append(ids[k])
                    out["rid"].append(rids[k])
                    out["i"].append(i)
            yield arrow(_CHUNKS, **out)

    return run


_BODIES = "h long, c long, d0 long, copies long, left int, n int, body binary"


def _bodies(units: Units):
    """The text of each distinct chunk, from the first document that has it. left: units before the anchor."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in _BODIES.split(", ")}
            s, a, wanted, windows = (batch.column(x).to_pylist() for x in ("s", "a", "wanted", "windows"))
            ids = batch.column("doc_id").to_pylist()
            for k, text in _texts(batch):
                bounds, ends = _spans(text, units), [*s[k][1:], windows[k]]
                for w in wanted[k]:
                    i = w["i"]
                    out["h"].append(w["h"])
                    out["c"].append(w["c"])
                    out["d0"].append(ids[k])
                    out["copies"].append(w["copies"])
                    out["left"].append(a[k][i] - s[k][i])
                    out["n"].append(ends[i] - s[k][i])
                    out["body"].append(_piece(text, bounds, s[k][i], ends[i] + units.window - 1))
                if sum(map(len, out["body"][-1000:])) and len(out["body"]) >= 20_000:
                    yield arrow(_BODIES, **out)
                    out = {x: [] for x in out}
            yield arrow(_BODIES, **out)

    return run


_VERDICTS = "h long, c long, at int, n int, verdict binary"
_CELLS = "ph long, pc long, at int, " + _BODIES


@dataclass
class Chunk:
    """A distinct chunk: key, id of the first document that has it, number of copies, units before its anchor, windows, text."""

    h: int
    c: int
    d0: int
    copies: int
    left: int
    n: int
    body: bytes


def _cells(units: Units, step: int):
    """Cut chunks (ph, pc) into cells with keys h and c; at: a cell's first window in its chunk."""
    w = units.window

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out: dict[str, list] = {x.split()[0]: [] for x in _CELLS.split(", ")}
            for h, c, d0, copies, left, n, body in zip(*(rows[x.split()[0]] for x in _BODIES.split(", "))):
                bounds, at = _spans(body, units), 0
                while at < n:
                    cell = (left - at) // step
                    stop = min(n, left - cell * step + 1)  # the last window of the cell begins cell * step units before the anchor
                    core = _piece(body, bounds, left - cell * step, left + w - (cell + 1) * step + 1)
                    text = _piece(body, bounds, at, stop + w - 1)
                    key = xxhash.xxh3_64_intdigest(core, seed=xxhash.xxh3_64_intdigest(b"%d %d" % (h, cell)))
                    values = (h, c, at, key - (1 << 63), xxhash.xxh3_64_intdigest(text, seed=left - at) - (1 << 63), d0, copies, left - at, stop - at, text)
                    for box, value in zip(out.values(), values):
                        box.append(value)
                    at = stop
                if len(out["h"]) >= 5000:
                    yield arrow(_CELLS, **out)
                    out = {x: [] for x in out}
            yield arrow(_CELLS, **out)

    return run


def _judge(build: Callable[[list[Chunk]], list[bytes | None]]):
    """Give whole shards, one at a time, to the index builder."""

    def run(batches):
        def verdicts(chunks):
            chunks.sort(key=lambda x: (x.d0 is not None, x.d0, x.h, x.c))
            said = [(x, v) for x, v in zip(chunks, build(chunks)) if v is not None]
            return arrow(_VERDICTS, h=[x.h for x, _ in said], c=[x.c for x, _ in said], at=[0] * len(said), n=[x.n for x, _ in said], verdict=[v for _, v in said])

        now, chunks = None, []
        for batch in batches:
            rows = batch.to_pydict()
            for shard, *row in zip(rows["shard"], *(rows[x.split()[0]] for x in _BODIES.split(", "))):
                if shard != now and chunks:
                    yield verdicts(chunks)
                    chunks = []
                now = shard
                chunks.append(Chunk(*row))
        if chunks:
            yield verdicts(chunks)

    return run


def _judged(bodies: DataFrame, shards: int, build) -> DataFrame:
    """Verdicts of chunks none of whose keys is hot."""
    shard = F.pmod(F.hash("h"), F.lit(shards)).alias("shard")
    parts = bodies.select(shard, *(x.split()[0] for x in _BODIES.split(", "))).repartition("shard").sortWithinPartitions("shard")
    return parts.mapInArrow(_judge(build), _VERDICTS)


def _judged_in_cells(bodies: DataFrame, units: Units, build, most: int, name: str, level: int = 0) -> DataFrame:
    """Verdicts of the chunks of hot keys, by cells of ever smaller steps."""
    cells = written(bodies.mapInArrow(_cells(units, units.steps[level]), _CELLS), f"{name}-cells-{level}")
    first = F.min_by(F.struct("d0", "left", "n", "body"), F.struct("d0", "ph", "pc", "at")).alias("f")
    distinct = cells.groupBy("h", "c").agg(first, F.sum("copies").alias("copies"))
    distinct = written(distinct.select("h", "c", "f.d0", "copies", "f.left", "f.n", "f.body"), f"{name}-distinct-{level}")
    keys = written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("copies").alias("copies")).where("copies > 1"), f"{name}-keys-{level}")
    few = keys.where(F.col("m") <= most).select("h")
    # keys are large here, so shards have the room of a quarter of the largest
    shards = max(1, (keys.where(F.col("m") <= most).agg(F.sum("m")).first()[0] or 0) // max(1, most // 4))
    out = _judged(distinct.join(few, "h", "left_semi"), shards, build)
    over = keys.where(F.col("m") > most).select("h")
    if level + 1 < len(units.steps) and over.take(1):
        out = out.unionByName(_judged_in_cells(distinct.join(over, "h", "left_semi"), units, build, most, name, level + 1))
    # written, so that both sides of the join come straight from a shuffle and AQE can split a common cell's rows
    of = cells.select("ph", "pc", F.col("at").alias("from"), "h", "c").join(written(out, f"{name}-verdicts-{level}"), ["h", "c"])
    return of.select(F.col("ph").alias("h"), F.col("pc").alias("c"), (F.col("at") + F.col("from")).cast("int").alias("at"), "n", "verdict")


_KEPT = "rid long, n_removed long, n_spans long, kept binary"


def _kept(units: Units, goes: Callable[[bytes, int, int | None], np.ndarray]):
    """Remove from each candidate document the units that removed windows cover."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in _KEPT.split(", ")}
            s, cut, windows, ids, rids = (batch.column(x).to_pylist() for x in ("s", "cut", "windows", "doc_id", "rid"))
            for k, text in _texts(batch):
                bounds = _spans(text, units)
                edge = np.zeros(windows[k] + units.window + 1, np.int32)
                for x in cut[k] or []:
                    at = np.flatnonzero(goes(x["verdict"], x["n"], ids[k])) + (s[k][x["i"]] + x["at"])
                    edge[at] += 1  # the windows of one verdict are distinct
                    edge[at + units.window] -= 1
                gone = np.cumsum(edge)[: windows[k] + units.window - 1] > 0
                data = np.frombuffer(text, np.uint8)
                if not gone.any():
                    kept = text
                elif bounds is None:
                    kept = data[~gone].tobytes()
                else:
                    words = text.split(b" ")
                    kept = b" ".join([words[j] for j in np.flatnonzero(~gone).tolist()])
                out["rid"].append(rids[k])
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
                out["kept"].append(kept)
            yield arrow(_KEPT, **out)

    return run


def removed(docs: DataFrame, units: Units, build: Callable, goes: Callable, in_same: bool, shard_units: int, name: str, most: int = MOST_CHUNKS) -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, n_spans, kept (null where nothing is removed), sha of the whole.

    build: verdicts of the chunks of a shard (None: all windows stay); goes(verdict, n, doc_id): which of a chunk's n windows
    are removed in that document. in_same: a repeat inside one document counts too.
    """
    session(docs)
    d1 = written(
        as_bytes(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "body").mapInArrow(_scan(units), _SCAN),
        f"{name}-texts",
    )
    if in_same:
        again = d1.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 1")
    else:
        again = d1.select("doc_id", F.explode("h").alias("h")).groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    # written, so that both sides of the semi-join come straight from a shuffle and AQE can split a hot anchor's rows
    again = written(again.select("h"), f"{name}-anchors")
    hit = d1.select("rid", F.posexplode("h").alias("i", "h")).join(again, "h", "left_semi")
    hit = hit.groupBy("rid").agg(F.sort_array(F.collect_list("i")).alias("idx"))
    d2 = written(d1.join(hit, "rid"), f"{name}-candidates")
    chunks = written(d2.select("rid", "doc_id", "windows", "blob", "h", "s", "idx").mapInArrow(_chunks(units), _CHUNKS), f"{name}-chunks")
    first = chunks.groupBy("h", "c").agg(F.min(F.struct("doc_id", "rid", "i")).alias("f"), F.count(F.lit(1)).alias("copies"))
    first = written(first.select("h", "c", "copies", "f.rid", "f.i"), f"{name}-distinct")
    per_key = first.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most)
    hot = written(per_key, f"{name}-hot")
    n_hot = hot.agg(F.sum("m")).first()[0] or 0

    def bodies(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("rid").agg(F.collect_list(F.struct("i", "h", "c", "copies")).alias("wanted"))
        return d2.select("rid", "doc_id", "windows", "blob", "s", "a").join(wanted, "rid").select("doc_id", "windows", "blob", "s", "a", "wanted").mapInArrow(_bodies(units), _BODIES)

    per_shard = max(1, shard_units // units.window)
    verdicts = _judged(bodies(first.join(hot.select("h"), "h", "left_anti") if n_hot else first), max(1, (first.count() - n_hot) // per_shard), build)
    if n_hot:
        verdicts = verdicts.unionByName(_judged_in_cells(bodies(first.join(hot.select("h"), "h", "left_semi")), units, build, most, name))
    cut = chunks.select("h", "c", "rid", "i").join(verdicts, ["h", "c"]).groupBy("rid").agg(F.collect_list(F.struct("i", "at", "n", "verdict")).alias("cut"))
    d3 = d2.select("rid", "doc_id", "windows", "blob", "s").join(cut, "rid").select("rid", "doc_id", "windows", "blob", "s", "cut").mapInArrow(_kept(units, goes), _KEPT)
    out = d1.select("rid", "doc_id", "n_units", "sha").join(d3, "rid", "left")
    return out.select("doc_id", "n_units", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), "kept", "sha")
