"""Media columns: MPEG audio (MPEG-1 Layer III).

Writing: an ID3v2.3 tag with the payload's length, a frame with the variable-bitrate table, then frames protected by CRC-16
whose granules are empty, so that a player hears silence and all main data is ancillary: the payload, losslessly. The last
frame has the smallest bitrate that holds the rest.

Reading: tags are parsed, frame headers are found again wherever bytes don't form one (a header counts if another follows
at its end, or the stream ends there, or the frame before ended here), the table, its seek places and all checksums are verified, exact durations counted in samples, and
the offsets of all frames kept for seeking.

Defined results: null text is empty and stored as 64 zero bytes; texts of any length are stored whole, as one stream; equal texts have equal values; broken media give what
could be read, with the counts of skipped bytes and failed checksums; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, session

# Fixed values of the format.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

RATE, SAMPLES, SIDE, HEADER = 48000, 1152, 17, 4
_ROOM = {b: 144 * b * 1000 // RATE - HEADER - 2 - SIDE for b in BITRATES[1, 3][1:]}
_LARGEST = max(_ROOM)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint16)


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, from 0xFFFF) of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


def _header(bitrate: int, protected: bool) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, BITRATES[1, 3].index(bitrate) << 4 | 1 << 2, 3 << 6])


def _start(bitrate: int) -> bytes:
    head = _header(bitrate, True)
    crc = crc16(np.frombuffer(head[2:] + bytes(SIDE), np.uint8)[None])[0]
    return head + struct.pack(">H", int(crc)) + bytes(SIDE)


_STARTS = {b: _start(b) for b in _ROOM}


def _text_frame(name: bytes, key: str, value: str) -> bytes:
    body = b"\x00" + key.encode("latin-1") + b"\x00" + value.encode("latin-1")
    return name + struct.pack(">IH", len(body), 0) + body


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def payload(body: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return body + bytes(-len(body) % 64 if body else 64)


def encode(data: bytes) -> bytes:
    """MPEG audio that carries the data."""
    room = _ROOM[_LARGEST]
    full, rest = divmod(len(data), room)
    start = _STARTS[_LARGEST]
    frames = []
    if full:
        table = np.empty((full, len(start) + room), np.uint8)
        table[:, : len(start)] = np.frombuffer(start, np.uint8)
        table[:, len(start) :] = np.frombuffer(data, np.uint8, full * room).reshape(full, room)
        frames.append(table.tobytes())
    sizes = [len(start) + room] * full
    if rest:
        bitrate = min(b for b, r in _ROOM.items() if r >= rest)
        frames.append(_STARTS[bitrate] + data[full * room :] + bytes(_ROOM[bitrate] - rest))
        sizes.append(len(frames[-1]))
    music = b"".join(frames)
    # the variable-bitrate table lies in a frame of its own, at 64 kbit/s, without checksum
    first = _header(64, False)
    length = 144 * 64 * 1000 // RATE
    ends = np.concatenate([[0], np.cumsum(sizes)]) + length
    marks = ends[(np.arange(100) * len(sizes)) // 100] * 256 // (length + len(music))
    table = b"Xing" + struct.pack(">III", 7, len(sizes), length + len(music)) + bytes(np.minimum(marks, 255).astype(np.uint8))
    first = (first + bytes(SIDE) + table).ljust(length, b"\x00")
    tag = _text_frame(b"TXXX", "payload_bytes", str(len(data)))
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + first + music


def _parse(head: bytes) -> tuple[int, int, int, int, bool] | None:
    """Length, samples, rate, side length and protection of the frame with this header, or None."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    index, rate = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    old = 1 if version == 3 else 2
    bitrate, hertz, pad = BITRATES[old, layer][index] * 1000, SAMPLE_RATES[version][rate], head[2] >> 1 & 1
    if layer == 1:
        length, samples = (12 * bitrate // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and old == 2 else 1152
        length = samples // 8 * bitrate // hertz + pad
    mono = head[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if old == 1 else (9 if mono else 17)
    return length, samples, hertz, side, not head[1] & 1


def tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """The text tags, and where audio begins and ends."""
    found, at, end = {}, 0, len(media)
    while media[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum((b & 0x7F) << s for b, s in zip(media[at + 6 : at + 10], (21, 14, 7, 0)))
        p, stop = at + 10, min(end, at + 10 + size)
        while p + 10 <= stop and media[p] != 0:
            n = struct.unpack(">I", media[p + 4 : p + 8])[0]
            body = media[p + 10 : min(stop, p + 10 + n)]
            if media[p : p + 4] == b"TXXX":
                key, _, value = body[1:].partition(b"\x00")
                found[key.decode("latin-1")] = value.decode("latin-1")
            p += 10 + n
        at = stop
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        found["title"] = media[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    return found, at, end


def _seeks(table: dict, offsets: list[int]) -> bool:
    """Whether the table's hundred places of its bytes, in parts of 256, are those of the frames at every hundredth of the time."""
    if "toc" not in table or not offsets or not table.get("bytes"):
        return "toc" not in table
    return all(mark == min(255, (offsets[k * len(offsets) // 100] - table["at"]) * 256 // table["bytes"]) for k, mark in enumerate(table["toc"]))


def decode(media: bytes) -> dict:
    """Payload, tags, frame offsets, samples, rate, checksums that fail, bytes skipped, and what the table says."""
    found, at, end = tags(media)
    offsets, sizes, shapes = [], [], []
    samples = rate = skipped = 0
    table, synced = None, False
    cache: dict[bytes, tuple | None] = {}
    while at + 4 <= end:
        head = media[at : at + 4]
        if head not in cache:
            cache[head] = _parse(head)
        x = cache[head]
        following = at + x[0] if x else 0
        if not x or not x[0] or following > end or not (synced or following == end or _parse(media[following : following + 4])):
            nxt = media.find(b"\xff", at + 1, end)  # resynchronise
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at, synced = nxt, False
            continue
        length, count, hertz, side, protected = x
        mark = at + 4 + side + 2 * protected
        # only the first frame can be the table, and its flags are four bits; elsewhere these letters are main data
        first = table is None and not offsets and mark + 8 <= following
        flags = struct.unpack(">I", media[mark + 4 : mark + 8])[0] if first and media[mark : mark + 4] in (b"Xing", b"Info") else 16
        if flags < 16:
            p, table = mark + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name] = struct.unpack(">I", media[p : p + 4])[0]
                    p += 4
            if flags & 4:
                table["toc"] = list(media[p : p + 100])
            table["at"] = at
        else:
            offsets.append(at)
            sizes.append(length)
            shapes.append((side, protected))
            samples += count
            rate = hertz
        at, synced = following, True
    skipped += max(0, end - at)
    data = np.frombuffer(media, np.uint8)
    bad, parts = 0, []
    for shape in set(shapes):
        where = np.array([o for o, s in zip(offsets, shapes) if s == shape])
        side, protected = shape
        if protected:
            rows = data[where[:, None] + np.concatenate([[2, 3], np.arange(6, 6 + side)])]
            stored = data[where + 4].astype(np.uint16) << np.uint16(8) | data[where + 5]
            bad += int((crc16(rows) != stored).sum())
    for o, n, (side, protected) in zip(offsets, sizes, shapes):
        parts.append(media[o + 4 + 2 * protected + side : o + n])
    body = b"".join(parts)
    size = int(found["payload_bytes"]) if found.get("payload_bytes", "").isdigit() else len(body)
    ok = table is None or (table.get("frames") == len(offsets) and table.get("bytes") == end - table["at"] and _seeks(table, offsets))
    return {"payload": body[:size], "tags": found, "offsets": offsets, "samples": samples, "rate": rate, "bad_crc": bad, "skipped": skipped, "table": table, "table_ok": ok}


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text stored as MPEG audio."""
    session(docs)
    schema = "doc_id long, n_bytes long, media binary"

    def run(batches):
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            yield arrow(schema, doc_id=batch.column("doc_id").to_pylist(), n_bytes=[len(b) for b in bodies], media=[encode(payload(b)) for b in bodies])

    return as_bytes(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_ms double, frames long, bad_crc long, skipped long, seek array<long>"


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes say: payload digests, exact duration, checksums and every frame's offset."""
    session(media)

    def run(batches):
        for batch in batches:
            stored = batch.column("media").to_pylist()
            out: dict[str, list] = {x.split()[0]: [] for x in _FEATURES.split(", ")}
            out["doc_id"], out["n_bytes"] = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist()
            for m in stored:
                x = decode(m or b"")
                p = x["payload"]
                ms = 1000 * x["samples"] / x["rate"] if x["rate"] else 0.0
                out["payload_bytes"].append(len(p))
                out["payload_sha256"].append(hashlib.sha256(p).hexdigest())
                out["tail_crc32"].append(zlib.crc32(p[-64:]))
                out["media_bytes"].append(len(m or b""))
                out["media_sha256"].append(hashlib.sha256(m or b"").hexdigest())
                vbr = "none" if x["table"] is None else "ok" if x["table_ok"] else "wrong"
                out["feature"].append(f"frames={len(x['offsets'])};samples={x['samples']};rate={x['rate']};ms={ms!r};vbr={vbr};bad_crc={x['bad_crc']};skipped={x['skipped']}")
                out["duration_ms"].append(ms)
                out["frames"].append(len(x["offsets"]))
                out["bad_crc"].append(x["bad_crc"])
                out["skipped"].append(x["skipped"])
                out["seek"].append(x["offsets"])
            yield arrow(_FEATURES, **out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _FEATURES)


def op7_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    return media_features(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")))
