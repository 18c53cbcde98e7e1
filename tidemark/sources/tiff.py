"""TIFF rasters as relations: pixels of two bands, masks, and what the tags say (shape, geotransform, geo tags).

Classic TIFF of either byte order, in strips or tiles, bands interleaved or apart, plain, deflated or LZW, with the horizontal
predictor for integers or that for floats. Other encodings raise. A file's stored blocks (strips, tiles) are cut out of its bytes,
written to the shared folder and dealt to tasks by their pixels before they are decoded, so a scene is decoded by many tasks, each
holding a block; lines that are not wanted are left out before that. How many files' bytes a batch brings is spark.sql.execution.arrow.maxBytesPerBatch, for the session to set.

Files are written by strips as well: tasks pack a strip's lines, and a file is its strips one after the other behind a header that
names the place of the directory, so it is streamed, never held. Files appear under their names when the job has ended well.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.functions import scalar as S
from tidemark.plans.lineage import written

#: Pixels that a task decodes or stores about. Packed bytes say little of them: a plain mask is a thousandth of its pixels.
PIXELS_A_TASK = 1 << 18

# Fixed values of the format: field types with their sizes, sample formats, geo tags.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
SAMPLES = {1: "u", 2: "i", 3: "f"}
GEO_TAGS = {33550: "pixel_scale", 33922: "tiepoint", 34264: "transformation", 34735: "geo_keys", 34736: "geo_doubles", 34737: "geo_ascii"}
IDENTITY = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)

PIXELS = "name string, row int, col int, vv float, vh float"
MASKS = "name string, row int, col int, y int"
INFO = "name string, height int, width int, bands int, dtype string, gt struct<ox:double,rx:double,kx:double,oy:double,ky:double,ry:double>, tags map<string,string>"


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's values by tag; unknown field types are left out."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for entry in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in FIELDS:
            continue
        code = order + (f"{count}s" if kind == 2 else f"{count}{FIELDS[kind]}")
        where = entry + 8 if struct.calcsize(code) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        found[tag] = struct.unpack_from(code, data, where)
    return order, found


class Layout(NamedTuple):
    """How a file stores its pixels: blocks of high x wide, `across` in a row of blocks."""

    dtype: str
    bands: int
    height: int
    width: int
    high: int
    wide: int
    apart: bool
    packing: int
    predictor: int
    across: int
    down: int
    offsets: tuple
    counts: tuple


def layout(data: bytes) -> Layout:
    order, t = tags(data)
    one = lambda tag, default: t.get(tag, (default,))[0]
    width, height, bands = one(256, 0), one(257, 0), one(277, 1)
    bits, predictor, packing = set(t.get(258, (1,))), one(317, 1), one(259, 1)
    kind = SAMPLES.get(one(339, 1))
    known = len(bits) == 1 and next(iter(bits)) in (8, 16, 32, 64) and kind is not None and packing in (1, 5, 8, 32946) and (predictor == 1 or (predictor == 2 and kind != "f") or (predictor == 3 and kind == "f"))
    if not known:
        raise ValueError(f"unsupported TIFF encoding: bits {sorted(bits)}, format {one(339, 1)}, compression {packing}, predictor {predictor}")
    if 324 in t:
        wide, high, offsets, counts = one(322, 0), one(323, 0), t[324], t[325]
    else:
        wide, high, offsets, counts = width, min(one(278, height), height), t.get(273, ()), t.get(279, ())
    across, down = -(-width // wide) if wide else 0, -(-height // high) if high else 0
    return Layout(f"{order}{kind}{next(iter(bits)) // 8}", bands, height, width, high, wide, one(284, 1) == 2, packing, predictor, across, down, offsets, counts)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, highest bit first, 256 to begin anew, 257 to end, widths growing one code early."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, None
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = single.copy(), 9, None
            continue
        if last is None:
            now = single[code]
        else:
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(now)
        last = now
    return b"".join(out)


def block(parts: list[bytes], dtype: str, bands: int, wide: int, apart: bool, packing: int, predictor: int) -> np.ndarray:
    """The pixels (bands, lines, wide) of a stored block: one part, or a part per band where bands lie apart."""
    kind, inner = np.dtype(dtype), 1 if apart else bands
    out = []
    for raw in parts:
        raw = raw if packing == 1 else unpacked_lzw(raw) if packing == 5 else zlib.decompress(raw)
        line = wide * inner
        if predictor == 3:  # a line's bytes lie by significance, highest first, as differences
            n = len(raw) // (line * kind.itemsize)
            planes = np.frombuffer(raw, np.uint8, n * line * kind.itemsize).reshape(n, -1, inner)
            planes = np.cumsum(planes, 1, dtype=np.uint8).reshape(n, kind.itemsize, line)
            values = np.ascontiguousarray(np.moveaxis(planes, 1, 2)).view(kind.newbyteorder(">")).reshape(n, wide, inner)
        else:
            values = np.frombuffer(raw, kind, len(raw) // kind.itemsize // line * line).reshape(-1, wide, inner)
            if predictor == 2:
                values = np.cumsum(values, 1, dtype=kind.newbyteorder("="))
        out.append(np.moveaxis(values, 2, 0).astype(kind.newbyteorder("=")))
    return np.concatenate(out) if len(out) > 1 else out[0]


def blocks(data: bytes, rows: tuple[int, int] | None = None):
    """First row, first column and parts of every stored block that has lines of `rows` (first, last)."""
    t = layout(data)
    for place in range(t.across * t.down):
        r, c = place // t.across * t.high, place % t.across * t.wide
        if rows is None or (r <= rows[1] and r + t.high > rows[0]):
            which = range(place, len(t.offsets), t.across * t.down) if t.apart else (place,)
            yield r, c, [bytes(data[t.offsets[i] : t.offsets[i] + t.counts[i]]) for i in which]


def decode(data: bytes) -> np.ndarray:
    """The raster as (bands, height, width)."""
    t = layout(data)
    out = np.zeros((t.bands, t.height, t.width), np.dtype(t.dtype).newbyteorder("="))
    for r, c, parts in blocks(data):
        found = block(parts, t.dtype, t.bands, t.wide, t.apart, t.packing, t.predictor)
        h, w = min(found.shape[1], t.high, t.height - r), min(t.wide, t.width - c)
        out[:, r : r + h, c : c + w] = found[:, :h, :w]
    return out


def geotransform(t: dict[int, tuple]) -> tuple[float, ...] | None:
    """ox, rx, kx, oy, ky, ry of the transformation tag, else of scale and tie point; the identity counts as none."""
    m, scale, tie = t.get(34264), t.get(33550), t.get(33922)
    if m and len(m) >= 16:
        gt = tuple(float(m[i]) for i in (3, 0, 1, 7, 4, 5))
    elif scale and tie and len(tie) >= 6:
        gt = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1])
    else:
        return None
    return None if gt == IDENTITY else gt


def packed_strip(lines: np.ndarray) -> bytes:
    """A deflated strip of (bands, lines, width), bands interleaved, low byte first."""
    kind = lines.dtype.newbyteorder("<")
    return zlib.compress(np.ascontiguousarray(np.moveaxis(lines, 0, 2)).astype(kind).tobytes(), 1)


def header(strips: int) -> bytes:
    """The beginning of a file whose strips have so many bytes in all: the directory comes after them."""
    return b"II" + struct.pack("<HI", 42, 8 + strips + strips % 2)


def directory(sizes: list[int], shape: tuple[int, int, int], dtype: np.dtype, lines: int, gt: tuple[float, ...] | None = None) -> bytes:
    """The end of a file of (bands, height, width) after strips of these sizes, of `lines` lines each."""
    n, height, width = shape
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    total = sum(sizes)
    offsets = (8 + np.cumsum([0, *sizes])[:-1]).tolist()
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8 * dtype.itemsize] * n), (259, 3, [8]), (273, 4, offsets), (277, 3, [n]), (278, 4, [lines]), (279, 4, sizes), (284, 3, [1]), (339, 3, [kind] * n)]
    if gt:
        ox, rx, kx, oy, ky, ry = gt
        fields.append((34264, 12, [rx, kx, 0.0, ox, ky, ry, 0.0, oy, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    at = 8 + total + total % 2
    entries, far = b"", b""
    for tag, code, values in fields:
        raw = struct.pack(f"<{len(values)}{FIELDS[code]}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + 2 + 12 * len(fields) + 4 + len(far))
        far += raw + bytes(len(raw) % 2) if len(raw) > 4 else b""
        entries += struct.pack("<HHI", tag, code, len(values)) + place
    return bytes(total % 2) + struct.pack("<H", len(fields)) + entries + bytes(4) + far


def encode(bands: np.ndarray, gt: tuple[float, ...] | None = None, lines: int = 1) -> bytes:
    """A little-endian TIFF of (bands, height, width) in deflated strips, bands interleaved, with a transformation tag."""
    strips = [packed_strip(bands[:, r : r + lines]) for r in range(0, bands.shape[1], lines)]
    sizes = [len(x) for x in strips]
    return header(sum(sizes)) + b"".join(strips) + directory(sizes, bands.shape, bands.dtype, lines, gt)


def encoded(pixels: DataFrame, bands: list[str], scenes: DataFrame | None = None) -> DataFrame:
    """name and content: a float32 TIFF per scene, every pixel present. A file is one scene, so a task holds one scene at a time.

    scenes: scene and gt (null: none), where files are to carry a geotransform.
    """
    df = pixels.select(F.col("scene").cast("string").alias("name"), "row", "col", *bands)
    gt = scenes.select(F.col("scene").cast("string").alias("name"), "gt") if scenes is not None else pixels.sparkSession.createDataFrame([], "name string, gt struct<ox:double>")

    def run(key, left, right):
        h, w = int(left["row"].max()) + 1, int(left["col"].max()) + 1
        out = np.zeros((len(bands), h, w), np.float32)
        for i, b in enumerate(bands):
            out[i, left["row"], left["col"]] = left[b]
        t = right["gt"].iloc[0] if len(right) else None
        return pd.DataFrame({"name": [key[0]], "content": [encode(out, tuple(t[k] for k in ("ox", "rx", "kx", "oy", "ky", "ry")) if t else None)]})

    return df.groupBy("name").cogroup(gt.groupBy("name")).applyInPandas(run, "name string, content binary") if scenes is not None else df.groupBy("name").applyInPandas(lambda key, left: run(key, left, ()), "name string, content binary")


# --- files of a folder, written by strips

_STRIPS = "name string, strip int, height int, width int, content binary"


def strips(pixels: DataFrame, bands: list[str], dtype: str = "f4", lines: int = 64) -> DataFrame:
    """Packed strips of so many lines of every scene: name, strip, height and width (of the scene), content. A task fills a strip at a time.

    Pixels that are missing are 0; of several pixels in one place any counts; values beyond the type are cut to it.
    """
    kind = np.dtype(dtype)
    df = pixels.select(F.col("scene").cast("string").alias("name"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *(F.col(b).cast("double").alias(f"v{i}") for i, b in enumerate(bands)))
    size = df.groupBy("name").agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))
    every = size.withColumn("strip", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / lines).cast("int"))))

    def run(batches):
        now, out = (), None  # name, strip, height and width of the strip that is being filled

        for batch in batches:
            done = []
            strip, row, col = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("strip", "row", "col"))
            heads = np.flatnonzero(batch.column("height").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *heads], [*heads, batch.num_rows]):
                if a >= 0:
                    if now:
                        done.append((*now, packed_strip(out)))
                    now = tuple(batch.column(c)[a].as_py() for c in ("name", "strip", "height", "width"))
                    out = np.zeros((len(bands), min(lines, now[2] - now[1] * lines), now[3]), kind)
                part = slice(a + 1, b)
                if a + 1 == b:
                    continue
                if not now or (strip[part] != now[1]).any():
                    raise ValueError("a pixel has no place in its scene")
                at = row[part].astype(np.int64) - now[1] * lines, col[part].astype(np.int64)
                for i in range(len(bands)):
                    v = batch.column(f"v{i}")[part].fill_null(float("nan") if kind.kind == "f" else 0).to_numpy()
                    if kind.kind != "f":
                        v = np.clip(np.nan_to_num(v), np.iinfo(kind).min, np.iinfo(kind).max)
                    out[i][at] = v
            if done:
                yield _packed_rows(done)
        if now:
            yield _packed_rows([(*now, packed_strip(out))])

    pixel = [F.lit(None).cast("int").alias(c) for c in ("height", "width")]
    dealt = df.select("*", F.floor(F.col("row") / lines).cast("int").alias("strip"), *pixel).unionByName(every, allowMissingColumns=True)
    # a strip's row of `every`, with its scene's shape, comes before its pixels
    ready = dealt.repartition("name", "strip").sortWithinPartitions("name", "strip", F.col("height").isNull())
    return ready.mapInArrow(run, _STRIPS)


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"name": pa.string(), "strip": pa.int32(), "height": pa.int32(), "width": pa.int32(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds.values())], names=list(kinds))


class _Commit(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def _store(path: str):
    """File system and path of a folder by its address."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (LocalFileSystem(), path) if path.startswith("/") else FileSystem.from_uri(path)


class _Writer(DataSourceWriter):
    """Tasks stream whole files into a folder of this job; the driver moves them to their names when all have ended, or removes the folder."""

    def __init__(self, options: dict):
        self.path, self.dtype, self.bands, self.lines = options["path"], options["dtype"], int(options["bands"]), int(options["lines"])
        self.job = posixpath.join("_temporary", uuid.uuid4().hex)
        store, root = _store(self.path)
        store.create_dir(posixpath.join(root, self.job), recursive=True)

    def write(self, iterator):
        store, root = _store(self.path)
        mine = posixpath.join(root, self.job, uuid.uuid4().hex)  # an attempt's own: a second one of this task meets nothing
        store.create_dir(mine, recursive=False)  # a task that outlives its job meets no folder
        names, out, now, sizes, last = [], None, None, [], None

        def finish():
            if out is not None:
                gt = last["gt"]
                out.write(directory(sizes, (self.bands, last["height"], last["width"]), np.dtype(self.dtype), self.lines, tuple(gt) if gt else None))
                out.close()

        for row in iterator:
            if row["name"] != now:
                finish()
                now, sizes = row["name"], []
                names.append(posixpath.join(mine, f"{now}.tif"))
                out = store.open_output_stream(names[-1])
                out.write(header(row["total"]))
            out.write(bytes(row["content"]))
            sizes.append(len(row["content"]))
            last = row
        finish()
        return _Commit(names)

    def commit(self, messages):
        store, root = _store(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(name, posixpath.join(root, posixpath.basename(name)))
        self.abort(messages)

    def abort(self, messages):
        from pyarrow.fs import FileType

        store, root = _store(self.path)
        where = posixpath.join(root, self.job)
        if store.get_file_info(where).type != FileType.NotFound:
            store.delete_dir(where)
        above = posixpath.join(root, "_temporary")
        if store.get_file_info(above).type != FileType.NotFound and not store.get_file_info(_below(above)):
            store.delete_dir(above)


def _below(path: str):
    from pyarrow.fs import FileSelector

    return FileSelector(path)


class TiffSink(DataSource):
    """Sink of packed strips (name, strip, height, width, content, total, gt), sorted by name and strip within a task."""

    @classmethod
    def name(cls):
        return "tidemark_tiff"

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def write_rasters(pixels: DataFrame, bands: list[str], path: str, dtype: str = "f4", scenes: DataFrame | None = None, lines: int = 64, suffix: str = "") -> None:
    """A TIFF per scene under a folder, named by the scene and the suffix. scenes: scene and gt (null: none), where files carry a geotransform.

    A file is its strips in order: the task that writes it streams them. Scenes' names must be file names. A failed job leaves no file.
    pixels are read twice: give them written.
    """
    spark = pixels.sparkSession
    spark.dataSource.register(TiffSink)
    found = written(strips(pixels, bands, dtype, lines), "strips")
    total = found.groupBy("name").agg(F.sum(F.length("content")).alias("total"))
    if scenes is not None:
        total = total.join(scenes.select(F.col("scene").cast("string").alias("name"), F.when(F.col("gt").isNotNull(), F.array(*(F.col(f"gt.{k}") for k in ("ox", "rx", "kx", "oy", "ky", "ry")))).alias("gt")), "name", "left")
    else:
        total = total.withColumn("gt", F.lit(None).cast("array<double>"))
    ready = found.join(total, "name").withColumn("name", F.concat("name", F.lit(suffix)))
    # strips of a file meet in one task, packed; sorted, they are streamed
    high = F.least(F.lit(lines), F.col("height") - F.col("strip") * lines)
    ready = ready.repartition(_tasks(found, high.cast("long") * F.col("width")), "name").sortWithinPartitions("name", "strip")
    ready.write.format("tidemark_tiff").option("dtype", dtype).option("bands", len(bands)).option("lines", lines).mode("append").save(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """name (without folders and extension) and content of the files of a path."""
    return spark.read.format("binaryFile").load(path).select(S.base_name(F.col("path")).alias("name"), "content")


def _tasks(rows: DataFrame, pixels: Column) -> int:
    """The number of tasks for rows of so many pixels each."""
    return max(1, -(-(rows.agg(F.sum(pixels).alias("n")).first()["n"] or 0) // PIXELS_A_TASK))


_BLOCKS = "name string, row int, col int, high int, wide int, stored int, dtype string, bands int, apart boolean, packing int, predictor int, parts array<binary>"


def stored_blocks(found: DataFrame, rows: tuple[int, int] | None = None) -> DataFrame:
    """The stored blocks of files (name, content), packed as they are, dealt by name and place; rows: only blocks with lines of these (first, last).

    high and wide are the block's pixels in the raster, stored its width in the file. Blocks are written and their pixels counted, so
    that tasks are as many as these ask for: dealt by packed bytes, all pixels of many small files would meet in one task.
    """
    kinds = pa.schema([("name", pa.string()), *((c, pa.int32()) for c in ("row", "col", "high", "wide", "stored")), ("dtype", pa.string()), ("bands", pa.int32()), ("apart", pa.bool_()), ("packing", pa.int32()), ("predictor", pa.int32()), ("parts", pa.list_(pa.binary()))])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                data = memoryview(data).tobytes() if data.size < 1 << 16 else memoryview(data)
                t = layout(data)
                for r, c, parts in blocks(data, rows):
                    row = [name, r, c, min(t.high, t.height - r), min(t.wide, t.width - c), t.wide, t.dtype, t.bands, t.apart, t.packing, t.predictor, parts]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(row, kinds)], schema=kinds)

    cut = written(found.select("name", "content").mapInArrow(run, _BLOCKS), "blocks")
    return cut.repartition(_tasks(cut, F.col("high").cast("long") * F.col("wide")), "name", "row", "col")


#: Pixels that a batch of decoded lines has about.
PIXELS_AT_ONCE = 1 << 16


def _lines(found, schema, columns, rows):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                lines = block(b["parts"], b["dtype"], b["bands"], b["stored"], b["apart"], b["packing"], b["predictor"])[:, : b["high"], : b["wide"]]
                first = 0 if rows is None else max(0, rows[0] - b["row"])
                last = lines.shape[1] if rows is None else min(lines.shape[1], rows[1] - b["row"] + 1)
                step = max(1, PIXELS_AT_ONCE // max(1, b["wide"]))
                for r in range(first, last, step):
                    part = lines[:, r : min(r + step, last)]
                    h, w = part.shape[1:]
                    row = np.repeat(np.arange(r, r + h, dtype=np.int32) + b["row"], w)
                    col = np.tile(np.arange(w, dtype=np.int32) + b["col"], h)
                    yield pa.RecordBatch.from_arrays([pa.array([b["name"]] * (h * w)), pa.array(row), pa.array(col), *(pa.array(v.reshape(-1)) for v in columns(part))], names=names)

    return stored_blocks(found, rows).mapInArrow(run, schema)


def pixels(found: DataFrame, rows: tuple[int, int] | None = None) -> DataFrame:
    """name (of the file), row, col, vv and vh of two-band rasters (name, content); further bands are left out. rows: only lines first to last."""

    def columns(part):
        if len(part) < 2:
            raise ValueError("a scene has two bands")
        return part[0].astype(np.float32), part[1].astype(np.float32)

    return _lines(found, PIXELS, columns, rows)


def masks(found: DataFrame, rows: tuple[int, int] | None = None) -> DataFrame:
    """name, row, col and y, 1 where the first band is positive."""
    return _lines(found, MASKS, lambda part: ((part[0] > 0).astype(np.int32),), rows)


def bands(found: DataFrame, n: int, rows: tuple[int, int] | None = None) -> DataFrame:
    """name, row, col and b1 to bn as floats."""
    return _lines(found, "name string, row int, col int, " + ", ".join(f"b{i + 1} float" for i in range(n)), lambda part: [part[i].astype(np.float32) for i in range(n)], rows)


def read_pixels(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    return pixels(files(spark, path), rows)


def read_masks(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    return masks(files(spark, path), rows)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    return info(files(spark, path))


def unexpected_shapes(found: DataFrame, height: int = 2048, width: int = 2048) -> DataFrame:
    """Of info() the rasters of another shape than scenes should have."""
    return found.where((F.col("height") != height) | (F.col("width") != width))


def info(found: DataFrame) -> DataFrame:
    """Shape, sample type, geotransform (null without one) and geo tags of every raster; pixels aren't decoded."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, t = tags(content)
                gt = geotransform(t)
                geo = [(k, " ".join(v.decode("latin-1") if isinstance(v, bytes) else repr(v) for v in t[tag])) for tag, k in GEO_TAGS.items() if tag in t]
                kind = SAMPLES.get(t.get(339, (1,))[0], "?") + str(t.get(258, (1,))[0])
                rows.append((name, t[257][0], t[256][0], t.get(277, (1,))[0], kind, dict(zip(("ox", "rx", "kx", "oy", "ky", "ry"), gt)) if gt else None, geo))
            names, kinds = ("name", "height", "width", "bands", "dtype", "gt", "tags"), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.struct([(k, pa.float64()) for k in ("ox", "rx", "kx", "oy", "ky", "ry")]), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

    return found.mapInArrow(run, INFO)
