"""The range-request source against a local server that serves ranges, and fails now and then."""

import io
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from tidemark.sources import ranged, tiff


@pytest.fixture(scope="module")
def served():
    rng = np.random.default_rng(1)
    files = {f"img/{k:02}.tif": tiff.encode(rng.normal(size=(2, 6, 5)).astype("f4")) for k in range(6)} | {"readme.txt": b"x", "top.tif": b"y", "img/big.bin": rng.bytes(200_000)}
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("img")
        for n, b in files.items():
            z.writestr(n, b)
    data, failures = box.getvalue(), {"next": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            if failures["next"]:
                failures["next"] -= 1
                self.send_error(503)
                return
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            self.send_response(206)
            self.send_header("Content-Length", str(b - a + 1))
            self.end_headers()
            self.wfile.write(data[a : b + 1])

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/a.zip", data, files, failures
    server.shutdown()


def test_seek_and_read(served):
    url, data, _, failures = served
    f = ranged.HttpRange(url, block=1000)
    assert f.size == len(data) and f.seekable() and f.readable()
    for at, n in ((0, 10), (5, 3), (990, 40), (len(data) - 5, 50), (len(data) + 9, 4)):
        f.seek(at)
        got = b""
        while len(got) < n and (more := f.read(n - len(got))):
            got += more
        assert got == data[at : at + n]
    f.seek(-7, io.SEEK_END)
    assert f.read(7) == data[-7:] and f.tell() == len(data)
    before = f.requests
    f.seek(len(data) - 5)
    assert f.read(3) == data[-5:-2] and f.requests == before  # the held block serves it
    failures["next"] = 2
    f.seek(0)
    assert f.read(4) == data[:4]
    failures["next"] = 3
    f.seek(5000)
    with pytest.raises(OSError):
        f.read(4)
    failures["next"] = 0


def test_names_and_selection(served):
    url, _, files, _ = served
    found = ranged.names(url)
    assert sorted(found) == sorted(files)
    assert ranged.selected(found, ".tif", 4) == [f"img/{k:02}.tif" for k in range(4)] and "top.tif" not in ranged.selected(found)


def test_archive_as_rows(spark, served):
    url, data, files, _ = served
    rows = ranged.read_archive(spark, url, suffix=".tif", most="5", block="4096").collect()
    assert {r.name: bytes(r.content) for r in rows} == {f"img/{k:02}.tif": files[f"img/{k:02}.tif"] for k in range(5)}
    assert all(0 < r.bytes_read < len(data) and r.requests >= 1 for r in rows)  # the large member is never fetched
    found = ranged.read_archive(spark, url).select("name", "content")
    pixels = tiff.pixels(found)
    assert pixels.count() == 6 * 30
    want = tiff.decode(files["img/02.tif"])
    got = pixels.where("name = 'img/02.tif' and row = 3 and col = 4").first()
    assert (np.float32(got.vv), np.float32(got.vh)) == (want[0, 3, 4], want[1, 3, 4])
