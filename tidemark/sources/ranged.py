"""Members of a remote ZIP archive as rows, without fetching the archive: a data source over HTTP range requests.

The driver reads the archive's directory only, one task reads one member at a time, and each reads the byte ranges it
needs in blocks. (The 7z archives of the published data set need a reader that this environment does not have; the ranges,
the selection and the statistics are the same.)
"""

from __future__ import annotations

import io
import urllib.request
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, ATTEMPTS = 20 << 20, 3


class HttpRange(io.RawIOBase):
    """A seekable file of a URL: the last block stays in memory, a failed request is tried again, bytes and requests are counted."""

    def __init__(self, url: str, size: int | None = None, block: int = BLOCK, attempts: int = ATTEMPTS):
        self.url, self.block, self.attempts = url, block, attempts
        self.at, self.held, self.first = 0, b"", 0
        self.bytes_read = self.requests = 0
        self.size = size if size is not None else self._length()

    def _length(self) -> int:
        with urllib.request.urlopen(urllib.request.Request(self.url, method="HEAD"), timeout=60) as r:  # noqa: S310
            return int(r.headers["Content-Length"])

    def _fetch(self, first: int, last: int) -> bytes:
        ask = urllib.request.Request(self.url, headers={"Range": f"bytes={first}-{last}"})
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(ask, timeout=60) as r:  # noqa: S310
                    if r.status != 206:
                        raise OSError(f"{self.url} does not serve ranges (status {r.status})")
                    data = r.read()
                if len(data) != last - first + 1:
                    raise OSError(f"{len(data)} bytes of {last - first + 1}")
                self.requests += 1
                self.bytes_read += len(data)
                return data
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
        raise AssertionError

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.at)
        if n <= 0:
            return 0
        if not self.first <= self.at < self.first + len(self.held):
            self.held = self._fetch(self.at, min(self.size, self.at + self.block) - 1)
            self.first = self.at
        part = self.held[self.at - self.first :][:n]
        buffer[: len(part)] = part
        self.at += len(part)
        return len(part)


def names(url: str, block: int = BLOCK) -> list[str]:
    """The archive's members, directories left out."""
    with zipfile.ZipFile(io.BufferedReader(HttpRange(url, block=block))) as z:
        return [i.filename for i in z.infolist() if not i.is_dir()]


def selected(found: list[str], suffix: str = ".tif", most: int | None = None) -> list[str]:
    """Of the names those in a folder with the suffix, in order, the first `most` of them."""
    return sorted(n for n in found if n.endswith(suffix) and "/" in n)[:most]


class _Member(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.suffix, self.block = options["url"], options.get("suffix", ".tif"), int(options.get("block", BLOCK))
        self.most = int(options["most"]) if "most" in options else None

    def partitions(self) -> list[_Member]:
        return [_Member(n) for n in selected(names(self.url, self.block), self.suffix, self.most)]

    def read(self, partition: _Member) -> Iterator[tuple]:
        remote = HttpRange(self.url, block=self.block)
        with zipfile.ZipFile(io.BufferedReader(remote)) as z:
            content = z.read(partition.name)
        yield partition.name, content, remote.bytes_read, remote.requests


class ArchiveSource(DataSource):
    """Options: url; suffix (.tif), most (of the names in order), block (bytes of a request)."""

    @classmethod
    def name(cls) -> str:
        return "ranged_zip"

    def schema(self) -> str:
        return "name string, content binary, bytes_read long, requests long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_archive(spark: SparkSession, url: str, **options) -> DataFrame:
    """name, content, and the bytes and requests it took, a row per selected member."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("ranged_zip").options(url=url, **options).load()
