"""Python data source for crawl archives (WARC and WET), plain or gzipped, one file per partition.

``spark.dataSource.register(WarcDataSource)``; then
``spark.read.format("warc").load("dir/*.warc.gz")`` gives ``url, warc_type, payload, path``.  A
broken record becomes a row of type ``broken`` with what could be read of it, so that a count by path and
type tells how much was lost; reading goes on at the next record.
"""

from __future__ import annotations

import glob
import gzip
import io
import itertools
import re
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, warc_type string, payload binary, path string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _lines(f) -> Iterator[bytes]:
    """The lines of a file up to where its compression breaks."""
    try:
        yield from f
    except (EOFError, OSError, zlib.error):
        yield b""


def records(path: str) -> Iterator[tuple[str | None, str | None, bytes, str]]:
    """The records of one archive, broken ones as type ``broken``."""
    with open(path, "rb") as raw:
        zipped = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        yield from _records(gzip.open(raw) if zipped else raw, path)


def _records(f, path: str) -> Iterator[tuple[str | None, str | None, bytes, str]]:
    lost: list[bytes] = []  # lines that belong to no whole record
    lines = _lines(f)
    line = next(lines, None)
    while line is not None:
        if not line.startswith(b"WARC/"):
            if line.strip() or not line:
                lost.append(line)
            line = next(lines, None)
            continue
        if lost:
            yield None, "broken", b"".join(lost), path
            lost = []
        begin = [line]
        head: dict[str, str] = {}
        for line in lines:
            if line in (b"", b"\r\n", b"\n") or line.startswith(b"WARC/"):
                break
            begin.append(line)
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        else:
            line = b""
        size = head.get("content-length", "")
        if line.startswith(b"WARC/") or not size.isdecimal():
            lost = begin
            line = line if line.startswith(b"WARC/") else next(lines, None)
            continue
        n, body, got = int(size), [], 0
        whole = True
        while got < n:
            line = next(lines, None)
            if not line:
                whole = False
                break
            body.append(line)
            got += len(line)
        data = b"".join(body)
        # A body that is too long or cut off: the next record's head is inside it, or the end came early.
        inner = re.search(rb"(?:^|\n)WARC/1\.\d\r?\n(?:[\w-]+:)", data) if not whole or data[n:].strip() else None
        if inner:
            at = inner.start() + (data[inner.start() : inner.start() + 1] == b"\n")
            yield head.get("warc-target-uri"), "broken", data[:at], path
            yield from _records(itertools.chain(io.BytesIO(data[at:]), [line] if line and not body else [], lines), path)
            return
        if not whole:
            yield head.get("warc-target-uri"), "broken", data, path
            return
        data = data[:n]
        if head.get("warc-type") == "response" and data[:5] == b"HTTP/":
            data = data.partition(b"\r\n\r\n")[2]
        yield head.get("warc-target-uri"), head.get("warc-type"), data, path
        line = next(lines, None)
    if lost:
        yield None, "broken", b"".join(lost), path


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.path))] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.path:
            yield from records(partition.path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"])
