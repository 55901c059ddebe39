"""Token shards as NumPy files of unsigned 16-bit numbers: reading and writing, a file a partition."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class NpyReader(DataSourceReader):
    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[InputPartition]:
        p = self.path if any(c in self.path for c in "*?[") else os.path.join(self.path, "*.npy")
        return [_File(x) for x in sorted(glob.glob(p))] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.path:
            a = np.load(partition.path, mmap_mode="r")
            for at in range(0, len(a), self.chunk):
                yield partition.path, at, a[at : at + self.chunk].astype(np.int32).tolist()


class _Done(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class NpyWriter(DataSourceWriter):
    """Rows of a partition become one shard, in order; files get their names on commit."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        parts = [np.asarray(r.tokens, dtype=np.uint16) for r in rows if r.tokens]
        if not parts:
            return _Done(None)
        os.makedirs(self.path, exist_ok=True)
        tmp = os.path.join(self.path, f".part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tmp")
        with open(tmp, "wb") as f:
            np.save(f, np.concatenate(parts))
        return _Done(tmp)

    def commit(self, messages) -> None:
        for i, m in enumerate(sorted(x.path for x in messages if x is not None and x.path)):
            os.replace(m, os.path.join(self.path, f"shard_{i:05d}.npy"))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, start long, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("chunk", 1 << 16)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NpyWriter(self.options["path"])
