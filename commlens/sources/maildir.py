"""A data source of mail folders: ``spark.read.format("maildir")``.

Options: path; depth (levels of folders below it of which each folder is read by tasks of its
own, 1 by default), splits (tasks a folder, dealt by the hash of a file's path), limit (the first
files only, in the order of their paths' parts), batch_bytes (contents of one batch).

Only folders down to ``depth`` are listed where the query is planned (and, with a limit, files until it
is reached); tasks list the rest.  A file or folder that can't be read is a row with an error
and no content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from commlens.sources.stores import open_store

SCHEMA = "source_path string, length long, content binary, error string"
_ROWS = pa.schema([("source_path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


@dataclass
class Folder(InputPartition):
    """Files of one folder (below it too, if deep) whose path's hash is ``part`` of ``parts``; or those named."""

    path: str
    deep: bool
    part: int = 0
    parts: int = 1
    names: tuple[str, ...] | None = None

    def __post_init__(self):
        super().__init__(self.path)


def _parts(path: str) -> list[str]:
    return path.split("/")


def _list(store: fs.FileSystem, path: str, deep: bool = False) -> list[fs.FileInfo]:
    """What is in a folder, by the parts of the paths."""
    return sorted(store.get_file_info(fs.FileSelector(path, recursive=deep)), key=lambda f: _parts(f.path))


class MaildirReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.depth, self.splits = int(options.get("depth", 1)), int(options.get("splits", 1))
        self.limit = int(options["limit"]) if options.get("limit") is not None else None
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))

    def partitions(self) -> list[Folder]:
        store, base = open_store(self.path)
        if self.limit is not None:
            return self._first(store, base)
        plan, level = [], [base]
        for _ in range(self.depth):
            below = []
            for folder in level:
                plan.append(Folder(folder, deep=False))
                below += [f.path for f in _list(store, folder) if f.type == fs.FileType.Directory]
            level = below
        return plan + [Folder(folder, True, k, self.splits) for folder in level for k in range(self.splits)]

    def _first(self, store: fs.FileSystem, base: str) -> list[Folder]:
        """The folders of the first files, with their names: a walk in the order of the parts that stops at the limit."""
        found: dict[str, list[str]] = {}
        left = self.limit
        stack = [iter(_list(store, base))]
        while stack and left:
            f = next(stack[-1], None)
            if f is None:
                stack.pop()
            elif f.type == fs.FileType.Directory:
                stack.append(iter(_list(store, f.path)))
            else:
                found.setdefault(f.path.rpartition("/")[0], []).append(f.path)
                left -= 1
        return [Folder(folder, False, names=tuple(names)) for folder, names in found.items()]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, base = open_store(self.path)
        relative = lambda p: p[len(base) + 1 :]
        rows: list[tuple] = []
        held = 0
        try:
            paths = partition.names if partition.names is not None else [f.path for f in _list(store, partition.path, partition.deep) if f.type != fs.FileType.Directory]
        except OSError as e:
            paths = []
            if not partition.part:
                rows.append((relative(partition.path), None, None, str(e)[:500]))
        for p in paths:
            if partition.parts > 1 and zlib.crc32(p.encode("utf-8", "surrogateescape")) % partition.parts != partition.part:
                continue
            try:
                with store.open_input_stream(p, compression=None) as f:
                    data = f.read()
                rows.append((relative(p), len(data), data, None))
                held += len(data)
            except OSError as e:
                rows.append((relative(p), None, None, str(e)[:500]))
            if held >= self.batch_bytes or len(rows) == BATCH_ROWS:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


class Maildir(DataSource):
    @classmethod
    def name(cls) -> str:
        return "maildir"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MaildirReader:
        return MaildirReader(dict(self.options))
