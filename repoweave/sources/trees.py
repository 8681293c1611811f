"""File trees as a Spark data source.

    trees.register(spark)
    files = spark.read.format("file_tree").option("path", "/data/repositories").load()

A scan is planned on the driver by listing folders from the root down until there are enough of them for
the wanted number of splits; each split then walks its folders in a task.  A file is opened only if its
``bytes`` are asked for and no filter on repository, path, size or time has dropped it: filters are pushed
down to the walk, and a scan whose schema has no ``bytes`` opens nothing.

``corpus.scan_tree`` lists the same files as a job per level, which also splits what lies below one
folder; it suits trees with most files in few folders.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

SCHEMA = "repo_id string, path string, size bigint, mtime timestamp, bytes binary, read_error string"
#: What a scan that opens no file can give.
LISTING = "repo_id string, path string, size bigint, mtime timestamp"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Splits that a scan is planned for, unless the option ``splits`` says otherwise.
SPLITS = 256
#: Rows, and bytes of content, after which a batch is passed on.
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20

_ARROW = {
    "repo_id": pa.string(), "path": pa.string(), "size": pa.int64(), "mtime": pa.timestamp("us", "UTC"),
    "bytes": pa.binary(), "read_error": pa.string(),
}
_COMPARE = {
    D.EqualTo: lambda a, b: a == b, D.EqualNullSafe: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b,
    D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b,
    D.In: lambda a, b: a in b, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith,
    D.StringContains: lambda a, b: b in a,
}
_TESTED = ("repo_id", "path", "size", "mtime")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark hand filters to it."""
    spark.dataSource.register(FileTree)
    spark.conf.set(PUSHDOWN, "true")


class FileTree(D.DataSource):
    """Options: ``path`` (root), ``repo_id`` (the whole root is one repository; else its folders are),
    ``prune`` (names of folders that are not listed below a repository's root, comma-separated),
    ``splits`` and ``max_bytes`` (a larger file is not read; ``read_error`` says so)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        unknown = [n for n in schema.names if n not in _ARROW]
        if unknown or not self.options.get("path"):
            raise ValueError(f"a file tree has no columns {unknown}" if unknown else "option path is missing")
        return TreeReader(dict(self.options), schema.names, self.open_store)

    @staticmethod
    def open_store(root: str):
        """The file system of a root and the root's path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(root)


@dataclass
class Split(D.InputPartition):
    """Folders that are walked whole, and folders of which only the files are taken."""

    whole: list[str]
    flat: list[str]


@dataclass
class _Test:
    """A pushed filter: column, comparison, value, and whether it is negated."""

    column: str
    kind: type
    value: object
    negated: bool = False

    def holds(self, value) -> bool:
        return bool(_COMPARE[self.kind](value, self.value)) != self.negated


def _test_of(given: D.Filter) -> _Test | None:
    negated = isinstance(given, D.Not)
    inner = given.child if negated else given
    column = getattr(inner, "attribute", ())
    if type(inner) not in _COMPARE or len(column) != 1 or column[0] not in _TESTED:
        return None
    value = tuple(inner.value) if isinstance(inner, D.In) else inner.value
    if value is None or isinstance(value, tuple) and None in value:
        return None
    if column[0] == "mtime":
        micros = lambda x: x.replace(tzinfo=x.tzinfo or timezone.utc) if isinstance(x, datetime) else None
        value = tuple(map(micros, value)) if isinstance(value, tuple) else micros(value)
        if value is None or isinstance(value, tuple) and None in value:
            return None
    return _Test(column[0], type(inner), value, negated)


class TreeReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str], open_store):
        self.root, self.names, self.open_store = options["path"], names, open_store
        self.repo_id = options.get("repo_id")
        self.prune = frozenset(filter(None, options.get("prune", "").split(",")))
        self.splits = max(1, int(options.get("splits", SPLITS)))
        self.max_bytes = int(options["max_bytes"]) if "max_bytes" in options else None
        self.tests: list[_Test] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for given in filters:
            test = _test_of(given)
            if test:
                self.tests.append(test)
            elif not (isinstance(given, D.IsNotNull) and given.attribute in [(n,) for n in _TESTED]):
                yield given

    def _listed(self, store, folder: str):
        """(folders, files) of one folder; pipes, devices and links are neither."""
        from pyarrow import fs

        try:
            found = store.get_file_info(fs.FileSelector(folder))
        except OSError:  # gone meanwhile, or not ours to read
            return [], []
        if isinstance(store, fs.LocalFileSystem):
            found = [f for f in found if not os.path.islink(f.path)]
        folders = [f.path for f in found if f.type == fs.FileType.Directory]
        return folders, [f for f in found if f.type == fs.FileType.File]

    def _open(self):
        store, base = self.open_store(self.root)
        return store, base.rstrip("/")

    def _below(self, base: str, folder: str, folders: list[str]) -> list[str]:
        """Folders that are walked: any name may be a repository's, pruned names only lie below one."""
        if folder == base:
            if self.repo_id:
                return [f for f in folders if f.rpartition("/")[2] not in self.prune]
            return [f for f in folders if self._passes("repo_id", f.rpartition("/")[2])]
        return [f for f in folders if f.rpartition("/")[2] not in self.prune]

    def _passes(self, column: str, value) -> bool:
        return all(t.holds(value) for t in self.tests if t.column == column)

    def partitions(self) -> list[Split]:
        """Folders dealt to splits; listed level by level while there are fewer than splits."""
        store, base = self._open()
        flat, level = [], [base]
        while level and len(level) < self.splits:
            deeper = []
            for folder in level:
                folders, _ = self._listed(store, folder)
                deeper += self._below(base, folder, folders)
            flat += level
            level = deeper
        deal = lambda i: Split(sorted(level)[i :: self.splits], sorted(flat)[i :: self.splits])
        return [s for s in map(deal, range(self.splits)) if s.whole or s.flat] or [Split([], [])]

    def _files(self, store, base: str, split: Split):
        for folder in split.flat:
            yield from self._listed(store, folder)[1]
        waiting = list(split.whole)
        while waiting:
            folder = waiting.pop()
            folders, files = self._listed(store, folder)
            waiting += self._below(base, folder, folders)
            yield from files

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, base = self._open()
        wanted = "bytes" in self.names or "read_error" in self.names
        schema = pa.schema([(n, _ARROW[n]) for n in self.names])
        rows, held = {n: [] for n in _ARROW}, 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(rows[n], _ARROW[n]) for n in self.names], schema=schema)

        for file in self._files(store, base, split):
            relative = file.path[len(base) + 1 :]
            repo, _, path = ("", "", relative) if self.repo_id else relative.partition("/")
            micros = (file.mtime_ns or 0) // 1000
            row = {"repo_id": self.repo_id or repo, "path": path, "size": file.size or 0, "mtime": _time(micros)}
            if not path or not all(t.holds(row[t.column]) for t in self.tests):
                continue
            row["bytes"], row["read_error"] = self._read(store, file.path, row["size"]) if wanted else (None, None)
            for name, value in row.items():
                rows[name].append(value)
            held += len(row["bytes"] or b"")
            if held >= BATCH_BYTES or len(rows["path"]) >= BATCH_ROWS:
                yield batch()
                rows, held = {n: [] for n in _ARROW}, 0
        if rows["path"]:
            yield batch()

    def _read(self, store, at: str, size: int) -> tuple[bytes | None, str | None]:
        if self.max_bytes is not None and size > self.max_bytes:
            return None, "too large"
        try:
            with store.open_input_stream(at, compression=None) as stream:
                return stream.read(), None
        except OSError as reason:
            return None, str(reason) or type(reason).__name__


def _time(micros: int) -> datetime:
    seconds, rest = divmod(micros, 1_000_000)
    return datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=rest)
