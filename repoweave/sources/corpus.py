"""The file table: ``repo_id, path, size, mtime, content``, one row per file.

``scan_tree`` lists directories of repositories and ``with_bytes`` reads the
files that are still wanted; ``from_table`` takes a table that already holds
files.  Spark's own file sources skip names that start with a dot, which here
are files like any other (``.gitignore``, ``.env``), so the tree is listed and
read in tasks through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoweave.sources.scratch import written

FILE_COLUMNS = ["repo_id", "path", "size", "mtime", "content"]
READ_BATCH_BYTES = 32 * 1024 * 1024


def scan_tree(
    spark: SparkSession, root: str, repo_id: str | None = None, modified_after: str | None = None,
    prune: Iterable[str] = (),
) -> DataFrame:
    """Every regular file below ``root`` with size and time; no content is read.

    The first directory level names the repository, unless ``repo_id`` makes the
    whole root one.  Directories are listed level by level, each level in
    parallel; symbolic links are not followed.  Directories below a repository's
    root with a name in ``prune`` are not listed, so their files do not appear.
    """
    pruned = set(prune)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch["at"]:
                try:
                    found = store.get_file_info(fs.FileSelector(folder))
                except OSError:  # gone meanwhile, or not ours to read
                    found = []
                if isinstance(store, fs.LocalFileSystem):
                    found = [f for f in found if not os.path.islink(f.path)]
                # Pipes, sockets and devices would block a reader.
                found = [f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)]
                if not found:
                    continue
                yield pd.DataFrame({
                    "at": [f.path for f in found],
                    "is_directory": [f.type == fs.FileType.Directory for f in found],
                    "size": [f.size or 0 for f in found],
                    "micros": [(f.mtime_ns or 0) // 1000 for f in found],
                })

    base = _path_in_store(root)
    level = spark.createDataFrame([(base,)], "at string")
    files = []
    while True:
        spread_level = level.repartition(spark.sparkContext.defaultParallelism)
        listed = written(
            spread_level.mapInPandas(entries, "at string, is_directory boolean, size bigint, micros bigint"),
            "listing",
        )
        files.append(listed.where(~F.col("is_directory")))
        level = listed.where("is_directory").select("at")
        # The first level names repositories, whatever they are called, unless the root is one.
        if pruned and (repo_id or len(files) > 1):
            level = level.where(~F.substring_index("at", "/", -1).isin(*pruned))
        if level.isEmpty():
            break
    relative = F.substring(F.col("at"), F.lit(len(base) + 2), F.length("at"))
    owner = F.lit(repo_id) if repo_id else F.substring_index(relative, "/", 1)
    path = relative if repo_id else F.substring(relative, F.length(owner) + 2, F.length(relative))
    table = reduce(DataFrame.unionByName, files).select(
        owner.alias("repo_id"), path.alias("path"), "size",
        F.timestamp_micros("micros").alias("mtime"), F.lit(root).alias("root"), "at",
    )
    if modified_after:
        table = table.where(F.col("mtime") >= F.to_timestamp(F.lit(modified_after)))
    return table.where(F.col("path") != "")


def _path_in_store(root: str) -> str:
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)[1].rstrip("/")


def with_bytes(listing: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``listing`` (of ``scan_tree``, filtered or not) with the ``bytes`` of each file.

    A file that is gone, cannot be read or is larger than ``max_bytes`` has null bytes, and
    ``read_error`` says why; the others go on.
    """
    names = [c for c in listing.columns if c not in ("root", "at")]

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        stores: dict[str, object] = {}
        for batch in batches:
            start, held, texts, errors = 0, 0, [], []
            for i, (root, at) in enumerate(zip(batch["root"], batch["at"])):
                if root not in stores:
                    stores[root] = fs.FileSystem.from_uri(root)[0]
                data, error = None, None
                if max_bytes is not None and batch["size"].iloc[i] > max_bytes:
                    error = "too large"
                else:
                    try:
                        with stores[root].open_input_stream(at, compression=None) as stream:
                            data = stream.read()
                    except OSError as reason:
                        error = str(reason) or type(reason).__name__
                texts.append(data)
                errors.append(error)
                held += len(data or b"")
                if held >= READ_BATCH_BYTES or i + 1 == len(batch):
                    yield batch.iloc[start:i + 1][names].assign(bytes=texts, read_error=errors)
                    start, held, texts, errors = i + 1, 0, [], []

    schema = listing.select(*names).schema.add("bytes", T.BinaryType()).add("read_error", T.StringType())
    return listing.repartition("repo_id", "path").mapInPandas(contents, schema)


def scan_stats(files: DataFrame) -> DataFrame:
    """Path, size and time only; a stored content column is pruned from the scan."""
    return files.select("repo_id", "path", "size", "mtime")


def read_text(files: DataFrame) -> DataFrame:
    """Bytes as UTF-8 text; invalid sequences become U+FFFD and are flagged.

    Files that could not be read are left out.
    """
    raw = F.col("bytes").cast("string") if "bytes" in files.columns else F.col("content")
    if "read_error" in files.columns:
        files = files.where("read_error is null")
    return files.select(
        "repo_id", "path", "size", "mtime",
        F.make_valid_utf8(raw).alias("content"), F.is_valid_utf8(raw).alias("is_valid_utf8"),
    )


def reader(max_bytes: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """What reads the texts of listed files, for ``flow.from_listing``."""
    return lambda listing: read_text(with_bytes(listing, max_bytes))


def from_table(table: DataFrame) -> DataFrame:
    """Files from a table with at least ``repo_id``, ``path`` and ``content``."""
    size = F.col("size") if "size" in table.columns else F.octet_length("content")
    mtime = F.col("mtime") if "mtime" in table.columns else F.lit(None)
    return table.select(
        "repo_id", "path", size.cast("bigint").alias("size"),
        mtime.cast("timestamp").alias("mtime"), "content",
    )


def within_depth(files: DataFrame, max_depth: int) -> DataFrame:
    """Files at most ``max_depth`` directories below the root."""
    return files.where(F.size(F.split("path", "/", -1)) - 1 <= max_depth)


def picked(files: DataFrame, picks: DataFrame) -> DataFrame:
    """Only the files a caller picked, as ``repo_id, path``: the batch form of choosing by hand."""
    return files.join(picks.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` over all cores where its files give fewer splits than there are cores.

    A large table has many splits and passes through without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, *keys) if table.rdd.getNumPartitions() < cores else table
