"""One text file per repository, in hashed folders, written with a commit.

    document_files.write(documents, "/data/packed")           # repo_id, document
    document_files.write_parts(parts, "/data/packed")         # repo_id, part, key, pos, text

Rows are dealt by a hash of the repository, whose first digits name the folder, so a folder is written by
one task and holds a bounded share of all files.  A task attempt writes below a staging folder of its
own; only what the attempts that Spark counts as successful have written is moved into place, folder by
folder, when all tasks are done, and a file ``_SUCCESS`` is put last.  What failed, repeated or
speculative attempts have left goes with the staging folder.  A reader sees whole files or none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that the files are spread over; with 4,096, a hundred million files are 24,000 in each.
FOLDERS = 4096
SUCCESS = "_SUCCESS"
#: Bytes of a file name that are kept as they are; a longer one ends in a digest of the whole.
NAME_BYTES = 180
_COLUMNS = ["folder", "repo_id", "text"]


def file_name(repo_id: str | None) -> str:
    """A name that no other repository has: special characters escaped, long names cut."""
    if repo_id is None:
        return "%.md"
    name = quote(repo_id, safe=" ()+,=@~!")
    if len(name) > NAME_BYTES:
        name = re.sub(r"%[0-9A-F]?$", "", name[:NAME_BYTES]) + "%" + hashlib.sha256(repo_id.encode()).hexdigest()
    return name + ".md"


def folder_of(repo_id, folders: int = FOLDERS):
    """Column: the folder of a repository, in digits that sort."""
    return F.format_string("%04x", F.pmod(F.xxhash64(repo_id), F.lit(folders)))


class DocumentFiles(D.DataSource):
    """Options: ``path``, which must not exist.  Rows (folder, repo_id, text) of one file follow each other."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceArrowWriter:
        if overwrite:
            raise ValueError("document files are written to a new path; they replace nothing")
        if schema.names != _COLUMNS:
            raise ValueError(f"document files are written from {_COLUMNS}, not {schema.names}")
        return FilesWriter(self.options["path"], uuid4().hex)


@dataclass
class Attempt(D.WriterCommitMessage):
    """What one task attempt has written."""

    staged: str
    folders: list[str] = field(default_factory=list)
    files: int = 0


class FilesWriter(D.DataSourceArrowWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root.rstrip("/"), job

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        return store, base, f"{base}/_staging-{self.job}"

    def _attempt(self) -> str:
        task = TaskContext.get()
        return f"{task.partitionId()}-{task.taskAttemptId()}" if task else uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, _, staging = self._store()
        attempt = Attempt(f"{staging}/{self._attempt()}")
        at, stream = None, None
        try:
            for batch in iterator:
                for folder, repo, text in zip(*(batch.column(n).to_pylist() for n in _COLUMNS), strict=True):
                    if at != (folder, repo):
                        if stream:
                            stream.close()
                        if at is None or at[0] != folder:
                            store.create_dir(f"{attempt.staged}/{folder}")
                            attempt.folders.append(folder)
                        at = folder, repo
                        stream = store.open_output_stream(f"{attempt.staged}/{folder}/{file_name(repo)}")
                        attempt.files += 1
                    stream.write((text or "").encode())
        finally:
            if stream:
                stream.close()
        return attempt

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        store, base, staging = self._store()
        store.create_dir(base)
        done = [m for m in messages if m]
        taken = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path != staging]
        if taken:
            self.abort(messages)
            raise FileExistsError(f"{base} is not empty: {taken[0]}")
        for attempt in done:
            for folder in attempt.folders:
                store.move(f"{attempt.staged}/{folder}", f"{base}/{folder}")
        self.abort(messages)
        with store.open_output_stream(f"{base}/{SUCCESS}") as stream:
            stream.write(str(sum(m.files for m in done)).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        """Removes the job's own staging folder, with all that unfinished attempts have left."""
        from pyarrow import fs

        store, _, staging = self._store()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


def _save(rows: DataFrame, path: str, folders: int, order: list[str]) -> None:
    rows.sparkSession.dataSource.register(DocumentFiles)
    dealt = rows.withColumn("folder", folder_of("repo_id", folders)).repartition("folder")
    ordered = dealt.sortWithinPartitions("folder", "repo_id", *order).select(*_COLUMNS)
    ordered.write.format("document_files").mode("append").option("path", path).save()


def write(documents: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Documents (repo_id, document) as files; several of one repository follow each other in its file."""
    _save(documents.select("repo_id", F.col("document").alias("text")), path, folders, ["text"])


def write_parts(parts: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Documents from their parts, which are streamed in order into one file per repository."""
    lines = parts.withColumn("text", F.concat("text", F.lit("\n")))
    _save(lines, path, folders, ["part", "key", "pos"])
