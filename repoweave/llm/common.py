"""What the operators of this package share: words, tables in the shared folder, batches of texts."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import partial
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.sources.scratch import checkpoint_folder

#: One or more characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 512
#: Bytes of text after which such a slice ends early.
SLICE_BYTES = 8 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text; ``bytes.split`` knows exactly the six ASCII blanks."""
    return text.split()


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def word_count(text: Column) -> Column:
    """Number of words, without a list of them: blanks that follow a word, and a word at the end."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(squeezed, BLANK, "")).cast("bigint")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid4().hex}"


def stored_path(df: DataFrame, label: str) -> str:
    """Writes ``df`` once as Parquet in the shared folder and gives the path."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, so that every later reader sees the same rows."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df, label))


def numbered(df: DataFrame, label: str, name: str = "_row") -> DataFrame:
    """``df`` stored with a number for each row, which tells repeated rows apart."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), label)


def wrapped(docs: DataFrame, *columns: Column) -> DataFrame:
    """Whole rows as one struct ``_doc``, a locator ``_row`` and computed columns.

    Columns of the input cannot clash with names that an operator uses; ``select("_doc.*")``
    gives them back.  To be stored before it is read twice, which fixes the locators.
    """
    whole = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("_doc")
    return docs.select(whole, F.monotonically_increasing_id().alias("_row"), *columns)


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of "name type, ..." with the few types used here."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(","))])


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes; a single long text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def _run(batches: Iterator[pa.RecordBatch], make: Callable, text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    step = make()
    for batch in batches:
        for part in slices(batch, text):
            texts = [b"" if t is None else t for t in part.column(text).cast(pa.binary()).to_pylist()]
            rest = {n: part.column(n).to_pylist() for n in part.schema.names if n != text}
            out = step(texts, rest)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def map_texts(df: DataFrame, make: Callable, schema: str, text: str = "text") -> DataFrame:
    """Runs ``make()`` once per task; what it gives maps (texts as bytes, other columns) to columns.

    Null texts arrive as empty bytes.  Memory is bounded by SLICE_BYTES of text or
    one longer text at a time.
    """
    return df.mapInArrow(partial(_run, make=make, text=text, schema=arrow_schema(schema)), schema)


class Remembered(dict):
    """Ids of pieces met since the last change of generation; asking for another piece adds it.

    A piece that no generation knows gets empty ids, which are in ``new`` to be filled.
    """

    def __init__(self, older: dict[str, bytes]):
        self.older, self.new = older, {}

    def __missing__(self, piece: str):
        ids = self.older.get(piece)
        if ids is None:
            ids = self.new[piece] = bytearray()
        self[piece] = ids
        return ids


def quiet_tokenizers() -> None:
    """One thread for the tokenizers library: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


#: Blanks that are not ASCII, and separators that some libraries take for blanks.
ODD_BLANKS = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
