"""Token ids in directly addressable codes, in files that Spark reads and writes.

Ids are cut into chunks of eight bits.  The first level holds the low chunk of every id and one
continuation bit for each; the next level holds the second chunk of the ids that go on, and so forth.
A rank directory counts the set bits before every block of the bitmap, so the place of an id's next
chunk follows by one look-up and the bits of one block: any id is read without decoding others.

The file format is a folder of Parquet files in ascending doc_id order.  A row is a segment:

    part      range of doc_ids it belongs to; ranges are numbered in ascending order
    segment   number in its part
    first     ids before it in its part
    n_ids     ids in it
    doc_ids   its documents; counts has their numbers of ids
    codes     magic, number of levels; per level: length, chunks, bitmap, directory
"""

from __future__ import annotations

import struct
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoweave.llm.common import arrow_schema, new_folder, slices
from repoweave.llm.tokens import encoder
from repoweave.sources.scratch import broadcast_if_small

MAGIC = b"DAC1"
#: Bits of a bitmap that one entry of its rank directory covers.
RANK_BITS = 512
#: Ids after which a segment ends; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 16

_SEGMENTS = "part int, segment int, first long, n_ids long, doc_ids array<long>, counts array<long>, codes binary"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


class Codes:
    """Random access to the ids of one segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (levels,), at = struct.unpack_from("<I", data, 4), 8
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            at += 8 + n + len(bitmap)
            directory = np.frombuffer(data, "<u4", n // RANK_BITS + 1, at)
            at += 4 * len(directory)
            self.levels.append((chunks, bitmap, directory))

    @staticmethod
    def encode(ids: np.ndarray) -> bytes:
        out, left = [], np.asarray(ids, np.uint64)
        while True:
            more = left > 0xFF
            bitmap = np.packbits(more, bitorder="little")
            ones = np.concatenate(([0], np.cumsum(more)))
            directory = ones[::RANK_BITS][: len(left) // RANK_BITS + 1].astype("<u4")
            chunks = (left & np.uint64(0xFF)).astype(np.uint8)
            out.append(struct.pack("<Q", len(left)) + chunks.tobytes() + bitmap.tobytes() + directory.tobytes())
            if not more.any():
                return MAGIC + struct.pack("<I", len(out)) + b"".join(out)
            left = left[more] >> np.uint64(8)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, at: int) -> int:
        """Set bits before ``at``: the directory, and the bits of one block."""
        _, bitmap, directory = self.levels[level]
        block = at // RANK_BITS
        inside = bitmap[block * RANK_BITS // 8 : -(-at // 8)]
        if not len(inside):
            return int(directory[block])
        ones = int(np.bitwise_count(inside).sum())
        if at % 8:
            ones -= int(inside[-1] >> (at % 8)).bit_count()
        return int(directory[block]) + ones

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * level)
            if not bitmap[at >> 3] >> (at & 7) & 1:
                break
            at = self._rank(level, at)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``; only their chunks are read."""
        values = np.zeros(stop - start, "<u4")
        places = np.arange(stop - start)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            values[places] |= chunks[start:stop].astype("<u4") << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[start >> 3 : -(-stop // 8)], bitorder="little")
            places = places[np.flatnonzero(bits[start & 7 : (start & 7) + stop - start])]
            if not len(places):
                break
            start = self._rank(level, start)
            stop = start + len(places)
        return values


def _encode(batches, path: str, end_id: int, segment_ids: int, schema: pa.Schema):
    coder, part = encoder(path), TaskContext.get().partitionId()
    end = np.array([end_id], coder.dtype).tobytes()
    state = {"segment": 0, "first": 0, "held": 0}
    docs, counts, parts = [], [], []

    def flush():
        ids = np.frombuffer(b"".join(parts), coder.dtype)
        row = [part, state["segment"], state["first"], len(ids), list(docs), list(counts), Codes.encode(ids)]
        state["segment"] += 1
        state["first"] += len(ids)
        state["held"] = 0
        docs.clear(), counts.clear(), parts.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for some in slices(batch, "text"):
            texts = [b"" if t is None else t for t in some.column("text").cast(pa.binary()).to_pylist()]
            for doc, ids in zip(some.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                docs.append(doc)
                parts.append(ids + end)
                counts.append(len(parts[-1]) // len(end))
                state["held"] += counts[-1]
                if state["held"] >= segment_ids:
                    yield flush()
    if docs:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes all texts whole and writes their ids, each document closed by ``end_id``.

    Documents are dealt by ranges of doc_id, null first; the hash of the text splits a doc_id that
    many rows share and orders them.  Null text is empty, so the end id alone.  Columns other than
    doc_id and text are not looked at.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ranged = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    write = partial(_encode, path=tokenizer, end_id=end_id, segment_ids=segment_ids, schema=arrow_schema(_SEGMENTS))
    ranged.mapInArrow(write, _SEGMENTS).write.option("compression", "zstd").parquet(path)


def placed_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``before``, the ids of all parts before theirs: one row per part is summed up."""
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return segments.join(broadcast_if_small(before), "part")


def _decode(batches, schema: pa.Schema):
    for batch in batches:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            codes, at, out = Codes(row["codes"]), 0, {f.name: [] for f in schema}
            for doc, n in zip(row["doc_ids"], row["counts"], strict=True):
                out["doc_id"].append(doc)
                out["start"].append(row["before"] + row["first"] + at)
                out["n_tokens"].append(n)
                out["ids"].append(codes.slice(at, at + n).tobytes())
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole folder), n_tokens, ids (little-endian 32-bit)."""
    return placed_segments(spark, path).mapInArrow(partial(_decode, schema=arrow_schema(_DOCUMENTS)), _DOCUMENTS)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes to a folder of its own below the shared one and reads the documents back."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, segment_ids)
    return read_documents(docs.sparkSession, path)
