"""Packing by deficit round robin: one queue of tokens for each source, windows of fixed length.

Every round adds to each source's deficit its share of a window and serves whole quanta from the
queues in turn while a deficit covers one; what is left of a deficit is carried to the next round.
Windows are cut from the emitted stream, so each is full and holds the target proportions within a
quantum per source.  A source whose queue is empty drops out and the others fill the windows.

The deficits are plain integers that grow by a constant, so the round that serves a quantum, and
the place in the stream, follow by arithmetic from its number in its queue.  A task therefore needs
only the number of tokens of each source in earlier parts of the table, which carries all deficits
over windows and partitions; no task depends on another and no token is shuffled.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoweave.llm.common import arrow_schema, map_texts, stored
from repoweave.llm.tokens import encoder, id_type
from repoweave.sources.scratch import broadcast_if_small

WINDOW = 2048
QUANTUM = 256
#: Sources with a queue of their own; if there are more, sources share queues by hash.
MAX_QUEUES = 4096
#: A deficit is counted in this fraction of a token.
UNIT = 1 << 16
#: Cells of (quanta x queues) that are computed at a time.
_CELLS = 1 << 20

_ENCODED = "doc_id long, source string, queue string, part int, queue_start long, doc_tokens long, ids binary"
_PIECES = (
    "doc_id long, source string, start long, length long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def _encode_step(path: str, end_id: int):
    coder, part, taken = encoder(path), TaskContext.get().partitionId(), {}
    end = np.array([end_id], coder.dtype).tobytes()
    width = len(end)

    def step(texts, rest):
        ids = [x + end for x in coder.encode(texts)]
        counts = [len(x) // width for x in ids]
        starts = []
        for queue, n in zip(rest["queue"], counts, strict=True):
            starts.append(taken.get(queue, 0))
            taken[queue] = starts[-1] + n
        return rest | {"part": [part] * len(ids), "queue_start": starts, "doc_tokens": counts, "ids": ids}

    return step


class Schedule:
    """Places in the emitted stream of the quanta of all queues."""

    def __init__(self, tokens: list[int], weights: list[float], window: int, quantum: int):
        self.tokens = np.array(tokens, np.int64)
        whole = sum(weights)
        #: What a round adds to each deficit; at least one unit, so that every queue ends.
        self.adds = np.array([max(1, round(window * UNIT * w / whole)) for w in weights], np.int64)
        self.quantum, self.cost = quantum, quantum * UNIT
        #: Rounds after which each queue is empty; later ones would only make large numbers.
        self.last = -(-(self.tokens // quantum + 1) * self.cost // self.adds)

    def places(self, queue: int, quanta: np.ndarray) -> np.ndarray:
        """Tokens emitted before each of the numbered quanta of one queue."""
        turn = -(-(quanta + 1) * self.cost // self.adds[queue]) - 1
        out = np.empty(len(quanta), np.int64)
        step = max(1, _CELLS // len(self.tokens))
        ahead = (np.arange(len(self.tokens)) < queue).astype(np.int64)
        for i in range(0, len(quanta), step):
            rounds = np.minimum(turn[i : i + step, None] + ahead, self.last)
            served = rounds * self.adds // self.cost * self.quantum
            served = np.minimum(served, self.tokens)
            served[:, queue] = quanta[i : i + step] * self.quantum
            out[i : i + step] = served.sum(axis=1)
        return out


def _pieces(batches, queues: list[tuple], weights: list[float], window: int, quantum: int, width: str, schema: pa.Schema):
    plan = Schedule([n for _, n in queues], weights, window, quantum)
    number = {name: i for i, (name, _) in enumerate(queues)}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = {f.name: [] for f in schema}
            for row in batch.slice(at, 256).to_pylist():
                ids = np.frombuffer(row["ids"], width).astype("<u4").tobytes()
                first = row["before"] + row["queue_start"]
                end = first + row["doc_tokens"]
                quanta = np.arange(first // quantum, (end - 1) // quantum + 1, dtype=np.int64)
                places = plan.places(number[row["queue"]], quanta)
                begins = np.maximum(quanta * quantum, first)
                ends = np.minimum((quanta + 1) * quantum, end)
                places = places + (begins - quanta * quantum)
                # Quanta that follow each other in the stream are one run; runs are cut at windows.
                joined = np.flatnonzero(places[1:] != places[:-1] + (ends - begins)[:-1]) + 1
                runs = np.concatenate(([0], joined, [len(quanta)]))
                for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                    place, start, left = int(places[a]), int(begins[a]) - first, int(ends[b - 1] - begins[a])
                    while left:
                        n = min(left, window - place % window)
                        for name, value in (
                            ("doc_id", row["doc_id"]), ("source", row["source"]), ("start", start), ("length", n),
                            ("doc_tokens", row["doc_tokens"]), ("sequence_id", place // window),
                            ("offset", place % window), ("ids", ids[4 * start : 4 * (start + n)]),
                        ):
                            out[name].append(value)
                        place, start, left = place + n, start + n, left - n
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, quantum: int = QUANTUM,
    weights: dict[str | None, float] | None = None, max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens; only the last window can be short.

    Returns doc_id, source, start (tokens of the document before the piece), length, doc_tokens
    (with the end id), sequence_id, offset and ids (little-endian unsigned 32-bit numbers).

    ``weights`` are target proportions by source; by default each source's share of all tokens,
    so that all queues end together.  A source that is not named weighs nothing beyond one unit:
    its tokens come when the others are used up.  Beyond ``max_queues`` sources, queues are shared
    by hash of the source and weigh their tokens.

    Null text is the end id alone; a null source is a queue of its own; a null doc_id stays null;
    repeated rows are packed as often as they come; no rows give no pieces.  Columns other than
    doc_id, text and source are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    shared = rows.select("source").distinct().limit(max_queues + 1).count() > max_queues
    queue = F.format_string("#%d", F.pmod(F.xxhash64("source"), F.lit(max_queues))) if shared else F.col("source")
    encoded = stored(
        map_texts(rows.withColumn("queue", queue), partial(_encode_step, tokenizer, end_id), _ENCODED), "encoded"
    )
    parts = stored(encoded.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("tokens")), "parts")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    # At most max_queues + 1 rows.
    queues = sorted(
        ((r[0], r[1]) for r in parts.groupBy("queue").agg(F.sum("tokens")).collect()),
        key=lambda r: (r[0] is None, r[0] or ""),
    )
    targets = [float(n) if weights is None or shared else float(weights.get(name, 0.0)) for name, n in queues]
    placed = encoded.alias("e").join(
        broadcast_if_small(stored(before, "before")).alias("b"),
        (F.col("e.part") == F.col("b.part")) & F.col("e.queue").eqNullSafe(F.col("b.queue")),
    ).select("e.*", "b.before")
    fill = partial(
        _pieces, queues=queues, weights=targets, window=window, quantum=quantum, width=id_type(tokenizer),
        schema=arrow_schema(_PIECES),
    )
    return placed.mapInArrow(fill, _PIECES) if queues else spark.createDataFrame([], _PIECES)
