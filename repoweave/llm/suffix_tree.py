"""Scores of documents by a probabilistic suffix tree over tokens.

Tokens are words (ASCII letters in lower case) and one end per document.  A state is a context of up
to ``DEPTH`` tokens before the next one.  Contexts seen at least ``LEAST_COUNT`` times in training
are candidates, and next tokens seen at least ``ENTRY_COUNT`` times after them are counted one by
one, so the tree grows with the corpus.  A candidate is retained if the divergence of its next tokens
from those of its suffix gains more nats than its entries cost.  A distribution is smoothed by that of
the longest retained suffix, which gets what the entries leave and a discount of each; the root is the
smoothed unigram distribution of all words.  A token is scored by the longest retained context
before it.

The tree is never held in one place.  Contexts, entries and their probabilities are Spark tables; a
context is as frequent as the sequence that ends with its last token, so each length gives the
candidates of the next.  All retained contexts before a token lie on one path to the root, so its
log10 probability is a sum over them: of what a context leaves to its suffix, and, for an entry, of
what the entry changes.  A document's score is thus a sum of weights of its token sequences.

Tokens and sequences are known by 64-bit hashes; two that share one would be taken for the same.
What tasks send of a block of documents is distinct sequences by bucket of the hash, as arrays: their
counts to learn from, or the documents that hold them, to be met by the bucket's weights.  The buckets
give sums by document back to the block.  Weights of frequent sequences (bounded by their share) are
known in the tasks that read the texts.  A bit table of fixed size keeps out sequences that have
no weight; a bit hit by chance only sends a sequence that finds nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.llm.common import SLICE_ROWS, arrow_schema, lower_ascii, slices, stored, stored_path
from repoweave.sources.scratch import broadcast_if_small

DEPTH = 3
LEAST_COUNT = 20.0
ENTRY_COUNT = 2.0
#: Shares of all training tokens that a context and an entry must hold besides; none, at any size.
LEAST = 0.0
ENTRY = 0.0
#: Nats that a context must gain beyond half the logarithm of its count for each entry.
DIVERGENCE = 5.0
#: Taken off the count of every entry and given to the suffix.
DISCOUNT = 0.5
#: Share of all tokens from which on a sequence is frequent; at most 1 / FREQUENT of a length are.
FREQUENT = 1 / 131_072
FOLDS = 10
#: Tokens and documents from which on a block, what a task holds at a time, is full; places take 16 bits.
HELD_TOKENS = 1_500_000
HELD_DOCS = 65_536 - SLICE_ROWS
#: Packed rows that a task passes on at a time.
PASSED_ROWS = 32
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 64
#: Rows of a table that a task packs at a time.
HELD_ROWS = 1_000_000
#: Logarithm of the number of bits in a table that sequences are tested against.
SIEVE = 27
#: Buckets: so many at least, and one for so many tokens to learn from, or to score.
BUCKETS = 32
BUCKET_COUNTED = 500_000
BUCKET_SCORED = 8_000_000
_SEED = 42
#: The end's hash; no word is empty.
END = np.uint64(0x9FB21C651E98DF25)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Masks of the first bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

_COUNTS = "word long, train long, total long"
_PACKED = "bucket int, context binary, next binary, n binary"
_GRAMS = "context long, next long, word long, n long"
# Of a bucket: weights (no block), sequences of a block (lens and at: how many documents of the block, and
# which); of a block: its documents and their sums so far, or a bucket's sums for documents ``at``.
_MET = (
    "bucket int, block long, doc_ids array<long>, n_tokens binary, keys binary, lens binary, at binary, "
    "known binary, base binary, gain binary"
)
_SUMS = "doc_id long, n_tokens long, n_known long, base double, gain double"


def held_out(doc_id: int | None) -> bool:
    """Documents that nothing is learned from; a null doc_id counts as empty text and is one."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def _joined(key: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of a sequence and one more token."""
    x = key * np.uint64(0x9E3779B97F4A7C15) + token
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(29)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, one text after another with its end, and the number of each text.

    A word is hashed by its length and eight bytes at a time, all words at once; long ones by xxHash.
    """
    from xxhash import xxh64_intdigest

    data = lower_ascii(b"".join([b" ", b" ".join(texts), b" ", bytes(8)]))
    blank = _BLANK[np.frombuffer(data, np.uint8)[:-8]]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    lens = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - starts
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes = _joined(lens.astype(np.uint64), eights[starts] & _FIRST[np.minimum(lens, 8)])
    at, done = np.flatnonzero(lens > 8), 8
    while len(at) and done < LONG_WORD:
        hashes[at] = _joined(hashes[at], eights[starts[at] + done] & _FIRST[np.minimum(lens[at] - done, 8)])
        done += 8
        at = at[lens[at] > done]
    for i in at.tolist():
        hashes[i] = xxh64_intdigest(data[starts[i] : starts[i] + lens[i]], _SEED)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return np.insert(hashes, ends, END), np.diff(ends, prepend=0) + 1


def _blocks(batches, learning: bool = False) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """Rows, doc_ids, hashes of tokens and the place in the block of each token's document."""
    rows, docs, tokens, sizes, held = [], [], [], [], 0

    def block():
        places = np.repeat(np.arange(len(docs), dtype=np.uint16), np.concatenate(sizes))
        return list(rows), list(docs), np.concatenate(tokens), places

    for batch in batches:
        for part in slices(batch, "text"):
            if learning:
                part = part.filter(pa.array([not held_out(d) for d in part.column("doc_id").to_pylist()], pa.bool_()))
            if not part.num_rows:
                continue
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            hashes, each = _tokens(texts)
            docs += part.column("doc_id").to_pylist()
            rows += part.column("row").to_pylist() if "row" in part.schema.names else []
            tokens.append(hashes), sizes.append(each)
            held += len(hashes)
            if held >= HELD_TOKENS or len(docs) >= HELD_DOCS:
                yield block()
                rows.clear(), docs.clear(), tokens.clear(), sizes.clear()
                held = 0
    if docs:
        yield block()


def _sequences(tokens: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of ``length`` tokens from each token on, and which of them are within a document."""
    keys = tokens[: max(0, len(tokens) - length + 1)]
    for i in range(1, length):
        keys = _joined(keys, tokens[i : i + len(keys)])
    return keys, places[: len(keys)] == places[length - 1 :][: len(keys)]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where equal keys begin, in keys in order."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def _by_bucket(ordered: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets, by the upper bits, and their parts of keys in order."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.searchsorted(ordered, np.arange(buckets, dtype=np.uint64) << shift).tolist() + [len(ordered)]
    for i in range(buckets):
        if edges[i] < edges[i + 1]:
            yield i, slice(edges[i], edges[i + 1])


def _buckets(size: int, each: int) -> int:
    """A power of two."""
    return 1 << (max(BUCKETS, -(-size // each)) - 1).bit_length()


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _thin(ordered: np.ndarray) -> bytes:
    """Keys in order as differences, byte by byte, so that the upper bytes take little room when compressed."""
    return np.diff(ordered, prepend=np.zeros(1, np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(thin: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(thin, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _small(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)


def _numbers(small: bytes, kind, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(small, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _all(values: list, kind) -> np.ndarray:
    """Arrays packed as bytes, one after another."""
    return np.concatenate([np.frombuffer(v, kind) for v in values]) if values else np.zeros(0, kind)


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Spark drops the shuffle files of a query that ends in here, so that those of several do not add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a table of this run that has no more readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _count_words(batches, schema: pa.Schema):
    for _, docs, tokens, places in _blocks(batches):
        order = np.argsort(tokens)
        words = tokens[order]
        starts = _starts(words)
        learned = np.array([not held_out(d) for d in docs], np.int64)[places[order]]
        total = np.diff(starts, append=len(words))
        yield _batch(schema, words[starts].view(np.int64), np.add.reduceat(learned, starts), total)


def count_words(docs: DataFrame) -> DataFrame:
    """Hashes of the distinct tokens, with their counts in training documents and in all; the end is one of them."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = rows.mapInArrow(partial(_count_words, schema=arrow_schema(_COUNTS)), _COUNTS)
    return stored(counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "words")


class SuffixTree:
    """Probabilities in memory as the tables have them: retained contexts (tuples of token numbers,
    the last token last) and their next tokens."""

    def __init__(self, root: list[float]):
        #: Probability of each numbered token by the root; number 0 stands for all others.
        self.root = root
        self.entries: dict[tuple, dict[int, int]] = {}
        self.totals: dict[tuple, int] = {}
        self.left: dict[tuple, float] = {}

    def probability(self, context: tuple, token: int) -> float:
        """By a retained context: its discounted entry, and its suffix's share of what is left."""
        if not context:
            return self.root[token]
        own = max(0.0, self.entries[context].get(token, 0) - DISCOUNT) / self.totals[context]
        return own + self.left[context] * self.probability(self.suffix(context), token)

    def suffix(self, context: tuple) -> tuple:
        """The longest retained context that ends ``context`` and is shorter."""
        context = context[1:]
        while context and context not in self.entries:
            context = context[1:]
        return context

    def retain(self, context: tuple, entries: dict[int, int], total: int) -> None:
        taken = sum(max(0.0, n - DISCOUNT) for n in entries.values())
        self.entries[context], self.totals[context] = entries, total
        self.left[context] = 1 - taken / total


def _sieve(keys: DataFrame) -> Broadcast:
    """Bits that the only column of ``keys``, hashes, sets, as words of 64 in a broadcast."""
    bit = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - SIEVE)
    words = (
        keys.select(bit.alias("bit"))
        .select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, int(bit & 63))").alias("bits"))
        .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    table = np.zeros(1 << (SIEVE - 6), np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def _passed(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> np.uint64(64 - SIEVE)
    return (sieve[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _count_grams(batches, contexts: Broadcast, depth: int, buckets: int, schema: pa.Schema):
    for _, _, tokens, places in _blocks(batches, learning=True):
        last = max(0, len(tokens) - depth)
        at = np.flatnonzero(places[:last] == places[depth:])
        context = _sequences(tokens, places, depth)[0][at]
        passed = _passed(contexts.value, context)
        context, token = context[passed], tokens[at[passed] + depth]
        keys, first, n = np.unique(_joined(context, token), return_index=True, return_counts=True)
        context, token, n = context[first], token[first], n.astype(np.uint32)
        out = [(i, context[p].tobytes(), token[p].tobytes(), n[p].tobytes()) for i, p in _by_bucket(keys, buckets)]
        for i in range(0, len(out), PASSED_ROWS):
            yield _batch(schema, *zip(*out[i : i + PASSED_ROWS], strict=True))


def _add_grams(table: pa.Table, least: float, schema: pa.Schema) -> pa.Table:
    """Counts of the sequences of a bucket, of those seen often enough."""
    context, token = (_all(table.column(c).to_pylist(), np.uint64) for c in ("context", "next"))
    n = _all(table.column("n").to_pylist(), np.uint32).astype(np.int64)
    keys = _joined(context, token)
    order = np.argsort(keys)
    keys = keys[order]
    starts = _starts(keys)
    n = np.add.reduceat(n[order], starts)
    starts, n = starts[n >= least], n[n >= least]
    columns = (context[order[starts]], token[order[starts]], keys[starts])
    return pa.Table.from_batches([_batch(schema, *(c.view(np.int64) for c in columns), n)], schema)


def learn(docs: DataFrame, scored: DataFrame, n: int, depth: int = DEPTH) -> DataFrame:
    """Weights (word, single, n, gain) of the sequences of training documents, one pass for each length.

    ``scored`` has word, train and base.  A sequence's gain is what it leaves to its suffix as a
    context, if it is retained, and what its last token changes as an entry of the tokens before; each
    is a row, and n, the sequence's count, is the same in both.  Single ones are words.
    An entry's count is no larger than that of the same token after the suffix, so the suffix of a
    candidate is a candidate and every entry finds its probability by the suffix one length below.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    least, entry = max(LEAST_COUNT, LEAST * n), max(ENTRY_COUNT, ENTRY * n)
    end = F.lit(int(END.view(np.int64)))
    # Below an entry: the probability by the suffix, and the key of the suffix with the entry.
    below = scored.where(F.col("train") >= entry).select(
        F.col("word").alias("next"), F.pow(F.lit(10.0), "base").alias("q"), F.col("word").alias("under")
    )
    contexts = scored.where((F.col("word") != end) & (F.col("train") >= least)).select(
        F.col("word").alias("context"), F.col("train").alias("total"), F.lit(0).cast("bigint").alias("suffix")
    )

    def add(table: pa.Table) -> pa.Table:
        return _add_grams(table, entry, arrow_schema(_GRAMS))

    weights = scored.select(
        "word", F.lit(True).alias("single"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("gain")
    ).limit(0)
    kept = []
    for length in range(1, depth + 1):
        contexts = stored(contexts, "contexts")
        if contexts.isEmpty():
            break
        count = partial(
            _count_grams, contexts=_sieve(contexts.select("context")), depth=length,
            buckets=_buckets(n, BUCKET_COUNTED), schema=arrow_schema(_PACKED),
        )
        grams = rows.mapInArrow(count, _PACKED).groupBy("bucket").applyInArrow(add, _GRAMS)
        # A context of one word has the root below it.
        on = ["next"] if length == 1 else ["suffix", "next"]
        counted = (
            grams.join(broadcast_if_small(contexts), "context").join(below, on)
            .select("context", "next", "word", "under", "n", "total", "q")
        )
        kept.append(stored_path(counted, "counted"))
        counted = docs.sparkSession.read.schema(counted.schema).parquet(kept[-1])
        sums = counted.groupBy("context", "total").agg(
            F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).alias("gain"),
            F.sum("n").alias("taken"), F.sum("q").alias("share"), F.count(F.lit(1)).alias("entries"),
            F.sum(F.greatest(F.lit(0.0), F.col("n") - DISCOUNT)).alias("own"),
        )
        rest, share = F.col("total") - F.col("taken"), 1 - F.col("share")
        others = F.when((rest > 0) & (share > 0), rest * F.log(rest / F.col("total") / share)).otherwise(0.0)
        gain = F.col("gain") + others - 0.5 * F.col("entries") * F.log("total")
        states = stored(
            sums.where(gain >= DIVERGENCE).select("context", "total", (1 - F.col("own") / F.col("total")).alias("left")),
            "states",
        )
        own = F.greatest(F.lit(0.0), F.col("n") - DISCOUNT) / F.col("total") + F.col("left") * F.col("q")
        entries = counted.join(broadcast_if_small(states.select("context", "left")), "context", "left").select(
            "context", "next", "word", "under", "n", F.coalesce(own, "q").alias("p"),
            F.log10(own / F.col("left") / F.col("q")).alias("gain"),
        )
        changes = entries.where("gain is not null").select("word", F.lit(False).alias("single"), "n", "gain")
        weights = weights.unionByName(
            states.select(
                F.col("context").alias("word"), F.lit(length == 1).alias("single"), F.col("total").alias("n"),
                F.log10("left").alias("gain"),
            )
        ).unionByName(stored(changes, "changes"))
        below = entries.select(
            F.col("context").alias("suffix"), "next", F.col("p").alias("q"), F.col("word").alias("under")
        )
        contexts = entries.where((F.col("next") != end) & (F.col("n") >= least)).select(
            F.col("word").alias("context"), F.col("n").alias("total"), F.col("under").alias("suffix")
        )
    for path in kept:
        _delete(docs.sparkSession, path)
    return weights


def _values(keys: np.ndarray, known: np.ndarray, base: np.ndarray, gain: np.ndarray):
    """Keys in order, each once, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = _starts(keys)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in (known, base, gain))


def _places(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` are in a table in order, and which are there at all."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _pack_weights(batches, buckets: int, schema: pa.Schema):
    """Weights by bucket, those of words (with ``base``) apart from those of sequences."""
    held, size = [], 0

    def flush():
        whole = pa.Table.from_batches(held)
        keys = whole.column("word").to_numpy().view(np.uint64)
        values = [whole.column(c).to_numpy() for c in ("known", "base", "gain")]
        single = whole.column("single").to_numpy()
        held.clear()
        out = []
        for side in (0, 1):
            at = np.flatnonzero(single == bool(side))
            at = at[np.argsort(keys[at])]
            known, base, gain = (v[at] for v in values)
            known = known.astype(np.uint8)
            for i, p in _by_bucket(keys[at], buckets):
                out.append({
                    "bucket": 2 * i + side, "keys": _thin(keys[at[p]]), "known": known[p].tobytes(),
                    "base": base[p].tobytes(), "gain": gain[p].tobytes(),
                })
        return [_rows(schema, out[i : i + PASSED_ROWS]) for i in range(0, len(out), PASSED_ROWS)]

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD_ROWS:
            yield from flush()
            size = 0
    if size:
        yield from flush()


def _score_texts(
    batches, frequent: Broadcast, sieve: Broadcast, once_base: float, depth: int, buckets: int, schema: pa.Schema
):
    """The documents of a block with the sums of what is known here, and its other sequences by bucket.

    A word that has no bit was seen once in training: all others have a weight.
    """
    table, *values = frequent.value
    for rows, docs, tokens, places in _blocks(batches):
        size, out = len(docs), []
        sums = [np.zeros(size) for _ in values]
        for length in range(1, depth + 2):
            keys, whole = _sequences(tokens, places, length)
            passed = _passed(sieve.value, keys)
            if length == 1:
                once = np.bincount(places[~passed], minlength=size)
                sums[0] += once
                sums[1] += once * once_base
            whole &= passed
            keys, at = keys[whole], places[: len(keys)][whole]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            starts = _starts(keys)
            lens, keys = np.diff(starts, append=len(keys)).astype(np.uint32), keys[starts]
            found, hit = _places(table, keys)
            hits = np.repeat(hit, lens)
            for total, value in zip(sums, values, strict=True):
                if len(table):
                    total += np.bincount(at[hits], np.repeat(value[found[hit]], lens[hit]), size)
            keys, lens, at = keys[~hit], lens[~hit], at[~hits]
            ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
            for i, p in _by_bucket(keys, buckets):
                out.append({
                    "bucket": 2 * i + (length == 1), "block": rows[0], "keys": _thin(keys[p]),
                    "lens": _small(lens[p]), "at": _small(at[ends[p.start] : ends[p.stop]]),
                })
        known, base, gain = (v.tobytes() for v in sums)
        out.append({
            "bucket": rows[0] % (2 * buckets), "block": rows[0], "doc_ids": docs,
            "n_tokens": np.bincount(places, minlength=size).tobytes(), "known": known, "base": base, "gain": gain,
        })
        for i in range(0, len(out), PASSED_ROWS):
            yield _rows(schema, out[i : i + PASSED_ROWS])


def _meet(table: pa.Table, once_base: float) -> pa.Table:
    """What the weights of a bucket add to the documents of each block; words without one are seen once."""
    rows = table.to_pylist()
    weights = [r for r in rows if r["block"] is None]
    keys = np.concatenate([np.zeros(0, np.uint64), *(_whole(r["keys"]) for r in weights)])
    kinds = {"known": np.uint8, "base": np.float64, "gain": np.float64}
    known, base, gain = (_all([r[c] for r in weights], k) for c, k in kinds.items())
    keys, *values = _values(keys, known.astype(np.float64), base, gain)
    out = [r for r in rows if r["doc_ids"] is not None]
    for r in rows:
        if r["block"] is None or r["doc_ids"] is not None:
            continue
        wanted = _whole(r["keys"])
        lens = _numbers(r["lens"], np.uint32, len(wanted))
        at = _numbers(r["at"], np.uint16, int(lens.sum()))
        found, hit = _places(keys, wanted)
        once = (1.0, once_base, 0.0) if r["bucket"] & 1 else (0.0, 0.0, 0.0)
        docs = np.flatnonzero(np.bincount(at)).astype(np.uint16)
        parts = {}
        for name, value, other in zip(("known", "base", "gain"), values, once, strict=True):
            each = np.full(len(lens), other)
            each[hit] = value[found[hit]]
            parts[name] = np.bincount(at, np.repeat(each, lens))[docs].tobytes()
        out.append({"bucket": r["bucket"], "block": r["block"], "at": docs.tobytes()} | parts)
    schema = arrow_schema(_MET)
    return pa.Table.from_batches([_rows(schema, out)], schema)


def _add_sums(table: pa.Table) -> pa.Table:
    """The documents of a block; sums are added in the order of the buckets, so that reruns agree."""
    rows = table.sort_by([("bucket", "ascending")]).to_pylist()
    head = next(r for r in rows if r["doc_ids"] is not None)
    sums = {c: np.frombuffer(head[c]).copy() for c in ("known", "base", "gain")}
    # A bucket has words or sequences of several lengths; the latter are rows of their own, in no fixed order.
    parts = sorted((r for r in rows if r["doc_ids"] is None), key=lambda r: (r["bucket"], r["at"], r["gain"]))
    for r in parts:
        at = np.frombuffer(r["at"], np.uint16)
        for c, total in sums.items():
            total[at] += np.frombuffer(r[c])
    known = np.rint(sums["known"]).astype(np.int64)
    n_tokens = np.frombuffer(head["n_tokens"], np.int64)
    schema = arrow_schema(_SUMS)
    return pa.Table.from_batches([_batch(schema, head["doc_ids"], n_tokens, known, sums["base"], sums["gain"])], schema)


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents that are not held out.  ``base_score`` is the smoothed unigram score
    of the tokens and ``score`` the tree's log10 probability of the text; both count words never seen
    in training as one kind.  Null and empty texts are the end alone.  With nothing to learn from,
    both scores are those of the smoothing.  Repeated rows are scored each for itself and counted as
    often as they come.  Columns other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    with _shuffles_dropped(spark):
        words = count_words(docs)
        n, v, everything = words.agg(
            F.sum("train"), F.count_if(F.col("train") > 0), F.sum("total")
        ).first()
        n, v, everything = n or 0, v or 0, everything or 0
        scored = words.select(
            "word", "train", (F.col("train") > 0).cast("bigint").alias("known"),
            F.log10((F.col("train") + 0.1) / (n + 0.1 * (v + 1))).alias("base"),
        )
        learned = learn(docs, scored, n, depth).select(
            "word", "single", "n", F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("base"), "gain"
        )
        # Words seen once, the most of all, have no row.
        once_base = math.log10(1.1 / (n + 0.1 * (v + 1)))
        plain = scored.where("train <> 1").select(
            "word", F.lit(True).alias("single"), F.col("train").alias("n"), "known", "base", F.lit(0.0).alias("gain")
        )
        # A sequence can have a weight as a word, as a context and as an entry, in rows with the same count.
        weights = learned.unionByName(plain)
        # Shares of all tokens add up to one for each length, so these are at most 1 / FREQUENT sequences of each.
        top = F.col("n") >= max(1.0, FREQUENT * everything)
        table = weights.where(top).select("word", "known", "base", "gain").toArrow()
        sieve = _sieve(weights.select("word"))
    keys, known, base, gain = (table.column(c).to_numpy() for c in table.column_names)
    hot = spark.sparkContext.broadcast(_values(keys.view(np.uint64), known.astype(np.float64), base, gain))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    )
    met, buckets = arrow_schema(_MET), _buckets(everything, BUCKET_SCORED)
    score = partial(
        _score_texts, frequent=hot, sieve=sieve, once_base=once_base, depth=depth, buckets=buckets, schema=met
    )
    pack = partial(_pack_weights, buckets=buckets, schema=met)

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table, once_base)

    parts = rows.mapInArrow(score, _MET).unionByName(weights.where(~top).mapInArrow(pack, _MET))
    sums = (
        parts.groupBy("bucket").applyInArrow(meet, _MET)
        .groupBy("block").applyInArrow(_add_sums, _SUMS)
    )
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return sums.select(
        "doc_id", (F.crc32(text) % FOLDS == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("base") + F.col("gain")).alias("score"),
    )
