"""Near duplicates by SimHash fingerprints that meet at Golay codewords.

A 64-bit fingerprint is cut into three segments, each a word of the perfect binary Golay code of
length 23.  A word that lies three errors from its codeword also takes the five codewords at four
errors, so a word has one or six codeword indices of 12 bits, and two words at most two errors apart
share one.  At most four differing bits over three segments leave two segments with at most two
together, hence both with a common codeword: the keys of a fingerprint are the pairs of indices for
each two segments (84 on average, 24 bits each).  Fingerprints with a common key are compared in
full, which proves every link; none is lost.

Within a key, members are visited from link to link, so a dense group of any size gives one edge per
member and not all pairs.  A key with more members than a task should hold is cut into blocks, and
pairs of blocks are compared by separate tasks.  Edges are contracted round by round in Spark.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.common import arrow_schema, lower_ascii, map_texts, stored, words_of, wrapped
from repoweave.sources.scratch import broadcast_if_small

WORDS = 4
MOST_BITS = 4
SEED = 42
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a key that one task compares at once.
BLOCK = 8192

#: Generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0xC75

_KEYS = "key long, fingerprint long"
_FOUND = "a long, b long, key long, block long"


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 majority bits of the hashes of all word shingles; 0 without words."""
    import xxhash

    found = words_of(lower_ascii(text))
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        line = b" ".join(found)
        starts = np.cumsum([0] + [len(w) + 1 for w in found]).tolist()
        shingles = [line[a : b - 1] for a, b in zip(starts, starts[words:], strict=False)]
    digest = xxhash.xxh64_intdigest
    ones, count = np.zeros(64, np.int64), len(shingles)
    for at in range(0, count, 1 << 16):
        hashes = np.array([digest(s, SEED) for s in shingles[at : at + (1 << 16)]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprint_step():
    def step(texts, rest):
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return rest | {"fingerprint": values}

    return step


def _remainder(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@lru_cache(maxsize=1)
def golay_errors() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome the error patterns that lead to a codeword taken, and how many there are."""
    patterns = [sum(1 << i for i in c) for n in range(5) for c in combinations(range(23), n)]
    weights = [bin(p).count("1") for p in patterns]
    syndromes = _remainder(np.array(patterns)).tolist()
    least: dict[int, int] = {}
    for s, w in zip(syndromes, weights, strict=True):
        least[s] = min(w, least.get(s, 9))
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s, w, p in zip(syndromes, weights, patterns, strict=True):
        if w == least[s] or (w == 4 and least[s] == 3):
            table[s, count[s]] = p
            count[s] += 1
    return table, count


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n x 6) of the codewords of 23-bit words, and how many of them count."""
    table, count = golay_errors()
    syndrome = _remainder(words)
    return (words[:, None] ^ table[syndrome]) >> 11, count[syndrome]


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, position of the fingerprint) pairs."""
    bits = fingerprints.astype(np.uint64)
    parts = [
        codeword_indices(((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS
    ]
    keys, rows = [], []
    slot = np.arange(6)
    for number, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (left, n_left), (right, n_right) = parts[i], parts[j]
        used = (slot[None, :, None] < n_left[:, None, None]) & (slot[None, None, :] < n_right[:, None, None])
        row, a, b = np.nonzero(used)
        keys.append((number << 24) | (left[row, a] << 12) | right[row, b])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _key_rows(batches, schema: pa.Schema):
    for batch in batches:
        values = batch.column("fingerprint").to_numpy(zero_copy_only=False)
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096]
            keys, rows = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], schema=schema)


def _near(one: np.uint64, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ one) <= MOST_BITS


def spanning_edges(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints.

    Each visit compares one member with those not reached yet, so a dense group costs about its
    size and only members without links are compared with all.
    """
    left, edges = values.copy(), []
    while len(left):
        queue, left = [left[-1]], left[:-1]
        while queue and len(left):
            one = queue.pop()
            near = _near(one, left)
            if near.any():
                reached = left[near]
                edges += [(int(one), int(x)) for x in reached.view(np.int64)]
                queue += list(reached)
                left = left[~near]
    return [(int(np.uint64(a).view(np.int64)), b) for a, b in edges]


def crossing_edges(ones: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """For every member of ``others``, all it links to in ``ones`` up to a spanning forest.

    Members of ``others`` found by one member of ``ones`` are only searched again by members that
    may join them to another part, so the forest is kept by union of what has been joined.
    """
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for one in ones:
        a = int(np.uint64(one).view(np.int64))
        for b in others[_near(one, others)].view(np.int64).tolist():
            if (ra := root(a)) != (rb := root(b)):
                parent[ra] = rb
                edges.append((a, b))
    return edges


def _pairs_in_runs(keys: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Links within small runs: each member against the ones up to ``most`` places on."""
    a, b = [], []
    inside = np.repeat(sizes, sizes)
    rest = inside - (np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    at = np.arange(len(inside))
    index = np.repeat(starts, sizes) + (inside - rest)
    for shift in range(1, int(sizes.max(initial=0))):
        at = at[rest[at] > shift]
        left, right = values[index[at]], values[index[at] + shift]
        near = np.bitwise_count(left ^ right) <= MOST_BITS
        a.append(left[near])
        b.append(right[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def _compare(batches, block: int, schema: pa.Schema):
    """Edges of every key in rows sorted by (key, fingerprint).

    Rows of a key that come after the first ``block`` go out again, with a block number, together
    with the first ones, to be compared by pairs of blocks.
    """
    held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)
    blocks = 0  # full blocks of the key held last that have gone out

    def out(a, b, key=None, number=None):
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(a, np.int64)) if b is not None else none if key is None else pa.array(np.asarray(a, np.int64)),
                pa.array(np.asarray(b, np.int64)) if b is not None else none,
                none if key is None else pa.array(np.full(n, key, np.int64)),
                none if key is None else pa.array(np.full(n, number, np.int64)),
            ],
            schema=schema,
        )

    def finish(keys, values, first_blocks):
        """All runs in ``keys`` are complete; the first run continues ``first_blocks`` blocks."""
        if not len(keys):
            return
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(keys)))
        if first_blocks:
            values_0 = values[: sizes[0]]
            yield out(values_0.view(np.int64), None, int(keys[0]), first_blocks)
            yield from forest(values_0)
            starts, sizes = starts[1:], sizes[1:]
        small = (sizes > 1) & (sizes <= 48)
        a, b = _pairs_in_runs(keys, values, starts[small], sizes[small])
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield out(pairs[:, 0].view(np.int64), pairs[:, 1].view(np.int64))
        for start, size in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist(), strict=True):
            yield from forest(values[start : start + size])

    def forest(values):
        edges = spanning_edges(values)
        if edges:
            a, b = zip(*edges, strict=True)
            yield out(a, b)

    for batch in batches:
        held_keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
        held = np.concatenate([held, batch.column("fingerprint").to_numpy().view(np.uint64)])
        last = int(np.searchsorted(held_keys, held_keys[-1]))
        if last:
            yield from finish(held_keys[:last], held[:last], blocks)
            held_keys, held, blocks = held_keys[last:], held[last:], 0
        while len(held) > block:
            yield out(held[:block].view(np.int64), None, int(held_keys[0]), blocks)
            yield from forest(held[:block])
            held_keys, held, blocks = held_keys[block:], held[block:], blocks + 1
    yield from finish(held_keys, held, blocks)


def _cross(batches, schema: pa.Schema):
    """Edges between two blocks of a key, from rows sorted by (key, pair, side)."""
    current, ones, others = None, [], []

    def done():
        edges = crossing_edges(np.array(ones, np.int64).view(np.uint64), np.array(others, np.int64).view(np.uint64))
        return pa.RecordBatch.from_arrays(
            [pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], schema=schema
        )

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "block", "a")), strict=True)
        for key, low, high, block, value in rows:
            if (key, low, high) != current:
                if ones and others:
                    yield done()
                current, ones, others = (key, low, high), [], []
            (ones if block == low else others).append(value)
    if ones and others:
        yield done()


def link_edges(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all linked fingerprints, from a table of distinct ones.

    Not every link is an edge, but every link lies within a connected part of the edges.
    """
    keyed = classes.select("fingerprint").mapInArrow(partial(_key_rows, schema=arrow_schema(_KEYS)), _KEYS)
    by_key = keyed.repartition("key").sortWithinPartitions("key")
    found = stored(by_key.mapInArrow(partial(_compare, block=block, schema=arrow_schema(_FOUND)), _FOUND), "links")
    edges = found.where("b is not null").select("a", "b").distinct()
    over = found.where("b is null")
    if over.isEmpty():
        return edges
    # Every two blocks of such a key meet once; a row goes to as many pairs as its key has blocks.
    blocks = over.groupBy("key").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    paired = over.join(blocks, "key").select("key", "a", "block", other).where("other <> block")
    paired = paired.select("key", "a", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    schema = "a long, b long"
    crossed = (
        paired.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInArrow(partial(_cross, schema=arrow_schema(schema)), schema)
    )
    return edges.unionByName(crossed).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges``: nodes with the same root are connected.

    Each round maps every node to the neighbour that comes first in a random order (or itself) and
    contracts the edges by this map; edges that become loops go.  About half of the nodes go in a
    round whatever the shape, so the rounds grow with the logarithm of the largest component.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    nodes = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    roots, number = nodes.withColumn("root", F.col("node")), 0
    while not edges.isEmpty():
        number += 1
        both = edges.union(edges.select("b", "a"))
        order = lambda c, n=number: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("id"))
        first = stored(
            both.groupBy("a").agg(F.min(order("b")).alias("b"))
            .select(F.col("a").alias("from"), F.least("b", order("a"))["id"].alias("to")),
            "first",
        )
        step = broadcast_if_small(first)
        moved = edges.join(step.withColumnRenamed("from", "a"), "a").select(F.col("to").alias("x"), "b")
        moved = moved.join(step.withColumnRenamed("from", "b"), "b").select("x", F.col("to").alias("y"))
        edges = stored(
            moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        roots = (
            roots.join(step.withColumnRenamed("from", "root"), "root", "left")
            .select("node", F.coalesce("to", "root").alias("root"))
        )
        if number % 4 == 0:
            roots = stored(roots, "roots")
    return roots


def _linked(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (.., doc_id, fingerprint) with component_id."""
    classes = stored(
        rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies")),
        "classes",
    )
    roots = components(link_edges(classes, block))
    rooted = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stored(rooted.join(least, "root").select("fingerprint", "root", "component_id"), "components")
    return rows.join(broadcast_if_small(table), "fingerprint")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links of at most four bits, the
    document itself included.  Null and empty texts have fingerprint 0 and link like others.  A
    null doc_id is never the smallest, unless all of a component are null.  Repeated rows come out
    as often as they came; texts repeated under one doc_id link by their fingerprints.
    """
    rows = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"))
    prints = stored(map_texts(rows, _fingerprint_step, "doc_id long, fingerprint long"), "prints")
    return _linked(prints, block).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of every component, the one with the smallest doc_id, with all its columns."""
    staged = stored(wrapped(docs, F.col("doc_id").cast("bigint").alias("doc_id")), "near-docs")
    texts = staged.select(F.col("_doc.text").alias("text"), "_row", "doc_id")
    prints = stored(map_texts(texts, _fingerprint_step, "_row long, doc_id long, fingerprint long"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row"))["_row"]
    kept = stored(_linked(prints).groupBy("root").agg(first.alias("_row")).select("_row"), "near-kept")
    return staged.join(broadcast_if_small(kept), "_row").select("_doc.*")
