"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT style).

A node holds a few split points; a row belongs to the subtree of the nearest one, so the borders are
hyperplanes.  For each split point and each subtree beside it, the node stores the least and the
largest distance from the point to the subtree's rows, and for each subtree the least and largest norm.
Scores are inner products, so a window of scores is an annulus of distances around a query, as wide as
the norms allow.  A subtree is eliminated if, for any split point, the range to it does not meet the
annulus seen from there (triangle inequality).  Leaves are compared exactly.  What has been found
narrows a window from below: with k rows found, lower scores than the k-th no longer matter.

The upper levels, fitted on a bounded sample, deal all rows into cells; their ranges are aggregated
over all rows.  A cell's rows lie in blocks of bounded expected size, by hash, so a vector that a
third of the rows share fills many blocks.  Queries go to the blocks of the cells that are left, in
chunks of bounded size; a task builds the lower levels of one block and searches one chunk in it.
Results of blocks are merged by rank.  Nothing is left out, so results are exact; where vectors are so
spread that no range eliminates anything, all queries meet all blocks.

Positives of all anchors are searched first (once in the block nearest to each, for a lower bound, then
everywhere), then the windows that each positive's score gives.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoweave.llm.common import arrow_schema, stored

POSITIVES, NEGATIVES = 5, 3
#: Percent of a positive's score within which a negative's score must lie.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Integer steps that one unit of a component has.
SCALE = 256
#: Rows of the sample that the upper levels' split points are chosen from.
SAMPLE = 4096
#: Split points of a node, rows wanted in a cell, and levels above the cells at most.
FANOUT, CELL, LEVELS = 16, 1024, 3
#: Rows expected in a block and rows in a leaf within it at most; anchors expected in a chunk.
BLOCK, LEAF, CHUNK = 8192, 128, 16_384
#: Pairs of queries and rows that a task compares at a time.
_CELLS = 1 << 21
_FOUND = "anchor long, window int, score long, vec_id long, _row long"
_RANGES = "node long, point long, child long, least double, most double"


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors in integer steps, as doubles; missing last components are zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        out = flat.reshape(len(sizes), dim)
    else:
        out = np.zeros((len(sizes), dim))
        out[np.arange(dim) < sizes[:, None]] = flat
    return np.floor(SCALE * out)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` and ``b``; beyond a long, its limits."""
    largest = lambda m: float(np.abs(m).max(initial=0.0))
    if largest(a) * largest(b) * max(1, a.shape[1]) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    limit = 2**63 - 1
    return np.clip(np.dot(whole(a), whole(b).T), -limit, limit).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        return np.sqrt(np.maximum(squares, 0))


def split_points(rows: np.ndarray, count: int) -> np.ndarray:
    """Numbers of up to ``count`` rows that lie far apart, none equal to another."""
    some = np.unique(np.linspace(0, len(rows) - 1, 10 * count).astype(int)) if len(rows) > 10 * count else np.arange(len(rows))
    chosen = [0]
    apart = distances(rows[some], rows[some[:1]])[:, 0]
    while len(chosen) < min(count, len(some)):
        next_one = int(np.argmax(apart))
        if not apart[next_one] > 0:
            break
        chosen.append(next_one)
        apart = np.minimum(apart, distances(rows[some], rows[some[next_one : next_one + 1]])[:, 0])
    return some[chosen]


class Node:
    """Split points with, for each child, the ranges of distances from all points and of norms."""

    def __init__(self, points: np.ndarray):
        count = len(points)
        self.points = points
        #: Nodes, or what stands for a leaf: rows of a block, or the number of a cell.
        self.children: list = [None] * count
        self.least, self.most = np.full((count, count), np.inf), np.full((count, count), -np.inf)
        self.norms = np.full(count, np.inf), np.full(count, -np.inf)
        self.size = float(np.sqrt((points * points).sum(axis=1)).max(initial=0.0))

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        return np.argmin(np.nan_to_num(distances(rows, self.points), nan=np.inf), axis=1)

    def reach(self, child: int, apart: np.ndarray, norms: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which queries (distances to the points, norms, windows of scores) may find rows in a child."""
        with np.errstate(over="ignore", invalid="ignore"):
            low, high = self.norms[0][child], self.norms[1][child]
            far = np.sqrt(np.maximum(norms * norms + high * high - 2 * least, 0))
            near = np.sqrt(np.maximum(norms * norms + low * low - 2 * most, 0))
            slack = 1e-6 * (1 + norms + high + self.size)
            above = self.least[:, child] > apart + (far + slack)[:, None]
            below = self.most[:, child] < np.maximum(apart - far[:, None], near[:, None] - apart) - slack[:, None]
            return ~(above | below).any(axis=1)


def grow(rows: np.ndarray, held: np.ndarray) -> Node | np.ndarray:
    """The tree over the rows numbered ``held`` (ascending); rows themselves if they are few or alike."""
    if len(held) <= LEAF:
        return held
    node = Node(rows[held[split_points(rows[held], FANOUT)]])
    if len(node.points) < 2:
        return held
    apart = distances(rows[held], node.points)
    nearest = np.argmin(np.nan_to_num(apart, nan=np.inf), axis=1)
    norms = np.sqrt((rows[held] * rows[held]).sum(axis=1))
    if (nearest == nearest[0]).all():
        return held
    for child in range(len(node.points)):
        own = nearest == child
        if own.any():
            node.least[:, child], node.most[:, child] = apart[own].min(axis=0), apart[own].max(axis=0)
            node.norms[0][child], node.norms[1][child] = norms[own].min(), norms[own].max()
            node.children[child] = grow(rows, held[own])
    return node


class Search:
    """The best rows of one block for each of many windows.

    A window belongs to an anchor (row of ``vectors``) and asks for the ``count`` rows of highest score
    between ``least`` and ``most``, of the anchor's label or of others, the anchor itself left out.
    Rows are in order of vec_id, so among equal scores earlier ones come first.
    """

    def __init__(self, rows, labels, locators, vectors, anchor_labels, anchor_rows, of, least, most, same: bool, count: int):
        self.rows, self.labels, self.locators = rows, labels, locators
        self.vectors, self.anchor_labels, self.anchor_rows = vectors, anchor_labels, anchor_rows
        self.of, self.least, self.most, self.same, self.count = of, least.astype(np.float64), most, same, count
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def run(self, tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row, score) of the best rows."""
        self._visit(tree, np.arange(len(self.of)))
        if not self.found:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        window, row, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((row, -score, window))
        window, row, score = window[order], row[order], score[order]
        nth = np.arange(len(window)) - np.searchsorted(window, window)
        best = nth < self.count
        return window[best], row[best], score[best]

    def _visit(self, node, windows: np.ndarray) -> None:
        if node is None or not len(windows):
            return
        if isinstance(node, np.ndarray):
            step = max(1, _CELLS // len(node))
            for i in range(0, len(windows), step):
                self._leaf(node, windows[i : i + step])
            return
        anchors, place = np.unique(self.of[windows], return_inverse=True)
        apart = distances(self.vectors[anchors], node.points)
        for child in np.argsort(apart.mean(axis=0)).tolist():
            if node.children[child] is not None:
                ok = node.reach(child, apart[place], self.norms[self.of[windows]], self.least[windows], self.most[windows])
                self._visit(node.children[child], windows[ok])

    def _leaf(self, held: np.ndarray, windows: np.ndarray) -> None:
        anchors, place = np.unique(self.of[windows], return_inverse=True)
        scores = inner(self.vectors[anchors], self.rows[held])
        own = (self.labels[held] == self.anchor_labels[anchors][:, None]) == self.same
        own &= self.locators[held] != self.anchor_rows[anchors][:, None]
        scores, own = scores[place], own[place]
        own &= (scores >= self.least[windows][:, None]) & (scores <= self.most[windows][:, None])
        many = np.flatnonzero(own.sum(axis=1) > self.count)
        if len(many):
            # The count-th best is a bound; of rows that equal it, the first ones.
            inside = np.where(own[many], scores[many], np.iinfo(np.int64).min)
            bound = np.partition(inside, -self.count, axis=1)[:, -self.count]
            ties = own[many] & (inside == bound[:, None])
            own[many] &= (inside > bound[:, None]) | (ties & (np.cumsum(ties, axis=1) <= self.count))
            self.least[windows[many]] = bound
        w, r = np.nonzero(own)
        if len(w):
            self.found.append((windows[w], held[r], scores[w, r]))


def upper_levels(sample: np.ndarray, rows: int) -> Node | int:
    """The upper levels for a table of ``rows`` rows, with cells numbered from 0; a sole cell is 0."""
    wanted, levels = -(-rows // CELL), 0
    while FANOUT**levels < wanted and levels < LEVELS:
        levels += 1
    fanout = min(FANOUT, max(2, round(wanted ** (1 / levels)))) if levels else 0
    cells = iter(range(FANOUT**LEVELS + 1))

    def build(held: np.ndarray, left: int):
        if not left or len(held) < 2:
            return next(cells)
        node = Node(held[split_points(held, fanout)])
        if len(node.points) < 2:
            return next(cells)
        nearest = node.nearest(held)
        node.children = [build(held[nearest == c], left - 1) for c in range(len(node.points))]
        return node

    return build(sample, levels)


def _nodes(tree) -> list[Node]:
    return [tree] + [n for c in tree.children for n in _nodes(c)] if isinstance(tree, Node) else []


def _cells_of(tree, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)

    def place(node, held):
        if not isinstance(node, Node):
            out[held] = node
            return
        nearest = node.nearest(rows[held])
        for c, child in enumerate(node.children):
            place(child, held[nearest == c])

    place(tree, np.arange(len(rows)))
    return out


def _deal(batches, tree: Broadcast, dim: int, schema: pa.Schema):
    for batch in batches:
        cells = _cells_of(tree.value, matrix(batch.column("embedding"), dim))
        columns = [pa.array(cells) if f.name == "cell" else batch.column(f.name) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _ranges(batches, tree: Broadcast, dim: int, schema: pa.Schema):
    """Ranges of distances for each node, split point and child (point -1: of norms) over a task's rows."""
    nodes = _nodes(tree.value)
    number = {id(n): i for i, n in enumerate(nodes)}
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def measure(node, rows):
        if not isinstance(node, Node) or not len(rows):
            return
        apart = np.column_stack((distances(rows, node.points), np.sqrt((rows * rows).sum(axis=1))))
        nearest = node.nearest(rows)
        for c, child in enumerate(node.children):
            own = nearest == c
            if own.any():
                key, found = (number[id(node)], c), (apart[own].min(axis=0), apart[own].max(axis=0))
                old = held.get(key, found)
                held[key] = np.minimum(old[0], found[0]), np.maximum(old[1], found[1])
                measure(child, rows[own])

    for batch in batches:
        measure(tree.value, matrix(batch.column("embedding"), dim))
    out = [
        (n, i if i < len(least) - 1 else -1, c, least[i], most[i])
        for (n, c), (least, most) in held.items() for i in range(len(least))
    ]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


class Index:
    """All rows of a table (_row, vec_id, label, embedding) in blocks of cells, and the upper levels."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.count, self.dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        first = rows.orderBy(F.xxhash64("_row"), "_row").limit(SAMPLE).select("embedding").toArrow()
        self.tree = upper_levels(matrix(first.column(0), self.dim), self.count)
        fields = [f for f in rows.schema.names]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        width = pa.float32() if "float" in rows.schema["embedding"].dataType.simpleString() else pa.float64()
        schema = pa.schema([(f, pa.list_(width) if f == "embedding" else pa.int64()) for f in [*fields, "cell"]])
        sent = self.spark.sparkContext.broadcast(self.tree)
        deal = partial(_deal, tree=sent, dim=self.dim, schema=schema)
        dealt = stored(rows.mapInArrow(deal, f"{kinds}, cell long"), "tree-rows")
        for r in (
            dealt.mapInArrow(partial(_ranges, tree=sent, dim=self.dim, schema=arrow_schema(_RANGES)), _RANGES)
            .groupBy("node", "point", "child").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()
        ):
            node = _nodes(self.tree)[r["node"]]
            if r["point"] < 0:
                node.norms[0][r["child"]], node.norms[1][r["child"]] = r["least"], r["most"]
            else:
                node.least[r["point"], r["child"]], node.most[r["point"], r["child"]] = r["least"], r["most"]
        self.sent = self.spark.sparkContext.broadcast(self.tree)
        #: One row for each cell, of which there are at most FANOUT ** LEVELS.
        sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        self.blocks = stored(sizes, "tree-blocks")
        self.rows = dealt.join(F.broadcast(self.blocks), "cell").withColumn(
            "block", F.pmod(F.xxhash64("_row", F.lit("block")), F.col("blocks")).cast("int")
        )

    def search(self, anchors: DataFrame, count: int, same: bool, nearest: bool = False) -> DataFrame:
        """(anchor, window, score, vec_id, _row) of the best ``count`` rows of each block for each window.

        ``anchors`` has _row, label, embedding and the windows' bounds as arrays least and most; they
        are sent to all blocks their windows can reach, or only to one of the nearest cell.
        """
        chunks = max(1, -(-anchors.count() // CHUNK))
        kinds = {f.name: f.dataType.simpleString() for f in anchors.schema}
        names = ["_row", "label", "embedding", "least", "most"]
        fields = ", ".join(f"{n} {kinds[n]}" for n in names) + ", cell long"
        sent = anchors.select(*names).mapInArrow(partial(_route, tree=self.sent, dim=self.dim, nearest=nearest), fields)
        sent = sent.join(F.broadcast(self.blocks), "cell")
        chunk = F.pmod(F.xxhash64("_row", F.lit("chunk")), F.lit(chunks)).cast("int").alias("chunk")
        one = F.pmod(F.xxhash64("_row", F.lit("block")), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        sent = sent.select(*names, "cell", (one if nearest else every).alias("block"), chunk)
        rows = self.rows.select(
            "_row", "vec_id", "label", "embedding", "cell", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
        )
        on = ["cell", "block", "chunk"]
        search = partial(_search, dim=self.dim, count=count, same=same, schema=arrow_schema(_FOUND))
        return rows.groupBy(*on).cogroup(sent.groupBy(*on)).applyInArrow(search, _FOUND)


def _route(batches, tree: Broadcast, dim: int, nearest: bool):
    top = tree.value
    for batch in batches:
        vectors = matrix(batch.column("embedding"), dim)
        if nearest:
            held, cells = np.arange(len(vectors)), _cells_of(top, vectors)
        else:
            held, cells = _reached(top, vectors, batch)
        sent = batch.take(pa.array(held))
        yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(cells, pa.int64())], [*sent.schema.names, "cell"])


def _reached(top, vectors: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, cell) for all cells that any window of an anchor can reach."""
    of, least, most = _windows(batch)
    norms, held, cells = np.sqrt((vectors * vectors).sum(axis=1)), [], []

    def visit(node, windows):
        if not len(windows):
            return
        if not isinstance(node, Node):
            anchors = np.unique(of[windows])
            held.append(anchors), cells.append(np.full(len(anchors), node))
            return
        apart = distances(vectors, node.points)
        for c, child in enumerate(node.children):
            # A child that no row belongs to has an empty range.
            if node.norms[1][c] >= 0:
                visit(child, windows[node.reach(c, apart[of[windows]], norms[of[windows]], least[windows], most[windows])])

    visit(top, np.arange(len(of)))
    none = [np.empty(0, np.int64)]
    return np.concatenate(held or none), np.concatenate(cells or none)


def _windows(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, least and most of all windows; a null bound is none."""
    column = lambda n: batch.column(n).combine_chunks() if isinstance(batch.column(n), pa.ChunkedArray) else batch.column(n)
    least, most = column("least"), column("most")
    of = np.repeat(np.arange(len(least)), least.value_lengths().to_numpy(zero_copy_only=False))
    bound = lambda x, none: x.flatten().cast(pa.float64(), safe=False).fill_null(none).to_numpy(zero_copy_only=False)
    return of, bound(least, -np.inf), bound(most, np.inf)


def _search(rows: pa.Table, anchors: pa.Table, dim: int, count: int, same: bool, schema: pa.Schema) -> pa.Table:
    if not rows.num_rows or not anchors.num_rows:
        return schema.empty_table()
    rows = rows.sort_by([("vec_id", "ascending"), ("_row", "ascending")])  # null ids come last
    vectors = matrix(rows.column("embedding"), dim)
    plain = lambda table, n: table.column(n).to_numpy()
    of, least, most = _windows(anchors)
    search = Search(
        vectors, plain(rows, "label"), plain(rows, "_row"), matrix(anchors.column("embedding"), dim),
        plain(anchors, "label"), plain(anchors, "_row"), of, least, most, same, count,
    )
    window, row, score = search.run(grow(vectors, np.arange(len(vectors))))
    first = np.searchsorted(of, of)  # windows of an anchor are numbered from 0
    number = (np.arange(len(of)) - first)[window]
    return pa.Table.from_arrays([
        pa.array(plain(anchors, "_row")[of[window]]), pa.array(number, pa.int32()), pa.array(score),
        rows.column("vec_id").take(pa.array(row)), rows.column("_row").take(pa.array(row)),
    ], schema=schema)


def _best(found: DataFrame, count: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_row")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= count)


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, label and embedding.  Rows with a null label, a null vector or any null or
    non-finite component take no part; rows of which ``anchors`` holds are the anchors.  Components count as
    floor(SCALE * x); a shorter vector is filled up with zeros, so an empty one has score 0 with all.  Scores
    are exact integers (beyond a long, its limits).  Higher scores come first, then smaller vec_id,
    null ids last.  A positive is one of the first rows of the anchor's label, other than
    itself; negatives are the first rows of other labels within LEAST_PERCENT and MOST_PERCENT of the
    positive's score, so a negative positive_score has none.  Repeated rows take part each for itself.
    Other columns are not looked at; no rows give none.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = stored(
        rows.select(
            F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("label").cast("bigint").alias("label"), F.col("embedding").cast(kind).alias("embedding"),
            F.coalesce(anchors, F.lit(False)).alias("_anchor"),
        ),
        "vectors",
    )
    asked = rows.where("_anchor").drop("_anchor")
    index = Index(rows.drop("_anchor"))
    bounds = lambda least, most: (F.array(least).alias("least"), F.array(most).alias("most"))
    nothing = F.lit(None).cast("bigint")
    near = index.search(asked.select("*", *bounds(nothing, nothing)), positives, same=True, nearest=True)
    bound = near.groupBy("anchor").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= positives)
    asked = stored(asked.join(bound.select(F.col("anchor").alias("_row"), "bound"), "_row", "left"), "anchors")
    first = _best(index.search(asked.select("*", *bounds(F.col("bound"), nothing)), positives, same=True), positives, "anchor")
    # A percentage of a score, rounded up or down, by quotient and remainder so that no product overflows.
    chosen = stored(
        first.select(
            "anchor", F.col("nth").alias("number"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
            *[
                F.expr(f"(score - pmod(score, 100)) div 100 * {percent} + (pmod(score, 100) * {percent} + {up}) div 100").alias(name)
                for name, percent, up in (("least", LEAST_PERCENT, 99), ("most", MOST_PERCENT, 0))
            ],
        ),
        "positives",
    )
    windows = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("number", "least", "most"))).alias("w"))
    windows = asked.join(windows, asked["_row"] == windows["anchor"]).select(
        "_row", "label", "embedding", F.col("w.least").alias("least"), F.col("w.most").alias("most")
    )
    found = _best(index.search(stored(windows, "windows"), negatives, same=False), negatives, "anchor", "window")
    found = found.select("anchor", (F.col("window") + 1).alias("number"), F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asked.select(F.col("_row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(chosen, ["anchor", "number"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
