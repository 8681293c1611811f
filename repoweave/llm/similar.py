"""Near duplicates by similarity: word shingles with a Jaccard similarity of at least a bound.

Candidates come from two places, and every link is proved with the shingles of both texts.  SimHash
fingerprints that meet at Golay codewords (``simhash``) link the closest texts first.  Texts of
similarity 0.8 lie about ten of 64 bits apart, too far for codewords to meet, so the others share a band
of minima of hashed shingles: with 24 bands of five minima, a pair of similarity 0.8 shares none in less
than one of 10,000 cases, and more similar ones in fewer.  Of candidates by bands, only pairs that
agree in enough of all minima are proved; at similarity 0.8 fewer than one of 10,000 does not.

A band can hold a large group of near copies, so its members are first compared with one of them
chosen by hash, in a few rounds.  After that, members of different components are compared by their
minima within the tasks that hold a band, or two blocks of a large one, each pair in the first band that
it shares.  What comes out are the members that have a likely partner; only those are sent again, with
their hashed shingles, and proved where they meet.  So neither step gives more rows than a band has
members: the second gives the links of a spanning forest.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.common import arrow_schema, lower_ascii, map_texts, stored, words_of, wrapped
from repoweave.llm.simhash import components, fingerprint, link_edges
from repoweave.sources.scratch import broadcast_if_small

WORDS = 5
LEAST = 0.8
BANDS, MINIMA = 24, 5
SEED = 42
#: Rounds in which members of a band are compared with one of them only.
ROUNDS = 2
#: Share of all minima in which a pair must agree to be proved.
LIKELY = 0.65
#: Members of a band that a task compares with each other or with as many others, their shingles, and
#: cells and shingles at a time.
BLOCK = 4096
BLOCK_SHINGLES = 1 << 21
_CELLS = 1 << 24

_SETS = "_row long, size long, bands array<long>, minima binary, fingerprint long"
_PAIRS = "a long, b long, size_a long, size_b long"
_LINKS = "a long, b long"
_MEMBERS = "band long, nth int, low long, high long, block long, _row long, root long"
_HASHES = "_row long, hashes binary"


def shingles(text: bytes, words: int = WORDS) -> set[bytes]:
    """Distinct runs of words in lower case; a shorter text is one run, without words an empty one."""
    found = words_of(lower_ascii(text))
    if len(found) <= words:
        return {b" ".join(found)}
    return set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))


def similarity(one: set[bytes], other: set[bytes]) -> float:
    both = len(one & other)
    return both / (len(one) + len(other) - both)


def bands(found: set[bytes]) -> tuple[list[int], bytes]:
    """16 bits of each minimum over the hashed shingles, and one number for each band of them.

    The numbers follow from these bits, so that two texts share a band where its minima are the same.
    """
    rng = np.random.default_rng(SEED)
    factors, offsets, mix = (rng.integers(1 << 62, size=BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
    hashes = hashed(found)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * factors + offsets
        least = np.minimum(least, (part ^ part >> np.uint64(29)).min(axis=0))
    # The upper bits of a minimum are mostly zero.
    least = least.astype("<u2")
    sums = (least * mix).reshape(BANDS, MINIMA).sum(axis=1, dtype=np.uint64) ^ mix[:BANDS]
    return sums.view(np.int64).tolist(), least.tobytes()


def hashed(found: set[bytes]) -> np.ndarray:
    """XXH64 of each shingle, in order."""
    from xxhash import xxh64_intdigest

    return np.sort(np.array([xxh64_intdigest(s, SEED) for s in found], np.uint64))


def _hashes_step(words: int):
    def step(texts, rest):
        return rest | {"hashes": [hashed(shingles(t, words)).astype("<u8").tobytes() for t in texts]}

    return step


def _sets_step(words: int):
    def step(texts, rest):
        found = [shingles(t, words) for t in texts]
        banded = [bands(f) for f in found]
        prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64).tolist()
        return rest | {
            "size": [len(f) for f in found], "bands": [b for b, _ in banded], "minima": [m for _, m in banded], "fingerprint": prints,
        }

    return step


def agreement(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many minima each row of ``one`` agrees with each of ``other``."""
    out = np.empty((len(one), len(other)), np.int16)
    step = max(1, _CELLS // max(1, other.size))
    for at in range(0, len(one), step):
        out[at : at + step] = (one[at : at + step, None, :] == other[None, :, :]).sum(axis=2)
    return out


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), BANDS * MINIMA)


def _likely(batches, schema: pa.Schema):
    """Of pairs with the minima of both, those that agree in enough."""
    for batch in batches:
        same = (_minima(batch.column("minima_a")) == _minima(batch.column("minima_b"))).sum(axis=1)
        yield batch.select(schema.names).filter(pa.array(same >= LIKELY * BANDS * MINIMA))


def _groups(batches):
    """(low, high, table) of each (band, low, high), from members sorted by these."""
    current, parts = None, []
    for batch in batches:
        keys = np.column_stack([batch.column(n).to_numpy() for n in ("band", "low", "high")])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(keys[a].tolist())
            if key != current:
                if parts:
                    yield current[1], current[2], pa.Table.from_batches(parts)
                current, parts = key, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield current[1], current[2], pa.Table.from_batches(parts)


def _likely_within(low: int, high: int, members: pa.Table):
    """Places (i, j) of likely pairs of different roots that share no earlier band, some at a time.

    ``low`` and ``high`` are two blocks of a band; where they are the same, all its members meet.
    """
    minima = _minima(members.column("minima").combine_chunks())
    root, block = members.column("root").to_numpy(), members.column("block").to_numpy()
    nth = members.column("nth")[0].as_py()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    for at in range(0, len(left), 512):
        some = left[at : at + 512]
        likely = agreement(minima[some], minima[right]) >= LIKELY * BANDS * MINIMA
        likely &= root[some][:, None] < root[right] if low == high else root[some][:, None] != root[right]
        i, j = np.nonzero(likely)
        for k in range(0, len(i), _CELLS >> 8):
            a, b = some[i[k : k + (_CELLS >> 8)]], right[j[k : k + (_CELLS >> 8)]]
            shared = (minima[a] == minima[b]).reshape(-1, BANDS, MINIMA).all(axis=2)
            first = shared.argmax(axis=1) == nth
            yield a[first], b[first]


def _with_partner(batches, schema: pa.Schema):
    """Members that have a likely partner in their band."""
    for low, high, members in _groups(batches):
        has = np.zeros(len(members), bool)
        for i, j in _likely_within(low, high, members):
            has[i] = has[j] = True
        yield from members.select(schema.names).filter(pa.array(has)).to_batches()


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes of ``own`` each of the ``others`` holds."""
    lengths = np.array([len(o) for o in others])
    every = np.concatenate(others)
    found = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    return np.add.reduceat(found, np.append(0, np.cumsum(lengths)[:-1]), dtype=np.int64)


def _forest(batches, least: float, schema: pa.Schema):
    """Links (a, b) that connect all members of a band that are linked in it, with no more than that."""
    for low, high, members in _groups(batches):
        hashes = [np.frombuffer(h, "<u8") for h in members.column("hashes").to_pylist()]
        row, parent = members.column("_row").to_numpy(), {r: r for r in members.column("root").to_pylist()}
        root, links = members.column("root").to_pylist(), []

        def top(place):
            x = root[place]
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in _likely_within(low, high, members):
            starts = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i)) if len(i) else []
            for a, b in zip(starts, starts[1:], strict=False):
                one = int(i[a])
                others = [k for k in j[a:b].tolist() if top(k) != top(one)]
                while others:
                    # As many at a time as hold a bounded number of hashes, or one longer.
                    held, n = 0, 0
                    while n < len(others) and (n == 0 or held + len(hashes[others[n]]) <= BLOCK_SHINGLES):
                        held, n = held + len(hashes[others[n]]), n + 1
                    some, others = others[:n], others[n:]
                    both = _shared(hashes[one], [hashes[k] for k in some]).tolist()
                    for k, n_both in zip(some, both, strict=True):
                        similar = n_both / (len(hashes[one]) + len(hashes[k]) - n_both) >= least
                        if similar and top(k) != top(one):
                            parent[top(k)] = top(one)
                            links.append((one, k))
        places = np.array(links, np.int64).reshape(-1, 2)
        ends = np.sort(row[places], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)


def _prove(batches, words: int, least: float, schema: pa.Schema):
    """Pairs that are links, from rows with both texts; those of one ``a`` follow each other."""
    known, own = None, set()
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("a", "b")] + [batch.column(c).cast(pa.binary()) for c in ("text_a", "text_b")]
        for at in range(batch.num_rows):
            a, b, text_a, text_b = (c[at].as_py() for c in columns)
            if a != known:
                known, own = a, shingles(text_a or b"", words)
            if similarity(own, shingles(text_b or b"", words)) >= least:
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)


def _links(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Pairs (a, b) of rows of at least the similarity, from candidates (a, b, size_a, size_b)."""
    # No two sets are more similar than the smaller is to the larger by size.
    fits = F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b")
    ordered = pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(ordered.distinct(), "near-pairs")
    # Most rows are in no pair; their texts do not move.
    asked = stored(pairs.select(F.col("a").alias("_row")).union(pairs.select("b")).distinct(), "near-asked")
    texts = texts.join(broadcast_if_small(asked), "_row", "left_semi")
    text = lambda side: texts.select(F.col("_row").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(text("b"), "b").join(text("a"), "a").sortWithinPartitions("a")
    return stored(both.mapInArrow(partial(_prove, words=words, least=least, schema=arrow_schema(_LINKS)), _LINKS), "near-links")


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Pairs (a, b, size_a, size_b) that connect all rows whose fingerprints link."""
    first = F.min(F.struct("_row", "size"))
    classes = stored(sets.groupBy("fingerprint").agg(first.alias("f")).select("fingerprint", "f.*"), "near-classes")
    small = broadcast_if_small(classes)
    same = sets.select("fingerprint", F.col("_row").alias("b"), F.col("size").alias("size_b")).join(small, "fingerprint")
    same = same.where("b <> _row").select(F.col("_row").alias("a"), "b", F.col("size").alias("size_a"), "size_b")

    def side(x: str) -> DataFrame:
        return small.select(F.col("fingerprint").alias(f"f{x}"), F.col("_row").alias(x), F.col("size").alias(f"size_{x}"))

    edges = link_edges(classes).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return same.unionByName(edges.join(side("a"), "fa").join(side("b"), "fb").select(same.columns))


def linked(texts: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(node, root) of all rows of ``texts`` (_row, text) that are similar to another one."""
    sets = stored(map_texts(texts, partial(_sets_step, words), _SETS), "near-sets")
    links = _links(_by_fingerprint(sets), texts, words, least)
    roots = stored(components(links), "near-roots")
    minima = sets.select("_row", "minima")
    members = sets.select("_row", "size", F.posexplode("bands").alias("nth", "band"))
    shared = members.groupBy("band").count().where("count > 1").select("band")
    members = stored(members.join(shared, "band"), "shared-bands")
    for number in range(ROUNDS + 1):
        rooted = members.join(broadcast_if_small(roots).withColumnRenamed("node", "_row"), "_row", "left")
        rows = rooted.withColumn("root", F.coalesce("root", "_row"))
        open_bands = rows.groupBy("band").agg(
            F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")
        )
        rows = stored(rows.join(open_bands.where("least < most").select("band", "n", "total"), "band"), "band-members")
        if rows.isEmpty():
            break
        if number < ROUNDS:
            order = F.struct(F.xxhash64("_row", F.lit(number)).alias("h"), "_row", "size", "root")
            first = rows.groupBy("band").agg(F.min(order).alias("f"))
            met = rows.join(first, "band").where("root <> f.root").select(
                F.col("_row").alias("a"), F.col("f._row").alias("b"), F.col("size").alias("size_a"), F.col("f.size").alias("size_b")
            )
            of = lambda x: minima.select(F.col("_row").alias(x), F.col("minima").alias(f"minima_{x}"))
            both = met.distinct().join(of("a"), "a").join(of("b"), "b")
            pairs = both.mapInArrow(partial(_likely, schema=arrow_schema(_PAIRS)), _PAIRS)
            found = _links(pairs, texts, words, least)
        else:
            found = _links_within(rows, minima, texts, words, least)
        links = links.unionByName(found)
        roots = stored(components(links), "near-roots")
    return roots


def _links_within(rows: DataFrame, minima: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links between members of a band that have different roots, each band or two blocks of it in a task."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("_row", F.lit("block")), blocks).cast("bigint")
    placed = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select(
        "band", "nth", "_row", "root", "block",
        F.least("block", "other").cast("bigint").alias("low"), F.greatest("block", "other").cast("bigint").alias("high"),
    )

    def by_key(table: DataFrame) -> DataFrame:
        return table.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")

    likely = by_key(placed.join(minima, "_row")).mapInArrow(partial(_with_partner, schema=arrow_schema(_MEMBERS)), _MEMBERS)
    likely = stored(likely, "near-likely")
    asked = stored(likely.select("_row").distinct(), "near-asked")
    hashes = map_texts(texts.join(broadcast_if_small(asked), "_row", "left_semi"), partial(_hashes_step, words), _HASHES)
    both = by_key(likely.join(minima, "_row").join(hashes, "_row"))
    return stored(both.mapInArrow(partial(_forest, least=least, schema=arrow_schema(_LINKS)), _LINKS), "near-links")


def drop_similar(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of every component of similar texts, the one with the smallest doc_id, with all its columns.

    Null texts count as empty; texts without words are alike.  A null doc_id stays only if all of a
    component are null.
    """
    staged = stored(wrapped(docs, F.col("doc_id").cast("bigint").alias("doc_id")), "near-docs")
    roots = linked(staged.select(F.col("_doc.text").alias("text"), "_row"), words, least)
    ids = roots.join(staged.select(F.col("_row").alias("node"), "doc_id"), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node"))["node"]
    kept = ids.groupBy("root").agg(first.alias("node")).select("node")
    gone = stored(roots.join(kept, "node", "left_anti").select(F.col("node").alias("_row")), "near-gone")
    return staged.join(broadcast_if_small(gone), "_row", "left_anti").select("_doc.*")
