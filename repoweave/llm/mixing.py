"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected as often as the source's target bears to its size.  The
expected copies are summed in an order within the source, one random offset per source is added, and
a document is emitted once for each integer that its step of the sum crosses.  The order is by size,
so the words taken differ from the target by less than the largest document; within a size it is by
a hash of doc_id.  Positions come from counts per (source, size, slice of the hash), so no window
holds more than a slice of one size, and no task a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoweave.llm.common import numbered, stored, word_count, wrapped
from repoweave.sources.scratch import broadcast_if_small

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
#: Rows of one (source, size) class above which it is cut into slices of about this many.
SLICE = 50_000
#: Expected copies are counted in this fraction of a copy; hashes have as many values over 4.
UNIT_BITS = 30
HASH_BITS = 28


def hashed(value: Column, seed: str) -> Column:
    """28 bits of SHA-256, which other engines can compute too."""
    text = F.concat(F.lit(seed), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 7), 16, 10).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST
) -> DataFrame:
    """Target words per source: shares of ``budget`` times all words by weight, filled up like water.

    One row per source, and windows over all of them: the number of sources bounds the work.  In
    the order of capacity by weight the first sources are full; the level of the others follows
    from what is left over by them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.lit(list(weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    table = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    table = (
        table.withColumn("total", F.lit(budget) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - full) / rest)
        .withColumn("nth", F.row_number().over(fill))
    )
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    table = table.withColumn("at", F.min(open_).over(everything)["level"])
    return table.select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), "cap")).alias("target")
    )


def _copies(position: Column) -> Column:
    """Integers crossed by the step of the ``position``-th document.

    Whole turns of the position change the sum by whole steps, and so by integers that cancel; only
    its rest is multiplied, which keeps the product within 64 bits at any number of documents.
    """
    end = F.col("offset") + F.pmod(position, F.lit(1 << UNIT_BITS)) * F.col("step")
    return F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("step"), UNIT_BITS)


def plan_mix(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST,
    seed: str = "mix", slice_rows: int = SLICE,
) -> DataFrame:
    """Rows (_row, doc_id, source, size) with source_size, target and copies.

    Null sources are one source, last in the order.  Null doc_ids hash as empty text.  A source
    without words has target 0 and no copies.  The result does not depend on the partitions of
    the input, nor on ``slice_rows``.
    """
    sources = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    most_units = F.lit(int(most * (1 << UNIT_BITS)))
    sources = stored(
        sources.withColumn("step", F.least(F.round(rate * (1 << UNIT_BITS)).cast("bigint"), most_units))
        .withColumn("offset", hashed(F.col("source"), seed) * (1 << (UNIT_BITS - HASH_BITS))),
        "mix-sources",
    )
    rows = sized.withColumn("_hash", hashed(F.col("doc_id"), seed))
    classes = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-classes")
    slices = F.ceil(F.col("n") / slice_rows).cast("bigint")
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))
    cut = rows.alias("r").join(broadcast_if_small(classes).alias("c"), same).select(
        "r.*", F.shiftright(F.col("r._hash") * slices, HASH_BITS).alias("_slice")
    )
    counts = cut.groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("size", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(
        counts.select("source", "size", "_slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")),
        "mix-before",
    )
    inside = Window.partitionBy("source", "size", "_slice").orderBy("_hash", "doc_id")
    ranked = cut.withColumn("_rank", F.row_number().over(inside))
    same = same & (F.col("r._slice") == F.col("c._slice"))
    placed = ranked.alias("r").join(broadcast_if_small(before).alias("c"), same).select("r.*", "c._before")
    known = F.col("r.source").eqNullSafe(F.col("s.source"))
    return (
        placed.alias("r").join(broadcast_if_small(sources).alias("s"), known)
        .select("r.*", "s.source_size", "s.target", "s.step", "s.offset")
        .withColumn("copies", _copies(F.col("_before") + F.col("_rank")))
        .select("_row", "doc_id", "source", "size", "source_size", "target", "copies")
    )


def measure(docs: DataFrame) -> DataFrame:
    """Rows numbered and sized in words; null text has none."""
    return numbered(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
        ),
        "mix-sized",
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with all their columns, each as often as it is emitted."""
    staged = stored(
        wrapped(
            docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
        ),
        "mix-docs",
    )
    plan = plan_mix(staged.select("_row", "doc_id", "source", "size"))
    taken = stored(plan.where("copies > 0").select("_row", "copies"), "mix-taken")
    chosen = staged.join(broadcast_if_small(taken), "_row")
    return chosen.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
