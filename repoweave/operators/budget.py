"""Fitting a repository into a size budget and a token budget.

Both budgets are walks in a fixed order that skip what does not fit.  Neither
needs a whole repository in one place: counts by size, or a cut per hash part
of a large repository, first drop the rows that provably cannot be kept.  What
is left per repository is bounded by the budget, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoweave.functions import fixed, paths
from repoweave.operators.rank import rank_within_repo, score_order
from repoweave.plans.options import PackOptions
from repoweave.sources.scratch import broadcast_if_small, written

#: Files of one size in a repository above which no window ranks them.
EDGE_ROWS = 50_000


def _salt(buckets: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(buckets))


def _running(value: Column) -> Column:
    """Sum of ``value`` over the files before this one in metadata order."""
    # Ordering by a plain column lets the windows of a step share one sort.
    order = [F.col("is_main").desc(), F.col("size").asc(), F.col("path").asc()]
    window = Window.partitionBy("repo_id").orderBy(*order)
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def within_reach(rows: DataFrame, opts: PackOptions = PackOptions(), edge_rows: int = EDGE_ROWS) -> DataFrame:
    """``rows`` with ``is_main``, without the files that the size budget cannot keep; sizes alone tell.

    Files are counted by (repository, tier, size), which gives the largest size that can still be
    kept if every file has the fewest characters its bytes can hold (a quarter).  Files below that
    size stay, and of those of that size as many as then fit, in path order.  Where more than
    ``edge_rows`` files have that size, their places come from a range sort and not from a window.
    """
    limit, size, tier = opts.limit_bytes, F.col("size"), ["repo_id", "is_main"]
    fewest = F.ceil(size / F.lit(4))
    rows = rows.where(size.between(1, limit)).withColumn("is_main", paths.is_include_name())
    smaller = Window.partitionBy(*tier).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*tier, "size").agg(F.count(F.lit(1)).alias("_n"))
    left = F.lit(limit) - size - F.coalesce(F.sum(F.col("_n") * fewest).over(smaller), F.lit(0))
    reached = counted.withColumn("_quota", F.floor(left / fewest) + 1).where(F.col("_quota") > 0)
    edge = F.max(F.struct("size", "_quota", "_n")).alias("_e")
    last = written(
        reached.groupBy(*tier).agg(edge)
        .select(*tier, F.col("_e.size").alias("_last"), F.col("_e._quota").alias("_quota"), F.col("_e._n").alias("_n")),
        "cut_off",
    )
    near = rows.join(broadcast_if_small(last), tier)
    at_edge, many = near.where(size == F.col("_last")), F.col("_n") > edge_rows
    by_path = Window.partitionBy(*tier).orderBy("path")
    parts = [near.where(size < F.col("_last")), at_edge.where(~many).withColumn("rank", F.row_number().over(by_path))]
    if not last.where(many).isEmpty():
        parts += [rank_within_repo(at_edge.where(many & t), [F.col("path")]) for t in (F.col("is_main"), ~F.col("is_main"))]
    first = [p.where(F.col("rank") <= F.col("_quota")) for p in parts[1:]]
    return reduce(DataFrame.unionByName, [p.select(*rows.columns) for p in (parts[0], *first)])


def size_budget(rows: DataFrame, opts: PackOptions = PackOptions()) -> DataFrame:
    """Files kept when walked in metadata order: ``rows`` plus ``is_main, used_before``.

    A file is kept if the characters kept so far plus its bytes stay in the
    limit.  Sizes ascend within a tier (main files, others), so once a file does
    not fit no later one of its tier does, and a running sum decides:

    1. ``within_reach`` drops what the limit excludes whatever the characters are.
    2. The rest, at most some ``limit`` files per tier and usually a few hundred, is decided exactly
       in one window.
    """
    limit, size, chars, main = opts.limit_bytes, F.col("size"), F.col("chars"), F.col("is_main")
    possible = within_reach(rows, opts)
    fits_main = main & (F.col("_main") + size <= limit)
    used = F.when(main, F.col("_main")).otherwise(F.col("_kept_main") + F.col("_rest"))
    return (
        possible.withColumns({
            "_main": _running(F.when(main, chars)), "_rest": _running(F.when(~main, chars)),
        })
        .withColumn("_kept_main", _running(F.when(fits_main, chars)))
        .withColumn("used_before", used.cast("bigint"))
        .where(F.col("used_before") + size <= limit)
        .drop("_main", "_rest", "_kept_main")
    )


def token_candidates(rows: DataFrame, opts: PackOptions) -> DataFrame:
    """The rows that a token walk could keep, at most a number set by the limit.

    Files that cost the same are refused for good once one of them is: what is
    used only grows.  So of each cost class only the first ``limit / cost`` in
    score order matter, and the always-kept ones.  With summaries all files
    above the summary cost share its class, as each may be kept at that cost.
    """
    limit = opts.token_limit_chars
    cost = F.least("size", F.lit(fixed.SUMMARY_COST)) if opts.summarize_large_files else F.col("size")
    # A large file may also be kept whole, so it is told apart from one of just that cost.
    large = F.col("size") > fixed.SUMMARY_COST if opts.summarize_large_files else F.lit(False)
    quota = F.floor(F.lit(limit) / F.col("_cost")) + fixed.ALWAYS_KEPT

    def first(table: DataFrame, most: Column, *keys: str) -> DataFrame:
        window = Window.partitionBy("repo_id", "_cost", *keys).orderBy(*score_order())
        return table.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= most)

    classed = rows.where(F.col("size") >= 1).withColumns(
        {"_cost": cost, "_large": large, "_salt": _salt(opts.salt_buckets)}
    )
    bounded = first(first(classed.where(~F.col("_large")), quota, "_salt"), quota)
    if opts.summarize_large_files:
        # All large files cost the same, so their quota is a number that Spark cuts by before the shuffle.
        most = F.lit(limit // fixed.SUMMARY_COST + fixed.ALWAYS_KEPT)
        large_rows = classed.where("_large")
        bounded = bounded.unionByName(first(first(large_rows, most, "_salt"), most))
    return bounded.drop("_cost", "_large", "_salt", "_n")


def token_budget(scored: DataFrame, opts: PackOptions = PackOptions(), bounded: bool = False) -> DataFrame:
    """Files kept when walked in score order: ``scored`` plus ``cost, summarized, rank``.

    The ten best are always kept.  Each further file is kept whole if it fits,
    else at the cost of a summary if summaries are on and that fits, else it is
    skipped and the walk goes on.  Spark brings the candidates of a repository
    together in order; the walk streams over them and holds only its counters.
    ``bounded`` tells that a size budget has already bounded each repository.
    """
    limit, summarize = opts.token_limit_chars, opts.summarize_large_files
    always, summary_cost = fixed.ALWAYS_KEPT, fixed.SUMMARY_COST
    schema = T.StructType(list(scored.schema.fields))
    schema = schema.add("cost", T.LongType()).add("summarized", T.BooleanType()).add("rank", T.LongType())

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, used, seen, rank = None, 0, 0, 0
        for batch in batches:
            costs, ranks = [], []
            for owner, size in zip(batch["repo_id"], batch["size"]):
                if owner != repo:
                    repo, used, seen, rank = owner, 0, 0, 0
                cost = size if seen < always or used + size <= limit else None
                if cost is None and summarize and used + min(size, summary_cost) <= limit:
                    cost = min(size, summary_cost)
                seen += 1
                if cost is not None:
                    used, rank = used + cost, rank + 1
                costs.append(-1 if cost is None else cost)
                ranks.append(rank)
            decided = batch.assign(cost=costs, summarized=batch["size"] > costs, rank=ranks)
            yield decided[decided["cost"] >= 0]

    candidates = scored if bounded else token_candidates(scored, opts)
    in_order = candidates.repartition("repo_id").sortWithinPartitions("repo_id", *score_order())
    return in_order.mapInPandas(walk, schema)
