"""Orders and top-k cuts within a repository that hold for a repository of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoweave.functions import fixed, paths
from repoweave.sources.scratch import broadcast_if_small, written


def score_order() -> list[Column]:
    return [F.col("score").desc(), F.col("path").asc()]


def metadata_order() -> list[Column]:
    """Main files first, then smaller files first; small before large is implied."""
    return [paths.is_include_name().desc(), F.col("size").asc(), F.col("path").asc()]


def rank_within_repo(
    rows: DataFrame, order: list[Column], name: str = "rank", costly: bool = False
) -> DataFrame:
    """``rows`` with their 1-based position in their repository.

    A window by repository would sort the largest repository in one task.  Here
    the rows are range-sorted on (repository, order), which splits a large
    repository over many slices, and written once so that slices and positions
    are fixed.  A small aggregate counts the rows of earlier slices, and the
    position follows by arithmetic.  A range sort computes its input twice, for the
    sample and for the sort, so ``costly`` rows (from content) are written first.
    """
    if costly:
        rows = written(rows, "rows")
    position = F.monotonically_increasing_id()
    sorted_rows = rows.orderBy("repo_id", *order).withColumn("_at", position)
    placed = written(
        sorted_rows.withColumn("_slice", F.shiftright("_at", 33)), name
    )
    slices = placed.groupBy("repo_id", "_slice").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    earlier = (
        Window.partitionBy("repo_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    # One row per repository and slice it touches: at most repositories + slices rows.
    offsets = written(slices.withColumn("_before", before).drop("_n"), "offsets")
    position = (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("bigint")
    ranked = placed.join(broadcast_if_small(offsets), ["repo_id", "_slice"])
    return ranked.withColumn(name, position).drop("_slice", "_at", "_first", "_before")


def top_in_repo(rows: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per repository, for a small ``k``.

    Spark keeps only ``k`` rows per repository and task before the shuffle.
    """
    by_order = Window.partitionBy("repo_id").orderBy(*order)
    return rows.withColumn(name, F.row_number().over(by_order).cast("bigint")).where(F.col(name) <= k)


def cap_files(rows: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` files per repository in metadata order."""
    return rank_within_repo(rows, metadata_order()).where(F.col("rank") <= cap)


def priority_cap(rows: DataFrame, cap: int) -> DataFrame:
    """All priority files, then the others in path order while the cap leaves room."""
    priority = paths.is_high_priority() | paths.is_entry_point()
    ranked = rank_within_repo(
        rows.withColumn("is_priority", priority),
        [F.col("is_priority").desc(), F.col("path").asc()],
    )
    return ranked.where(F.col("is_priority") | (F.col("rank") <= cap))


def priority_union_rest(rows: DataFrame) -> DataFrame:
    """Priority files, then the files that are not among them; ``is_priority`` tells which."""
    return rows.withColumn("is_priority", paths.is_high_priority() | paths.is_entry_point())


def critical_files(scored: DataFrame) -> DataFrame:
    """The best files of a repository, which a token budget always keeps."""
    return top_in_repo(scored, score_order(), fixed.ALWAYS_KEPT)


def largest_files(rows: DataFrame, k: int = fixed.DISPLAY_FILES) -> DataFrame:
    """The ``k`` largest files per repository, with the number of files not shown."""
    counts = rows.groupBy("repo_id").agg(F.count("*").alias("n"))
    top = top_in_repo(rows, [F.col("size").desc(), F.col("path").asc()], k)
    more = F.greatest(F.col("n") - k, F.lit(0)).cast("bigint")
    return top.join(counts, "repo_id").withColumn("more_files", more).drop("n")
