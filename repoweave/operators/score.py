"""Relevance score of a file: a sum of integer terms, each a column of its own."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions import fixed, paths
from repoweave.functions.text import is_in, lookup, mentions_any, shared
from repoweave.plans.options import PackOptions

DAY_MICROS = 86_400_000_000


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0)).cast("bigint")


def size_points() -> Column:
    size = F.col("size")
    small = F.greatest(F.lit(0), F.lit(50) - F.floor(size / F.lit(1000))).cast("bigint")
    return (
        small
        + _points(size > 100 * fixed.KB, -50)
        + _points(size < 100, -20)
        + _points((size > 500) & (size < 10 * fixed.KB), 20)
    )


def recency_points(opts: PackOptions) -> Column:
    """Up to 30 points for the last two weeks, unless only recent files are taken anyway."""
    if opts.recent_days:
        return F.lit(0).cast("bigint")
    age = F.unix_micros(F.to_timestamp(F.lit(opts.as_of))) - F.unix_micros("mtime")
    half_days = F.floor(age * F.lit(2) / F.lit(float(DAY_MICROS)))
    points = F.greatest(F.lit(0), F.lit(30) - half_days)
    return F.when(age < 14 * DAY_MICROS, points).otherwise(F.lit(0)).cast("bigint")


def infra_points(opts: PackOptions) -> Column:
    if not opts.infrastructure:
        return F.lit(0).cast("bigint")
    ext, base = paths.lower_ext(), paths.basename()
    return (
        F.when(is_in(ext, [".tf", ".tfvars", ".hcl"]), 100)
        .when(is_in(ext, [".yaml", ".yml"]), F.when(F.col("has_manifest"), 80).otherwise(0))
        .when((base == "Dockerfile") | base.contains("docker-compose"), 70)
        .when(is_in(ext, [".tpl", ".tmpl", ".j2"]), 60)
        .otherwise(0)
        .cast("bigint")
    )


def penalties() -> dict[str, Column]:
    path, base = F.col("path"), paths.basename()
    generated = mentions_any(base, fixed.GENERATED_NAME_PARTS) | mentions_any(
        path, fixed.GENERATED_PATH_PARTS
    )
    tests = mentions_any(base, fixed.TEST_NAME_PARTS) | mentions_any(path, fixed.TEST_PATH_PARTS)
    return {
        "generated_points": _points(generated, -80),
        "minified_points": _points(mentions_any(base, fixed.MINIFIED_NAME_PARTS), -100),
        "test_points": _points(tests, -40),
    }


def terms(opts: PackOptions = PackOptions()) -> dict[str, Column]:
    """All terms over the columns of ``facts``."""
    capped = lambda points: F.least(F.lit(20), points).cast("bigint")
    return {
        "docs_points": _points(is_in(F.lower(paths.basename()), fixed.DOC_NAMES), 200),
        "config_points": _points(paths.is_high_priority(), 150),
        "entry_points": _points(paths.is_entry_point(), 100),
        "folder_points": _points(paths.in_important_folder(), 50),
        "extension_points": lookup(paths.lower_ext(), fixed.EXTENSION_POINTS, 0).cast("bigint"),
        "size_points": size_points(),
        "import_points": capped(F.col("imports") * 2),
        "definition_points": capped(F.col("definitions")),
        "architecture_points": _points(F.col("has_architecture"), 15),
        "recency_points": recency_points(opts),
        "infra_points": infra_points(opts),
        **penalties(),
    }


def score_files(facts: DataFrame, opts: PackOptions = PackOptions()) -> DataFrame:
    """``facts`` with every term and their sum, ``score``."""
    parts = terms(opts)
    return facts.withColumns(parts).withColumn("score", reduce(add, [F.col(c) for c in parts]))


@shared
def total(opts: PackOptions = PackOptions()) -> Column:
    return reduce(add, terms(opts).values())


def scored(facts: DataFrame, opts: PackOptions = PackOptions()) -> DataFrame:
    """``facts`` with ``score`` only."""
    return facts.withColumn("score", total(opts))
