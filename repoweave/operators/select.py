"""Which files to keep, and why: one ordered first-match decision per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions import fixed, paths
from repoweave.functions.globs import any_glob_regex
from repoweave.functions.text import is_in, mentions_any, shared
from repoweave.plans.options import PackOptions

ACCEPTED = [
    "include_name", "special_name", "high_priority", "entry_point", "important_folder",
    "extension", "content",
]


# ------------------------------------------------------------- predicates ----
@shared
def in_ignored_directory(opts: PackOptions = PackOptions()) -> Column:
    names = F.array(*[F.lit(x) for x in fixed.IGNORE_DIR_NAMES])
    hit = F.arrays_overlap(paths.directories(), names) | is_in(paths.basename(), fixed.IGNORE_BASE_NAMES)
    if opts.ignore:
        hit = hit | F.col("path").rlike(any_glob_regex(list(opts.ignore), dot=True))
    return hit


def _excludes(opts: PackOptions) -> list[str]:
    return list(fixed.EXCLUDE_FILES if opts.exclude is None else opts.exclude)


@shared
def is_excluded_exactly(opts: PackOptions = PackOptions()) -> Column:
    return is_in(paths.basename(), _excludes(opts))


def is_excluded_by_glob(opts: PackOptions = PackOptions()) -> Column:
    globs = [x for x in _excludes(opts) if "*" in x]
    return paths.basename().rlike(any_glob_regex(globs)) if globs else F.lit(False)


@shared
def has_include_name(opts: PackOptions = PackOptions()) -> Column:
    names = fixed.INCLUDE_NAMES if opts.files is None else list(opts.files) + fixed.NO_EXTENSION_NAMES
    hit = is_in(paths.basename(), sorted(set(names)))
    if opts.needs_detection:
        hit = hit | F.array_contains("added_names", paths.basename())
    return hit


@shared
def has_special_name() -> Column:
    return mentions_any(paths.basename(), fixed.NO_EXTENSION_NAMES)


def extensions_for(opts: PackOptions) -> list[str]:
    """The extensions that hold for every repository, before project detection."""
    base = list(fixed.INCLUDE_EXTENSIONS if opts.extensions is None else opts.extensions)
    if opts.infrastructure:
        base += fixed.INFRA_ADDED_EXTENSIONS
    return list(dict.fromkeys(base))


@shared
def has_extension(opts: PackOptions = PackOptions()) -> Column:
    hit = is_in(paths.extname(), extensions_for(opts))
    if opts.needs_detection:
        hit = hit | F.array_contains("added_extensions", paths.extname())
    return hit


def is_recent(opts: PackOptions) -> Column:
    if not opts.recent_days:
        return F.lit(True)
    cutoff = F.to_timestamp(F.lit(opts.as_of)) - F.expr(f"INTERVAL {int(opts.recent_days)} DAYS")
    return F.col("mtime") >= cutoff


def fits_file_limit(opts: PackOptions = PackOptions()) -> Column:
    return F.col("size").between(1, opts.max_file_bytes)


# --------------------------------------------------------------- decision ----
@shared
def first_reason(opts: PackOptions = PackOptions()) -> Column:
    """Label of the first rule that decides, ignore rules left aside.

    Works on the columns of ``facts``; needs ``added_extensions`` and
    ``added_names`` if detection matters.
    """
    stale = ~is_recent(opts)
    return (
        F.when(in_ignored_directory(opts), "ignored_directory")
        .when(is_excluded_exactly(opts), "excluded_name")
        .when(is_excluded_by_glob(opts), "excluded_glob")
        .when(has_include_name(opts), F.when(stale, "stale").otherwise("include_name"))
        .when(has_special_name(), "special_name")
        .when(paths.is_high_priority(), "high_priority")
        .when(paths.is_entry_point(), "entry_point")
        .when(
            has_extension(opts),
            F.when(paths.in_important_folder(), "important_folder")
            .when(stale, "stale_extension").otherwise("extension"),
        )
        .when(F.col("looks_like_code"), "content")
        .otherwise("no_rule")
    )


def reason(opts: PackOptions = PackOptions()) -> Column:
    """The final label, from ``first_reason`` and, if ignore rules count, ``is_gitignored``.

    Ignore rules reach the files that only their extension speaks for, or with
    ``strict_gitignore`` all files.
    """
    first = F.col("first_reason")
    label = F.when(first == "stale_extension", "stale").otherwise(first)
    if not opts.respect_gitignore:
        return label
    reached = first.isin("extension", "stale_extension")
    if opts.strict_gitignore:
        reached = first != "ignored_directory"
    return F.when(reached & F.col("is_gitignored"), "gitignored").otherwise(label)


def is_accepted(label: str = "reason") -> Column:
    return F.col(label).isin(ACCEPTED)


def excluded_names(spark) -> DataFrame:
    """The exactly excluded names as a table of fixed size."""
    names = [n for n in fixed.EXCLUDE_FILES if "*" not in n]
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("base"))


def without_excluded(files: DataFrame, names: DataFrame) -> DataFrame:
    """Anti-join on the base name; a name table of any size works."""
    return files.withColumn("base", paths.basename()).join(names, "base", "left_anti")


