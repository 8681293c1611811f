"""One pass over the contents: everything later steps need to know about a file.

The result is narrow (no content), so selection, scoring, budgets and reports
shuffle about a hundred bytes per file.  Facts that a plan does not use are
pruned and never computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions import fixed, paths, sniff
from repoweave.functions.text import Text, contains_any, count_of, is_in, shared, sum_of
from repoweave.operators.select import extensions_for
from repoweave.plans.options import PackOptions


@shared
def import_count(content: Text = "content") -> Column:
    return sum_of(count_of(content, *form) for form in fixed.IMPORT_FORMS)


@shared
def definition_count(content: Text = "content") -> Column:
    return sum_of(count_of(content, *form) for form in fixed.DEFINITION_FORMS)


@shared
def has_architecture(content: Text = "content") -> Column:
    return contains_any(content, fixed.ARCHITECTURE_MARKERS)


@shared
def has_manifest(content: Text = "content") -> Column:
    return contains_any(content, fixed.MANIFEST_MARKERS)


def is_undecided(opts: PackOptions = PackOptions()) -> Column:
    """Whether a file may need a look at its content: no other rule can decide it by name and size."""
    return (
        ~is_in(paths.extname(), extensions_for(opts))
        & ~paths.is_binary()
        & (F.col("size") <= fixed.SNIFF_MAX_BYTES)
    )


def named_facts(listing: DataFrame, opts: PackOptions = PackOptions()) -> DataFrame:
    """``facts`` as far as names and sizes tell; ``looks_like_code`` is what a look could say at most."""
    return listing.withColumns({
        "looks_like_code": is_undecided(opts), "has_packer_markers": F.lit(False),
    })


def facts(files: DataFrame, opts: PackOptions = PackOptions()) -> DataFrame:
    """``repo_id, path, size, mtime`` and what the content tells."""
    content, ext = F.col("content"), paths.extname()
    # The sniff decides only files that no other rule can, so only those are looked at.
    may_be_packer = (ext == ".json") & ~is_in(paths.basename(), fixed.PACKER_EXEMPT_NAMES)
    packer = content.contains(fixed.PACKER_MARKERS[0]) & content.contains(fixed.PACKER_MARKERS[1])
    return files.select(
        "repo_id", "path", "size", "mtime",
        F.length(content).cast("bigint").alias("chars"),
        F.when(is_undecided(opts), sniff.looks_like_code()).otherwise(False).alias("looks_like_code"),
        F.when(may_be_packer, packer).otherwise(False).alias("has_packer_markers"),
        import_count().alias("imports"),
        definition_count().alias("definitions"),
        has_architecture().alias("has_architecture"),
        has_manifest().alias("has_manifest"),
    )
