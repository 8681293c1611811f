"""Credential redaction over a table of files: narrow work only, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions import redaction as R


def _with_state(files: DataFrame, state: Column) -> DataFrame:
    """``files`` with the new ``content`` and the columns ``findings`` and ``found``."""
    done = files.withColumn("_state", state)
    return done.withColumns(
        {"content": F.col("_state.content"), "findings": F.col("_state.findings")}
    ).drop("_state").withColumn("found", F.size("findings") > 0)


def redact(files: DataFrame, patterns: Iterable[R.CredentialPattern] | None = None) -> DataFrame:
    """All patterns in order and the environment pass; works on streams as well."""
    return _with_state(files, R.redact("content", "path", None if patterns is None else tuple(patterns)))


def redact_pattern(files: DataFrame, pattern: R.CredentialPattern) -> DataFrame:
    return _with_state(files, R.redact_patterns("content", (pattern,)))


def redact_env(files: DataFrame) -> DataFrame:
    return _with_state(files, R.redact_env())


def findings_table(redacted: DataFrame) -> DataFrame:
    """One row per finding: repository, path, sequence in the file, place, type, preview."""
    # The outer form keeps the optimizer from testing the findings twice.
    exploded = redacted.select("repo_id", "path", F.posexplode_outer("findings").alias("n", "f"))
    return exploded.where(F.col("n").isNotNull()).select(
        "repo_id", "path", (F.col("n") + 1).cast("bigint").alias("seq"), "f.*"
    )


def pattern_matches(files: DataFrame) -> DataFrame:
    """Every match of every pattern on the unredacted text, with type and exemption."""
    gated = files.where(R.may_hold_credentials())
    patterns = F.array(*[p.column() for p in R.PATTERNS])
    by_pattern = gated.select("repo_id", "path", "content", F.explode(patterns).alias("p"))
    return by_pattern.select(
        "repo_id", "path", F.col("p.name").alias("pattern"),
        F.posexplode(R.matches_of(F.col("content"), F.col("p"))).alias("n", "h"),
    ).select(
        "repo_id", "path", "pattern", (F.col("n") + 1).cast("bigint").alias("n"),
        F.col("h.match").alias("match"), F.col("h.value").alias("value"),
        R.credential_type("h.match").alias("type"),
        R.is_false_positive("h.value").alias("is_false_positive"),
    )
