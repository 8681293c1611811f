"""Where results go: documents, listings and reports as tables or text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as one Parquet table; a folder per repository would be millions of small files."""
    documents.write.mode("errorifexists").parquet(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """Documents as text files, one folder per repository: for people, not for millions of repositories."""
    documents.select("repo_id", F.col("document").alias("value")).write.mode(
        "errorifexists"
    ).partitionBy("repo_id").text(path)


def write_parts(parts: DataFrame, path: str) -> None:
    """Documents from their parts, one folder of text files per repository, to be read in name order."""
    order = ["repo_id", "part", "key", "pos"]
    parts.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "repo_id", F.col("text").alias("value")
    ).write.mode("errorifexists").partitionBy("repo_id").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report lines sorted by repository, path and sequence across the written files."""
    report.orderBy("repo_id", "path", "seq").write.mode("errorifexists").json(path)


def write_listing(listing: DataFrame, path: str) -> None:
    listing.orderBy("repo_id", "dir", "rank").write.mode("errorifexists").json(path)
