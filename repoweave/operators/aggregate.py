"""Totals, groupings and reports per repository; all combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoweave.functions import fixed, paths
from repoweave.operators import select
from repoweave.plans.options import PackOptions


def _totals() -> list:
    return [
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        F.sum(paths.token_estimate("size")).alias("tokens"),
    ]


def repo_totals(rows: DataFrame) -> DataFrame:
    """Files, bytes, shown size and the token estimate of the bytes, as a document header has them."""
    totals = rows.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return totals.withColumns(
        {"shown_size": paths.human_size("bytes"), "tokens": paths.token_estimate("bytes")}
    )


def by_directory(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo_id", paths.dirname().alias("dir")).agg(*_totals())


def by_type(rows: DataFrame) -> DataFrame:
    """Groups without files do not appear."""
    return rows.groupBy("repo_id", paths.type_group().alias("type_group")).agg(*_totals())


def skip_counts(
    labelled: DataFrame, kept: DataFrame, opts: PackOptions = PackOptions(), under_cap: DataFrame | None = None
) -> DataFrame:
    """Per repository, how many accepted files each later stage dropped.

    ``labelled`` comes from ``select.with_reason``, ``kept`` from the size budget, ``under_cap``
    from the file cap, which drops none by default.  All are aggregated before they meet, so one row per repository is joined.
    """
    binary, size = paths.is_binary(), F.col("size")
    large = ~binary & (size > opts.max_file_bytes)
    eligible = ~binary & select.fits_file_limit(opts)
    counted = labelled.where("selected").groupBy("repo_id").agg(
        F.count("*").alias("selected"),
        F.count_if(binary).alias("skipped_binary"),
        F.count_if(large).alias("skipped_large"),
        F.coalesce(F.sum(F.when(large, size)), F.lit(0)).alias("skipped_large_bytes"),
        F.count_if(~binary & (size == 0)).alias("skipped_empty"),
        F.count_if(eligible).alias("_eligible"),
    )
    used = kept.groupBy("repo_id").agg(
        F.count("*").alias("included"), F.sum("size").alias("included_bytes"),
        F.sum(paths.token_estimate("chars")).alias("included_tokens"),
    )
    zero = F.lit(0).cast("bigint")
    filled = {c: F.coalesce(F.col(c), zero) for c in ("included", "included_bytes", "included_tokens")}
    if under_cap is None:
        counted = counted.withColumn("_left", F.col("_eligible"))
    else:
        left = under_cap.groupBy("repo_id").agg(F.count("*").alias("_left"))
        counted = counted.join(left, "repo_id", "left").withColumn("_left", F.coalesce("_left", zero))
    return (
        counted.join(used, "repo_id", "left").withColumns(filled)
        .withColumn("over_cap", F.col("_eligible") - F.col("_left"))
        .withColumn("over_budget", F.col("_left") - F.col("included")).drop("_eligible", "_left")
    )


def repo_stats(skips: DataFrame) -> DataFrame:
    """The statistics record of a project, with real skip counts."""
    return skips.select(
        "repo_id",
        F.col("selected").alias("total_files"),
        F.col("included").alias("included_files"),
        F.col("included_bytes").alias("total_size"),
        F.col("included_tokens").alias("total_tokens"),
        F.col("skipped_binary").alias("skipped_binary_files"),
        F.col("skipped_large").alias("skipped_large_files"),
        # Invalid sequences are replaced when a file is read, so none is skipped for them.
        F.lit(0).cast("bigint").alias("skipped_encoding_issues"),
    )


def budget_warnings(rows: DataFrame, opts: PackOptions = PackOptions()) -> DataFrame:
    """Whether the characters of a repository exceed its size and token limits."""
    totals = rows.groupBy("repo_id").agg(F.sum("chars").alias("chars"))
    return totals.select(
        "repo_id", "chars", paths.token_estimate("chars").alias("tokens"),
        (F.col("chars") > opts.limit_bytes).alias("over_size_limit"),
        (F.col("chars") > opts.token_limit_chars).alias("over_token_limit"),
    )


def dry_run_summary(kept: DataFrame) -> DataFrame:
    """The largest kept files of each repository beside its totals.

    A budget has bounded the rows of a repository, so windows over it are safe.
    """
    whole = Window.partitionBy("repo_id")
    by_size = whole.orderBy(F.col("size").desc(), F.col("path").asc())
    return kept.select(
        "repo_id", "path", "size", paths.human_size().alias("shown_size"),
        paths.token_estimate("chars").alias("tokens"),
        F.row_number().over(by_size).cast("bigint").alias("rank"),
        F.count("*").over(whole).alias("total_files"), F.sum("chars").over(whole).alias("total_chars"),
    ).where(F.col("rank") <= fixed.DISPLAY_FILES).withColumns({
        "more_files": F.greatest(F.col("total_files") - fixed.DISPLAY_FILES, F.lit(0)).cast("bigint"),
        "total_tokens": paths.token_estimate("total_chars"),
    })


def findings_by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", "path", "type").agg(F.count("*").alias("findings"))


def findings_total(redacted: DataFrame) -> DataFrame:
    """Findings and files with findings per repository, counted without exploding them."""
    return redacted.groupBy("repo_id").agg(
        F.sum(F.size("findings")).alias("findings"), F.count_if("found").alias("files_with_findings")
    )


def findings_report(findings: DataFrame) -> DataFrame:
    """The lines of the credential report; sort by repository, path and sequence to print."""
    place = F.concat(F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"))
    return findings.select(
        "repo_id", "path", "seq",
        F.concat(
            F.lit("  - "), "type", F.lit(" at line "), place, F.lit(": "), "preview"
        ).alias("entry"),
    )


def report_lines(findings: DataFrame) -> DataFrame:
    """The whole credential report per repository, to be read by ``part, path, seq``.

    Part 0 is the title, part 1 each file's heading (``seq`` 0) and findings, part 2 the total.
    ``findings`` is read three times; write it first if it is costly.
    """
    def lines(table: DataFrame, part: int, path, seq, entry) -> DataFrame:
        return table.select(
            "repo_id", F.lit(part).cast("bigint").alias("part"), path.alias("path"),
            seq.cast("bigint").alias("seq"), entry.alias("entry"),
        )

    totals = findings.groupBy("repo_id").agg(F.count("*").alias("n"))
    files = findings.select("repo_id", "path").distinct()
    none, zero = F.lit(""), F.lit(0)
    total = F.concat(F.lit("\n" + fixed.REPORT_TOTAL), F.col("n").cast("string"), F.lit("\n" + fixed.REPORT_RULE))
    return (
        lines(totals, 0, none, zero, F.lit(fixed.REPORT_TITLE + "\n" + fixed.REPORT_RULE))
        .unionByName(lines(files, 1, F.col("path"), zero, F.concat(F.lit("\nFile: "), "path")))
        .unionByName(lines(findings_report(findings), 1, F.col("path"), F.col("seq"), F.col("entry")))
        .unionByName(lines(totals, 2, none, zero, total))
    )


def directory_levels(rows: DataFrame, depth: int = fixed.TREE_DEPTH) -> DataFrame:
    """Directories down to ``depth`` with the files at or below them."""
    names = paths.directories()
    level = F.explode(F.sequence(F.lit(1), F.least(F.size("_dirs"), F.lit(depth))))
    return (
        rows.select("repo_id", names.alias("_dirs")).where(F.size("_dirs") > 0)
        .withColumn("level", level)
        .groupBy("repo_id", F.array_join(F.slice("_dirs", F.lit(1), F.col("level")), "/").alias("dir"),
                 F.col("level").cast("bigint").alias("level"))
        .agg(F.count("*").alias("files"))
    )


def directory_tree(rows: DataFrame) -> DataFrame:
    """Lines of a two-level tree: ``repo_id, top, pos, line``; hidden directories are left out.

    At most five directories are shown below each top directory, then a count
    of the others.  Sort by repository, top and position to print.
    """
    names = paths.directories()
    pairs = rows.select(
        "repo_id", F.get(names, F.lit(0)).alias("top"), F.get(names, F.lit(1)).alias("sub")
    ).where(F.col("top").isNotNull() & ~F.col("top").startswith(".")).distinct()
    tops = pairs.groupBy("repo_id", "top").agg(F.count("sub").alias("n"))
    shown = fixed.TREE_CHILDREN
    by_name = Window.partitionBy("repo_id", "top").orderBy("sub")
    subs = (
        pairs.where(F.col("sub").isNotNull())
        .withColumn("pos", F.row_number().over(by_name).cast("bigint")).where(F.col("pos") <= shown)
        .where(~F.col("sub").startswith("."))
        .select("repo_id", "top", "pos", F.concat(F.lit("  |   |- "), "sub", F.lit("/")).alias("line"))
    )
    head = tops.select(
        "repo_id", "top", F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.lit("  |- "), "top", F.lit("/")).alias("line"),
    )
    more = tops.where(F.col("n") > shown).select(
        "repo_id", "top", F.lit(shown + 1).cast("bigint").alias("pos"),
        F.concat(F.lit("  |   |- ... "), (F.col("n") - shown).cast("string"), F.lit(" more directories")).alias("line"),
    )
    return head.unionByName(subs).unionByName(more)


def directory_tree_deep(rows: DataFrame, depth: int = fixed.TREE_DEPTH, shown: int = fixed.TREE_CHILDREN) -> DataFrame:
    """A tree of ``depth`` levels: ``repo_id, key, level, line, files, directories``.

    Sort by repository and key to print.  Below each directory, and at the root, the first ``shown``
    directories by name are given with the files at or below them and the directories right below
    them, then a line that counts the others.  Hidden directories and what lies in them are left out.

    Counts are rolled up once from the files; the first children of a directory are a cut by rank, which
    Spark makes before it shuffles; levels below are kept by a join with the few directories above them.
    """
    names = F.filter(paths.directories(), lambda n: n != "")
    hidden = F.filter(F.transform("_dirs", lambda n, i: F.when(n.startswith("."), i)), lambda i: i.isNotNull())
    # What lies in a hidden directory counts for the directories above it.
    visible = F.coalesce(F.get(hidden, F.lit(0)), F.size("_dirs"))
    levels = F.least("_visible", F.lit(depth + 1))
    at = (
        rows.select("repo_id", names.alias("_dirs")).withColumn("_visible", visible).where(F.col("_visible") > 0)
        .withColumn("level", F.explode(F.sequence(F.lit(1), levels)))
    )
    nodes = at.groupBy("repo_id", F.slice("_dirs", F.lit(1), F.col("level")).alias("names")).agg(F.count("*").alias("files"))
    above = F.slice("names", F.lit(1), F.size("names") - 1)
    nodes = nodes.select("*", F.size("names").cast("bigint").alias("level"), above.alias("above"))
    below = nodes.groupBy("repo_id", "above").agg(F.count("*").alias("directories"))
    by_name = Window.partitionBy("repo_id", "above").orderBy(F.element_at("names", -1))
    first = nodes.where(F.col("level") <= depth).withColumn("_nth", F.row_number().over(by_name)).where(F.col("_nth") <= shown)
    first = first.drop("_nth")
    kept = first.where("level = 1")
    whole = kept
    for level in range(2, depth + 1):
        up = kept.select("repo_id", F.col("names").alias("above"))
        kept = first.where(F.col("level") == level).join(up, ["repo_id", "above"], "left_semi").select(whole.columns)
        whole = whole.unionByName(kept)
    # Names end in a character before all others, so a directory stands before what lies in it.
    key = lambda dirs: F.array_join(F.transform(dirs, lambda n: F.concat(n, F.lit("\x01"))), "")
    indent = lambda level: F.concat(F.lit("  "), F.repeat(F.lit("|   "), level.cast("int")))
    counts = below.select("repo_id", F.col("above").alias("names"), "directories")
    lines = whole.join(counts, ["repo_id", "names"], "left").select(
        "repo_id", key("names").alias("key"), "level",
        F.concat(indent(F.col("level") - 1), F.lit("|- "), F.element_at("names", -1), F.lit("/")).alias("line"), "files",
        F.coalesce("directories", F.lit(0).cast("bigint")).alias("directories"),
    )
    roots = counts.where(F.size("names") == 0).select("repo_id", "names")
    parents = whole.where(F.col("level") < depth).select("repo_id", "names").unionByName(roots)
    more = counts.where(F.col("directories") > shown).join(parents, ["repo_id", "names"], "left_semi")
    level = F.size("names").cast("bigint") + 1
    rest = more.select(
        "repo_id", F.concat(key("names"), F.lit(chr(0x10FFFF))).alias("key"), level.alias("level"),
        F.concat(indent(level - 1), F.lit("|- ... "), (F.col("directories") - shown).cast("string"), F.lit(" more directories")).alias("line"),
        F.lit(None).cast("bigint").alias("files"), (F.col("directories") - shown).alias("directories"),
    )
    return lines.unionByName(rest)
