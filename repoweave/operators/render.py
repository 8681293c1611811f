"""From kept files to text: rendered bodies, file blocks, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoweave.functions import comments, fixed, paths, summary
from repoweave.functions.text import shared
from repoweave.plans.options import PackOptions

NOTICE = (
    "> ⚠️ **Security Notice**: Sensitive information and credentials have been "
    "automatically redacted\n\n"
)
FENCE = "```\n"


@shared
def rendered(opts: PackOptions = PackOptions(), summarized: str | None = None) -> Column:
    """Body of a file: placeholder, summary, stripped text or the text itself.

    ``summarized`` names a column that asks for a summary.
    """
    content, ext = F.col("content"), paths.lower_ext()
    long = F.length(content) > opts.max_file_bytes
    if summarized is not None:
        long = long | F.coalesce(F.col(summarized), F.lit(False))
    chain = F.when(paths.is_render_skipped(), F.lit(fixed.RENDER_SKIP_TEXT)).when(
        long, summary.summarize_code(content, ext)
    )
    if opts.strip_comments or opts.optimize_tokens:
        return chain.otherwise(comments.strip_comments(content, ext))
    return chain.otherwise(content)


def fenced(body: Column) -> Column:
    end = F.when(body.endswith("\n"), F.lit("")).otherwise(F.lit("\n"))
    return F.concat(F.lit(FENCE), body, end, F.lit(FENCE + "\n"))


def file_block(opts: PackOptions = PackOptions()) -> Column:
    """A single file under its own top heading, sized by its characters."""
    heading = F.concat(
        F.lit("# "), paths.basename(), F.lit(" ("),
        paths.human_size(F.length("content").cast("bigint")), F.lit(")\n\n"),
    )
    return F.concat(heading, fenced(rendered(opts)))


def header(opts: PackOptions) -> Column:
    """Opening of a document, over ``files`` and ``bytes``."""
    return F.concat(
        F.lit(
            "# PROJECT CONTEXT\n\n"
            f"This code was collected by the {opts.tool_name} tool on {opts.as_of[:10]}.\nTotal files: "
        ),
        F.col("files").cast("string"), F.lit(", Size: "), paths.human_size("bytes"),
        F.lit(", Est. tokens: ~"), paths.token_estimate("bytes").cast("string"), F.lit("\n\n"),
    )


def footer(opts: PackOptions) -> str:
    return f"---\nGenerated with {opts.tool_name}.\n"


def directory_heading(directory: Column) -> Column:
    return F.when(directory == ".", F.lit("## Root Directory\n\n")).otherwise(
        F.concat(F.lit("## Directory: "), directory, F.lit("/\n\n"))
    )


def _file_section() -> Column:
    """Heading and fenced body of a packed file."""
    return F.concat(
        F.lit("### "), paths.basename(), F.lit(" ("), paths.human_size(), F.lit(")\n\n"),
        fenced(F.col("body")),
    )


def _opening(opts: PackOptions) -> str:
    return (NOTICE if opts.redact_credentials else "") + "# PROJECT FILES\n\n"


def documents(kept: DataFrame, opts: PackOptions) -> DataFrame:
    """One document per repository from rows with ``rank``, ``size`` and the rendered ``body``.

    Only kept files come here, so what is gathered per repository is bounded by
    the budgets.
    """
    block = F.struct(paths.dirname().alias("dir"), "rank", _file_section().alias("block"))
    gathered = kept.select("repo_id", "size", block.alias("f")).groupBy("repo_id").agg(
        F.sort_array(F.collect_list("f")).alias("blocks"),
        F.count("*").alias("files"), F.sum("size").alias("bytes"),
    )
    blocks = F.col("blocks")

    def with_heading(f: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(blocks, i - 1)["dir"] != f["dir"])
        return F.concat(F.when(opens, directory_heading(f["dir"])).otherwise(F.lit("")), f["block"])

    return gathered.select(
        "repo_id", "files", "bytes",
        F.concat(
            header(opts), F.lit(_opening(opts)),
            F.array_join(F.transform(blocks, with_heading), ""), F.lit(footer(opts)),
        ).alias("document"),
    )


def listings(kept: DataFrame, opts: PackOptions) -> DataFrame:
    """One listing per repository: the header and the names and sizes of the kept files by directory.

    Needs ``rank`` and ``size`` of files that a budget has bounded; no content.
    """
    line = F.concat(F.lit("- "), paths.basename(), F.lit(" ("), paths.human_size(), F.lit(")\n"))
    by_dir = kept.select("repo_id", paths.dirname().alias("dir"), "size", F.struct("rank", line.alias("line")).alias("f"))
    blocks = by_dir.groupBy("repo_id", "dir").agg(
        F.sort_array(F.collect_list("f")).alias("fs"), F.count("*").alias("n"), F.sum("size").alias("s")
    )
    block = F.concat(
        F.lit("### "), "dir", F.lit("/\n"), F.array_join(F.transform("fs", lambda f: f["line"]), ""), F.lit("\n")
    )
    gathered = blocks.groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct("dir", block.alias("block")))).alias("blocks"),
        F.sum("n").alias("files"), F.sum("s").alias("bytes"),
    )
    opening = (NOTICE if opts.redact_credentials else "") + fixed.LISTING_TITLE + "\n\n"
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "")
    return gathered.select(
        "repo_id", "files", "bytes",
        F.concat(header(opts), F.lit(opening), body, F.lit(footer(opts))).alias("document"),
    )


def _part(part: int, key, pos, text: Column) -> list[Column]:
    """Position and text of a row; the writer ends each text with the line break cut here."""
    return [
        F.col("repo_id"), F.lit(part).cast("bigint").alias("part"), key.alias("key"),
        pos.cast("bigint").alias("pos"), F.regexp_replace(text, r"\n\z", "").alias("text"),
    ]


def document_parts(kept: DataFrame, opts: PackOptions) -> DataFrame:
    """The same documents as rows in order (part, key, pos): 0 header, 2 opening, 3 files, 4 footer."""
    empty, zero = F.lit(""), F.lit(0)
    totals = kept.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    in_dir = Window.partitionBy("repo_id", "dir").orderBy("rank")
    sections = kept.withColumn("dir", paths.dirname()).withColumn("n", F.row_number().over(in_dir))
    heading = F.when(F.col("n") == 1, directory_heading(F.col("dir"))).otherwise(empty)
    return (
        totals.select(*_part(0, empty, zero, header(opts)))
        .unionByName(totals.select(*_part(2, empty, zero, F.lit(_opening(opts)))))
        .unionByName(sections.select(*_part(3, F.col("dir"), F.col("rank"), F.concat(heading, _file_section()))))
        .unionByName(totals.select(*_part(4, empty, zero, F.lit(footer(opts)))))
    )


def tree_parts(tree: DataFrame, kept: DataFrame) -> DataFrame:
    """Part 1: the directory tree in a fence, one row per line."""
    repos = kept.select("repo_id").distinct()
    title = F.concat(
        F.lit("## PROJECT STRUCTURE\n" + FENCE + "Project Directory Structure:\n"), F.col("repo_id")
    )
    # Keys place the title before and the closing fence after all directory names.
    opening = repos.select(*_part(1, F.lit(""), F.lit(-1), title))
    lines = tree.select(*_part(1, F.concat(F.lit("/"), F.col("top")), F.col("pos"), F.col("line")))
    closing = repos.select(*_part(1, F.lit(chr(0x10FFFF)), F.lit(0), F.lit(FENCE + "\n")))
    return opening.unionByName(lines).unionByName(closing)
