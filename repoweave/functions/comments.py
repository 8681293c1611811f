"""Comment stripping by file extension.

The rules are lexical on purpose: ``//`` inside a string also starts a comment.
Blocks to keep are replaced by numbered marks before the strip passes and put
back afterwards; a mark swallowed by a later pass takes its block with it.  The
marks use Unicode noncharacters, which do not occur in exchanged text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoweave.functions import fixed
from repoweave.functions.text import (
    REST_OF_LINE, Text, column, contains_any, is_in, let, unicode_space,
)

OPEN, CLOSE = "\ufdd0", "\ufdd1"
MARK_REGEX = f"{OPEN}([0-9]+){CLOSE}"
# A whole line comment; group 1 holds it if it mentions a word worth keeping.
LINE_COMMENT_REGEX = (
    f"(//{REST_OF_LINE}(?:" + "|".join(fixed.LINE_COMMENT_KEEP) + f"){REST_OF_LINE})|//{REST_OF_LINE}"
)
HASH_COMMENT_REGEX = "#" + REST_OF_LINE
BLANK_RUN_REGEX = unicode_space(fixed.BLANK_RUN_REGEX)


def _with_blocks_kept(
    text: Column, block: str, keep: list[str], drop_others: bool, strip: Callable[[Column], Column]
) -> Column:
    """``strip`` the text while the blocks that hold one of ``keep`` stand aside."""

    def restore(stripped: Column, blocks: Column) -> Column:
        ids = F.regexp_extract_all(stripped, F.lit(MARK_REGEX), F.lit(1))
        return let(
            F.struct(F.split(stripped, MARK_REGEX, -1).alias("gaps"), ids.alias("ids")),
            lambda s: F.array_join(
                F.transform(
                    s["gaps"],
                    lambda gap, i: F.concat(
                        gap, F.coalesce(F.get(blocks, F.get(s["ids"], i).cast("int")), F.lit(""))
                    ),
                ),
                "",
            ),
        )

    def mark(parts: Column) -> Column:
        blocks = parts["blocks"]

        def joined(gap: Column, i: Column) -> Column:
            here = F.get(blocks, i)
            other = F.lit("") if drop_others else here
            shown = F.when(
                contains_any(here, keep), F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE))
            ).otherwise(other)
            return F.concat(gap, F.coalesce(shown, F.lit("")))

        marked = F.array_join(F.transform(parts["gaps"], joined), "")
        return let(strip(marked), lambda s: restore(s, blocks))

    with_blocks = let(
        F.struct(
            F.split(text, block, -1).alias("gaps"),
            F.regexp_extract_all(text, F.lit(block), F.lit(0)).alias("blocks"),
        ),
        mark,
    )
    return F.when(text.rlike(block), with_blocks).otherwise(strip(text))


def strip_c(content: Text = "content") -> Column:
    def strip(text: Column) -> Column:
        no_blocks = F.regexp_replace(text, fixed.BLOCK_COMMENT_REGEX, "")
        return F.regexp_replace(no_blocks, LINE_COMMENT_REGEX, "$1")

    return _with_blocks_kept(
        column(content), fixed.DOC_BLOCK_REGEX, fixed.DOC_BLOCK_KEEP, True, strip
    )


def strip_hash(content: Text = "content") -> Column:
    return F.regexp_replace(column(content), HASH_COMMENT_REGEX, "")


def strip_python(content: Text = "content") -> Column:
    return _with_blocks_kept(
        column(content), fixed.DOCSTRING_REGEX, fixed.DOCSTRING_KEEP, False, strip_hash
    )


def strip_markup(content: Text = "content") -> Column:
    return F.regexp_replace(column(content), fixed.MARKUP_COMMENT_REGEX, "")


def collapse_blank_lines(content: Text = "content") -> Column:
    return F.regexp_replace(column(content), BLANK_RUN_REGEX, "\n\n\n")


def strip_comments(content: Text, ext: Column) -> Column:
    """Strip by lower-cased extension, then collapse runs of blank lines."""
    text = column(content)
    stripped = (
        F.when(is_in(ext, fixed.C_COMMENT_EXTENSIONS), strip_c(text))
        .when(ext == ".py", strip_python(text))
        .when(ext == ".rb", strip_hash(text))
        .when(is_in(ext, fixed.MARKUP_EXTENSIONS), strip_markup(text))
        .otherwise(text)
    )
    return collapse_blank_lines(stripped)
