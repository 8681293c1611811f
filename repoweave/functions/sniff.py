"""Does a file look like code?  A name rule, a content rule and a printable-share rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoweave.functions import fixed
from repoweave.functions.paths import basename, is_binary, lower_ext
from repoweave.functions.text import (
    LINE_START, Text, column, ends_with_any, is_in, mentions_any, shared, unicode_space,
)

CODE_CONTENT_REGEX = unicode_space(
    "|".join(fixed.CODE_ANYWHERE)
    + "|" + LINE_START + r"\s*(?:" + "|".join(fixed.CODE_LINE_STARTS) + ")"
)


def sample(content: Text = "content") -> Column:
    """The opening characters that the test is defined on."""
    return F.substring(column(content), 1, fixed.SNIFF_CHARS)


def code_like_name(path: Text = "path") -> Column:
    base = basename(path)
    return (
        mentions_any(base, fixed.CODE_NAME_PARTS)
        | ends_with_any(base, fixed.CODE_NAME_SUFFIXES)
        | is_in(base, fixed.CODE_NAMES)
    )


def code_like_content(content: Text = "content") -> Column:
    return sample(content).rlike(CODE_CONTENT_REGEX)


def mostly_printable(path: Text = "path", content: Text = "content") -> Column:
    """A short, non-binary extension and more than 90 % printable ASCII in the sample."""
    text = sample(content)
    short_ext = F.length(lower_ext(path)).between(2, 5) & ~is_binary(path)
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7E]", ""))
    return (
        short_ext
        & (F.length(text) > 0)
        & (printable > F.length(text) * F.lit(fixed.PRINTABLE_SHARE))
    )


@shared
def looks_like_code(path: Text = "path", content: Text = "content") -> Column:
    return (
        code_like_name(path)
        | code_like_content(content)
        | mostly_printable(path, content)
    )
