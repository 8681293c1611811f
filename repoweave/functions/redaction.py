"""Finding and redacting credentials, as Columns.

The patterns are folded over the text in order, each on what the one before it
left.  Every match is cut out, redacted by position unless its value is exempt,
and put back; a finding records where the match starts in the text as it entered
that pattern.  The fold is one expression of fixed depth: a filter on its result
that the optimizer pushes down copies it once, where a chain of projections
would be copied again at every step.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoweave.functions import fixed
from repoweave.functions.text import (
    Text, column, ends_with_any, is_in, let, lines_of, mentions_any, shared, unicode_space,
)

MARK, SPARE = "\ufdd2", "\ufdd3"
FINDING = "struct<pattern:string,line:bigint,column:bigint,type:string,preview:string>"


class CredentialPattern(NamedTuple):
    name: str
    regex: str
    group: int
    suffix: int  # characters of the match after the value
    # Both only save work: characters a match can start with, and lower-case
    # texts of which a match holds at least one (none given: no such test).
    starts: str = ""
    needs: tuple[str, ...] = ()

    def column(self) -> Column:
        ahead = f"(?=[{self.starts}])" if self.starts else ""
        return F.struct(
            F.lit(self.name).alias("name"),
            F.lit("(?i)" + ahead + unicode_space(self.regex)).alias("regex"),
            F.lit(self.group).alias("group"),
            F.lit(self.suffix).alias("suffix"),
            F.array(*[F.lit(n) for n in self.needs]).cast("array<string>").alias("needs"),
        )


_WORDS = ("secret", "token", "key", "password", "credential", "auth")
_HINTS = {
    "p01": ("\"'asc", ("key", "token", "secret")),
    "p02": ("\"'a", ("aws",)),
    "p03": ("\"'a", ("aws",)),
    "p04": ("\"'m", ("mongodb",)),
    "p05": ("\"'pmj", ("://",)),
    "p06": ("\"'p", ("password", "passwd", "pwd")),
    "p07": ("-", ("private key-----",)),
    "p08": ("\"'obar", ("token",)),
    "p09": ("\"'jt", ("eyj",)),
    "p10": ("f", ("firebaseconfig",)),
    "p11": ("stkpca", _WORDS),
    "p12": ("\"'stkpca", _WORDS),
}
PATTERNS = tuple(CredentialPattern(*p, *_HINTS[p[0]]) for p in fixed.CREDENTIAL_PATTERNS)

# Necessary conditions for any pattern, the cheapest first; most files stop here.
VALUE_REGEX = unicode_space(r"""[=:]\s*["']""")
GATE_REGEX = unicode_space(
    r"""(?i)(?:key|token|secret|password|passwd|pwd|jwt|credential|auth)[\w-]*["']?\s*[=:]\s*["']"""
    r"""|mongodb(?:\+srv)?://|postgres://|mysql://|jdbc:|PRIVATE KEY-----|firebaseConfig"""
)


def may_hold_credentials(content: Text = "content") -> Column:
    text = column(content)
    first = text.rlike(VALUE_REGEX) | text.contains("://") | text.contains("-----")
    return first & text.rlike(GATE_REGEX)


def credential_type(match: Text) -> Column:
    text = F.lower(column(match))
    chain = F
    for parts, name in fixed.CREDENTIAL_TYPES:
        chain = chain.when(mentions_any(text, parts), F.lit(name))
    return chain.otherwise(F.lit(fixed.OTHER_CREDENTIAL_TYPE))


def is_false_positive(value: Text) -> Column:
    """A known literal, or one short word of letters only."""
    value = column(value)
    short_word = F.length(value) < fixed.FALSE_POSITIVE_WORD_LENGTH
    return is_in(value, fixed.FALSE_POSITIVE_WORDS) | (value.rlike(r"^[A-Za-z]+\z") & short_word)


def preview(value: Text) -> Column:
    return F.concat(F.substring(column(value), 1, 3), F.lit("..."))


def matches_of(text: Column, pattern: Column) -> Column:
    """``array<struct<match, value, real>>`` in order of appearance."""
    return F.zip_with(
        F.regexp_extract_all(text, pattern["regex"], F.lit(0)),
        F.regexp_extract_all(text, pattern["regex"], pattern["group"]),
        lambda m, v: F.struct(
            m.alias("match"), v.alias("value"),
            (~is_false_positive(v) & (v != fixed.REDACTED)).alias("real"),
        ),
    )


def _rewritten(text: Column, matches: Column, pattern: Column) -> Column:
    """``text`` with the values of its real matches redacted."""

    def put_back(gap: Column, i: Column) -> Column:
        hit = F.get(matches, i)
        before = F.length(hit["match"]) - F.length(hit["value"]) - pattern["suffix"]
        redacted = F.concat(
            F.substring(hit["match"], F.lit(1), before),
            F.lit(fixed.REDACTED),
            F.right(hit["match"], pattern["suffix"]),
        )
        shown = F.when(hit["real"], redacted).otherwise(hit["match"])
        return F.concat(gap, F.coalesce(shown, F.lit("")))

    return F.array_join(F.transform(F.split(text, pattern["regex"], -1), put_back), "")


def _places(text: Column, wanted: Callable[[Column], Column]) -> Column:
    """Numbers, from 0, of the characters that are wanted, in one pass over the text."""
    numbered = F.transform(F.split(text, ""), lambda c, i: F.when(wanted(c), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _positions(text: Column, pattern: Column) -> Column:
    """``array<struct<line, column>>`` of the match starts.

    The starts are marked in the text, the text is cut into lines, and only the
    lines that carry a mark are looked at, so the work stays linear in the text.
    """
    # A mark that the text already holds gives way to another character no pattern names.
    unmarked = F.translate(text, MARK, SPARE)
    marked = F.regexp_replace(unmarked, pattern["regex"], F.lit(MARK + "$0"))

    def in_line(line: Column, i: Column) -> Column:
        # The marks before a mark are not in the text itself.
        return F.transform(
            _places(line, lambda c: c == MARK),
            lambda at, nth: F.struct(
                (i + 1).cast("bigint").alias("line"), (at - nth + 1).cast("bigint").alias("column")
            ),
        )

    none = F.array().cast("array<struct<line:bigint,column:bigint>>")
    return F.flatten(
        F.transform(
            lines_of(marked), lambda l, i: F.when(l.contains(MARK), in_line(l, i)).otherwise(none)
        )
    )


def _findings(text: Column, matches: Column, pattern: Column) -> Column:
    located = F.zip_with(
        matches,
        _positions(text, pattern),
        lambda hit, at: F.struct(hit.alias("hit"), at.alias("at")),
    )
    return F.transform(
        F.filter(located, lambda x: x["hit"]["real"]),
        lambda x: F.struct(
            pattern["name"].alias("pattern"),
            x["at"]["line"].alias("line"),
            x["at"]["column"].alias("column"),
            credential_type(x["hit"]["match"]).alias("type"),
            preview(x["hit"]["value"]).alias("preview"),
        ),
    )


def _start(text: Column) -> Column:
    return F.struct(text.alias("content"), F.array().cast(f"array<{FINDING}>").alias("findings"))


def _apply_pattern(state: Column, pattern: Column) -> Column:
    """One pattern over ``struct<content, findings>``."""
    text = state["content"]
    rewritten = let(
        matches_of(text, pattern),
        lambda hits: F.struct(
            _rewritten(text, hits, pattern).alias("content"),
            F.concat(state["findings"], _findings(text, hits, pattern)).alias("findings"),
        ),
    )
    return F.when(F.rlike(text, pattern["regex"]), rewritten).otherwise(state)


def _wanted(lowered: Column, pattern: Column) -> Column:
    """Redaction adds none of the needed texts, so the text before any pattern decides."""
    needs = pattern["needs"]
    return (F.size(needs) == 0) | F.exists(needs, lambda n: lowered.contains(n))


def is_env_file(path: Text = "path") -> Column:
    return column(path).contains(fixed.ENV_FILE_PART) | ends_with_any(path, fixed.ENV_FILE_SUFFIXES)


OTHER_ENDS = r"\r\x{2028}\x{2029}"
LINE_ENDS = r"\n" + OTHER_ENDS
ENV_LINE = rf"^([A-Za-z0-9_]+)=(?:['\"]([^{LINE_ENDS}]*)['\"]|([^{LINE_ENDS}]*))[{LINE_ENDS}]?\z"


def _env_line(line: Column, number: Column, start: Column) -> Column:
    """One line of an environment file with its end: its new text and, where redacted, its finding.

    Any of four characters ends a line.  A finding counts lines by line feeds alone, and columns from
    the last of them, as the other patterns do: ``number`` and ``start`` are those of the line's first
    character, from 0.
    """
    name = F.regexp_extract(line, ENV_LINE, 1)
    value = F.concat(F.regexp_extract(line, ENV_LINE, 2), F.regexp_extract(line, ENV_LINE, 3))

    def decide(x: Column) -> Column:
        sensitive = mentions_any(F.lower(x["name"]), fixed.ENV_SENSITIVE_PARTS)
        hit = (
            sensitive
            & (x["value"] != "")
            & ~is_false_positive(x["value"])
            & ~x["value"].contains("REDACTED")
        )
        finding = F.struct(
            F.lit("env").alias("pattern"),
            (number + 1).cast("bigint").alias("line"),
            (start + F.length(x["name"]) + 1).cast("bigint").alias("column"),
            F.lit(fixed.ENV_TYPE).alias("type"),
            preview(x["value"]).alias("preview"),
        )
        redacted = F.concat(x["name"], F.lit("=" + fixed.REDACTED), F.regexp_extract(line, rf"([{LINE_ENDS}]?)\z", 1))
        return F.struct(
            F.when(hit, redacted).otherwise(line).alias("text"),
            F.when(hit, finding).alias("finding"),
        )

    return let(F.struct(name.alias("name"), value.alias("value")), decide)


def _apply_env(state: Column) -> Column:
    """Redact the ``NAME=value`` lines with a sensitive name."""
    def lines_between(feeds: Column, number: Column, count: Column) -> Column:
        """What lies between two line feeds: lines that the other characters end, and the feed after them."""
        pieces = F.split(feeds, rf"(?<=[{OTHER_ENDS}])", -1)
        none = F.array().cast("array<int>")
        ends = F.when(feeds.rlike(f"[{OTHER_ENDS}]"), _places(feeds, lambda c: c.rlike(f"[{OTHER_ENDS}]"))).otherwise(none)
        feed = F.when(number < count - 1, F.lit("\n")).otherwise(F.lit(""))
        return let(
            F.struct(pieces.alias("pieces"), ends.alias("ends"), feed.alias("feed")),
            lambda x: F.transform(
                x["pieces"],
                lambda piece, k: _env_line(
                    F.concat(piece, F.when(k == F.size(x["pieces"]) - 1, x["feed"]).otherwise(F.lit(""))),
                    number, F.coalesce(F.get(x["ends"], k - 1) + 1, F.lit(0)),
                ),
            ),
        )

    return let(
        let(
            F.split(state["content"], "\n", -1),
            lambda rows: F.flatten(F.transform(rows, lambda row, i: lines_between(row, i, F.size(rows)))),
        ),
        lambda lines: F.struct(
            F.array_join(F.transform(lines, lambda x: x["text"]), "").alias("content"),
            F.concat(
                state["findings"],
                F.filter(F.transform(lines, lambda x: x["finding"]), lambda f: f.isNotNull()),
            ).alias("findings"),
        ),
    )


@shared
def redact_env(content: Text = "content", path: Text = "path") -> Column:
    """The environment pass alone."""
    return let(
        _start(column(content)),
        lambda s: F.when(is_env_file(path), _apply_env(s)).otherwise(s),
    )


def redact_patterns(content: Text, patterns: tuple[CredentialPattern, ...]) -> Column:
    """The given patterns alone, in order: ``struct<content, findings>``."""
    text = column(content)
    return let(
        F.lower(text),
        lambda lowered: F.aggregate(
            F.filter(F.array(*[p.column() for p in patterns]), lambda p: _wanted(lowered, p)),
            _start(text), _apply_pattern,
        ),
    )


@shared
def redact(
    content: Text = "content", path: Text = "path", patterns: tuple[CredentialPattern, ...] | None = None
) -> Column:
    """``struct<content, findings>`` after all patterns and the environment pass."""
    text = column(content)
    state = redact_patterns(text, PATTERNS if patterns is None else patterns)
    if patterns is None:  # the gate holds for the built-in patterns only
        state = F.when(may_hold_credentials(text), state).otherwise(_start(text))
    return let(state, lambda s: F.when(is_env_file(path), _apply_env(s)).otherwise(s))
