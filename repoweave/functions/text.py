"""Small Column helpers shared by the text and path functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ECMAScript's \s sees it; Java's \s is ASCII only.
WHITE_SPACE = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# Start of a line, line ends as ECMAScript's multi-line mode sees them.
LINE_START = r"(?:^|[\n\r\x{2028}\x{2029}])"
REST_OF_LINE = r"[^\n\r\x{2028}\x{2029}]*"

Text = Column | str


def unicode_space(regex: str) -> str:
    """``regex`` with ``\\s`` widened to Unicode white space (``[\\s\\S]`` stays "any character")."""
    return r"[\s\S]".join(part.replace(r"\s", WHITE_SPACE) for part in regex.split(r"[\s\S]"))


def column(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared(build: Callable[..., Column]) -> Callable[..., Column]:
    """Make an expression of plain arguments once per process; large ones take a while to make."""
    made = lru_cache(maxsize=None)(build)

    @wraps(build)
    def get(*args, **named) -> Column:
        plain = not any(isinstance(a, Column) for a in (*args, *named.values()))
        return (made if plain else build)(*args, **named)

    return get


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


@lru_cache(maxsize=None)
def _literals(values: tuple) -> list[Column]:
    return [F.lit(v) for v in values]


def is_in(text: Text, values: Iterable[str]) -> Column:
    """Membership in a fixed list, whose literals are made once per process."""
    return column(text).isin(_literals(tuple(values)))


def sum_of(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def contains_any(text: Text, parts: Iterable[str]) -> Column:
    """For long texts: plain searches, which beat a regular expression there."""
    return any_of(column(text).contains(part) for part in parts)


def _either(parts: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(p) for p in parts) + ")"


def mentions_any(text: Text, parts: Iterable[str]) -> Column:
    """For names: one expression, so the name is taken from the path only once."""
    return column(text).rlike(_either(parts))


def ends_with_any(text: Text, suffixes: Iterable[str]) -> Column:
    return column(text).rlike(_either(suffixes) + r"\z")


def starts_with_any(text: Text, prefixes: Iterable[str]) -> Column:
    return column(text).rlike("^" + _either(prefixes))


def count_of(text: Text, literal: str, rest: str = "") -> Column:
    """Matches of a literal followed by the regex ``rest``; most texts fail the plain search."""
    text = column(text)
    counted = F.regexp_count(text, F.lit(re.escape(literal) + unicode_space(rest)))
    return F.when(text.contains(literal), counted).otherwise(F.lit(0)).cast("bigint")


def lookup(key: Column, table: dict, default) -> Column:
    """Value of ``key`` in a small fixed table."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*entries)[key], F.lit(default))


def lines_of(text: Text) -> Column:
    return F.split(column(text), "\n", -1)
