"""Summary of a long source file: header, definition index, samples, footer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoweave.functions import fixed
from repoweave.functions.text import Text, column, contains_any, is_in, let, lines_of, unicode_space


def header_end(lines: Column, ext: Column) -> Column:
    """Number of opening lines shown: ten, or the import block and a little more."""
    # State: last import line seen, and whether the scan has ended.
    start = F.struct(F.lit(0).alias("last"), F.lit(False).alias("done"), F.lit(0).alias("i"))

    def step(s: Column, line: Column) -> Column:
        hit = contains_any(line, fixed.IMPORT_LINE_PARTS)
        over = ~hit & (s["i"] > 15) & (s["last"] < s["i"] - 5)
        return F.struct(
            F.when(hit & ~s["done"], s["i"]).otherwise(s["last"]).alias("last"),
            (s["done"] | over).alias("done"),
            (s["i"] + 1).alias("i"),
        )

    imports_end = F.aggregate(F.slice(lines, 1, 30), start, step, lambda s: s["last"] + 3)
    return F.when(
        is_in(ext, fixed.IMPORT_HEADER_EXTENSIONS), F.least(imports_end, F.lit(20))
    ).otherwise(F.lit(10))


def _first_name(line: Column, regexes: list[str]) -> Column:
    empty = F.lit("")
    return F.coalesce(
        *[F.nullif(F.regexp_extract(line, unicode_space(r), 1), empty) for r in regexes]
    )


def definitions(lines: Column, ext: Column, start: Column) -> Column:
    """``array<struct<at, name>>`` of the lines from ``start`` on that define something."""

    def found(regexes: list[str]) -> Column:
        named = F.transform(
            lines,
            lambda line, i: F.struct(
                i.alias("at"), F.when(i >= start, _first_name(line, regexes)).alias("name")
            ),
        )
        return F.filter(named, lambda d: d["name"].isNotNull())

    chain = F
    for key, regexes in fixed.DEFINITIONS.items():
        chain = chain.when(ext == key, found(regexes))
    return chain.otherwise(found(fixed.DEFAULT_DEFINITIONS))


def file_definitions(content: Text, ext: Column) -> Column:
    """The definitions below the header of a file."""
    return let(
        lines_of(content),
        lambda lines: let(header_end(lines, ext), lambda head: definitions(lines, ext, head)),
    )


def summarize_code(content: Text, ext: Column) -> Column:
    content = column(content)

    def text(s: Column) -> Column:
        lines, head, defs = s["lines"], s["head"], s["defs"]
        n = F.size(defs)
        names = F.transform(defs, lambda d: d["name"])
        more = F.when(
            n > 20, F.concat(F.lit(", ... and "), (n - 20).cast("string"), F.lit(" more"))
        ).otherwise(F.lit(""))
        index = F.concat(
            F.lit("// File contains these "), n.cast("string"), F.lit(" definitions:\n// - "),
            F.array_join(F.slice(names, 1, 20), ", "), more, F.lit("\n\n"),
        )
        picks = F.array(F.lit(0), F.floor(n / F.lit(2)).cast("int"), n - 1)
        samples = F.array_join(
            F.transform(
                picks,
                lambda p: F.concat(
                    F.lit("// Sample definition: "), F.get(defs, p)["name"], F.lit("\n"),
                    F.array_join(F.slice(lines, F.get(defs, p)["at"] + 1, F.lit(5)), "\n"),
                    F.lit("\n\n"),
                ),
            ),
            "",
        )
        hidden = F.concat(
            F.lit("// ... "), (F.size(lines) - head - 5).cast("string"),
            F.lit(" lines not shown ...\n\n"),
        )
        middle = (
            F.when(n > 3, F.concat(index, samples)).when(n > 0, index).otherwise(hidden)
        )
        return F.concat(
            F.array_join(F.slice(lines, F.lit(1), head), "\n"), F.lit("\n\n"), middle,
            F.array_join(F.slice(lines, F.size(lines) - 4, F.lit(5)), "\n"),
        )

    def with_header(lines: Column) -> Column:
        return let(header_end(lines, ext), lambda head: with_definitions(lines, head))

    def with_definitions(lines: Column, head: Column) -> Column:
        return let(
            F.struct(
                lines.alias("lines"), head.alias("head"),
                definitions(lines, ext, head).alias("defs"),
            ),
            text,
        )

    return (
        F.when(content == "", F.lit("// Empty file"))
        .when(
            F.size(lines_of(content)) > fixed.SUMMARY_MIN_LINES, let(lines_of(content), with_header)
        )
        .otherwise(content)
    )
