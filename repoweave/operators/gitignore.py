"""Ignore rules of a repository: parsing, translation to regular expressions, matching.

The rules of a repository travel as one row, so matching never forms the pairs
of files and rules.  A file is ignored if the last rule that matches it, or any
directory above it, is not a re-inclusion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions.text import Text, column, let, lines_of, shared

#: Pieces of a glob in the order in which they are tried; every character is a piece in the end.
PIECE = (
    r"(?s)\A\*\*/|/\*\*\z|/(?:\*\*/)+|\*+|\?|\\.|\[[!^]?[^\]!^][^\]]*\]|."
)
#: Members of a class: a range, an escaped character, a character.
MEMBER = r"(?s)(?:\\.|[^\\])-(?:\\.|[^\\])|\\.|."


def ignore_rules(files: DataFrame) -> DataFrame:
    """The lines of every root ignore file: ``repo_id, seq, pattern``."""
    return files.where(F.col("path") == ".gitignore").select(
        "repo_id", F.posexplode(lines_of("content")).alias("n", "pattern")
    ).select("repo_id", (F.col("n") + 1).cast("bigint").alias("seq"), "pattern")


def rule_of(line: Text) -> Column:
    """``struct<body, directory, negated>``; null for a blank line or a remark."""
    text = F.regexp_replace(F.regexp_replace(column(line), r"\r\z", ""), r"(?<!\\)[ \t]+\z", "")

    def parsed(t: Column) -> Column:
        negated = t.startswith("!")
        raw = F.when(negated, F.substring(t, F.lit(2), F.length(t))).otherwise(t)
        bare = F.regexp_replace(raw, r"/+\z", "")
        anchored = bare.contains("/")
        start = F.when(anchored, F.lit("^")).otherwise(F.lit("(?:^|/)"))
        return F.when(
            (t != "") & ~t.startswith("#") & (bare != "") & ~_is_malformed(bare),
            F.struct(
                F.concat(start, _body(F.regexp_replace(bare, r"\A/", ""))).alias("body"),
                raw.endswith("/").alias("directory"),
                negated.alias("negated"),
            ),
        )

    return let(text, parsed)


def _is_malformed(glob: Column) -> Column:
    """A lone trailing backslash, or a class with a range that runs backwards."""
    classes = F.array_join(F.regexp_extract_all(glob, F.lit(r"\[[^\]]*\]"), F.lit(0)), " ")
    ends = [F.regexp_extract_all(classes, F.lit("([^ ])-([^ ])"), F.lit(g)) for g in (1, 2)]
    backwards = F.exists(F.zip_with(*ends, lambda a, b: a > b), lambda x: x)
    return glob.rlike(r"(?<!\\)(?:\\\\)*\\\z") | backwards


def _literal(text: Column) -> Column:
    """Characters that stand for themselves, inside a class or outside."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", r"\\$0")


def _members(token: Column) -> Column:
    """A class put together again from its members; a range that runs backwards holds nothing."""
    inside = F.regexp_extract(token, r"(?s)\A\[[!^]?(.*)\]\z", 1)

    def member(m: Column) -> Column:
        low, high = (F.regexp_extract(m, r"(?s)\A\\?(.)-\\?(.)\z", g) for g in (1, 2))
        single = F.when((F.length(m) == 2) & m.startswith("\\"), F.substring(m, 2, 1)).otherwise(m)
        return F.when(F.length(low) == 0, _literal(single)).when(
            low <= high, F.concat(_literal(low), F.lit("-"), _literal(high))
        ).otherwise(F.lit(""))

    body = F.array_join(F.transform(F.regexp_extract_all(inside, F.lit(MEMBER), F.lit(0)), member), "")
    start = F.when(token.rlike(r"\A\[[!^]"), F.lit("[^")).otherwise(F.lit("["))
    return let(body, lambda b: F.when(b == "", F.lit("(?!)")).otherwise(F.concat(start, b, F.lit("]"))))


def _body(glob: Column) -> Column:
    """Regular expression for one glob, without its start and end.

    Each piece becomes an expression that is valid by itself, so no rule text can make an invalid one.
    """

    def piece(t: Column) -> Column:
        return (
            F.when(t == "**/", F.lit("(?:.*/)?")).when(t == "/**", F.lit("/.+"))
            .when((F.length(t) > 1) & t.startswith("/"), F.lit("/(?:.*/)?"))
            .when(t.startswith("*"), F.lit("[^/]*")).when(t == "?", F.lit("[^/]"))
            .when((F.length(t) == 2) & t.startswith("\\"), _literal(F.substring(t, 2, 1)))
            .when((F.length(t) > 2) & t.startswith("["), _members(t))
            .otherwise(_literal(t))
        )

    return F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(PIECE), F.lit(0)), piece), "")


@shared
def _rules_of(content: str) -> Column:
    return F.filter(F.transform(lines_of(content), rule_of), lambda r: r.isNotNull())


def rule_sets(files: DataFrame) -> DataFrame:
    """One row per repository with an ignore file: its rules in order, and a first test.

    ``first_test`` matches a path if any ignoring rule matches it or a directory
    above it; without re-inclusions that already decides.
    """
    compiled = files.where(F.col("path") == ".gitignore").select("repo_id", _rules_of("content").alias("rules"))
    ignoring = F.transform(
        F.filter("rules", lambda r: ~r["negated"]),
        lambda r: F.concat(r["body"], F.when(r["directory"], F.lit("/")).otherwise(F.lit(r"(?:/|\z)"))),
    )
    tests = F.transform(
        "rules",
        lambda r: F.struct(
            F.concat(
                F.lit("(?is)"), r["body"],
                F.when(r["directory"], F.lit(r"/\z")).otherwise(F.lit(r"/?\z")),
            ).alias("regex"),
            r["negated"].alias("negated"),
        ),
    )
    return compiled.where(F.exists("rules", lambda r: ~r["negated"])).select(
        "repo_id",
        F.concat(F.lit("(?is)"), F.array_join(ignoring, "|")).alias("first_test"),
        F.exists("rules", lambda r: r["negated"]).alias("has_negation"),
        tests.alias("rules"),
    )


def ignored_by(rules: Column, path: Column) -> Column:
    """Last matching rule wins; an ignored directory ignores everything below it."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    steps = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(
            i < n, F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))
        ).otherwise(path),
    )

    def ignored(step: Column) -> Column:
        hits = F.filter(rules, lambda r: F.regexp_instr(step, r["regex"]) > 0)
        return let(hits, lambda h: (F.size(h) > 0) & ~F.coalesce(F.get(h, F.size(h) - 1)["negated"], F.lit(True)))

    return F.exists(steps, ignored)


def with_ignored(files: DataFrame, sets: DataFrame) -> DataFrame:
    """``files`` with the flag ``is_gitignored``; one row per repository on the other side."""
    joined = files.join(sets, "repo_id", "left")
    path = F.col("path")
    verdict = F.when(F.col("first_test").isNull(), F.lit(False)).when(
        F.regexp_instr(path, F.col("first_test")) == 0, F.lit(False)
    ).when(~F.col("has_negation"), F.lit(True)).otherwise(ignored_by(F.col("rules"), path))
    return joined.withColumn("is_gitignored", verdict).drop("first_test", "has_negation", "rules")
