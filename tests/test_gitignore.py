import pytest

from repoweave.operators import gitignore

CASES = [
    ("foo", ["foo", "a/foo", "foo/x", "a/foo/b/c"], ["foobar", "a/xfoo"]),
    ("/foo", ["foo", "foo/x"], ["a/foo"]),
    ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
    ("dir/", ["dir/x", "a/dir/b/c"], ["dir", "a/dir"]),
    ("*.log", ["x.log", "a/b.log", ".log"], ["x.log.txt"]),
    ("a/*.c", ["a/x.c"], ["a/b/x.c", "x.c"]),
    ("**/tmp", ["tmp", "a/b/tmp", "tmp/x"], ["atmp"]),
    ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["z", "b/a/z"]),
    ("logs/**", ["logs/a", "logs/a/b"], ["logs", "x/logs/a"]),
    ("f?o", ["fxo"], ["fo", "f/o"]),
    ("[ab].txt", ["a.txt", "d/b.txt"], ["c.txt", "[ab].txt"]),
    ("[!ab].txt", ["c.txt"], ["a.txt"]),
    ("x.y+z(1)", ["x.y+z(1)"], ["xayyz1"]),
    (r"\!keep", ["!keep"], ["keep"]),
    (r"\#note", ["#note"], ["note"]),
    ("# remark", [], ["# remark", "remark"]),
    ("trail   ", ["trail"], ["trail   x"]),
    ("FOO", ["foo", "Foo"], []),
    ("*.log\n!keep.log", ["a.log"], ["keep.log", "d/keep.log"]),
    ("!keep.log\n*.log", ["keep.log"], []),
    ("dir/\n!dir/keep", ["dir/keep", "dir/x"], []),
    ("/*\n!/src", ["a", "b/c"], ["src", "src/x"]),
    ("open[bracket", ["open[bracket"], ["openb"]),
    ("[z-a]\nok", ["ok"], ["z", "a"]),
    ("lone\\\nok", ["ok"], ["lone"]),
    ("a\r\nb\r", ["a", "b"], ["c"]),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rules = [(f"r{i}", ".gitignore", lines) for i, (lines, _, _) in enumerate(CASES)]
    files = [(f"r{i}", p) for i, (_, hits, misses) in enumerate(CASES) for p in hits + misses]
    sets = gitignore.rule_sets(spark.createDataFrame(rules, "repo_id string, path string, content string"))
    flagged = gitignore.with_ignored(spark.createDataFrame(files, "repo_id string, path string"), sets)
    return {(r.repo_id, r.path): r.is_gitignored for r in flagged.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(verdicts, i):
    lines, hits, misses = CASES[i]
    assert {p: verdicts[f"r{i}", p] for p in hits} == {p: True for p in hits}, lines
    assert {p: verdicts[f"r{i}", p] for p in misses} == {p: False for p in misses}, lines


def test_only_the_root_file_counts_and_lines_keep_their_number(spark):
    files = spark.createDataFrame(
        [("r", ".gitignore", "a\n\n!b"), ("r", "sub/.gitignore", "c")], "repo_id string, path string, content string")
    assert [tuple(r) for r in gitignore.ignore_rules(files).orderBy("seq").collect()] == [
        ("r", 1, "a"), ("r", 2, ""), ("r", 3, "!b")]


def test_repositories_without_rules_ignore_nothing(spark):
    empty = gitignore.rule_sets(spark.createDataFrame([("r", ".gitignore", "# none\n")], "repo_id string, path string, content string"))
    files = spark.createDataFrame([("r", "a"), ("s", "b")], "repo_id string, path string")
    assert {r.is_gitignored for r in gitignore.with_ignored(files, empty).collect()} == {False}
