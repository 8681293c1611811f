"""Odd ignore rules, unreadable files, and a skip report that agrees with the documents."""

import os
import random

from repoweave.operators import gitignore
from repoweave.plans import flow, queries
from repoweave.plans.options import PackOptions
from repoweave.sources import corpus


def test_no_rule_text_makes_an_invalid_expression(spark):
    rng = random.Random(7)
    parts = ["[", "]", "\\", "!", "^", "-", "a", "z", "*", "**", "/", "?", "&&", "[a-c-a]", "[[:alpha:]]", "{1", "(", ")", "$", ".", " ", "#", "é"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    lines += ["[\\]", "a[a[]a]", "[\\[a\\]b]a", "[\\]", "[a-]", "[]a]", "[" + "b" * 150 + "[c]x"]
    files = [(f"r{i // 40}", ".gitignore", "\n".join(lines[i : i + 40])) for i in range(0, len(lines), 40)]
    files += [(f"r{i // 40}", "a/b/c.txt", "") for i in range(0, len(lines), 40)]
    table = spark.createDataFrame(files, "repo_id string, path string, content string")
    assert len(gitignore.with_ignored(table, gitignore.rule_sets(table)).collect()) == len(files)


def test_classes_and_long_rules(spark):
    rules = "[" + "b" * 150 + "]x\n[!a-c]y\nq[\\-z]\np[a\\]b]\n!" + "k" * 1_000_005 + "\nlit\\*\n"
    paths = {"bx": True, "cx": False, "dy": True, "by": False, "q-": True, "qz": True, "q5": False, "lit*": True, "lita": False}
    rows = [("r", ".gitignore", rules)] + [("r", p, "") for p in paths]
    table = spark.createDataFrame(rows, "repo_id string, path string, content string")
    got = gitignore.with_ignored(table, gitignore.rule_sets(table)).where("path <> '.gitignore'")
    assert {r["path"]: r["is_gitignored"] for r in got.collect()} == paths


def test_files_that_cannot_be_read_do_not_stop_the_job(spark, tmp_path):
    repo = tmp_path / "one"
    repo.mkdir()
    for name in ("kept.py", "gone.py", "large.py"):
        (repo / name).write_text("x = 1\n" * (1 if name != "large.py" else 1000))
    os.mkfifo(repo / "pipe")
    listing = corpus.scan_tree(spark, str(tmp_path))
    assert {r["path"] for r in listing.collect()} == {"kept.py", "gone.py", "large.py"}
    (repo / "gone.py").unlink()
    read = corpus.with_bytes(listing, max_bytes=1000)
    errors = {r["path"]: r["read_error"] for r in read.collect()}
    assert errors["kept.py"] is None and errors["gone.py"] and errors["large.py"] == "too large"
    assert [r["path"] for r in corpus.read_text(read).collect()] == ["kept.py"]


def test_the_skip_report_counts_the_files_of_a_capped_document(spark):
    from repoweave.sources import sample

    files = sample.files(spark, "/root/testdata/sf0.001")
    opts = PackOptions.preset("code").__class__(**{**PackOptions.preset("code").to_dict(), "max_files": 4})
    kept = {r["repo_id"]: r["count"] for r in flow.budgeted(files, opts).groupBy("repo_id").count().collect()}
    report = {r["repo_id"]: r for r in flow.skip_report(files, opts).collect()}
    assert {k: r["included"] for k, r in report.items() if r["included"]} == kept
    assert any(r["over_cap"] > 0 for r in report.values())
