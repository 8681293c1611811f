"""Files that are listed first and read only where their content matters."""

from collections import Counter

import pytest

from repoweave.functions import fixed
from repoweave.operators import gitignore
from repoweave.plans import flow
from repoweave.plans.options import PackOptions
from repoweave.sources import corpus, sample

FOLDER = "/root/testdata/sf0.001"
OPTIONS = {
    "auto": PackOptions.preset("auto"),
    "code": PackOptions.preset("code", max_files=4),
    "own lists": PackOptions(extensions=(".py", ".md"), files=("LICENSE",), auto_detect=True),
    "small": PackOptions.preset("auto", limit_bytes=3_000, max_file_bytes=2_500),
    "recent": PackOptions(recent_days=30, strict_gitignore=True),
}


@pytest.mark.parametrize("name", OPTIONS)
def test_a_listing_gives_what_its_table_gives(spark, name):
    opts, files = OPTIONS[name], sample.files(spark, FOLDER).cache()
    rules = gitignore.rule_sets(sample.gitignore_files(spark, FOLDER))
    reads = Counter()

    def read(listing):
        reads.update((r["repo_id"], r["path"]) for r in listing.select("repo_id", "path").collect())
        return files.join(listing.select("repo_id", "path"), ["repo_id", "path"], "left_semi")

    listed = flow.from_listing(files.select("repo_id", "path", "size", "mtime"), read, opts, rules)

    def rows(build):
        return [sorted(map(repr, build(source, opts, rules).collect())) for source in (files, listed)]

    for build in (flow.list_files, flow.pack, flow.skip_report):
        from_table, from_listing = rows(build)
        assert from_table == from_listing
    labels = {(r["repo_id"], r["path"]): r for r in flow.labelled(files, opts, rules).collect()}
    never = ("ignored_directory", "excluded_name", "excluded_glob", "stale", "gitignored")
    assert not [k for k in reads if labels[k]["reason"] in never or k[1].endswith(".png")]
    assert all(n <= (2 if labels[k]["looks_like_code"] else 1) for k, n in reads.items())
    if name == "small":  # most files are out of reach by their sizes
        assert len([k for k in reads if not labels[k]["looks_like_code"]]) < len(labels) / 2


def test_a_tree_is_packed_from_its_listing(spark, tmp_path):
    texts = {
        "r1/main.py": "import os\n", "r1/.gitignore": "skip*.py\n", "r1/skip1.py": "x\n", "r1/notes.zzz": "print words\n",
        "r1/sub/node_modules/dep.js": "let a\n", "r1/picture.png": "no text", "node_modules/README.md": "a repository\n",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    listing = corpus.scan_tree(spark, str(tmp_path), prune=fixed.IGNORE_DIR_NAMES)
    assert {f"{r['repo_id']}/{r['path']}" for r in listing.collect()} == set(texts) - {"r1/sub/node_modules/dep.js"}
    (tmp_path / "r1/picture.png").chmod(0)
    listed = flow.from_listing(listing, corpus.reader(1 << 20), PackOptions.preset("auto"))
    got = {(r["repo_id"], r["name"]) for r in flow.list_files(listed).collect()}
    assert got == {("r1", "main.py"), ("r1", ".gitignore"), ("r1", "notes.zzz"), ("node_modules", "README.md")}
    assert "print words" in {r["repo_id"]: r["document"] for r in flow.pack(listed).collect()}["r1"]


def test_an_empty_listing(spark):
    empty = sample.files(spark, FOLDER).where("false")
    listed = flow.from_listing(empty.drop("content"), lambda rows: empty)
    assert flow.pack(listed).count() == flow.skip_report(listed).count() == 0
