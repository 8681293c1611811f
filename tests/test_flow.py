"""The whole job, its sources and sinks, and what its plans must and must not do."""

import datetime
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from repoweave.operators import aggregate, rank, redact
from repoweave.plans import flow
from repoweave.plans.options import PackOptions
from repoweave.sources import corpus, scratch, sinks
from repoweave.streaming.redaction import redact_stream

SCHEMA = "repo_id string, path string, size bigint, mtime timestamp, content string"
NOW = datetime.datetime(2024, 2, 29)
REPO = {
    "README.md": "# Hello\n",
    "src/a.ts": "/* x */ let token = 'abcd1234efgh';\n// gone\n",
    "src/b.ts": "let b = 1;",
    "logo.png": "binary",
    "drop/c.py": "x = 1",
    ".gitignore": "drop/\n",
    "empty.py": "",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", p, len(c.encode()), NOW, c) for p, c in REPO.items()]
    rows += [("s", "main.py", 4, NOW, "a=1\n")]
    return spark.createDataFrame(rows, SCHEMA)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_document(files):
    docs = {r.repo_id: r for r in flow.pack(files, PackOptions.preset()).collect()}
    assert docs["s"].document == (
        "# PROJECT CONTEXT\n\nThis code was collected by the repoweave tool on 2024-03-01.\n"
        "Total files: 1, Size: 4 B, Est. tokens: ~1\n\n"
        "> ⚠️ **Security Notice**: Sensitive information and credentials have been automatically redacted\n\n"
        "# PROJECT FILES\n\n## Root Directory\n\n### main.py (4 B)\n\n```\na=1\n```\n\n---\nGenerated with repoweave.\n")
    text = docs["r"].document
    assert re.findall(r"^##+ .*", text, re.M) == [
        "## Root Directory", "### README.md (8 B)", "### .gitignore (6 B)",
        "## Directory: src/", "### a.ts (44 B)", "### b.ts (10 B)"]
    assert " let token = '[REDACTED]';\n\n```" in text and "gone" not in text and "drop me" not in text


def test_modes(files):
    doc = flow.pack(files, PackOptions.preset("doc", security="none")).where("repo_id = 'r'").first().document
    assert "Security Notice" not in doc and "abcd1234efgh" in doc and "// gone" in doc
    assert "drop/" in doc                                   # ignore rules off
    infra = flow.list_files(files, PackOptions.preset("infra")).collect()
    assert {r.name for r in infra if r.repo_id == "r"} >= {"README.md", ".gitignore"}
    code = flow.kept(files, PackOptions.preset("code")).where("repo_id = 'r'").orderBy("rank").collect()
    assert [r.path for r in code] == [".gitignore", "README.md", "src/b.ts", "src/a.ts"]   # main first, then by size


@pytest.mark.parametrize("verdicts", [[True], [False, True], [False, False]])
def test_content_join_is_the_same_each_way(files, monkeypatch, verdicts):
    answers = iter(verdicts)
    monkeypatch.setattr(flow, "fits_broadcast", lambda table: next(answers))
    rows = flow.with_content(flow.kept(files, PackOptions()), files)
    assert {(r.repo_id, r.path, r.content) for r in rows.collect()} == {
        ("s", "main.py", "a=1\n"), *[("r", p, REPO[p]) for p in ("README.md", "src/a.ts", "src/b.ts", ".gitignore")]}


def test_few_kept_files_are_broadcast_and_content_is_not_shuffled(files, tmp_path):
    files.write.parquet(str(tmp_path / "files"))
    table = files.sparkSession.read.parquet(str(tmp_path / "files"))
    plan = plan_of(flow.with_content(flow.kept(table, PackOptions()), table))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def nodes_of(df):
    """All operators of the plan as first made."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        yield node
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def test_no_shuffle_or_sort_carries_content(files, tmp_path):
    files.write.parquet(str(tmp_path / "files"))
    table = files.sparkSession.read.parquet(str(tmp_path / "files"))
    opts = PackOptions.preset(extensions=(".py",))
    for df in (flow.accepted(table, opts), flow.budgeted(table, opts), flow.kept(table, opts), flow.labelled(table, opts)):
        moving = [n for n in nodes_of(df) if n.nodeName() in ("Exchange", "Sort", "Window", "MapInPandas")]
        assert moving
        assert not any("content" in n.output().mkString(",") for n in moving)


def test_stats_read_no_content(files, tmp_path):
    files.write.parquet(str(tmp_path / "files"))
    table = files.sparkSession.read.parquet(str(tmp_path / "files"))
    for df in (corpus.scan_stats(table), aggregate.repo_totals(table), rank.largest_files(table.select("repo_id", "path", "size"))):
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df))
        assert schemas and not any("content" in s for s in schemas)


def test_broadcast_is_measured(spark, monkeypatch):
    table = spark.createDataFrame([("ab", 1), ("cde", 2)], "s string, n bigint")
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 21)
    assert scratch.fits_broadcast(table) and scratch.fits_broadcast(table.limit(0))
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 20)
    assert not scratch.fits_broadcast(table)


def test_scratch_folder_is_the_one_the_session_names():
    made = []

    def fake(named, master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)

    assert scratch.checkpoint_folder(fake("hdfs://x/y", "yarn")) == "hdfs://x/y" and not made
    with pytest.raises(ValueError):
        scratch.checkpoint_folder(fake(None, "yarn"))
    assert scratch.checkpoint_folder(fake(None, "local[2]")) == made[0]


def test_top_k_is_cut_before_the_shuffle(files):
    assert "WindowGroupLimit" in plan_of(rank.largest_files(files))
    assert "WindowGroupLimit" in plan_of(aggregate.directory_tree(files))


def test_filter_on_findings_keeps_the_plan_small(files):
    assert plan_of(redact.redact(files).where("found").select("path")).count("aggregate(") < 10


def test_reports(files):
    opts = PackOptions.preset()
    lines = [r.entry for r in flow.security_report(files, opts).orderBy("repo_id", "path", "seq").collect()]
    assert lines == ["  - Token at line 1:13: abc..."]
    summary = flow.dry_run(files, opts).where("repo_id = 'r'").orderBy("rank").collect()
    assert [(r.path, r.shown_size, r.total_files, r.more_files) for r in summary][0] == ("src/a.ts", "44 B", 4, 0)


def test_tree(spark):
    paths = [f"a/s{i}/f" for i in range(8)] + ["a/.hid/f", "b/f", ".git/x/f", "top"]
    rows = aggregate.directory_tree(spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string"))
    assert [r.line for r in rows.orderBy("top", "pos").collect()] == [
        "  |- a/", "  |   |- s0/", "  |   |- s1/", "  |   |- s2/", "  |   |- s3/", "  |   |- ... 4 more directories", "  |- b/"]


def test_scan_and_read(spark, tmp_path):
    for path, data in {"r1/a/x.py": b"x = 1\n", "r1/.env": b"A=1", "r2/bad.txt": b"a\xffb\xe2\x82c"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "r1" / "link").symlink_to(tmp_path / "r2")
    listed = corpus.scan_tree(spark, str(tmp_path))
    assert {(r.repo_id, r.path, r["size"]) for r in corpus.scan_stats(listed).collect()} == {
        ("r1", "a/x.py", 6), ("r1", ".env", 3), ("r2", "bad.txt", 6)}
    texts = {r.path: (r.content, r.is_valid_utf8) for r in corpus.read_text(corpus.with_bytes(listed)).collect()}
    assert texts["a/x.py"] == ("x = 1\n", True)
    assert texts["bad.txt"] == ("a\ufffdb\ufffdc", False)
    assert corpus.within_depth(listed, 0).count() == 2
    picks = spark.createDataFrame([("r1", ".env")], "repo_id string, path string")
    assert [r.path for r in corpus.picked(listed, picks).select("path").collect()] == [".env"]
    one = corpus.scan_tree(spark, str(tmp_path / "r1"), repo_id="mine")
    assert {(r.repo_id, r.path) for r in one.collect()} == {("mine", "a/x.py"), ("mine", ".env")}
    assert corpus.scan_tree(spark, str(tmp_path), modified_after="2999-01-01").count() == 0
    docs = flow.pack(corpus.read_text(corpus.with_bytes(listed)), PackOptions.preset())
    assert {r.repo_id for r in docs.collect()} == {"r1", "r2"}


def test_sinks(spark, files, tmp_path):
    docs = flow.pack(files, PackOptions.preset())
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 2
    sinks.write_markdown(docs, str(tmp_path / "md"))
    text = "".join(p.read_text() for p in (tmp_path / "md" / "repo_id=s").glob("part-*"))
    assert text.startswith("# PROJECT CONTEXT") and "a=1" in text
    sinks.write_listing(flow.list_files(files), str(tmp_path / "list"))
    assert spark.read.json(str(tmp_path / "list")).count() == 5
    sinks.write_report(flow.security_report(files), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


@pytest.mark.parametrize("mode", ["auto", "doc"])
def test_parts_make_up_the_document(files, tmp_path, mode):
    opts = PackOptions.preset(mode)
    whole = {r.repo_id: r.document for r in flow.pack(files, opts).collect()}
    sinks.write_parts(flow.pack_parts(files, opts), str(tmp_path / "parts"))
    for repo, document in whole.items():
        parts = sorted((tmp_path / "parts" / f"repo_id={repo}").glob("part-*"))
        assert "".join(p.read_text() for p in parts) == document


def test_parts_with_a_tree(files):
    parts = flow.pack_parts(files, PackOptions(tree=True)).where("repo_id = 'r'").orderBy("part", "key", "pos").collect()
    text = "".join(r.text + "\n" for r in parts)
    assert (
        "## PROJECT STRUCTURE\n```\nProject Directory Structure:\nr\n  |- drop/\n  |- src/\n```\n\n> " in text)


def test_file_cap(spark):
    rows = [("big", f"d{i:02}/f{i}.py", 100 - i, NOW, "x" * (100 - i)) for i in range(30)]
    rows += [("big", "z/go.mod", 50, NOW, "x" * 50), ("big", "a.png", 5, NOW, "x" * 5), ("big", "src/b.png", 5, NOW, "x" * 5)]
    rows += [("small", "a.py", 1, NOW, "x")]
    kept = flow.eligible(spark.createDataFrame(rows, SCHEMA), PackOptions(max_files=4)).collect()
    # The priority file, then the first three others by path.
    assert {(r.repo_id, r.path) for r in kept} == {("small", "a.py"), ("big", "z/go.mod")} | {
        ("big", f"d{i:02}/f{i}.py") for i in range(3)}


def test_stream(spark, files, tmp_path):
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    redact_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    batch = {(r.path, r.content) for r in redact.redact(files).collect()}
    assert {(r.path, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    assert spark.read.parquet(str(tmp_path / "out")).where(F.size("findings") > 0).count() == 1
