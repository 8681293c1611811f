"""The file tree as a data source, and documents as files with a commit."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from repoweave.plans import flow
from repoweave.plans.options import PackOptions
from repoweave.sources import corpus, document_files, trees

REPO = Path(__file__).resolve().parents[1]
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LoggingTree(trees.FileTree):
    """A tree whose store notes every file that is opened."""

    @classmethod
    def name(cls):
        return "logging_tree"

    @staticmethod
    def open_store(root):
        from pyarrow import fs

        class Handler(fs.FileSystemHandler):
            def __init__(self, inner):
                self.inner = inner

            def open_input_stream(self, path):
                with open(os.path.join(os.path.dirname(root), "opened.log"), "a") as log:
                    log.write(path + "\n")
                return self.inner.open_input_stream(path)

            def get_file_info_selector(self, selector):
                return self.inner.get_file_info(selector)

            def get_file_info(self, paths):
                return self.inner.get_file_info(paths)

            def get_type_name(self):
                return "logging"

            def normalize_path(self, path):
                return path

            def __eq__(self, other):
                return self is other

            __ne__ = object.__ne__
            open_input_file = open_output_stream = open_append_stream = open_input_stream
            create_dir = delete_dir = delete_dir_contents = delete_file = move = copy_file = delete_root_dir_contents = None

        Handler.__abstractmethods__ = frozenset()
        return fs.PyFileSystem(Handler(fs.LocalFileSystem())), root


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees") / "repos"
    texts = {f"r{i}/src/deep/er/f{j}.py": "x = 1\n" * (i * 10 + j) for i in range(6) for j in range(4)}
    texts |= {"r1/.gitignore": "a", "r1/node_modules/dep.js": "let", "node_modules/README.md": "a repository", "r2/ä b.md": "é", "top.txt": "no repository"}
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "r1/empty").mkdir()
    (root / "r1/link.py").symlink_to(root / "top.txt")
    (root / "r1/loop").symlink_to(root / "r1")
    os.mkfifo(root / "r1/pipe")
    return root


def read(spark, root, source="file_tree", **options):
    trees.register(spark)
    spark.dataSource.register(LoggingTree)
    return spark.read.format(source).options(**{"path": str(root), "splits": 8} | options)


def rows(df):
    return sorted(map(tuple, df.select("repo_id", "path", "size", "mtime").collect()))


@pytest.mark.parametrize("splits", [1, 3, 256])
@pytest.mark.parametrize("prune", ["", "node_modules,er"])
def test_same_rows_as_the_scan(spark, tree, splits, prune):
    found = read(spark, tree, splits=splits, prune=prune).load()
    assert rows(found) == rows(corpus.scan_tree(spark, str(tree), prune=prune.split(",") if prune else ()))
    assert found.rdd.getNumPartitions() <= splits
    one = read(spark, tree / "r1", splits=splits, prune=prune, repo_id="mine").load()
    assert rows(one) == rows(corpus.scan_tree(spark, str(tree / "r1"), repo_id="mine", prune=prune.split(",") if prune else ()))


def test_bytes_and_errors(spark, tree):
    got = {(r.repo_id, r.path): r for r in read(spark, tree, max_bytes=250).load().collect()}
    assert bytes(got["r2", "ä b.md"].bytes) == "é".encode() and got["r2", "ä b.md"].read_error is None
    large = got["r5", "src/deep/er/f3.py"]
    assert large.size == 318 and large.bytes is None and large.read_error == "too large"
    assert read(spark, tree / "missing").load().count() == 0
    with pytest.raises(Exception, match="no columns"):
        read(spark, tree).schema("repo_id string, owner string").load().collect()


def opened(tree):
    log = tree.parent / "opened.log"
    lines = log.read_text().split("\n")[:-1] if log.exists() else []
    log.unlink(missing_ok=True)
    return sorted(os.path.relpath(x, tree) for x in lines)


def test_only_wanted_files_are_opened(spark, tree):
    opened(tree)
    sizes = read(spark, tree, "logging_tree").schema(trees.LISTING).load()
    assert sizes.where("size > 100").agg(F.sum("size")).first()[0] > 0
    assert opened(tree) == []
    whole = read(spark, tree, "logging_tree").load()
    got = whole.where((F.col("repo_id") == "r4") & (F.col("size") > 250) & F.col("path").endswith(".py") & ~F.col("path").contains("f3"))
    assert {r.path for r in got.select("path", "bytes").collect()} == {"src/deep/er/f2.py"}
    assert opened(tree) == ["r4/src/deep/er/f2.py"]
    recent = whole.where((F.col("mtime") >= F.to_timestamp(F.lit("2999-01-01"))) | F.col("repo_id").isin("none"))
    assert recent.where(F.col("mtime") >= F.to_timestamp(F.lit("2999-01-01"))).count() == 0
    assert opened(tree) == []


FILTERS = [
    "size >= 60 and size <= 120", "repo_id in ('r1', 'r9')", "not (repo_id = 'r1')", "not (repo_id in ('r1', 'r2'))",
    "path like 'src/%'", "path like '%.md' and size is not null", "path like '%deep%'", "size <=> 6", "size < 10 or repo_id = 'r3'",
    "mtime > timestamp'2001-01-01' and mtime < timestamp'2999-01-01'", "mtime < timestamp'2001-01-01'", "size = null", "repo_id > 'r2'",
]


@pytest.mark.parametrize("where", FILTERS)
def test_pushed_filters_keep_the_same_rows(spark, tree, where):
    listing = read(spark, tree).schema(trees.LISTING).load()
    assert rows(listing.where(where)) == rows(corpus.scan_tree(spark, str(tree)).where(where))


def test_the_flow_reads_from_it(spark, tree):
    opts = PackOptions.preset("doc", respect_gitignore=False)
    scanned = corpus.with_bytes(corpus.scan_tree(spark, str(tree), prune=["node_modules"]))
    found = read(spark, tree, prune="node_modules").load()
    packed = [sorted(map(repr, flow.pack(corpus.read_text(f), opts).collect())) for f in (scanned, found)]
    assert packed[0] == packed[1] and len(packed[0]) >= 6


# ------------------------------------------------------------------- document files ----
def written(path):
    assert not [p for p in os.listdir(path) if p.startswith("_staging")]
    return {p.name: p.read_text() for p in Path(path).glob("*/*.md")}


def test_documents_are_files(spark, tmp_path):
    names = ["r1", "a/b", "..", "", "x" * 400, "x" * 401, "é ü", "%", "a%2Fb", None]
    docs = spark.createDataFrame([(n, f"document of {n}\nend") for n in names] + [("r1", "more")], "repo_id string, document string")
    document_files.write(docs.repartition(5), str(tmp_path / "out"), folders=4)
    got = written(tmp_path / "out")
    assert len(got) == len(names)
    assert all(got[document_files.file_name(n)] == f"document of {n}\nend" + "more" * (n == "r1") for n in names)
    assert (tmp_path / "out" / "_SUCCESS").read_text() == str(len(names))
    assert len(list((tmp_path / "out").iterdir())) <= 5
    with pytest.raises(Exception, match="not empty"):
        document_files.write(docs, str(tmp_path / "out"))
    assert written(tmp_path / "out") == got
    document_files.write(docs.limit(0), str(tmp_path / "none"))
    assert written(tmp_path / "none") == {}


def test_parts_are_streamed_into_files(spark, tmp_path):
    from repoweave.sources import sample

    files = sample.files(spark, "/root/testdata/sf0.001")
    opts = PackOptions.preset("code")
    whole = {document_files.file_name(r.repo_id): r.document for r in flow.pack(files, opts).collect()}
    document_files.write_parts(flow.pack_parts(files, opts), str(tmp_path / "parts"))
    assert written(tmp_path / "parts") == whole


def batch(folder, repos):
    return pa.RecordBatch.from_pydict({"folder": [folder] * len(repos), "repo_id": repos, "text": [f"text of {r}" for r in repos]})


def test_attempts_that_fail_or_repeat_leave_nothing(tmp_path):
    def failing():
        yield batch("0001", ["a", "b"])
        raise OSError("lost")

    writer = document_files.FilesWriter(str(tmp_path / "out"), "job")
    with pytest.raises(OSError, match="lost"):
        writer.write(failing())
    speculative = writer.write(iter([batch("0001", ["a", "b", "c"])]))
    counted = writer.write(iter([batch("0001", ["a", "b", "c"]), batch("0002", ["d"])]))
    assert speculative.staged != counted.staged and not list((tmp_path / "out").glob("000*"))
    writer.commit([counted, None])
    assert written(tmp_path / "out") == {f"{r}.md": f"text of {r}" for r in "abcd"}
    gone = document_files.FilesWriter(str(tmp_path / "gone"), "job")
    gone.abort([gone.write(iter([batch("0001", ["a"])]))])
    assert written(tmp_path / "gone") == {}


RETRY = """
import sys
sys.path.insert(0, {repo!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from repoweave.sources import document_files
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()

def once(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt")

docs = spark.range(40).selectExpr("concat('r', id) repo_id", "concat('text ', id) document")
rows = docs.withColumnRenamed("document", "text").withColumn("folder", document_files.folder_of("repo_id", 7))
ordered = rows.repartition("folder").sortWithinPartitions("folder", "repo_id").select("folder", "repo_id", "text")
spark.dataSource.register(document_files.DocumentFiles)
ordered.mapInArrow(once, ordered.schema).write.format("document_files").mode("append").option("path", {out!r}).save()
"""


def test_a_task_that_fails_once(tmp_path):
    script = RETRY.format(repo=str(REPO), out=str(tmp_path / "out"))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "first attempt" in done.stderr
    assert Counter(written(tmp_path / "out").values()) == Counter(f"text {i}" for i in range(40))
