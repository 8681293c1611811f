import datetime

import pytest

from repoweave.operators import score
from repoweave.operators.facts import facts
from repoweave.plans.options import PackOptions

SCHEMA = "repo_id string, path string, size bigint, mtime timestamp, content string"
OLD = datetime.datetime(2020, 1, 1)
INFRA = PackOptions(infrastructure=True)


def terms(spark, rows, opts=PackOptions()):
    files = spark.createDataFrame([("r", p, s, m, c) for p, s, m, c in rows], SCHEMA)
    return {r.path: r for r in score.score_files(facts(files, opts), opts).collect()}


def test_size_boundaries(spark):
    want = {1: 30, 99: 30, 100: 50, 500: 50, 501: 70, 10_239: 60, 10_240: 40, 50_000: 0, 102_400: 0, 102_401: -50}
    got = terms(spark, [(f"f{n}", n, OLD, "") for n in want])
    assert {n: got[f"f{n}"].size_points for n in want} == want


def test_recency_boundaries(spark):
    as_of = datetime.datetime(2024, 3, 1)
    want = {0: 30, 0.4: 30, 0.5: 29, 7: 16, 13.9: 3, 14: 0, 100: 0, -1: 32}
    rows = [(f"d{d}", 10, as_of - datetime.timedelta(days=d), "") for d in want]
    got = terms(spark, rows)
    assert {d: got[f"d{d}"].recency_points for d in want} == want
    recent = terms(spark, rows, PackOptions(recent_days=3))
    assert {r.recency_points for r in recent.values()} == {0}


def test_names(spark):
    rows = [(p, 10, OLD, "") for p in [
        "x/ReadMe.MD", "setup.md", "x/README.md", "src/index.ts", "main.py", "x/main.py", "cmd/a/main.go",
        "src/a.test.ts", "src/a.min.js", "x/generated/a.c", "generated/a.c", "x/__tests__/a.c", "a.gen.rb"]]
    got = terms(spark, rows)
    points = lambda t: {p: r[t] for p, r in got.items() if r[t]}
    assert points("docs_points") == {"x/ReadMe.MD": 200, "setup.md": 200, "x/README.md": 200}
    assert points("config_points") == {"x/README.md": 150}
    assert points("entry_points") == {"src/index.ts": 100, "main.py": 100, "cmd/a/main.go": 100}
    assert points("folder_points") == {"src/index.ts": 50, "src/a.test.ts": 50, "src/a.min.js": 50}
    assert points("test_points") == {"src/a.test.ts": -40, "x/__tests__/a.c": -40}
    assert points("minified_points") == {"src/a.min.js": -100}
    assert points("generated_points") == {"x/generated/a.c": -80, "a.gen.rb": -80}
    assert got["x/ReadMe.MD"].extension_points == 30 and got["a.gen.rb"].extension_points == 20


@pytest.mark.parametrize("content, imports, definitions, architecture", [
    ("import a\nimport b", 4, 0, 0),
    ("import a require (x) require(y) important", 6, 0, 0),
    ("import x\n" * 30, 20, 0, 0),
    ("function f => def g class H interface I defx subclass J", 0, 6, 0),
    ("=> " * 30, 0, 20, 0),
    ("module.exports = 1", 0, 0, 15),
])
def test_content(spark, content, imports, definitions, architecture):
    row = terms(spark, [("a", 10, OLD, content)])["a"]
    assert (row.import_points, row.definition_points, row.architecture_points) == (imports, definitions, architecture)


def test_infra(spark):
    rows = [("a.tf", 1, OLD, ""), ("b.yml", 1, OLD, "kind: x"), ("c.yml", 1, OLD, "x"), ("Dockerfile", 1, OLD, ""),
            ("docker-compose.yml", 1, OLD, ""), ("docker-compose.x", 1, OLD, ""), ("d.j2", 1, OLD, "")]
    got = {p: r.infra_points for p, r in terms(spark, rows, INFRA).items()}
    assert got == {"a.tf": 100, "b.yml": 80, "c.yml": 0, "Dockerfile": 70, "docker-compose.yml": 0, "docker-compose.x": 70, "d.j2": 60}


def test_score_is_the_sum(spark):
    row = terms(spark, [("src/index.ts", 600, OLD, "import a")])["src/index.ts"]
    assert row.score == 100 + 50 + 25 + 50 + 20 + 2
    files = spark.createDataFrame([("r", "src/index.ts", 600, OLD, "import a")], SCHEMA)
    assert score.scored(facts(files)).first().score == row.score
