import datetime

import pytest

from repoweave.operators import detect, select
from repoweave.operators.facts import facts
from repoweave.plans import flow
from repoweave.plans.options import PackOptions

SCHEMA = "repo_id string, path string, size bigint, mtime timestamp, content string"
NEW, OLD = datetime.datetime(2024, 2, 28), datetime.datetime(2023, 1, 1)
PROSE = "plain words"
CASES = [
    ("src/node_modules/x.js", PROSE, "ignored_directory"),
    ("build", "class A", "content"),                      # a file, not a directory, of that name
    ("a/.DS_Store", PROSE, "ignored_directory"),
    ("yarn.lock", PROSE, "excluded_name"),
    ("src/a.min.js", PROSE, "excluded_glob"),
    ("src/.min.js", PROSE, "important_folder"),           # a wildcard matches no leading dot
    ("x/go.mod", PROSE, "include_name"),
    ("x/Dockerfile.dev", PROSE, "special_name"),
    ("x/angular.json", PROSE, "high_priority"),
    ("src/index.zig", PROSE, "entry_point"),
    ("lib/a.py", PROSE, "important_folder"),
    ("lib/a.PY", PROSE, "content"),                       # extensions are case-sensitive
    ("x/private/a.py", PROSE, "gitignored"),
    ("lib/private/a.py", PROSE, "important_folder"),      # ignore rules reach extensions only
    ("x/a.py", PROSE, "extension"),
    ("x/a.zig", PROSE, "content"),
    ("x/noext", PROSE, "no_rule"),
    ("x/noext2", "def f(x)", "content"),
    ("x/myconfig", PROSE, "content"),
    ("x/a.toolong", PROSE, "no_rule"),
    ("x/a.png", PROSE, "no_rule"),
    ("x/b.zig", "é" * 20, "no_rule"),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", p, len(c.encode()), NEW, c) for p, c, _ in CASES]
    rows += [("r", ".gitignore", 8, NEW, "private/"), ("r", "x/huge.zig", 102_401, NEW, PROSE)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_reason(files):
    labels = {r.path: r.reason for r in flow.labelled(files, PackOptions()).collect()}
    assert {p: labels[p] for p, _, _ in CASES} == {p: reason for p, _, reason in CASES}
    assert labels[".gitignore"] == "include_name"
    assert labels["x/huge.zig"] == "no_rule"


def test_strict_ignore_rules_come_first(files):
    labels = {r.path: r.reason for r in flow.labelled(files, PackOptions(strict_gitignore=True)).collect()}
    assert labels["lib/private/a.py"] == labels["x/private/a.py"] == "gitignored"


def test_no_ignore_rules(files):
    labels = {r.path: r.reason for r in flow.labelled(files, PackOptions.preset(security="none")).collect()}
    assert labels["x/private/a.py"] == "extension"


def test_user_lists(files):
    opts = PackOptions(extensions=(".zig",), files=("noext",), exclude=("*.py",), ignore=("lib/**",))
    labels = {r.path: r.reason for r in flow.labelled(files, opts).collect()}
    assert labels["x/a.zig"] == "extension" and labels["x/noext"] == "include_name"
    assert labels["x/a.py"] == "excluded_glob" and labels["lib/a.py"] == "ignored_directory"
    assert labels["yarn.lock"] == "content" and labels["x/go.mod"] == "high_priority"


def test_recent(spark):
    rows = [("r", p, 5, OLD, PROSE) for p in ["go.mod", "x/a.py", "lib/a.py", "x/Dockerfile.dev"]]
    rows += [("r", "new.py", 5, NEW, PROSE)]
    opts = PackOptions(recent_days=30)
    labels = {r.path: r.reason for r in flow.labelled(spark.createDataFrame(rows, SCHEMA), opts).collect()}
    assert labels == {
        "go.mod": "stale", "x/a.py": "stale", "lib/a.py": "important_folder",
        "x/Dockerfile.dev": "special_name", "new.py": "extension"}


def test_eligible_agrees_with_labels(files):
    opts = PackOptions(max_file_bytes=12)
    one = {r.path for r in flow.eligible(files, opts).collect()}
    other = {r.path for r in flow.eligible_of(flow.labelled(files, opts), opts).collect()}
    assert one == other and "x/a.py" in one and ".gitignore" in one


def test_detection(spark):
    rows = [
        ("tf", "a/x.tfvars", ""), ("tf", "main.tf", ""), ("k8s", "a/Chart.yaml", ""), ("ans", "inventory", ""),
        ("doc", "x/docker-compose.yaml", ""), ("pkr", "a.json", '{"builders":1,"provisioners":2}'),
        ("none", ".hidden/Dockerfile", ""), ("none", ".x.tf", ""), ("none", "package.json", '"builders" "provisioners"'),
        ("none", ".helmignore", ""), ("helm", "a/b.helmignore", ""),
    ]
    files = spark.createDataFrame([(r, p, len(c), NEW, c) for r, p, c in rows], SCHEMA)
    found = {r.repo_id: [k for k, v in r.asDict().items() if v is True] for r in detect.detect_repo_type(facts(files)).collect()}
    assert found == {
        "tf": ["is_terraform", "has_root_terraform"], "k8s": ["is_kubernetes"], "ans": ["is_ansible"],
        "doc": ["is_docker"], "pkr": ["is_packer"], "none": [], "helm": ["is_kubernetes"]}


def test_detection_widens_user_extensions(spark):
    rows = [("tf", "a/x.tf"), ("tf", "a/y.rb"), ("plain", "a/y.tfvars"), ("plain", "b/z.py"), ("yml", "playbook.yml"), ("yml", "k.yml")]
    files = spark.createDataFrame([(r, p, 5, NEW, "éé") for r, p in rows], SCHEMA)
    for auto, tf in ((True, "extension"), (False, "content")):
        opts = PackOptions(extensions=(".py",), auto_detect=auto)
        labels = {(r.repo_id, r.path): r.reason for r in flow.labelled(files, opts).collect()}
        assert labels["tf", "a/x.tf"] == tf                # .tf also looks like code by name
        assert labels["plain", "b/z.py"] == "extension"
        assert labels["yml", "k.yml"] == ("extension" if auto else "content")
    assert labels["tf", "a/y.rb"] == "no_rule"


def test_options():
    assert PackOptions.preset("auto").smart and not PackOptions.preset("code").smart
    assert PackOptions.preset("infra").infrastructure and not PackOptions.preset("doc").optimize_tokens
    assert not PackOptions.preset(security="none").redact_credentials
    saved = PackOptions.preset("code", extensions=(".py",))
    assert PackOptions.from_dict(saved.to_dict()) == saved
    for bad in (lambda: PackOptions.preset("fast"), lambda: PackOptions.from_dict({"nope": 1})):
        with pytest.raises(ValueError):
            bad()
    assert set(select.ACCEPTED) >= {"extension", "content"}
