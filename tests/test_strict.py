"""Strict mode's report, and a caller's credential patterns in a whole run."""

import json

import pytest

from repoweave.functions.redaction import PATTERNS, CredentialPattern
from repoweave.plans import flow
from repoweave.plans.options import PackOptions

OWN = CredentialPattern("own", r"ticket-([0-9]{4})", 1, 0, needs=("ticket-",))


@pytest.fixture(scope="module")
def files(spark):
    texts = {
        "src/a.js": 'password: "Fak3Pass99"\nlet t = "ticket-1234";\n', "src/b.js": "let x = 1;\n",
        "conf/.env": "API_KEY=abc123def456\n", "node_modules/c.js": 'password: "Fak3Pass99"\n',
    }
    rows = [("r", p, len(t), None, t) for p, t in texts.items()] + [("clean", "a.js", 5, None, "let a")]
    return spark.createDataFrame(rows, "repo_id string, path string, size long, mtime timestamp, content string")


def test_strict_gives_the_report_of_what_is_packed(files):
    opts = PackOptions.preset("auto", security="strict")
    documents, report = flow.pack_reported(files, opts)
    assert sorted(map(repr, documents.collect())) == sorted(map(repr, flow.pack(files, opts).collect()))
    lines = [r["entry"] for r in report.orderBy("repo_id", "part", "path", "seq").collect()]
    assert [x for x in lines if "File: " in x] == ["\nFile: conf/.env", "\nFile: src/a.js"]
    assert "  - " in "".join(lines) and not any("node_modules" in x for x in lines)
    assert sorted(map(repr, report.collect())) == sorted(map(repr, flow.report_lines(files, opts).collect()))


@pytest.mark.parametrize("level", ["auto", "none"])
def test_other_levels_give_no_report(files, level):
    opts = PackOptions.preset("auto", security=level)
    documents, report = flow.pack_reported(files, opts)
    assert report is None and documents.count() == 2


def test_own_patterns_reach_documents_and_report(files):
    opts = PackOptions.preset("auto", security="strict", patterns=(OWN,))
    documents, report = flow.pack_reported(files, opts)
    text = {r["repo_id"]: r["document"] for r in documents.collect()}["r"]
    assert "ticket-1234" not in text and "Fak3Pass99" in text
    assert any("src/a.js" in r["entry"] for r in report.collect())
    both = PackOptions.preset("auto", patterns=(*PATTERNS, OWN))
    text = {r["repo_id"]: r["document"] for r in flow.pack(files, both).collect()}["r"]
    assert "ticket-1234" not in text and "Fak3Pass99" not in text
    saved = json.loads(json.dumps(opts.to_dict()))
    assert PackOptions.from_dict(saved) == opts and PackOptions.from_dict(PackOptions().to_dict()) == PackOptions()
