import re

import pytest
from pyspark.sql import functions as F

from repoweave.functions import paths
from repoweave.functions.globs import glob_regex


def test_path_parts(column):
    rows = [{"path": p} for p in ["a/b.c/x.tar.gz", ".env", "a/.env.example", "Dockerfile", "x.", "d/X.PY"]]
    assert column(rows, paths.basename()) == ["x.tar.gz", ".env", ".env.example", "Dockerfile", "x.", "X.PY"]
    assert column(rows, paths.dirname()) == ["a/b.c", ".", "a", ".", ".", "d"]
    assert column(rows, paths.extname()) == [".gz", "", ".example", "", ".", ".PY"]
    assert column(rows, paths.lower_ext())[-1] == ".py"


def test_token_estimate_rounds_up(column):
    rows = [{"n": n} for n in [0, 1, 4, 5, 8]]
    assert column(rows, paths.token_estimate("n")) == [0, 1, 1, 2, 2]


def test_human_size(column):
    shown = {
        0: "0 B", 999: "999 B", 1000: "1 kB", 1500: "1.5 kB", 265318: "265.32 kB",
        999994: "999.99 kB", 999999: "1 MB", 1234567890: "1.23 GB",
    }
    assert column([{"n": n} for n in shown], paths.human_size("n")) == list(shown.values())


@pytest.mark.parametrize("glob, dot, hits, misses", [
    ("*.sql", False, ["a.sql", "a.b.sql"], [".sql", ".a.sql", "d/a.sql", "a.sqlx"]),
    ("*.generated.*", False, ["a.generated.js", "a.generated."], [".generated.js"]),
    ("src/index.*", False, ["src/index.ts", "src/index."], ["a/src/index.ts", "src/index/x"]),
    ("cmd/*/main.go", False, ["cmd/a/main.go"], ["cmd/main.go", "cmd/.a/main.go", "cmd/a/b/main.go"]),
    ("**/gen/**", True, ["gen/a", "a/gen/b/.c"], ["gen", "agen/b"]),
    ("notes/**", True, ["notes/a", "notes/a/b"], ["notes", "a/notes/b"]),
    ("*.{js,ts}", False, ["a.js", "b.ts"], ["a.tsx"]),
    ("f?[0-9].txt", False, ["fa1.txt"], ["f1.txt", "fab.txt"]),
])
def test_globs(glob, dot, hits, misses):
    regex = re.compile(glob_regex(glob, dot).replace(r"\z", r"\Z"))
    assert all(regex.search(h) for h in hits)
    assert not any(regex.search(m) for m in misses)


def test_language_and_group(column):
    rows = [{"path": p} for p in ["a.TSX", "x/README.md", "my-config.py", "a.py", "a.h", "Makefile"]]
    assert column(rows, paths.language_id()) == ["tsx", "markdown", "python", "python", "c", ""]
    assert column(rows, paths.type_group()) == [
        "JavaScript/TypeScript", "Documentation", "Configuration Files", "Backend Code", "Other", "Other"]


def test_sensitive_paths(column):
    rows = [{"path": p} for p in ["a/.env", ".env.local", ".envrc", "myCONFIG.prod.yml", "keys/a.pem", "config.py"]]
    assert column(rows, paths.is_sensitive_path()) == [True, True, False, True, True, False]


def test_flags(column):
    rows = [{"path": p, "size": s} for p, s in [("a.PNG", 512_000), ("src/x.py", 512_001), ("go.mod", 7), ("cmd/a/main.go", 1)]]
    flags = paths.file_flags()
    assert column(rows, flags["is_binary"]) == [True, False, False, False]
    assert column(rows, flags["is_large"]) == [False, True, False, False]
    assert column(rows, flags["is_config"]) == [False, False, True, False]
    assert column(rows, flags["is_entry"]) == [False, False, False, True]
    assert column(rows, flags["is_priority"]) == [False, True, True, True]
    assert column(rows, F.col("size")) == [512_000, 512_001, 7, 1]
