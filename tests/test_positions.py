"""Places of findings, and the time that long files take."""

import random
import re
import time

from repoweave.functions import fixed
from repoweave.operators import redact

ENDS = "\n\r  "


def findings(spark, path, texts, step):
    rows = [("r", f"{i}/{path}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "repo_id string, path string, content string").coalesce(1)
    out = [[] for _ in texts]
    for r in redact.findings_table(step(df)).collect():
        out[int(r["path"].split("/")[0])].append((r["seq"], r["line"], r["column"], r["preview"]))
    return [sorted(x) for x in out]


def env_places(text):
    """Line by line feeds, column from the last of them, by counting what stands before each line."""
    out, start = [], 0
    for line in re.split(f"(?<=[{ENDS}])", text):
        m = re.fullmatch(rf"([A-Za-z0-9_]+)=(?:['\"]([^{ENDS}]*)['\"]|([^{ENDS}]*))[{ENDS}]?", line)
        if m and any(p in m[1].lower() for p in fixed.ENV_SENSITIVE_PARTS):
            value = m[2] if m[2] is not None else m[3]
            letters = value.isascii() and value.isalpha() and len(value) < fixed.FALSE_POSITIVE_WORD_LENGTH
            if value and "REDACTED" not in value and value not in fixed.FALSE_POSITIVE_WORDS and not letters:
                before = text[:start]
                column = len(before) - (before.rfind("\n") + 1) + len(m[1]) + 1
                out.append((len(out) + 1, before.count("\n") + 1, column, value[:3] + "..."))
        start += len(line)
    return out


def test_places_in_environment_files(spark):
    rng = random.Random(2)
    parts = ["API_KEY=abc123def", "DB_PASSWORD='é😀x1y2z3'", "DEBUG=true", "", "x", "SECRET=", "# note 😀", "TOKEN=\"q1w2e3\""]
    texts = [
        "".join(rng.choice(parts) + rng.choice([*ENDS, "\r\n", "\n\n", ""]) for _ in range(rng.randint(0, 12))) for _ in range(400)
    ]
    got = findings(spark, ".env", texts, redact.redact_env)
    assert got == [env_places(t) for t in texts]
    assert sum(map(len, got)) > 500


def test_places_of_many_findings_in_a_line(spark):
    parts = ['password: "Fak3Pass99"', "😀é", " ", "\n", "; let x = 1"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    want = []
    for t in texts:
        hits = [m.start() for m in re.finditer(r'password: "Fak3Pass99"', t)]
        want.append([(t[:h].count("\n") + 1, h - t[:h].rfind("\n")) for h in hits])
    got = findings(spark, "a.txt", texts, redact.redact)
    assert [[f[1:3] for f in fs] for fs in got] == want


def test_a_long_file_takes_linear_time(spark):
    def seconds(path, text, step):
        findings(spark, path, [text], step)
        began = time.time()
        count = len(findings(spark, path, [text], step)[0])
        return time.time() - began, count

    for end in "\n\r":
        taken, count = seconds(".env", end.join(f"API_KEY{i}=abc123def456x{i}" for i in range(17_000)), redact.redact_env)
        assert count == 17_000 and taken < 12  # 95 s and more when every hit looked at all lines before it
    taken, count = seconds("a.txt", 'password: "Fak3Pass99x" ' * 20_000, redact.redact)
    assert count == 20_000 and taken < 20
