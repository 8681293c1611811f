import random
import re

import pytest
from pyspark.sql import functions as F

from repoweave.functions import comments, fixed, summary
from repoweave.operators import render
from repoweave.plans.options import PackOptions

C_CASES = {
    "/** a */x": "x",
    "/** @param p */x": "/** @param p */x",
    "a /* b\nc */ d": "a  d",
    "a // b\nc": "a \nc",
    "a // TODO b // c\nd": "a // TODO b // c\nd",
    "// x /// NOTE\n//y": "// x /// NOTE\n",
    'u = "http://a"': 'u = "http:',                       # lexical on purpose
    "// /** @param p */ lost\nz": "\nz",                  # a kept block inside a dropped comment
    "/* /** @return x */ */y": "y",                       # and inside a block comment
    "/** @throws $& */ $1": "/** @throws $& */ $1",       # restored literally
    "/**/ a */ b": " b",
    "a\r\n// b\r\nc": "a\r\n\r\nc",
}
PY_CASES = {
    "x = 1 # c\n": "x = 1 \n",
    '"""Args: # k"""\n# c': '"""Args: # k"""\n',
    '"""plain # c"""': '"""plain ',
    "'''Returns: # a\n# b'''": "'''Returns: # a\n# b'''",
    '# """Args: x"""\ny': "\ny",
}


def test_c_family(column):
    got = column([{"t": t} for t in C_CASES], comments.strip_c("t"))
    assert dict(zip(C_CASES, got)) == C_CASES


def test_python_and_hash(column):
    assert dict(zip(PY_CASES, column([{"t": t} for t in PY_CASES], comments.strip_python("t")))) == PY_CASES
    assert column([{"t": 'a # b\n"""Args: # c"""'}], comments.strip_hash("t")) == ['a \n"""Args: ']


def test_markup_and_blank_lines(column):
    assert column([{"t": "a<!-- b\nc -->d<!-->e-->f"}], comments.strip_markup("t")) == ["adf"]
    cases = {"a\n\n\nb": "a\n\n\nb", "a\n\n\n\nb": "a\n\n\nb", "a\n \n\t\n \n\n  b": "a\n\n\n  b", "a\n" * 3: "a\n" * 3}
    assert column([{"t": t} for t in cases], comments.collapse_blank_lines("t")) == list(cases.values())


def test_long_comments_do_not_overflow(column):
    text = "/*" + "x\n" * 150_000 + "*/a" + "//" + "y" * 100_000
    assert column([{"t": text}], comments.strip_c("t")) == ["a"]


def test_by_extension(column):
    rows = [{"path": p, "content": "a // b # c <!-- d -->"} for p in ["x.js", "x.py", "x.rb", "x.html", "x.md", "x.kt"]]
    got = column(rows, render.rendered(PackOptions.preset("code")))
    assert got == ["a ", "a // b ", "a // b ", "a // b # c ", "a // b # c <!-- d -->", "a // b # c <!-- d -->"]
    assert column(rows, render.rendered(PackOptions.preset("doc"))) == [r["content"] for r in rows]


def model_summary(content, ext):
    """The summary, line by line."""
    lines = content.split("\n")
    if len(lines) <= 20:
        return content
    head = 10
    if ext in fixed.IMPORT_HEADER_EXTENSIONS:
        last = 0
        for i, line in enumerate(lines[:30]):
            if "import " in line or "require(" in line:
                last = i
            elif i > 15 and last < i - 5:
                break
        head = min(last + 3, 20)
    found = []
    for i, line in enumerate(lines):
        names = [m.group(1) for m in (re.search(r, line) for r in fixed.DEFINITIONS.get(ext, fixed.DEFAULT_DEFINITIONS)) if m]
        if i >= head and names:
            found.append((i, names[0]))
    parts = ["\n".join(lines[:head]) + "\n\n"]
    if found:
        more = f", ... and {len(found) - 20} more" if len(found) > 20 else ""
        parts.append(f"// File contains these {len(found)} definitions:\n// - " + ", ".join(n for _, n in found[:20]) + more + "\n\n")
        if len(found) > 3:
            for i, name in (found[0], found[len(found) // 2], found[-1]):
                parts.append(f"// Sample definition: {name}\n" + "\n".join(lines[i:i + 5]) + "\n\n")
    else:
        parts.append(f"// ... {len(lines) - head - 5} lines not shown ...\n\n")
    return "".join(parts) + "\n".join(lines[-5:])


LINES = [
    "import a", "const x = require('y')", "export const a = 1", "const t: T = 1", "def f(x):", "class A", "  def g(y):",
    "func main() {", "type T struct {", "public int run() {", "private class B {", "module M", "fn go()", "enum E", "@deco",
    "export async function h() {}", "", "  pass", "trait X", "protocol P", "export type Q = 1", "internal enum Z",
]


@pytest.mark.parametrize("seed", range(4))
def test_summary_against_a_model(column, seed):
    rng = random.Random(seed)
    rows = []
    for ext in [*fixed.DEFINITIONS, ".jsx", ".tsx", ".c", ""]:
        for n in (20, 21, 26, 40, 90):
            rows.append({"ext": ext, "t": "\n".join(rng.choice(LINES) for _ in range(n))})
    got = column(rows, summary.summarize_code("t", F.col("ext")))
    assert got == [model_summary(r["t"], r["ext"]) for r in rows]


def test_summary_edges(column):
    assert column([{"t": ""}], summary.summarize_code("t", F.lit(".py"))) == ["// Empty file"]
    text = "\n".join("x" for _ in range(21))
    assert "// ... 6 lines not shown ..." in column([{"t": text}], summary.summarize_code("t", F.lit(".py")))[0]


def test_render_placeholder_and_blocks(column):
    rows = [{"path": "a/x.lock", "content": "x"}, {"path": "a/x.txt", "content": "x\n"}]
    assert column(rows, render.rendered()) == [fixed.RENDER_SKIP_TEXT, "x\n"]
    assert column(rows, render.file_block())[1] == "# x.txt (2 B)\n\n```\nx\n```\n\n"
