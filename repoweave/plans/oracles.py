"""The same queries in plain SQL for DuckDB, written without regard to skew or scale.

Each text is self-contained: the shared parts are common table expressions that
are put in front of it.  Only the fixed values are shared with the library.
"""

from __future__ import annotations

from repoweave.functions import fixed
from repoweave.functions.text import LINE_START, REST_OF_LINE, unicode_space
from repoweave.plans import queries as Q
from repoweave.sources.sample import AS_OF, TEMPLATES

NL = "chr(10)"


# ------------------------------------------------------------------- SQL text ----
def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def regex(value: str) -> str:
    return text(unicode_space(value))


def in_list(expr: str, values) -> str:
    return f"{expr} IN (" + ", ".join(text(v) for v in dict.fromkeys(values)) + ")"


def any_contains(expr: str, parts) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(p)})" for p in parts) + ")"


def any_ends(expr: str, parts) -> str:
    return "(" + " OR ".join(f"ends_with({expr}, {text(p)})" for p in parts) + ")"


def any_starts(expr: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({expr}, {text(p)})" for p in parts) + ")"


def points(condition: str, value: int) -> str:
    return f"CAST(CASE WHEN {condition} THEN {value} ELSE 0 END AS BIGINT)"


def quarter(expr: str) -> str:
    return f"CAST(ceil(({expr}) / 4.0) AS BIGINT)"


def human(expr: str) -> str:
    out = f"CAST({expr} AS VARCHAR) || ' B'"
    units = ["B", "kB", "MB", "GB", "TB", "PB"]
    for power in range(1, len(units)):
        h = f"CAST(floor(CAST({expr} AS DOUBLE) / 1e{3 * power} * 100 + 0.5) AS BIGINT)"
        shown = (
            f"rtrim(rtrim(CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0'), '0'), '.')"
            f" || ' {units[power]}'"
        )
        if power + 1 < len(units):
            shown = f"CASE WHEN {h} = 100000 THEN '1 {units[power + 1]}' ELSE {shown} END"
        out = f"CASE WHEN {expr} >= 1e{3 * power} THEN {shown} ELSE {out} END"
    return out


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    """``body`` behind the parts it builds on."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body


# ------------------------------------------------------------- shared relations ----
FILES = (
    "tmpl(k, path_t, snippet) AS (VALUES\n "
    + ",\n ".join(f"({k}, {text(p)}, {text(s)})" for k, (p, s) in enumerate(TEMPLATES))
    + f"""),
files AS MATERIALIZED (
  SELECT d.source AS repo_id, replace(t.path_t, '{{i}}', CAST(d.doc_id AS VARCHAR)) AS path,
         CAST(strlen(concat(replace(t.snippet, '~', {NL}), {NL}, d.text)) AS BIGINT) AS size,
         TIMESTAMP '2024-01-01 00:00:00' + (d.doc_id % 60) * INTERVAL '1' DAY AS mtime,
         concat(replace(t.snippet, '~', {NL}), {NL}, d.text) AS content
  FROM documents d JOIN tmpl t ON d.doc_id % {len(TEMPLATES)} = t.k)"""
)
PARTS = f"""parts AS (
  SELECT *, string_split(path, '/')[-1] AS base,
         CASE WHEN contains(path, '/') THEN left(path, length(path) - length(string_split(path, '/')[-1]) - 1) ELSE '.' END AS dir,
         CASE WHEN contains(substr(string_split(path, '/')[-1], 2), '.')
              THEN '.' || string_split(string_split(path, '/')[-1], '.')[-1] ELSE '' END AS ext
  FROM files),
p AS MATERIALIZED (
  SELECT *, lower(ext) AS lext, CAST(length(content) AS BIGINT) AS chars,
         substr(content, 1, 500) AS sample,
         list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) AS dirs
  FROM parts)"""
BASE = (FILES, PARTS)
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def simple(columns: str, where: str = "TRUE") -> str:
    return sql(f"SELECT repo_id, path, {columns} FROM p WHERE {where}", *BASE)


def kept(where: str) -> str:
    return sql(f"SELECT repo_id, path FROM p WHERE {where}", *BASE)


# -------------------------------------------------------------------- predicates ----
IGNORED_DIR = (
    "(len(list_intersect(dirs, [" + ", ".join(text(d) for d in fixed.IGNORE_DIR_NAMES) + "])) > 0"
    f" OR {in_list('base', fixed.IGNORE_BASE_NAMES)})"
)
EXCLUDED_EXACT = in_list("base", [x for x in fixed.EXCLUDE_FILES if "*" not in x])
# The wildcard excludes: a fixed ending, or ".generated." inside; never a hidden name.
_ENDINGS = [x[1:] for x in fixed.EXCLUDE_FILES if x.startswith("*") and not x.endswith("*")]
EXCLUDED_GLOB = (
    f"(NOT starts_with(base, '.') AND ({any_ends('base', _ENDINGS)} OR contains(base, '.generated.')))"
)
INCLUDE_NAME = in_list("base", fixed.INCLUDE_NAMES)
SPECIAL = any_contains("base", fixed.NO_EXTENSION_NAMES)
HIGH = in_list("base", fixed.HIGH_PRIORITY_NAMES)
ENTRY = (
    "(" + in_list("path", fixed.ENTRY_POINTS + ["cmd/main.go"])
    + " OR (dir = 'src' AND " + any_starts("base", ["index.", "main.", "app."]) + ")"
    + " OR (len(dirs) = 2 AND dirs[1] = 'cmd' AND NOT starts_with(dirs[2], '.') AND base = 'main.go'))"
)
FOLDER = any_starts("path", fixed.IMPORTANT_FOLDERS)
EXT_OK = in_list("ext", fixed.INCLUDE_EXTENSIONS)
BINARY = in_list("lext", fixed.BINARY_EXTENSIONS)
SKIPPED = in_list("lext", fixed.RENDER_SKIP_EXTENSIONS + fixed.BINARY_EXTENSIONS)
CODE_NAME = (
    f"({any_contains('base', fixed.CODE_NAME_PARTS)} OR {any_ends('base', fixed.CODE_NAME_SUFFIXES)}"
    f" OR {in_list('base', fixed.CODE_NAMES)})"
)
CODE_CONTENT = "(" + " OR ".join(
    [f"regexp_matches(sample, {regex(r)})" for r in fixed.CODE_ANYWHERE]
    + [f"regexp_matches(sample, {regex(LINE_START + chr(92) + 's*' + r)})" for r in fixed.CODE_LINE_STARTS]
) + ")"
PRINTABLE = (
    f"(length(lext) BETWEEN 2 AND 5 AND NOT {BINARY} AND length(sample) > 0"
    r" AND len(list_filter(string_split(sample, ''), lambda ch: unicode(ch) BETWEEN 32 AND 126)) > length(sample) * 0.9)"
)
CODE = f"({CODE_NAME} OR {CODE_CONTENT} OR {PRINTABLE})"
RECENT = f"mtime >= {AS_OF_SQL} - INTERVAL '30' DAY"
# The rules of the test repositories: private*/ is ignored, *.log is unless keep.log.
GITIGNORED = (
    "(len(list_filter(dirs, lambda d: starts_with(lower(d), 'private') OR (ends_with(lower(d), '.log') AND lower(d) <> 'keep.log'))) > 0"
    " OR (ends_with(lower(base), '.log') AND lower(base) <> 'keep.log'))"
)


def reason(ext_ok: str = EXT_OK, include: str = INCLUDE_NAME, recent: str = "TRUE") -> str:
    return f"""CASE WHEN {IGNORED_DIR} THEN 'ignored_directory'
      WHEN {EXCLUDED_EXACT} THEN 'excluded_name' WHEN {EXCLUDED_GLOB} THEN 'excluded_glob'
      WHEN {include} THEN CASE WHEN {recent} THEN 'include_name' ELSE 'stale' END
      WHEN {SPECIAL} THEN 'special_name' WHEN {HIGH} THEN 'high_priority'
      WHEN {ENTRY} THEN 'entry_point' WHEN {FOLDER} AND {ext_ok} THEN 'important_folder'
      WHEN {ext_ok} THEN CASE WHEN {GITIGNORED} THEN 'gitignored' WHEN {recent} THEN 'extension' ELSE 'stale' END
      WHEN NOT {BINARY} AND size <= 102400 AND {CODE} THEN 'content' ELSE 'no_rule' END"""


REJECTED = (
    "('ignored_directory', 'excluded_name', 'excluded_glob', 'stale', 'gitignored', 'no_rule')"
)


def labels(**how: str) -> str:
    return (
        f"labelled AS MATERIALIZED (SELECT *, {reason(**how)} AS reason FROM p),\n"
        f"labels AS MATERIALIZED (SELECT *, reason NOT IN {REJECTED} AS selected FROM labelled)"
    )


def eligible(max_file: int = fixed.MAX_FILE_BYTES) -> str:
    return f"elig AS MATERIALIZED (SELECT * FROM labels WHERE selected AND NOT {BINARY} AND size BETWEEN 1 AND {max_file})"


def size_budget(limit: int = fixed.SIZE_LIMIT_KB * fixed.KB) -> str:
    window = "OVER (PARTITION BY repo_id ORDER BY is_main DESC, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""b1 AS (SELECT *, {INCLUDE_NAME} AS is_main FROM elig),
b2 AS (SELECT *, CAST(coalesce(sum(chars) FILTER (WHERE is_main) {window}, 0) AS BIGINT) AS main_before,
              CAST(coalesce(sum(chars) FILTER (WHERE NOT is_main) {window}, 0) AS BIGINT) AS rest_before FROM b1),
b3 AS (SELECT repo_id, sum(chars) AS main_kept FROM b2 WHERE is_main AND main_before + size <= {limit} GROUP BY repo_id),
b4 AS (SELECT b2.*, CASE WHEN is_main THEN main_before ELSE CAST(coalesce(main_kept, 0) + rest_before AS BIGINT) END AS used_before
       FROM b2 LEFT JOIN b3 USING (repo_id)),
budgeted AS MATERIALIZED (SELECT * FROM b4 WHERE used_before + size <= {limit})"""


# ----------------------------------------------------------------------- scoring ----
def count_all(forms) -> str:
    return f"len(regexp_extract_all(content, {regex('|'.join(a.replace('(', chr(92) + '(') + b for a, b in forms))}))"


def extension_points() -> str:
    whens = " ".join(f"WHEN {text(e)} THEN {n}" for e, n in fixed.EXTENSION_POINTS.items())
    return f"CAST(CASE lext {whens} ELSE 0 END AS BIGINT)"


_AGE = f"(epoch_us({AS_OF_SQL}) - epoch_us(mtime))"
_GENERATED = f"({any_contains('base', fixed.GENERATED_NAME_PARTS)} OR {any_contains('path', fixed.GENERATED_PATH_PARTS)})"
_TESTS = f"({any_contains('base', fixed.TEST_NAME_PARTS)} OR {any_contains('path', fixed.TEST_PATH_PARTS)})"
_MANIFEST = any_contains("content", fixed.MANIFEST_MARKERS)
INFRA_POINTS = f"""CAST(CASE WHEN lext IN ('.tf', '.tfvars', '.hcl') THEN 100
  WHEN lext IN ('.yaml', '.yml') THEN CASE WHEN {_MANIFEST} THEN 80 ELSE 0 END
  WHEN base = 'Dockerfile' OR contains(base, 'docker-compose') THEN 70
  WHEN lext IN ('.tpl', '.tmpl', '.j2') THEN 60 ELSE 0 END AS BIGINT)"""
TERMS = {
    "docs_points": points(in_list("lower(base)", fixed.DOC_NAMES), 200),
    "config_points": points(HIGH, 150),
    "entry_points": points(ENTRY, 100),
    "folder_points": points(FOLDER, 50),
    "extension_points": extension_points(),
    "size_points": "CAST(greatest(0, 50 - size // 1000) AS BIGINT) + "
    + " + ".join([points("size > 102400", -50), points("size < 100", -20), points("size > 500 AND size < 10240", 20)]),
    "import_points": f"CAST(least(20, 2 * {count_all(fixed.IMPORT_FORMS)}) AS BIGINT)",
    "definition_points": f"CAST(least(20, {count_all(fixed.DEFINITION_FORMS)}) AS BIGINT)",
    "architecture_points": points(any_contains("content", fixed.ARCHITECTURE_MARKERS), 15),
    "recency_points": f"CAST(CASE WHEN {_AGE} < 1209600000000 THEN greatest(0, 30 - floor({_AGE} * 2 / 86400000000.0)) ELSE 0 END AS BIGINT)",
    "infra_points": INFRA_POINTS,
    "generated_points": points(_GENERATED, -80),
    "minified_points": points(any_contains("base", fixed.MINIFIED_NAME_PARTS), -100),
    "test_points": points(_TESTS, -40),
}


def scored(source: str = "p", infra: bool = False) -> str:
    names = [t for t in TERMS if infra or t != "infra_points"]
    total = " + ".join(f"({TERMS[t]})" for t in names)
    return f"scored AS MATERIALIZED (SELECT *, CAST({total} AS BIGINT) AS score FROM {source})"


def token_walk(source: str, limit: int) -> str:
    """The sequential walk, one recursion step per rank; needs WITH RECURSIVE."""
    return f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) AS rn FROM {source}),
walk AS (
  SELECT repo_id, path, score, size, rn, size AS cost, size AS used FROM ranked WHERE rn = 1
  UNION ALL
  SELECT n.repo_id, n.path, n.score, n.size, n.rn, n.cost, n.used_before + coalesce(n.cost, 0) AS used FROM (
    SELECT r.repo_id, r.path, r.score, r.size, r.rn, w.used AS used_before,
           CASE WHEN r.rn <= 10 OR w.used + r.size <= {limit} THEN r.size
                WHEN w.used + least(r.size, 1500) <= {limit} THEN least(r.size, 1500) END AS cost
    FROM walk w JOIN ranked r ON r.repo_id = w.repo_id AND r.rn = w.rn + 1) n),
picked AS (SELECT repo_id, path, score, size, cost, cost < size AS summarized, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY rn) AS BIGINT) AS rank FROM walk WHERE cost IS NOT NULL)"""


# ---------------------------------------------------------------- text functions ----
def rebuilt(gaps: str, piece: str) -> str:
    """Gaps of a split with ``piece`` (over the index i) between them."""
    return f"array_to_string(list_transform({gaps}, lambda g, i: g || coalesce({piece}, '')), '')"


def protect(source: str, target: str, column: str, block: str, keep: list[str], drop: bool) -> str:
    other = "''" if drop else "blocks[i]"
    shown = f"CASE WHEN i <= len(blocks) THEN CASE WHEN {any_contains('blocks[i]', keep)} THEN '__BLOCK_' || i || '__' ELSE {other} END END"
    return f"""{target}_a AS (SELECT *, regexp_extract_all({column}, {text(block)}) AS blocks, string_split_regex({column}, {text(block)}) AS gaps FROM {source}),
{target} AS (SELECT * EXCLUDE (gaps), {rebuilt('gaps', shown)} AS marked FROM {target}_a)"""




def restored(stripped: str) -> str:
    """The kept blocks put back; the fold carries text and index in one struct."""
    pairs = "list_transform(blocks, lambda b, i: {'t': b, 'i': i})"
    step = "lambda a, b: {'t': replace(a.t, '__BLOCK_' || b.i || '__', b.t), 'i': b.i}"
    return f"list_reduce({pairs}, {step}, {{'t': {stripped}, 'i': CAST(0 AS BIGINT)}}).t"


LINE_COMMENT = "//" + REST_OF_LINE
STRIP_C = (
    protect("files_c", "c1", "content", fixed.DOC_BLOCK_REGEX, fixed.DOC_BLOCK_KEEP, True)
    + f""",
c2 AS (SELECT *, regexp_replace(marked, {text(fixed.BLOCK_COMMENT_REGEX)}, '', 'g') AS unblocked FROM c1),
c3 AS (SELECT *, regexp_extract_all(unblocked, {text(LINE_COMMENT)}) AS remarks, string_split_regex(unblocked, {text(LINE_COMMENT)}) AS gaps FROM c2),
c4 AS (SELECT *, {rebuilt('gaps', f"CASE WHEN i <= len(remarks) AND {any_contains('remarks[i]', fixed.LINE_COMMENT_KEEP)} THEN remarks[i] END")} AS bare FROM c3),
stripped_c AS MATERIALIZED (SELECT repo_id, path, {restored('bare')} AS text FROM c4)"""
)


def strip_hash(expr: str) -> str:
    return f"regexp_replace({expr}, {text('#' + REST_OF_LINE)}, '', 'g')"


STRIP_PY = (
    protect("files_py", "y1", "content", fixed.DOCSTRING_REGEX, fixed.DOCSTRING_KEEP, False)
    + f""",
y2 AS (SELECT *, {strip_hash('marked')} AS bare FROM y1),
stripped_py AS MATERIALIZED (SELECT repo_id, path, {restored('bare')} AS text FROM y2)"""
)


def collapse(expr: str) -> str:
    return f"regexp_replace({expr}, {regex(fixed.BLANK_RUN_REGEX)}, repeat({NL}, 3), 'g')"


def strip_markup(expr: str) -> str:
    return f"regexp_replace({expr}, {text(fixed.MARKUP_COMMENT_REGEX)}, '', 'g')"


def stripped(source: str = "p") -> str:
    """``stripped(repo_id, path, text)``: every file of ``source`` stripped by extension."""
    return f"""files_c AS (SELECT repo_id, path, content FROM {source} WHERE {in_list('lext', fixed.C_COMMENT_EXTENSIONS)}),
files_py AS (SELECT repo_id, path, content FROM {source} WHERE lext = '.py'),
{STRIP_C},
{STRIP_PY},
stripped AS MATERIALIZED (
  SELECT s.repo_id, s.path, {collapse(f'''CASE WHEN c.text IS NOT NULL THEN c.text WHEN y.text IS NOT NULL THEN y.text
     WHEN lext = '.rb' THEN {strip_hash('content')} WHEN {in_list('lext', fixed.MARKUP_EXTENSIONS)} THEN {strip_markup('content')} ELSE content END''')} AS text
  FROM {source} s LEFT JOIN stripped_c c USING (repo_id, path) LEFT JOIN stripped_py y USING (repo_id, path))"""


def first_name(regexes: list[str]) -> str:
    names = [f"nullif(regexp_extract(l, {regex(r)}, 1), '')" for r in regexes]
    return "coalesce(" + ", ".join(names) + ")"


def summaries(source: str = "p") -> str:
    """``summaries(repo_id, path, head, defs, summary)``, the header end in closed form.

    The scan of imports ends at the first line past the 16th that is no import
    and lies more than five lines after the last one.
    """
    cases = " ".join(f"WHEN {text(e)} THEN {first_name(r)}" for e, r in fixed.DEFINITIONS.items())
    last = "coalesce(list_max(list_filter(imports, lambda j: j < {0})), 0)"
    return f"""u1 AS (SELECT repo_id, path, lext, content, string_split(content, {NL}) AS lines FROM {source}),
u2 AS (SELECT *, CAST(len(lines) AS BIGINT) AS n,
   list_filter(range(0, least(len(lines), 30)), lambda i: contains(lines[i + 1], 'import ') OR contains(lines[i + 1], 'require(')) AS imports FROM u1),
u3 AS (SELECT *, coalesce(list_min(list_filter(range(16, least(n, 30)), lambda i: NOT list_contains(imports, i) AND {last.format('i')} < i - 5)), 30) AS stop FROM u2),
u4 AS (SELECT *, CASE WHEN {in_list('lext', fixed.IMPORT_HEADER_EXTENSIONS)} THEN least({last.format('stop')} + 3, 20) ELSE 10 END AS head FROM u3),
u5 AS (SELECT *, list_filter(list_transform(lines, lambda l, i: {{'at': i, 'name': CASE WHEN i > head THEN CASE lext {cases} ELSE {first_name(fixed.DEFAULT_DEFINITIONS)} END END}}), lambda d: d.name IS NOT NULL) AS defs FROM u4),
u6 AS (SELECT *, len(defs) AS k FROM u5),
summaries AS MATERIALIZED (SELECT repo_id, path, CAST(head AS BIGINT) AS head, defs, CASE WHEN content = '' THEN '// Empty file' WHEN n <= 20 THEN content ELSE
   array_to_string(list_slice(lines, 1, head), {NL}) || repeat({NL}, 2)
   || CASE WHEN k = 0 THEN '// ... ' || CAST(n - head - 5 AS VARCHAR) || ' lines not shown ...' || repeat({NL}, 2) ELSE
      '// File contains these ' || k || ' definitions:' || {NL} || '// - '
      || array_to_string(list_transform(list_slice(defs, 1, 20), lambda d: d.name), ', ')
      || CASE WHEN k > 20 THEN ', ... and ' || (k - 20) || ' more' ELSE '' END || repeat({NL}, 2)
      || CASE WHEN k > 3 THEN array_to_string(list_transform([1, k // 2 + 1, k], lambda q: '// Sample definition: ' || defs[q].name || {NL}
           || array_to_string(list_slice(lines, defs[q].at, defs[q].at + 4), {NL}) || repeat({NL}, 2)), '') ELSE '' END END
   || array_to_string(list_slice(lines, n - 4, n), {NL}) END AS summary FROM u6)"""


# -------------------------------------------------------------------- credentials ----
def cred(pattern: tuple) -> str:
    return text("(?i)" + unicode_space(pattern[1]))


def false_positive(v: str) -> str:
    return f"({in_list(v, fixed.FALSE_POSITIVE_WORDS)} OR (regexp_matches({v}, '^[A-Za-z]+\\z') AND length({v}) < 8))"


def cred_type(m: str) -> str:
    whens = " ".join(f"WHEN {any_contains(f'lower({m})', parts)} THEN {text(name)}" for parts, name in fixed.CREDENTIAL_TYPES)
    return f"CASE {whens} ELSE {text(fixed.OTHER_CREDENTIAL_TYPE)} END"


def redact_step(source: str, target: str, pattern: tuple) -> str:
    """One pattern over ``source(repo_id, path, content, found)``.

    A match is at the summed lengths of the gaps and matches before it.
    """
    name, _, group, suffix = pattern
    real = f"(NOT {false_positive('vs[i]')} AND vs[i] <> '[REDACTED]')"
    piece = (
        f"CASE WHEN i <= len(ms) THEN CASE WHEN {real} THEN left(ms[i], length(ms[i]) - length(vs[i]) - {suffix})"
        f" || '[REDACTED]' || right(ms[i], {suffix}) ELSE ms[i] END END"
    )
    before = (
        "array_to_string(list_transform(range(1, i + 1), lambda j: gaps[j] || CASE WHEN j < i THEN ms[j] ELSE '' END), '')"
    )
    found = f"""list_transform(list_filter(range(1, len(ms) + 1), lambda i: {real}), lambda i: {{
      'pattern': '{name}',
      'line': CAST(len(string_split({before}, {NL})) AS BIGINT),
      'column': CAST(length(string_split({before}, {NL})[-1]) + 1 AS BIGINT),
      'type': {cred_type('ms[i]')}, 'preview': left(vs[i], 3) || '...'}})"""
    return f"""{target}_m AS (SELECT *, regexp_extract_all(content, {cred(pattern)}) AS ms,
   regexp_extract_all(content, {cred(pattern)}, {group}) AS vs, string_split_regex(content, {cred(pattern)}) AS gaps FROM {source}),
{target} AS MATERIALIZED (SELECT repo_id, path, {rebuilt('gaps', piece)} AS content, list_concat(found, {found}) AS found FROM {target}_m)"""


NO_FINDINGS = "CAST([] AS STRUCT(pattern VARCHAR, line BIGINT, \"column\" BIGINT, \"type\" VARCHAR, preview VARCHAR)[])"


def redact_start(source: str) -> str:
    return f"r0 AS (SELECT repo_id, path, content, {NO_FINDINGS} AS found FROM {source})"


def env_step(source: str, target: str) -> str:
    env_file = f"(contains(path, '.env') OR {any_ends('path', fixed.ENV_FILE_SUFFIXES)})"
    value = (
        "CASE WHEN regexp_matches(l, '(?s)^[A-Za-z0-9_]+=[''\"].*[''\"]\\z') THEN regexp_extract(l, '(?s)^[A-Za-z0-9_]+=[''\"](.*)[''\"]\\z', 1)"
        " ELSE regexp_extract(l, '(?s)^[A-Za-z0-9_]+=(.*)\\z', 1) END"
    )
    ends = r"'[\n\r\x{2028}\x{2029}]'"
    before = "array_to_string(list_transform(range(1, h.x.i), lambda j: cells[j] || seps[j]), '')"
    name = "regexp_extract(l, '^([A-Za-z0-9_]+)=', 1)"
    hit = (
        f"({any_contains('lower(x.name)', fixed.ENV_SENSITIVE_PARTS)} AND x.value <> '' AND NOT {false_positive('x.value')}"
        " AND NOT contains(x.value, 'REDACTED'))"
    )
    return f"""{target}_c AS (SELECT *, string_split_regex(content, {ends}) AS cells, list_append(regexp_extract_all(content, {ends}), '') AS seps FROM {source}),
{target}_l AS (SELECT *, list_transform(cells, lambda l, i: {{'l': l, 'i': i, 'name': {name}, 'value': {value}}}) AS ls FROM {target}_c),
{target}_h AS (SELECT *, list_transform(ls, lambda x: {{'x': x, 'hit': {hit}}}) AS hs FROM {target}_l),
{target} AS MATERIALIZED (SELECT repo_id, path,
   CASE WHEN {env_file} THEN array_to_string(list_transform(hs, lambda h: CASE WHEN h.hit THEN h.x.name || '=[REDACTED]' ELSE h.x.l END || seps[h.x.i]), '') ELSE content END AS content,
   CASE WHEN {env_file} THEN list_concat(found, list_transform(list_filter(hs, lambda h: h.hit), lambda h: {{
      'pattern': 'env', 'line': CAST(len(string_split({before}, {NL})) AS BIGINT),
      'column': CAST(length(string_split({before}, {NL})[-1]) + length(h.x.name) + 1 AS BIGINT),
      'type': 'Environment Variable', 'preview': left(h.x.value, 3) || '...'}})) ELSE found END AS found FROM {target}_h)"""


def redacted(source: str = "files") -> str:
    """``redacted(repo_id, path, content, found)`` after all patterns and the environment pass."""
    steps = [redact_start(source)]
    for i, pattern in enumerate(fixed.CREDENTIAL_PATTERNS):
        steps.append(redact_step(f"r{i}", f"r{i + 1}", pattern))
    return ",\n".join(steps + [env_step(f"r{len(fixed.CREDENTIAL_PATTERNS)}", "redacted")])


FINDINGS = """findings AS (SELECT repo_id, path, CAST(s AS BIGINT) AS seq, f.* FROM (
  SELECT repo_id, path, s, found[s] AS f FROM (SELECT repo_id, path, found, unnest(range(1, len(found) + 1)) AS s FROM redacted)))"""
RAW_MATCHES = "raw AS (" + "\nUNION ALL\n".join(
    f"SELECT repo_id, path, '{p[0]}' AS pattern, n, ms[n] AS match, vs[n] AS value FROM ("
    f"SELECT repo_id, path, ms, vs, unnest(range(1, len(ms) + 1)) AS n FROM ("
    f"SELECT repo_id, path, regexp_extract_all(content, {cred(p)}) AS ms, regexp_extract_all(content, {cred(p)}, {p[2]}) AS vs FROM files))"
    for p in fixed.CREDENTIAL_PATTERNS
) + ")"


# ---------------------------------------------------------------------- documents ----
def packed(limit: int) -> tuple[str, ...]:
    """``final(repo_id, path, ..., rank, summarized)``: what goes into the documents."""
    return (
        *BASE, labels(), eligible(), size_budget(), scored("budgeted"), token_walk("scored", limit),
        """final AS MATERIALIZED (SELECT s.*, k.summarized, k.rank FROM scored s JOIN picked k USING (repo_id, path))""",
    )


FENCE = "'```' || chr(10)"


def fenced(body: str) -> str:
    return f"{FENCE} || {body} || CASE WHEN ends_with({body}, {NL}) THEN '' ELSE {NL} END || {FENCE} || {NL}"


def body(long: str, source: str) -> str:
    return f"CASE WHEN {SKIPPED} THEN {text(fixed.RENDER_SKIP_TEXT)} WHEN {long} THEN u.summary ELSE t.text END"


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    time = "strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime"
    out["scan_files"] = simple(f"size, {time}, chars")
    out["scan_stats"] = simple(f"size, {time}")
    out["read_text"] = simple("content, TRUE AS is_valid_utf8")
    out["read_text_invalid"] = simple(
        "CASE WHEN size % 7 = 0 THEN content || chr(65533) ELSE content END AS content, size % 7 <> 0 AS is_valid_utf8")
    out["ignore_rules"] = """SELECT repo_id, CAST(seq AS BIGINT) AS seq, pattern FROM (SELECT DISTINCT source AS repo_id FROM documents),
 (VALUES (1, 'private*/'), (2, '*.log'), (3, '!keep.log')) AS r(seq, pattern)"""
    out["path_parts"] = simple("base, dir, ext, lext AS lower_ext")
    out["token_estimate"] = simple(f"{quarter('size')} AS size_tokens, {quarter('chars')} AS char_tokens")
    out["human_size"] = simple(
        f"{human('size')} AS shown_size, {human('(size * 997)')} AS shown_large, {human('(size * 1234567)')} AS shown_huge")
    out["file_flags"] = simple(
        f"{BINARY} AS is_binary, size > {fixed.MAX_FILE_BYTES} AS is_large, {HIGH} AS is_config, "
        f"({FOLDER} OR {HIGH} OR {ENTRY}) AS is_priority, {ENTRY} AS is_entry, {quarter('size')} AS estimated_tokens")
    langs = " ".join(f"WHEN {text(e)} THEN {text(i)}" for e, i in fixed.LANGUAGE_IDS.items())
    out["language_id"] = simple(f"CASE lext {langs} ELSE '' END AS language")
    groups = " ".join(
        f"WHEN {in_list('lext', e)}" + (" OR regexp_matches(base, '(?i)conf|setting')" if n == "Configuration Files" else "")
        + f" THEN {text(n)}" for n, e in fixed.TYPE_GROUPS.items())
    group = f"CASE {groups} ELSE 'Other' END"
    out["type_group"] = simple(f"{group} AS type_group")

    out["filter_ignore_dirs"] = kept(
        f"NOT ({IGNORED_DIR} OR starts_with(path, 'notes/') OR len(list_filter(dirs, lambda d: starts_with(d, 'k8s'))) > 0)")
    out["filter_exclude_exact"] = kept(f"NOT {EXCLUDED_EXACT}")
    out["filter_exclude_glob"] = kept(f"NOT {EXCLUDED_GLOB}")
    out["filter_include_name"] = kept(INCLUDE_NAME)
    out["filter_special_substring"] = kept(SPECIAL)
    out["filter_high_priority"] = kept(HIGH)
    out["filter_entry_point"] = kept(ENTRY)
    out["filter_important_folder"] = kept(f"{FOLDER} AND {EXT_OK}")
    out["filter_extension"] = kept(EXT_OK)
    out["filter_fallback_sniff"] = kept(f"NOT {EXT_OK} AND NOT {BINARY} AND size <= 102400 AND {CODE}")
    out["filter_recent"] = kept(RECENT)
    out["filter_gitignore"] = kept(f"NOT {GITIGNORED}")
    out["filter_binary"] = kept(f"NOT {BINARY}")
    out["filter_size"] = kept("size BETWEEN 1 AND 4000")
    out["code_likeness"] = simple(
        f"{CODE_NAME} AS by_name, {CODE_CONTENT} AS by_content, {PRINTABLE} AS by_characters, {CODE} AS looks_like_code")
    out["sensitive_paths"] = kept("(" + " OR ".join(
        f"regexp_matches(path, {text('(?i)' + r)})" for r in fixed.SENSITIVE_PATH_REGEXES) + ")")
    out["render_skip"] = kept(SKIPPED)

    def selection(**how: str) -> str:
        return sql("SELECT repo_id, path, reason, selected FROM labels", *BASE, labels(**how))

    out["select_files"] = selection()
    out["select_files_infra"] = selection(ext_ok=in_list("ext", fixed.INFRA_MODE_EXTENSIONS))
    out["select_files_recent"] = selection(recent=RECENT)
    detected = f"""visible AS (SELECT * FROM p WHERE len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) = 0),
detected AS MATERIALIZED (SELECT repo_id,
  bool_or(v AND (ends_with(base, '.tf') OR ends_with(base, '.tfvars'))) AS is_terraform,
  bool_or(v AND ({in_list('base', fixed.KUBERNETES_NAMES)} OR ends_with(base, '.helmignore'))) AS is_kubernetes,
  bool_or(v AND {in_list('base', fixed.ANSIBLE_NAMES)}) AS is_ansible,
  bool_or(v AND {in_list('base', fixed.DOCKER_NAMES)}) AS is_docker,
  bool_or(v AND (ends_with(base, '.pkr.hcl') OR (ends_with(base, '.json') AND base NOT IN ('package.json', 'package-lock.json')
     AND contains(content, '"builders"') AND contains(content, '"provisioners"')))) AS is_packer,
  bool_or(path IN ('main.tf', 'providers.tf')) AS has_root_terraform
  FROM (SELECT *, (repo_id, path) IN (SELECT (repo_id, path) FROM visible) AS v FROM p) GROUP BY repo_id)"""
    out["detect_repo_type"] = sql(
        "SELECT *, is_terraform OR is_kubernetes OR is_ansible OR is_docker OR is_packer AS is_infrastructure FROM detected",
        *BASE, detected)
    added = """added AS MATERIALIZED (SELECT repo_id, unnest(['.py', '.md']
   || CASE WHEN is_terraform THEN ['.tf', '.tfvars', '.hcl'] ELSE [] END
   || CASE WHEN is_kubernetes THEN ['.yaml', '.yml'] ELSE [] END
   || CASE WHEN is_ansible THEN ['.yml'] ELSE [] END
   || CASE WHEN has_root_terraform THEN ['.tf', '.tfvars', '.tpl'] ELSE [] END) AS extension FROM detected)"""
    out["effective_extensions"] = sql("SELECT DISTINCT repo_id, extension FROM added", *BASE, detected, added)
    user = f"""p2 AS MATERIALIZED (SELECT p.*, (repo_id, ext) IN (SELECT (repo_id, extension) FROM added) AS user_ext,
   {in_list('base', ['LICENSE'] + fixed.NO_EXTENSION_NAMES)} OR (is_docker AND {in_list('base', fixed.DOCKER_ADDED_NAMES)}) AS user_name
   FROM p JOIN detected USING (repo_id))"""
    out["select_files_user_lists"] = sql(
        "SELECT repo_id, path, reason, selected FROM labels", *BASE, detected, added, user,
        labels(ext_ok="user_ext", include="user_name").replace("FROM p)", "FROM p2)"))
    out["exclude_anti_join"] = kept(f"NOT {EXCLUDED_EXACT}")
    out["gitignore_join"] = simple(f"{GITIGNORED} AS is_gitignored")
    digit = "CAST(unicode(right(repo_id, 1)) % 10 AS VARCHAR)"
    out["gitignore_varied"] = simple(f"""(
  len(list_filter(dirs, lambda d, i: length(d) > 1 AND left(right(d, 2), 1) = {digit} AND NOT (i = 2 AND dirs[1] = 'cmd'))) > 0
  OR (NOT regexp_matches(base, '^[m-zM-Z]') AND ends_with(base, '.ts') AND left(right(base, 5), 1) = {digit} AND dir <> 'cmd')
  OR (starts_with(path, 'src/') AND ends_with(base, '.java') AND left(right(base, 7), 1) = {digit})
  OR (regexp_matches(base, '^[k-nK-N]') AND ends_with(base, '.py') AND left(right(base, 5), 1) = {digit})) AS is_gitignored""")
    budget = (*BASE, labels(), eligible(), size_budget())
    out["survivor_content"] = sql("SELECT repo_id, path, content FROM budgeted", *budget)
    out["size_budget"] = sql("SELECT repo_id, path, size, chars, is_main, used_before FROM budgeted", *budget)

    totals = "CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes"
    tokens = f"CAST(sum({quarter('size')}) AS BIGINT) AS tokens"
    out["repo_totals"] = sql(
        f"SELECT *, {human('bytes')} AS shown_size, {quarter('bytes')} AS tokens FROM (SELECT repo_id, {totals} FROM p GROUP BY repo_id)", *BASE)
    out["by_directory"] = sql(f"SELECT repo_id, dir, {totals}, {tokens} FROM p GROUP BY ALL", *BASE)
    out["by_type"] = sql(f"SELECT repo_id, {group} AS type_group, {totals}, {tokens} FROM p GROUP BY ALL", *BASE)
    out["directory_levels"] = sql(
        """SELECT repo_id, dir, level, CAST(count(*) AS BIGINT) AS files FROM (
  SELECT repo_id, CAST(l AS BIGINT) AS level, array_to_string(list_slice(dirs, 1, l), '/') AS dir FROM p, range(1, 4) r(l) WHERE l <= len(dirs)) GROUP BY ALL""", *BASE)
    tree = (
        "tops AS (SELECT DISTINCT repo_id, dirs[1] AS top FROM p WHERE len(dirs) > 0 AND NOT starts_with(dirs[1], '.'))",
        "subs AS (SELECT *, row_number() OVER (PARTITION BY repo_id, top ORDER BY sub) AS pos FROM (SELECT DISTINCT repo_id, dirs[1] AS top, dirs[2] AS sub FROM p WHERE len(dirs) > 1 AND NOT starts_with(dirs[1], '.')))",
        """tree AS (SELECT repo_id, top, CAST(0 AS BIGINT) AS pos, '  |- ' || top || '/' AS line FROM tops
UNION ALL SELECT repo_id, top, pos, '  |   |- ' || sub || '/' FROM subs WHERE pos <= 5 AND NOT starts_with(sub, '.')
UNION ALL SELECT repo_id, top, 6, '  |   |- ... ' || (count(*) - 5) || ' more directories' FROM subs GROUP BY repo_id, top HAVING count(*) > 5)""")
    out["directory_tree"] = sql("SELECT * FROM tree", *BASE, *tree)
    out["directory_tree_deep"] = sql(
        """SELECT repo_id, array_to_string(list_transform(names, lambda n: n || chr(1)), '') AS key, len(names)::BIGINT AS level,
  '  ' || repeat('|   ', len(names) - 1) || '|- ' || names[-1] || '/' AS line, files, coalesce(n, 0)::BIGINT AS directories
FROM shown LEFT JOIN (SELECT repo_id AS r, above AS a, n FROM below) ON repo_id = r AND names = a
UNION ALL SELECT repo_id, array_to_string(list_transform(above, lambda n: n || chr(1)), '') || chr(1114111), len(above)::BIGINT + 1,
  '  ' || repeat('|   ', len(above)) || '|- ... ' || (n - 5) || ' more directories', CAST(NULL AS BIGINT), n - 5
FROM below WHERE n > 5 AND len(above) < 3 AND (len(above) = 0 OR (repo_id, above) IN (SELECT (repo_id, names) FROM shown))""", *BASE,
        f"""deep AS (SELECT repo_id, list_concat(['area' || size % 3, ['.p', 'p', 'p-', 'q', 'r', 's', 't', 'u'][size % 8 + 1]], dirs) AS d FROM p WHERE NOT {GITIGNORED})""",
        """seen AS (SELECT repo_id, coalesce(list_min([i FOR i IN range(1, len(d) + 1) IF starts_with(d[i], '.')]) - 1, len(d)) AS v, d FROM deep)""",
        """nodes AS (SELECT repo_id, d[1:l] AS names, d[1:l - 1] AS above, count(*) AS files FROM seen, range(1, 5) t(l) WHERE l <= v GROUP BY ALL)""",
        "below AS (SELECT repo_id, above, count(*) AS n FROM nodes GROUP BY ALL)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, above ORDER BY names[-1]) AS nth FROM nodes WHERE len(names) <= 3)",
        """shown AS (SELECT * FROM ranked WHERE nth <= 5
  AND (len(names) < 2 OR (repo_id, names[1:1]) IN (SELECT (repo_id, names) FROM ranked WHERE nth <= 5))
  AND (len(names) < 3 OR (repo_id, names[1:2]) IN (SELECT (repo_id, names) FROM ranked WHERE nth <= 5)))""")
    out["budget_warnings"] = sql(
        f"""SELECT repo_id, chars, {quarter('chars')} AS tokens, chars > 51200 AS over_size_limit, chars > 60000 AS over_token_limit
FROM (SELECT repo_id, CAST(sum(chars) AS BIGINT) AS chars FROM elig GROUP BY repo_id)""", *BASE, labels(), eligible())
    def skips_of(limit: int) -> str:
        return f"""skips AS (SELECT l.repo_id, CAST(count(*) AS BIGINT) AS selected,
   CAST(count(*) FILTER (WHERE {BINARY}) AS BIGINT) AS skipped_binary,
   CAST(count(*) FILTER (WHERE NOT {BINARY} AND size > {limit}) AS BIGINT) AS skipped_large,
   CAST(coalesce(sum(size) FILTER (WHERE NOT {BINARY} AND size > {limit}), 0) AS BIGINT) AS skipped_large_bytes,
   CAST(count(*) FILTER (WHERE NOT {BINARY} AND size = 0) AS BIGINT) AS skipped_empty,
   CAST(count(*) FILTER (WHERE k) AS BIGINT) AS included,
   CAST(coalesce(sum(size) FILTER (WHERE k), 0) AS BIGINT) AS included_bytes,
   CAST(coalesce(sum({quarter('chars')}) FILTER (WHERE k), 0) AS BIGINT) AS included_tokens,
   CAST(count(*) FILTER (WHERE NOT {BINARY} AND size BETWEEN 1 AND {limit} AND NOT e) AS BIGINT) AS over_cap,
   CAST(count(*) FILTER (WHERE e AND NOT k) AS BIGINT) AS over_budget
   FROM (SELECT *, (repo_id, path) IN (SELECT (repo_id, path) FROM budgeted) AS k,
     (repo_id, path) IN (SELECT (repo_id, path) FROM elig) AS e FROM labels WHERE selected) l GROUP BY l.repo_id)"""

    skips = (*BASE, labels(), eligible(4000), size_budget(), skips_of(4000))
    out["skip_counts"] = sql("SELECT * FROM skips", *skips)
    stats = (
        """SELECT repo_id, selected AS total_files, included AS included_files, included_bytes AS total_size,
 included_tokens AS total_tokens, skipped_binary AS skipped_binary_files, skipped_large AS skipped_large_files, CAST(0 AS BIGINT) AS skipped_encoding_issues FROM skips""")
    out["repo_stats"] = sql(stats, *skips)

    def ranked(columns: str, order: str, where: str = "TRUE", source: str = "p") -> str:
        return (f"SELECT * FROM (SELECT repo_id, path, {columns}, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {order}) AS BIGINT) AS rank"
                f" FROM {source}) WHERE {where}")

    out["rank_by_score"] = sql(ranked("score", "score DESC, path", source="scored"), *BASE, scored())
    out["critical_files"] = sql(ranked("score", "score DESC, path", "rank <= 10", "scored"), *BASE, scored())
    main = f"CASE WHEN {INCLUDE_NAME} THEN 0 ELSE 1 END, size, path"
    out["metadata_order"] = sql(ranked("size", main), *BASE)
    out["cap_files"] = sql(ranked("size", main, f"rank <= {Q.FILE_CAP}"), *BASE)
    priority = f"({HIGH} OR {ENTRY})"
    out["priority_cap"] = sql(
        ranked(f"{priority} AS is_priority", f"{priority} DESC, path", f"is_priority OR rank <= {Q.PRIORITY_CAP}"), *BASE)
    out["priority_union_rest"] = simple(f"{priority} AS is_priority")
    out["largest_files"] = sql(
        "SELECT repo_id, path, size, rank, greatest(n - 10, 0) AS more_files FROM (" + ranked("size", "size DESC, path")
        + ") JOIN (SELECT repo_id, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY repo_id) USING (repo_id) WHERE rank <= 10", *BASE)

    for name, terms in Q.SCORE_QUERIES.items():
        out[name] = simple(", ".join(f"CAST({TERMS[t]} AS BIGINT) AS {t}" for t in terms))
    out["score_files"] = sql(
        "SELECT repo_id, path, " + ", ".join(f"CAST({e} AS BIGINT) AS {t}" for t, e in TERMS.items()) + ", score FROM scored",
        *BASE, scored(infra=True))
    walk = (*BASE, scored(), token_walk("scored", Q.TOKENS.token_limit_chars))
    out["token_budget"] = sql("SELECT * FROM picked", *walk, recursive=True)
    out["summarized_picks"] = sql("SELECT repo_id, path FROM picked WHERE summarized", *walk, recursive=True)

    out["strip_comments_c"] = sql(
        "SELECT * FROM stripped_c", *BASE,
        f"files_c AS (SELECT repo_id, path, content FROM p WHERE {in_list('lext', fixed.C_COMMENT_EXTENSIONS)})", STRIP_C)
    out["strip_comments_py"] = sql(
        f"SELECT * FROM stripped_py UNION ALL SELECT repo_id, path, {strip_hash('content')} FROM p WHERE lext = '.rb'",
        *BASE, "files_py AS (SELECT repo_id, path, content FROM p WHERE lext = '.py')", STRIP_PY)
    out["collapse_blank_lines"] = simple(f"{collapse('content')} AS text")
    out["strip_comments"] = sql("SELECT repo_id, path, text FROM stripped", *BASE, stripped())
    out["strip_comments_html"] = f"SELECT page_id, {strip_markup('html')} AS text FROM pages"
    out["summarize_code"] = sql("SELECT repo_id, path, summary FROM summaries", *BASE, summaries())
    long = (*BASE, f"long AS (SELECT repo_id, path, lext, repeat(content || {NL}, 6) AS content FROM p)", summaries("long"))
    out["summarize_long_code"] = sql("SELECT repo_id, path, summary FROM summaries", *long)
    out["summary_header"] = sql("SELECT repo_id, path, head AS header_lines FROM summaries", *long)
    out["extract_definitions"] = sql(
        "SELECT repo_id, path, CAST(d.at AS BIGINT) AS line, d.name AS name FROM (SELECT repo_id, path, unnest(defs) AS d FROM summaries)",
        *long)
    rendered_from = "JOIN summaries u USING (repo_id, path) JOIN stripped t USING (repo_id, path)"
    out["render_content"] = sql(
        f"SELECT repo_id, path, {body('chars > 4000', 'p')} AS body FROM p {rendered_from}", *BASE, summaries(), stripped())
    block = body("chars > 512000", "p")
    out["file_block"] = sql(
        f"""SELECT repo_id, path, '# ' || base || ' (' || {human('chars')} || ')' || repeat({NL}, 2) || {fenced('body')} AS block
FROM (SELECT p.*, {block} AS body FROM p {rendered_from})""", *BASE, summaries(), stripped())

    red = (FILES, redacted())
    out["redact_credentials"] = sql("SELECT repo_id, path, content, len(found) > 0 AS found FROM redacted", *red)
    out["credential_findings"] = sql("SELECT * FROM findings", *red, FINDINGS)
    out["findings_by_file"] = sql(
        "SELECT repo_id, path, type, CAST(count(*) AS BIGINT) AS findings FROM findings GROUP BY ALL", *red, FINDINGS)
    out["findings_total"] = sql(
        "SELECT repo_id, CAST(sum(len(found)) AS BIGINT) AS findings, CAST(count(*) FILTER (WHERE len(found) > 0) AS BIGINT) AS files_with_findings FROM redacted GROUP BY repo_id",
        *red)
    out["findings_report"] = sql(
        "SELECT repo_id, path, seq, '  - ' || \"type\" || ' at line ' || line || ':' || \"column\" || ': ' || preview AS entry FROM findings",
        *red, FINDINGS)
    report = f"""SELECT repo_id, CAST(part AS BIGINT) AS part, path, CAST(seq AS BIGINT) AS seq, entry FROM (
  SELECT DISTINCT repo_id, 0 AS part, '' AS path, 0 AS seq, '{fixed.REPORT_TITLE}' || {NL} || '{fixed.REPORT_RULE}' AS entry FROM findings
  UNION ALL SELECT DISTINCT repo_id, 1, path, 0, {NL} || 'File: ' || path FROM findings
  UNION ALL SELECT repo_id, 1, path, seq, '  - ' || "type" || ' at line ' || line || ':' || "column" || ': ' || preview FROM findings
  UNION ALL SELECT repo_id, 2, '', 0, {NL} || '{fixed.REPORT_TOTAL}' || count(*) || {NL} || '{fixed.REPORT_RULE}' FROM findings GROUP BY repo_id)"""
    out["security_report"] = sql(report, *red, FINDINGS)
    out["redact_env_cr"] = sql(
        "SELECT * FROM findings", FILES, f"cr AS (SELECT repo_id, path, replace(content, {NL}, chr(13)) AS content FROM files)",
        redact_start("cr"), env_step("r0", "redacted"), FINDINGS)
    out["credential_type"] = sql(
        f"SELECT repo_id, path, pattern, CAST(n AS BIGINT) AS n, match, {cred_type('match')} AS type FROM raw", FILES, RAW_MATCHES)
    out["credential_false_positive"] = sql(
        f"SELECT repo_id, path, pattern, CAST(n AS BIGINT) AS n, value, {false_positive('value')} AS is_false_positive FROM raw",
        FILES, RAW_MATCHES)
    findings = "CAST(len(found) AS BIGINT) AS findings"
    out["redact_env"] = sql(
        f"SELECT repo_id, path, content, {findings} FROM redacted", FILES, redact_start("files"), env_step("r0", "redacted"))
    for pattern in fixed.CREDENTIAL_PATTERNS:
        out[f"redact_{pattern[0]}"] = sql(
            f"SELECT repo_id, path, content, {findings} FROM r1", FILES, redact_start("files"), redact_step("r0", "r1", pattern))

    pack = packed(fixed.TOKEN_LIMIT * fixed.CHARS_PER_TOKEN)
    entry = f"'- ' || base || ' (' || {human('size')} || ')'"
    out["list_files"] = sql(
        f"SELECT repo_id, dir, rank, base AS name, size, {entry} AS entry FROM final", *pack, recursive=True)
    out["dry_run_summary"] = sql(
        f"""SELECT repo_id, CAST(rn2 AS BIGINT) AS rank, path, size, {human('size')} AS shown_size, {quarter('chars')} AS tokens,
  greatest(total_files - 10, 0) AS more_files, total_files, total_chars, {quarter('total_chars')} AS total_tokens
FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) AS rn2,
  CAST(count(*) OVER (PARTITION BY repo_id) AS BIGINT) AS total_files, CAST(sum(chars) OVER (PARTITION BY repo_id) AS BIGINT) AS total_chars FROM final)
WHERE rn2 <= 10""", *pack, recursive=True)
    clean = """clean AS MATERIALIZED (SELECT f.repo_id, f.path, f.base, f.dir, f.lext, f.size, f.rank, f.summarized, r.content,
   CAST(length(r.content) AS BIGINT) AS chars FROM final f JOIN redacted r USING (repo_id, path))"""
    heading = f"CASE WHEN row_number() OVER (PARTITION BY repo_id, dir ORDER BY rank) > 1 THEN '' WHEN dir = '.' THEN '## Root Directory' || repeat({NL}, 2) ELSE '## Directory: ' || dir || '/' || repeat({NL}, 2) END"
    pieces = f"""bodies AS (SELECT clean.*, {body('chars > 512000 OR summarized', 'clean')} AS body FROM clean {rendered_from}),
pieces AS (SELECT repo_id, dir, rank, size, {heading} || '### ' || base || ' (' || {human('size')} || ')' || repeat({NL}, 2) || {fenced('body')} AS piece FROM bodies),
docs AS (SELECT repo_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, string_agg(piece, '' ORDER BY dir, rank) AS pieces FROM pieces GROUP BY repo_id)"""
    notice = text("> ⚠️ **Security Notice**: Sensitive information and credentials have been automatically redacted")
    start = f"""'# PROJECT CONTEXT' || repeat({NL}, 2) || 'This code was collected by the repoweave tool on 2024-03-01.' || {NL}
  || 'Total files: ' || files || ', Size: ' || {human('bytes')} || ', Est. tokens: ~' || {quarter('bytes')}"""
    metadata = f"""final AS MATERIALIZED (SELECT *, FALSE AS summarized, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY is_main DESC, size, path) AS BIGINT) AS rank FROM budgeted)"""
    out["pack_parts"] = sql(
        f"""SELECT repo_id, CAST(part AS BIGINT) AS part, key, CAST(pos AS BIGINT) AS pos, text FROM (
  SELECT repo_id, 0 AS part, '' AS key, 0 AS pos, {start} || {NL} AS text FROM docs
  UNION ALL SELECT repo_id, 1, '', -1, '## PROJECT STRUCTURE' || {NL} || {FENCE} || 'Project Directory Structure:' || {NL} || repo_id FROM docs
  UNION ALL SELECT repo_id, 1, '/' || top, pos, line FROM tree
  UNION ALL SELECT repo_id, 1, chr(1114111), 0, {FENCE} FROM docs
  UNION ALL SELECT repo_id, 2, '', 0, {notice} || repeat({NL}, 2) || '# PROJECT FILES' || {NL} FROM docs
  UNION ALL SELECT repo_id, 3, dir, rank, left(piece, length(piece) - 1) FROM pieces
  UNION ALL SELECT repo_id, 4, '', 0, '---' || {NL} || 'Generated with repoweave.' FROM docs)""",
        *BASE, labels(), eligible(), size_budget(), metadata, *tree,
        redacted("final"), clean, summaries("clean"), stripped("clean"), pieces)
    discovered = f"""discovered AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {priority} DESC, path) AS n,
   count(*) OVER (PARTITION BY repo_id) AS accepted FROM labels WHERE selected) WHERE accepted <= 20 OR {priority} OR n <= 20),
elig AS MATERIALIZED (SELECT * EXCLUDE (n, accepted) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {main}) AS m
   FROM discovered WHERE NOT {BINARY} AND size BETWEEN 1 AND {fixed.MAX_FILE_BYTES}) WHERE m <= 20)"""
    capped = (*BASE, labels(), discovered, size_budget(), skips_of(fixed.MAX_FILE_BYTES))
    out["skip_counts_capped"] = sql("SELECT * FROM skips", *capped)
    out["repo_stats_capped"] = sql(stats, *capped)
    out["list_files_capped"] = sql(
        "SELECT repo_id, path, size, rank FROM final", *BASE, labels(), discovered, size_budget(), metadata)
    document = (
        f"""SELECT repo_id, files, bytes, {start} || repeat({NL}, 2)
  || {notice} || repeat({NL}, 2) || '# PROJECT FILES' || repeat({NL}, 2) || pieces || '---' || {NL} || 'Generated with repoweave.' || {NL} AS document FROM docs""")
    after = (redacted("final"), clean, summaries("clean"), stripped("clean"), pieces)
    out["pack_document"] = sql(document, *pack, *after, recursive=True)
    out["strict_report"] = sql(report, *pack, redacted("final"), FINDINGS, recursive=True)
    out["pack_document_small_tokens"] = sql(document, *packed(Q.SMALL_TOKENS.token_limit_chars), *after, recursive=True)
    out["budget_warnings_kept"] = sql(
        f"""SELECT repo_id, chars, {quarter('chars')} AS tokens, chars > {Q.SMALL_TOKENS.limit_bytes} AS over_size_limit,
  chars > {Q.SMALL_TOKENS.token_limit_chars} AS over_token_limit
FROM (SELECT repo_id, CAST(sum(chars) AS BIGINT) AS chars FROM budgeted GROUP BY repo_id)""",
        *BASE, labels(), eligible(), size_budget())
    by_dir = f"""dirs_listed AS (SELECT repo_id, dir, count(*) AS n, sum(size) AS s,
  '### ' || dir || '/' || {NL} || string_agg({entry} || {NL}, '' ORDER BY rank) || {NL} AS block FROM final GROUP BY repo_id, dir),
docs AS (SELECT repo_id, CAST(sum(n) AS BIGINT) AS files, CAST(sum(s) AS BIGINT) AS bytes, string_agg(block, '' ORDER BY dir) AS blocks FROM dirs_listed GROUP BY repo_id)"""
    out["listing_document"] = sql(
        f"""SELECT repo_id, files, bytes, {start} || repeat({NL}, 2) || {notice} || repeat({NL}, 2) || '{fixed.LISTING_TITLE}' || repeat({NL}, 2)
  || blocks || '---' || {NL} || 'Generated with repoweave.' || {NL} AS document FROM docs""", *pack, by_dir, recursive=True)
    return out


