import pytest

from repoweave.functions import redaction as R
from repoweave.operators import redact

HEX40, KEY20 = "0123456789abcdef0123456789abcdef01234567", "ABCDEFGHIJ0123456789"
JWT = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
PEM = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\nabc=\n"
# pattern -> (text, redacted value) hits, and near misses
HITS = {
    "p01": [('api_key = "abcdefgh12345678"', "abcdefgh12345678"), ("\"CLIENT-SECRET\": 'a.b-c_d.e-f_g.h-i'", "a.b-c_d.e-f_g.h-i")],
    "p02": [(f'aws_access_key_id="{KEY20}"', KEY20)],
    "p03": [(f"awsSecretAccessKey: '{HEX40}'", HEX40), (f'aws_secret_key="{HEX40}"', HEX40)],
    "p04": [("'mongodb+srv://me:p@ss.w0rd'", "p@ss.w0rd")],
    "p05": [("postgres://u:pw@host/db", "pw@host"), ("jdbc:mysql://u:pw1/", "pw1")],
    "p06": [('password: "Secr3t!!"', "Secr3t!!"), ("PWD='a,b;c:d1'", "a,b;c:d1")],
    "p07": [(PEM + "-----END RSA PRIVATE KEY-----", PEM)],
    "p08": [('bearer-token: "abcdefgh12345678"', "abcdefgh12345678")],
    "p09": [(f"jwt = '{JWT}'", JWT)],
    "p10": [('firebaseConfig = {\n a: 1, apiKey: "' + HEX40[:39] + '"', HEX40[:39])],
    "p11": [('my_SECRET_VALUE = "abc12345"', "abc12345"), ('monkey="12345678"', "12345678")],
    "p12": [("credential: 'abcdef123456'", "abcdef123456")],
}
MISSES = {
    "p01": ['api_key = "short1"', "api_key = abcdefgh12345678", 'apikey_x = "abcdefgh12345678"'],
    "p02": [f'aws_access_key_id="{KEY20}1"', f"aws_access_key_id={KEY20}"],
    "p03": [f'aws_secret_key="{HEX40}0"'], "p04": ["mongodb://me:pw"], "p05": ["postgres://host/db"],
    "p06": ['password: "short1!"', 'password: "with space 1"'], "p07": ["-----BEGIN PUBLIC KEY-----\nx\n-----END"],
    "p08": ['bearer: "abcdefgh12345678"'], "p09": ['jwt = "eyJabc.def"'],
    "p10": ['firebaseConfig = { apiKey: "short" }'], "p11": ['SECRET: "abc12345"', 'SECRET="abc1234"'],
    "p12": ['secret: "abcdef12345"'],
}
BY_NAME = {p.name: p for p in R.PATTERNS}


def run(spark, texts, operator, path="a.txt"):
    files = spark.createDataFrame([("r", path, i, t) for i, t in enumerate(texts)], "repo_id string, path string, i int, content string")
    return sorted(operator(files).collect(), key=lambda r: r.i)


@pytest.mark.parametrize("name", HITS)
def test_each_pattern(spark, name):
    hits, misses = HITS[name], MISSES[name]
    rows = run(spark, [t for t, _ in hits] + misses, lambda f: redact.redact_pattern(f, BY_NAME[name]))
    for row, (text, value) in zip(rows, hits):
        at = text.rindex(value)
        assert row.content == text[:at] + "[REDACTED]" + text[at + len(value):]
        assert [f.preview for f in row.findings] == [value[:3] + "..."]
    for row, text in zip(rows[len(hits):], misses):
        assert row.content == text and not row.findings and not row.found


def test_the_gate_lets_every_hit_through(spark):
    texts = [t for hits in HITS.values() for t, _ in hits]
    assert all(r.found for r in run(spark, texts, redact.redact))


def test_false_positives(column):
    values = ["true", "undefined", "Object", "Function", "abcdefg", "abcdefgh", "abc1", "RegExp", ""]
    assert column([{"v": v} for v in values], R.is_false_positive("v")) == [
        True, True, True, True, True, False, False, True, False]


def test_types(column):
    want = {
        "API_KEY=x": "API Key", "myPwd": "Password", "passwd": "Sensitive Data", "oauth_token": "Token",
        "aws_access_key_id": "Access Token", "aws_x": "AWS Key", "-----BEGIN PRIVATE KEY": "Private Key",
        "mongodb://": "MongoDB Credentials", "mysql://": "Database Credentials", "firebaseConfig": "Firebase Config",
        "client_secret": "Secret", "credential": "Sensitive Data",
    }
    assert column([{"m": m} for m in want], R.credential_type("m")) == list(want.values())


def test_positions_and_exemption(spark):
    text = 'é pwd="abcd1234" pwd="efgh5678"\n\n  password: "undefined" password: "Fak3Pass99"'
    row = run(spark, [text], redact.redact)[0]
    assert row.content == 'é pwd="[REDACTED]" pwd="[REDACTED]"\n\n  password: "undefined" password: "[REDACTED]"'
    assert [(f.line, f.column, f.type, f.preview) for f in row.findings] == [
        (1, 3, "Password", "abc..."), (1, 18, "Password", "efg..."), (3, 25, "Password", "Fak...")]


def test_only_false_positives_find_nothing(spark):
    row = run(spark, ['password: "undefined"'], redact.redact)[0]
    assert not row.found and row.content == 'password: "undefined"'


def test_redacting_twice_finds_nothing_new(spark):
    texts = [t for hits in HITS.values() for t, _ in hits] + ["\n".join(t for h in HITS.values() for t, _ in h)]
    once = run(spark, texts, redact.redact)
    twice = run(spark, [r.content for r in once], redact.redact)
    assert [r.content for r in twice] == [r.content for r in once]
    assert not any(r.found for r in twice)


def test_environment_files(spark):
    text = "\n".join([
        "API_KEY=abc123", "DB_LOGIN='svc_01'", 'X_TOKEN="a"b1"', "DEBUG=true1", "MY_SECRET=", 'OLD_SECRET=""',
        "AUTH=true", "# KEY=abc123", " KEY=abc123", "PASS=[REDACTED]", "Q_KEY=\"open1", "CR_KEY=v1\r", "A_PWD=x=y1"])
    row = run(spark, [text], redact.redact_env, "conf/.env.local")[0]
    assert row.content.split("\n") == [
        "API_KEY=[REDACTED]", "DB_LOGIN=[REDACTED]", "X_TOKEN=[REDACTED]", "DEBUG=true1", "MY_SECRET=", 'OLD_SECRET=""',
        "AUTH=true", "# KEY=abc123", " KEY=abc123", "PASS=[REDACTED]", "Q_KEY=[REDACTED]", "CR_KEY=[REDACTED]\r", "A_PWD=[REDACTED]"]
    assert [(f.line, f.column, f.preview) for f in row.findings] == [
        (1, 8, "abc..."), (2, 9, "svc..."), (3, 8, 'a"b...'), (11, 6, '"op...'), (12, 7, "v1..."), (13, 6, "x=y...")]
    assert run(spark, [text], redact.redact_env, "conf/env.txt")[0].content == text


def test_environment_lines_end_at_a_lone_carriage_return(spark):
    text = "DEBUG=1\rDB_LOGIN=svc_user_01\rX=2\nA_KEY='v1'\u2028B_KEY=v2\r\nC_KEY=v3\r"
    row = run(spark, [text], redact.redact_env, "conf/.env")[0]
    assert row.content == (
        "DEBUG=1\rDB_LOGIN=[REDACTED]\rX=2\nA_KEY=[REDACTED]\u2028B_KEY=[REDACTED]\r\nC_KEY=[REDACTED]\r")
    assert [(f.line, f.column, f.preview) for f in row.findings] == [
        (1, 17, "svc..."), (2, 6, "v1..."), (2, 17, "v2..."), (3, 6, "v3...")]


def test_texts_that_hold_the_mark(spark):
    row = run(spark, ['\ufdd2 x \ufdd2 pwd="abcd1234"\n\ufdd2pwd="efgh5678"'], redact.redact)[0]
    assert row.content == '\ufdd2 x \ufdd2 pwd="[REDACTED]"\n\ufdd2pwd="[REDACTED]"'
    assert [(f.line, f.column) for f in row.findings] == [(1, 7), (2, 2)]


def test_custom_patterns(spark):
    own = R.CredentialPattern("own", r"(id=)(\d{4})(;)", 2, 1)
    row = run(spark, ["id=1234; id=12;"], lambda f: redact.redact(f, [own]))[0]
    assert row.content == "id=[REDACTED]; id=12;" and row.findings[0].pattern == "own"


def test_whole_long_texts(spark):
    text = "x = 1\n" * 50_000 + 'pwd="abcd1234"\n' * 200
    row = run(spark, [text], redact.redact)[0]
    assert row.content.count("[REDACTED]") == 200 and row.findings[-1].line == 50_200
