import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from repoweave.llm import personal_data as P
from repoweave.llm.queries import op9_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x[-4:]) > 255 or int(x) > 255 for x in m[0].split(".") if len(x) < 4000):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


ODD = [
    "a.b@c.d@e.f _x@y.zz", "x@y.com_z@w.org", "@a.b c@d", "a@b-.c-.d..e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "5" * 5000, "1.2.3." * 3000, "a." * 4000 + "@b.c", "x@" + "a." * 4000 + "b",
    "+1 (555) 123-4567 +12345678 +123456789012345 +1234567890123456 ++1 23-", "é ß 日本 joe@mail.example.com +49 30 1234567 🙂 1.1.1.1",
    "378282246310005 6011111111111117 30569309025904", "tel +1 (555) 123-4567+1 (555) 765-4321", "joe@mail.com,ann@mail.com;1.1.1.1,2.2.2.2",
    "99999.1.1.1 9" + "0" * 30 + ".1.1.1 " + "0" * 30 + "9.1.1.1", "+" * 100 + "1" * 12, "1-2-3-4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def test_base_spans(spark, corpora):
    odd = [(10_000 + i, t, None, "s", 0, None, None, None, None) for i, t in enumerate(ODD)]
    frames = [*corpora, (spark.createDataFrame([r[:2] for r in odd], "doc_id long, text string"), [dict(doc_id=r[0], text=r[1]) for r in odd])]
    for df, rows in frames:
        want = Counter()
        for r in rows:
            found = brute(r["text"] or "")
            counts = [sum(f[0] == k for f in found) for k in P.BASE_KINDS]
            want[(r["doc_id"], *counts, ",".join(f"{k}:{a}:{b}" for k, a, b in found))] += 1
        got = P.find_personal_data(df)
        base = P.span_text(F.filter("spans", lambda s: s["base"])).alias("base")
        rows = got.select("doc_id", *[f"n_{k}" for k in P.BASE_KINDS], base).collect()
        assert Counter(map(tuple, rows)) == want


def test_spans_hold_their_values_and_do_not_overlap(spark):
    text = "contact: joe.doe (at) mail (dot) com, call (555) 123-4567, login token = \"0123456789abcdef0123\" Mr. Paul Jones"
    df = spark.createDataFrame([(i, f"{'x ' * i}{text} and 10.20.30.40 end") for i in range(30)], "doc_id long, text string")
    for r in P.find_personal_data(df).join(df, "doc_id").collect():
        assert {s["kind"] for s in r["spans"]} >= {"ip", "loose_phone", "secret"}
        at = 0
        for s in sorted(r["spans"], key=lambda s: s["start"]):
            assert r["text"][s["start"] : s["end"]] == s["value"] and s["start"] >= at
            at = s["end"]


def test_unreliable_votes_count_less():
    # The context labeler agrees with the shape in nine of ten cases, the gazetteer in half of them.
    patterns = [("a", (1, 1, 1), 450), ("a", (1, 0, 1), 450), ("a", (0, 1, 0), 450), ("a", (0, 0, 0), 450), ("a", (1, 1, 0), 50),
                ("a", (1, 0, 0), 50), ("a", (0, 1, 1), 50), ("a", (0, 0, 1), 50)]
    _, rates, posterior = P.fit_votes(patterns)
    assert min(rates["shape"]) > 0.85 and min(rates["context"]) > 0.85 and max(rates["gazetteer"]) < 0.6
    assert posterior[0] > 0.9 and posterior[2] < 0.1


def test_query_and_no_rows(spark, empty):
    r = op9_personal_data(spark, "/root/testdata/sf0.001").where("doc_id = 1").first()
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest() or r["spans"]
    assert P.find_personal_data(empty).collect() == []


def test_a_long_secret_is_in_its_span_to_the_end(spark):
    values = ["a1B2" * n for n in (64, 65, 200, 1500)] + ["eyJ0" * 900 + ".x_y-z/+" * 50]
    rows = [(i, f"login token = {v} and more") for i, v in enumerate(values)]
    got = P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert [s["value"] for s in r["spans"] if s["kind"] == "secret"] == [f"token = {values[r['doc_id']]}"]
