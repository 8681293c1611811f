"""Personal data by weak supervision: labelers vote on candidate spans, expectation maximisation
estimates how reliable each is, and a classifier trained on the votes decides.

Candidates are matches of patterns: base kinds (mail address, IP address, card, phone) whose valid
matches always stay, and looser kinds.  Three labelers vote yes, no or nothing on each: a shape test
of the value, a gazetteer (known names, codes and reserved values), and the words around it.  Equal
votes are counted in Spark; the counts (at most kinds x 27 rows) go to the driver, where expectation
maximisation fits the share of true spans per kind and each labeler's rates of right votes.  The
posteriors train a naive Bayes classifier over features of the span, again from counts in Spark.

All work on texts uses SQL functions.  Positions follow from the pieces between matches: gaps and
lengths are summed in order, so no list is searched again.  Texts stay in place; spans are shuffled.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoweave.llm.common import stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "loose_email", "loose_phone", "iban", "national_id", "person", "secret")

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Names that often begin a person's name after a title, and titles (fixed values).
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra|Don|Doña"
GIVEN_NAMES = (
    "Anna Antonio Carlos Charles Claire David Elena Elizabeth Emma Francisco Hans Hugo James Jan Jean John José Juan "
    "Julia Karl Klaus Laura Luis Manuel Maria Marie Mark Mary Max Michael Miguel Paul Peter Pierre Robert Sophie Susan "
    "Thomas William"
).split()
#: What must be in a text before a pattern is tried, and the pattern.  A repeated part that cannot
#: match otherwise is possessive and a start inside a run is refused, so long runs cost their length;
#: the place after the match before is no such start.
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "loose_email": (
        r"(?i)[\[(]at[\])]",
        r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z]{2,24}){1,4}",
    ),
    "loose_phone": (
        r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    ),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "person": (
        rf"(?:{TITLES})\.?\x20", rf"(?<![\p{{L}}])(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}{{1,30}}(?:\x20\p{{Lu}}\p{{Ll}}{{1,30}}){{0,2}}",
    ),
    "secret": (
        r"(?i)(?:pass|token|secret|api)",
        r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?[a-z0-9_/+.-]{8,}+[\"']?",
    ),
}
#: Words before a span that speak for it, and such that speak against it (fixed values).
CUES = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo",
    "ip": "address|server|host|client|from|adresse|servidor",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "loose_email": "mail|contact|write|reach|kontakt|courriel|correo",
    "loose_phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national_id": "ssn|social|security|id|number",
    "person": "name|dear|by|signed|from|contact",
    "secret": "login|user|key|credential|config",
}
AGAINST = r"(?:version|release|isbn|issn|doi|section|chapter|page|order|invoice|sku|v)[\x20.:#]*$"

_ROUNDS = 50
_BEFORE, _AFTER = 40, 20


def _matches(kind: str) -> Column:
    """Matches of a kind in order: the gap before each, its value, and the text around it."""
    need, pattern = PATTERNS[kind]
    has = F.contains(F.col("text"), F.lit(need)) if need == "@" else F.col("text").rlike(need)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pieces = F.split("text", pattern, -1)

    def one(value: Column, i: Column) -> Column:
        gap = F.get(pieces, i)
        return F.struct(
            F.lit(kind).alias("kind"), F.length(gap).cast("bigint").alias("gap"), value.alias("value"),
            F.right(gap, F.lit(_BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(_AFTER)).alias("after"),
        )

    return F.when(has, F.transform(found, one))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second one from the right is doubled."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda sum_, i: sum_ + F.when(i % 2 == 1, _digit(digits, i)).otherwise(
            _digit(digits, i) * 2 - F.when(_digit(digits, i) > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _digit(digits: Column, from_right: Column) -> Column:
    return F.substring(digits, F.length(digits) - from_right + 1, F.lit(1)).cast("int")


def _mod97(value: Column) -> Column:
    """The check of an account number: letters count from 10, the first four characters go last."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    return F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda rest, c: F.when(c == "", rest)
        .when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97)
        .otherwise((rest * 100 + F.ascii(c) - 55) % 97),
    ) == 1


def _valid(kind: Column, value: Column) -> Column:
    """The shape test; for base kinds it decides whether a match counts at all."""
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "iban", _mod97(value))
        .when(kind == "national_id", ~value.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "secret", value.rlike("[0-9]") & value.rlike("[A-Za-z]"))
        .otherwise(True)
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, 0).when(yes, 1).otherwise(-1)


def _votes(spans: DataFrame) -> DataFrame:
    """Votes of the labelers (1 yes, 0 no, -1 none) and the classifier's features."""
    kind, value, before = F.col("kind"), F.col("value"), F.lower(F.col("before"))
    digits = _digits(value)
    names = "|".join(GIVEN_NAMES)
    known = (
        (kind.isin("email", "loose_email") & value.rlike(r"(?i)[.\x20](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"))
        | (kind.isin("phone", "loose_phone") & digits.rlike("^(?:1?[2-9][0-9]{9}|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1-6]|9[0-8])"))
        | ((kind == "card") & digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"))
        | ((kind == "person") & value.rlike(rf"\x20(?:{names})(?:\x20|$)"))
        | ((kind == "secret") & value.rlike(r"(?i)password|passwd|token|secret"))
        | ((kind == "iban") & value.rlike("^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"))
    )
    reserved = (
        ((kind == "ip") & value.rlike(r"^(?:0|127|255)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
        | digits.rlike(r"^([0-9])\1{8,}$") | ((kind == "secret") & value.rlike("(?i)example|changeme|xxxx|your"))
    )
    cue = F.lit(False)
    for k in KINDS:
        cue = cue | ((kind == k) & before.rlike(CUES[k]))
    against = before.rlike(AGAINST)
    closed = F.col("after").rlike(r"^(?:[\x20\x09-\x0D.,;:!?)\"'\]]|$)") & F.col("before").rlike(r"(?:^|[\x20\x09-\x0D(\"'\[:=])$")
    return spans.select(
        "*",
        _vote(F.col("valid"), ~F.col("valid")).alias("shape"),
        _vote(known, reserved).alias("gazetteer"),
        _vote(cue, against).alias("context"),
        F.least(F.floor(F.length("value") / 6), F.lit(5)).cast("int").alias("f_size"),
        F.least(F.floor(F.length(digits) * 5 / F.greatest(F.length("value"), F.lit(1))), F.lit(4)).cast("int").alias("f_digits"),
        closed.cast("int").alias("f_closed"),
        _vote(cue, against).alias("f_cue"),
        F.col("valid").cast("int").alias("f_valid"),
    )


LABELERS = ("shape", "gazetteer", "context")
FEATURES = ("f_size", "f_digits", "f_closed", "f_cue", "f_valid")


def fit_votes(patterns: list[tuple]) -> tuple[dict[str, float], dict[str, tuple[float, float]], list[float]]:
    """Prior per kind, (yes if true, no if false) rates per labeler, posterior per pattern.

    ``patterns`` are (kind, votes, count).  Rates begin above one half, which fixes what true means,
    and counts of one right and one wrong vote keep them off 0 and 1.
    """
    prior = {k: 0.5 for k, _, _ in patterns}
    rates = {j: (0.8, 0.8) for j in range(len(LABELERS))}
    posterior = [0.5] * len(patterns)
    for _ in range(_ROUNDS):
        for i, (kind, votes, _) in enumerate(patterns):
            odds = log(prior[kind] / (1 - prior[kind]))
            for j, vote in enumerate(votes):
                yes, no = rates[j]
                if vote == 1:
                    odds += log(yes / (1 - no))
                elif vote == 0:
                    odds += log((1 - yes) / no)
            posterior[i] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        for kind in prior:
            own = [(p, n) for p, (k, _, n) in zip(posterior, patterns, strict=True) if k == kind]
            prior[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for j in rates:
            count = {(t, v): 1.0 for t in (0, 1) for v in (0, 1)}
            for p, (_, votes, n) in zip(posterior, patterns, strict=True):
                if votes[j] >= 0:
                    count[1, votes[j]] += p * n
                    count[0, votes[j]] += (1 - p) * n
            rates[j] = tuple(
                min(0.99, max(0.51, count[t, t] / (count[t, 0] + count[t, 1]))) for t in (1, 0)
            )
    return prior, {LABELERS[j]: r for j, r in rates.items()}, posterior


def _lookup(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, key), F.lit(0.0))


def classify(spans: DataFrame) -> Column:
    """Log odds that a span is personal data, by a classifier trained on the labelers' posteriors.

    ``spans`` is read twice for counts; both tables are bounded by kinds, votes and feature values.
    """
    groups = spans.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *LABELERS).collect()
    _, _, posterior = fit_votes([(g["kind"], tuple(g[x] for x in LABELERS), g["n"]) for g in groups])
    key = F.concat_ws("|", "kind", *LABELERS)
    true = _lookup({"|".join(map(str, g[:4])): p for g, p in zip(groups, posterior, strict=True)}, key)
    features = F.array(*[F.concat_ws("|", "kind", F.lit(f), F.col(f)) for f in FEATURES])
    rows = (
        spans.withColumn("true", true).select("kind", "true", F.explode(F.concat(F.array("kind"), features)).alias("feature"))
        .groupBy("kind", "feature").agg(F.sum("true").alias("yes"), F.sum(1 - F.col("true")).alias("no")).collect()
    )
    whole = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["feature"] == r["kind"]}
    weights = {k: log((yes + 1) / (no + 1)) for k, (yes, no) in whole.items()}
    for r in rows:
        if r["feature"] != r["kind"]:
            yes, no = whole[r["kind"]]
            weights[r["feature"]] = log((r["yes"] + 1) / (yes + 2)) - log((r["no"] + 1) / (no + 2))
    odds = _lookup(weights, F.col("kind"))
    for f in FEATURES:
        odds = odds + _lookup(weights, F.concat_ws("|", "kind", F.lit(f), F.col(f)))
    return odds


def span_text(spans: Column) -> Column:
    """kind:start:end of spans, by kind as listed and then start, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone and spans.

    ``spans`` is an array of (kind number, kind, start, end, value, base, odds) by kind as listed
    and start; positions are code points, the end exclusive.  ``base`` marks valid matches of the
    base kinds, which always stay; other spans are what the classifier accepts and what no base
    span and no earlier accepted candidate overlaps.  Null and empty texts have no spans; repeated
    rows are searched each for itself; columns other than doc_id and text are not looked at.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text
    )
    found = stored(
        rows.select("row", "doc_id", *[_matches(k).alias(f"m_{k}") for k in KINDS]), "private-matches"
    )
    none = F.array().cast("array<struct<kind:string,gap:bigint,value:string,before:string,after:string>>")
    listed = found.select("row", F.explode(F.array(*[F.coalesce(f"m_{k}", none) for k in KINDS])).alias("m"))
    one = listed.where(F.size("m") > 0).select("row", F.posexplode("m").alias("nth", "s")).select("row", "nth", "s.*")
    order = Window.partitionBy("row", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = (
        one.withColumn("end", end.cast("bigint")).withColumn("start", F.col("end") - F.length("value"))
        .withColumn("valid", _valid(F.col("kind"), F.col("value")))
        .withColumn("base", F.col("valid") & F.col("kind").isin(*BASE_KINDS)).withColumn("number", number)
    )
    spans = stored(_votes(spans), "private-spans")
    spans = spans.withColumn("odds", classify(spans))
    wanted = spans.where("base or (odds > 0 and valid)")
    # Ends of base spans that begin before, and the next base span's beginning, show an overlap.
    by_start = Window.partitionBy("row").orderBy("start", "number", "end")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    after = by_start.rowsBetween(1, Window.unboundedFollowing)
    clear = (
        (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start"))
        & (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    )
    kept = wanted.withColumn("clear", clear).where("base or clear")
    packed = F.sort_array(F.collect_list(F.struct("number", "start", "end", "kind", "value", "base", "odds")))
    per_row = kept.groupBy("row").agg(
        packed.alias("spans"), *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE_KINDS]
    )
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    empty = F.array().cast(kept.groupBy().agg(packed.alias("x")).schema["x"].dataType)
    return found.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *counts, F.coalesce("spans", empty).alias("spans")
    )
