import math
import re

from repoweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, duplicates = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 3000 else None
    if many is None:
        from collections import Counter

        many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": duplicates, "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def test_base_counts(corpora):
    for df, rows in corpora:
        want = sorted(str((r["doc_id"], *base(r["text"]).values())) for r in rows)
        got = [r.asDict() for r in quality.judge(df).collect()]
        assert sorted(str((g["doc_id"], *(g[k] for k in base("")))) for g in got) == want
        assert not any(g["kept"] and g["base_failed"] for g in got)


def test_bands(spark):
    import random

    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randint(0x21, 0x2FF)) for _ in range(40)) for _ in range(200))
    half = prose + " " + " ".join(f"row {i % 7} of a table {i % 5}" for i in range(900))
    rows = [(1, prose), (2, noise), (3, " ".join(f"copy {i % 9} {i % 4}" for i in range(2000))), (4, half)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: got[2], 3: False, 4: False}


def test_keep_good_gives_whole_rows(odd, empty):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    good = quality.judge(odd).where("kept").count()
    assert kept.count() == good
    assert quality.keep_good(empty).collect() == [] == quality.judge(empty).collect()


def test_limits_of_the_corpus_by_length_against_brute_force(spark):
    """Repetition and noise go, clean text stays; a large group of copies does not move the limits."""
    import random
    from collections import defaultdict

    import zstandard

    rng, texts = random.Random(4), []
    vocabulary = ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts += [prose(rng.choice([150, 400])) for _ in range(300)]
    copied = texts[0]
    texts += [copied] * 400
    for _ in range(12):
        line = prose(25)
        texts.append(" ".join(prose(20) + " " + line for _ in range(9)))
        texts.append(" ".join("".join(chr(rng.randint(0x21, 0x7E)) for _ in range(12)) for _ in range(200)))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pack = zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False)
    milli = {t: round(1000 * len(t) / len(pack.compress(t.encode()))) for t in texts}
    kind = lambda t: math.floor(quality.CLASSES * math.log2(len(t)))
    classes = defaultdict(list)
    for t in set(texts):
        if not base(t)["base_failed"] and all(lo <= milli[t] / 1000 <= hi for size, lo, hi in quality.BANDS[2:3]):
            classes[kind(t)].append(milli[t])
    for i, t in rows:
        values = sorted(classes[kind(t)])
        if len(t) > 4096 or len(values) < quality.LEAST_TEXTS:
            continue
        q1, q2, q3 = (values[math.ceil(share * len(values)) - 1] for share in (0.25, 0.5, 0.75))
        low = q2 - max(quality.BELOW * (q3 - q1), quality.BELOW_SHARE * q2)
        high = q2 + max(quality.ABOVE * (q3 - q1), quality.ABOVE_SHARE * q2)
        fixed = quality.BANDS[2][1] <= milli[t] / 1000 <= quality.BANDS[2][2]
        assert got[i] == (fixed and low <= milli[t] <= high and not base(t)["base_failed"]), (i, len(t), milli[t], low, high)
    assert sum(got[i] for i in range(700)) >= 690
    assert not any(got[i] for i in range(700, len(texts)))
