import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repoweave.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, periods=3):
    """All maximal stretches of every period, smallest period first; a stretch counts once."""
    place = {w: i for i, w in enumerate(words)}
    s, seen, out = np.array([place[w] for w in words], int), set(), []
    for q in range(1, len(s) // periods + 1):
        same = np.concatenate(([0], s[q:] == s[:-q], [0]))
        change = np.diff(same)
        for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            length = b - a + q
            if length >= 2 * q and (a, length) not in seen:
                seen.add((a, length))
                if length >= max(least, periods * q):
                    out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(words, doc_id):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.tuples(st.integers(1, 9), st.integers(1, 40)), max_size=4))
def test_runs_of_built_texts(words, repeats):
    for period, count in repeats:
        for _ in range(count):
            words.append(words[-period] if len(words) >= period else len(words) % 3)
    words = [b"%d" % w for w in words]
    for least, periods in ((24, 3), (4, 2), (1, 2), (7, 4)):
        assert periodic_runs.runs_of(periodic_runs.numbers_of(words), least, periods) == brute(words, least, periods)


def test_a_long_text_of_one_word_or_period_is_fast():
    import time

    began = time.process_time()
    for period in (1, 2, 7_000):
        words = [b"w%d" % (i % period) for i in range(60_000)]
        assert periodic_runs.runs_of(periodic_runs.numbers_of(words)) == [(0, 60_000, period)]
    assert time.process_time() - began < 20


def test_strongest_run_by_exact_ratio():
    assert periodic_runs.strongest([(0, 31, 10), (5, 62, 20), (1, 30, 9)]) == 2
    assert periodic_runs.strongest([(0, 31, 10), (5, 62, 20)]) == 0
    assert periodic_runs.strongest([]) is None


def digest(data):
    return hashlib.sha256(data.encode()).hexdigest()


def wanted(doc_id, text):
    words = planted(WORD.findall(text or ""), doc_id)
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        digest(lines), digest(" ".join(kept(words, runs))),
    )


def test_query_against_brute_force(corpora, tmp_path):
    for i, (df, rows) in enumerate(corpora):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        got = queries.op11_periodic_runs(df.sparkSession, f"{tmp_path}/{i}").collect()
        want = Counter(wanted(r["doc_id"], r["text"]) for r in rows)
        assert Counter(map(tuple, got)) == want
        assert any(w[1] for w in want)


def test_general_interface(spark, empty):
    text = "\t a b " * 15 + "tail " + "c " * 30
    df = spark.createDataFrame([(1, text), (2, None), (3, "a b " * 20)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(df).collect()}
    assert (got[1]["starts"], got[1]["lengths"], got[1]["periods"], got[1]["best"]) == ([0, 31], [30, 30], [2, 1], 1)
    assert [got[i]["collapsed"] for i in (1, 2, 3)] == ["a b tail c", "", "a b"]
    assert got[2]["starts"] == [] and got[2]["best"] is None
    assert periodic_runs.find_runs(empty).collect() == []


@pytest.mark.parametrize("length", [1, 2, 5, 16, 23])
def test_a_repeated_stretch_is_never_missed(length):
    rng = np.random.default_rng(length)
    for _ in range(300):
        ids = rng.integers(0, 3, size=rng.integers(0, 40))
        windows = [tuple(ids[i : i + length]) for i in range(len(ids) - length + 1)]
        assert periodic_runs.may_repeat(ids, length) == (len(set(windows)) < len(windows))
