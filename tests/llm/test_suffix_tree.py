import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from repoweave.llm import suffix_tree as S
from repoweave.llm.common import lower_ascii, words_of


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def brute(rows, depth):
    """Counts, tree and scores in plain Python over all contexts."""
    docs = [(r["doc_id"], tokens_of(r["text"])) for r in rows]
    unigrams = Counter(t for d, ts in docs if not held(d) for t in ts)
    n, v = sum(unigrams.values()), len(unigrams)
    root = lambda t: (unigrams[t] + 0.1) / (n + 0.1 * (v + 1))
    alphabet = {t for t, c in unigrams.items() if c >= max(2.0, S.ENTRY * n)}
    least, entry = max(20.0, S.LEAST * n), max(2.0, S.ENTRY * n)
    tree, share = {}, {}

    def suffix(c):
        c = c[1:]
        while c and c not in tree:
            c = c[1:]
        return c

    def p(c, t):
        if not c:
            return root(t)
        own, total, left = tree[c]
        return max(0.0, own.get(t, 0) - S.DISCOUNT) / total + left * p(suffix(c), t)

    for length in range(1, depth + 1):
        grams = defaultdict(Counter)
        for d, ts in docs:
            if not held(d):
                for i in range(length, len(ts)):
                    c = tuple(ts[i - length : i])
                    if all(x in alphabet for x in c):
                        grams[c][ts[i]] += 1
        fresh = {}
        for c, counts in grams.items():
            total = sum(counts.values())
            own = {t: k for t, k in counts.items() if k >= entry and t in alphabet}
            if total < least or not own:
                continue
            below, gain, rest, left = suffix(c), 0.0, total, 1.0
            for t, k in own.items():
                q = p(below, t)
                gain, rest, left = gain + k * math.log(k / total / q), rest - k, left - q
            if rest > 0 and left > 0:
                gain += rest * math.log(rest / total / left)
            if gain - 0.5 * len(own) * math.log(total) >= S.DIVERGENCE:
                fresh[c] = (own, total, 1 - sum(k - S.DISCOUNT for k in own.values()) / total)
        tree |= fresh
    out = {}
    for d, ts in docs:
        score = 0.0
        for i, t in enumerate(ts):
            state = tuple(ts[max(0, i - depth) : i])
            while state and state not in tree:
                state = state[1:]
            score += math.log10(p(state, t))
        out.setdefault(d, []).append(
            (held(d), len(ts), sum(t in unigrams for t in ts), n, sum(math.log10(root(t)) for t in ts), score)
        )
    return out, tree


@pytest.mark.parametrize("depth", [1, 2])
def test_scores(corpora, depth):
    for df, rows in corpora:
        want, tree = brute(rows, depth)
        got = defaultdict(list)
        for r in S.score_documents(df, depth).collect():
            got[r["doc_id"]].append(tuple(r)[1:])
        assert set(got) == set(want)
        for doc in want:
            for a, b in zip(sorted(got[doc]), sorted(want[doc]), strict=True):
                assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert tree  # the last table has contexts that are retained


def test_distributions_add_up():
    tree = S.SuffixTree([0.4, 0.3, 0.2, 0.1])
    tree.retain((1,), {1: 30, 2: 5}, 50)
    tree.retain((2, 1), {3: 10}, 12)
    for context in ((), (1,), (2, 1)):
        assert sum(tree.probability(context, t) for t in range(4)) == pytest.approx(1)


def test_held_out_documents_are_likelier_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_docs = S.score_documents(docs).where("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert held_docs["a"] > held_docs["b"]


def test_no_rows(empty):
    assert S.score_documents(empty).collect() == []


def test_the_tree_grows_with_the_corpus_and_needs_no_frequent_words(spark, monkeypatch):
    """A context of a few dozen occurrences counts in any corpus, also where every weight comes by the join."""
    filler = [(i, " ".join(f"w{(i * 31 + j * j) % 4999}" for j in range(2000))) for i in range(200)]
    rare = [(1000 + i, "quartz lantern drifts over") for i in range(60)]
    docs = spark.createDataFrame(filler + rare, "doc_id long, text string").repartition(4)
    want, tree = brute([r.asDict() for r in docs.collect()], S.DEPTH)
    assert ("quartz",) in tree and S.DEPTH >= 3 and S.LEAST == S.ENTRY == 0
    for share in (S.FREQUENT, 1.0):
        monkeypatch.setattr(S, "FREQUENT", share)
        got = {r["doc_id"]: r["score"] for r in S.score_documents(docs).collect()}
        assert got == pytest.approx({d: v[0][-1] for d, v in want.items()}, rel=1e-9)


def test_tokens_have_hashes_of_their_own():
    texts = ["", " ", "A a\x0ba\x00 \x00a \x00", "é 你好 É", *("x" * n + " " + "x" * n + "y" for n in (7, 8, 9, 63, 64, 65, 70_000))]
    texts = [t.encode() for t in texts]
    hashes, sizes = S._tokens(texts)
    words = [[*words_of(lower_ascii(t)), b""] for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    pairs = set(zip((w for ws in words for w in ws), hashes.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_what_a_task_sends_of_a_block_is_arrays_and_few_bytes():
    """One row per bucket and length, not one per sequence of a document; most of a sequence is its hash."""
    docs = [(i, i, " ".join(f"w{(i * 31 + j * j) % 4999}" for j in range(2000))) for i in range(200)]
    schema = S.arrow_schema("row long, doc_id long, text string")
    batch = S.pa.RecordBatch.from_arrays([S.pa.array(c, f.type) for c, f in zip(zip(*docs), schema)], schema=schema)

    class Sent:
        def __init__(self, value):
            self.value = value

    none = Sent((np.zeros(0, np.uint64), *[np.zeros(0)] * 3))
    bits = Sent(np.full(1 << (S.SIEVE - 6), -1, np.int64).view(np.uint64))
    sent = list(S._score_texts(iter([batch]), none, bits, -1.0, 3, S.BUCKETS, S.arrow_schema(S._MET)))
    rows = [r for b in sent for r in b.to_pylist()]
    assert len(rows) <= 4 * S.BUCKETS + 1
    queries = [r for r in rows if r["doc_ids"] is None]
    keys = sum(len(S._whole(r["keys"])) for r in queries)
    assert keys > 10_000
    packed = sum(len(r[c]) for r in queries for c in ("lens", "at"))
    assert packed < 2 * 4 * 200 * 2000


def test_tables_without_readers_are_deleted(spark, tmp_path, monkeypatch):
    from repoweave.llm import common

    monkeypatch.setattr(common, "checkpoint_folder", lambda _: str(tmp_path))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, "quartz lantern drifts over") for i in range(60)], "doc_id long, text string")
    assert S.score_documents(docs).count() == 60
    left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert "words" in left and "changes" in left and "counted" not in left
    assert spark.conf.get(name) == before
