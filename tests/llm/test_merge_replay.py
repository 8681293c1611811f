import hashlib
import random
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from repoweave.llm import merge_replay, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache
def _library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merge_replay.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return _library()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_any_texts(texts):
    coder, known = merge_replay.encoder(PATH, PATTERN), _library()
    assert [x.tolist() for x in coder.encode([t.encode() for t in texts])] == [known.encode_ordinary(t) for t in texts]


def test_long_and_odd_texts(library):
    rng = random.Random(5)
    pool = "aaabbc  \n\t'stDll1234$%éü你好՘࢏ꟍ\x1c\x85 😀<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["x" * 60_000, "ab" * 9000, "aaa" * 3333, " " * 5001, "\n \n" * 900, "é" * 20_001, "'s'S'll" * 50]
    for kept in (0, 50, 10**6):  # what is remembered changes no result
        coder = merge_replay.Encoder(PATH, PATTERN, kept)
        for at in range(0, len(texts), 500):
            some = texts[at : at + 500]
            assert [x.tolist() for x in coder.encode([t.encode() for t in some])] == [library.encode_ordinary(t) for t in some]


def test_merges_that_overlap_and_ranks_out_of_order():
    # "abc" has a lower rank than "bc" but comes from "ab", which is no token here.
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"aa": 270, b"aaaa": 280, b"aab": 275}
    merges = merge_replay.Merges(ranks)
    names = {r: t for t, r in ranks.items()}
    cut = lambda w: [names[i] for i in merges.replay([w])[0]]
    assert cut(b"aaaaa") == [b"aaaa", b"a"]
    assert cut(b"aab") == [b"aab"]
    assert cut(b"abc") == [b"abc"]
    assert cut(b"aaabcbc") == [b"aa", b"abc", b"bc"]
    assert merges.replay([b"", b"a", b"bc", b""]) == [[], [97], [300], []]


def test_query_against_the_library(corpora, tmp_path, library):
    digest = lambda data: hashlib.sha256(data).hexdigest()
    for i, (df, rows) in enumerate(corpora):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        want = Counter()
        for r in rows:
            ids = library.encode_ordinary(r["text"] or "")
            want[(r["doc_id"], len(ids), digest(" ".join(map(str, ids)).encode()), digest((r["text"] or "").encode()))] += 1
        assert Counter(map(tuple, queries.op12_merge_replay(df.sparkSession, f"{tmp_path}/{i}").collect())) == want


def test_decode_and_no_rows(spark, empty):
    rows = spark.createDataFrame([(1, [15496, 11]), (2, None), (3, []), (None, [40])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in merge_replay.decode(rows, PATH).collect()}
    assert got == {1: b"Hello,", 2: b"", 3: b"", None: b"I"}
    assert merge_replay.encode(empty, PATH, PATTERN).collect() == []
    assert merge_replay.decode(rows.limit(0), PATH).collect() == []
