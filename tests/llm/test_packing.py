import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repoweave.llm import packing
from repoweave.llm.tokens import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_hold_every_id_once_and_fill_every_window(corpora):
    tokenizer = Tokenizer.from_file(PATH)
    for df, rows in corpora:
        want = Counter()
        for r in rows:
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
            want[(r["doc_id"], np.array(ids, "<u4").tobytes())] += 1
        got = [r.asDict() for r in packing.pack(df, PATH, 1, window=64, quantum=16).collect()]
        windows = defaultdict(list)
        for p in got:
            assert len(p["ids"]) == 4 * p["length"] > 0
            windows[p["sequence_id"]].append((p["offset"], p["length"]))
        total = sum(p["length"] for p in got)
        assert sorted(windows) == list(range(-(-total // 64)))
        for number, parts in windows.items():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == (64 if number < len(windows) - 1 else total - 64 * number)
        # Documents are put together again from their pieces; repeated rows come out as often.
        texts = defaultdict(lambda: defaultdict(list))
        for p in got:
            texts[(p["doc_id"], p["doc_tokens"])][p["start"]].append(p["ids"])
        bytes_want, bytes_got = Counter(), Counter()
        for (doc, ids), n in want.items():
            bytes_want[doc] += n * len(ids)
            if len([k for k in want if k[0] == doc and len(k[1]) == len(ids)]) == 1 and doc is not None:
                pieces = texts[(doc, len(ids) // 4)]
                joined, at = b"", 0
                while at < len(ids) // 4:
                    best = max(pieces[at], key=len)
                    joined += best
                    at += len(best) // 4
                if n == 1:
                    assert zlib.crc32(joined) == zlib.crc32(ids)
        for p in got:
            bytes_got[p["doc_id"]] += len(p["ids"])
        assert bytes_got == bytes_want


def test_no_rows(empty):
    assert packing.pack(empty, PATH, 1).collect() == []


def simulated(tokens, adds, quantum, unit):
    """The rounds played one after the other."""
    left, deficit, order = list(tokens), [0] * len(tokens), []
    while any(left):
        for s, add in enumerate(adds):
            deficit[s] += int(add)
            while deficit[s] >= quantum * unit and left[s]:
                n = min(quantum, left[s])
                order.append((s, n))
                left[s] -= n
                deficit[s] -= quantum * unit
    return order


@pytest.mark.parametrize("seed", range(20))
def test_places_are_those_of_the_rounds(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 3000, rng.integers(1, 8)).tolist()
    weights = tokens if seed % 2 else rng.random(len(tokens)).tolist()
    plan = packing.Schedule(tokens, weights, 256, 32)
    at, taken = 0, [0] * len(tokens)
    for s, n in simulated(tokens, plan.adds, 32, packing.UNIT):
        assert plan.places(s, np.array([taken[s] // 32])).tolist() == [at]
        at, taken[s] = at + n, taken[s] + n
    assert taken == tokens


def test_a_source_without_weight_comes_last_at_any_size():
    """Numbers of its rounds are far larger than a long holds when they count for the others."""
    plan = packing.Schedule([10**9, 10**9], [1.0, 0.0], 2048, 256)
    last = 10**9 // 256
    assert plan.places(1, np.array([last])).tolist() == [10**9 + last * 256]
    assert plan.places(0, np.array([0])).tolist() == [0]


def test_windows_hold_the_target_proportions(spark):
    text = "some words that make tokens " * 60
    rows = [(i, text, "abbcccc"[i % 7]) for i in range(210)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), PATH, 1)
    windows = defaultdict(Counter)
    for p in got.collect():
        windows[p["sequence_id"]][p["source"]] += p["length"]
    for number, parts in windows.items():
        if number < len(windows) - 1:
            for source, share in (("a", 1 / 7), ("b", 2 / 7), ("c", 4 / 7)):
                assert abs(parts[source] - 2048 * share) <= 2 * packing.QUANTUM


def test_shared_queues(odd):
    one = packing.pack(odd, PATH, 1)
    two = packing.pack(odd, PATH, 1, max_queues=2)
    def total(df):
        return df.groupBy("doc_id").sum("length").collect()

    assert sorted(total(one), key=str) == sorted(total(two), key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name, corpora):
    path = public_tokenizers.path(name)
    whole, coder = Tokenizer.from_file(path), TextEncoder(path)
    texts = [r["text"] or "" for _, rows in corpora for r in rows]
    texts += ["á ́b é", " lead", "trail  ", "a \n b\t\tc", "don't  won't 'll", "12 345\r\n6", "x\x85y z", "\x1f a"]
    texts += ["ÀÉÖ×Øß÷éÿ «où» l'été 's'Été", "Ωσς, あい ½²a ﬁne Ⅷ 1٣4 \u00ad- é\u0301é — a–b", "é" * 100 + " é1é2 É", "don''t _a_ x1y22"]
    got = coder.encode([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, coder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, text[:40]


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    monkeypatch.setattr("repoweave.llm.tokens.KEPT_PIECES", 3)
    whole, coder = Tokenizer.from_file(PATH), TextEncoder(PATH)
    texts = [f"word {i % 5} other{i} été{i % 3} again" for i in range(40)]
    got = [x for i in range(0, 40, 4) for x in coder.encode([t.encode() for t in texts[i : i + 4]])]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in got] == [
        whole.encode(t, add_special_tokens=False).ids for t in texts
    ]
