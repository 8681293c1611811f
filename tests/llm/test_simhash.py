import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from repoweave.llm import simhash


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Label of the component of each distinct fingerprint."""
    values = sorted(set(prints))
    label, out = {}, np.array(values, np.uint64)
    for v in values:
        if v in label:
            continue
        label[v], todo = v, [v]
        while todo:
            near = out[np.bitwise_count(out ^ np.uint64(todo.pop())) <= 4]
            for x in near.tolist():
                if x not in label:
                    label[x] = v
                    todo.append(x)
    return label


def brute(rows):
    prints = [brute_print(r["text"]) for r in rows]
    label = brute_components(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        known = [x for x in (least.get(label[p]), r["doc_id"]) if x is not None]
        least[label[p]] = min(known) if known else None
    return Counter((r["doc_id"], f"{p:016x}", least[label[p]]) for r, p in zip(rows, prints, strict=True))


def test_documents(corpora):
    for df, rows in corpora:
        got = Counter(tuple(r) for r in simhash.near_duplicates(df).collect())
        assert got == brute(rows)


def test_words_two_errors_apart_share_a_codeword():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 4000)
    index, count = simhash.codeword_indices(words)
    for bits in (0, 1, 2):
        flips = np.array([sum(1 << b for b in rng.choice(23, bits, replace=False)) for _ in words], np.int64)
        other, n = simhash.codeword_indices(words ^ flips)
        for a, na, b, nb in zip(index, count, other, n, strict=True):
            assert set(a[:na]) & set(b[:nb])
    assert set(count.tolist()) == {1, 6}


def test_fingerprints_four_bits_apart_share_a_key():
    rng = np.random.default_rng(4)
    for _ in range(400):
        one = int(rng.integers(0, 1 << 63))
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        keys, rows = simhash.keys_of(np.array([one, one ^ flips], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def clusters(rng, n_groups, members, spread):
    out = set()
    for _ in range(n_groups):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(members):
            out.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, spread + 1)), replace=False)))
    return sorted(out)


@pytest.mark.parametrize("block", [simhash.BLOCK, 20, 3])
def test_components_of_dense_groups(spark, block):
    rng = np.random.default_rng(5)
    prints = clusters(rng, 6, 150, 4) + clusters(rng, 40, 3, 6) + clusters(rng, 300, 1, 0)
    label = brute_components(prints)
    want = {}
    for p in prints:
        want.setdefault(label[p], set()).add(p)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(7)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.link_edges(df, block)).collect()}
    got = {}
    for s, p in zip(signed, prints, strict=True):
        got.setdefault(roots.get(s, s), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert len({r["root"] for r in simhash.components(edges).collect()}) == 1


def test_one_of_each_component_stays(odd, empty):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    label = brute_components([brute_print(r["text"]) for r in odd.collect()])
    assert kept.count() == len(set(label.values()))
    assert simhash.near_duplicates(empty).collect() == [] == simhash.drop_near_duplicates(empty).collect()
