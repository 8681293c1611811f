import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoweave.llm import hyperplane_tree as tree
from repoweave.llm import queries

ROWS = "vec_id long, label int, embedding array<float>, anchor_id string, score string, cell string, _row string"


def brute(rows, positives=5, negatives=3):
    """All anchors against all rows, with integers of any size."""
    taken = []
    for vec_id, label, vector in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            taken.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = Counter()
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for i, (anchor, label, vector) in enumerate(taken):
        if anchor is None or anchor % 50:
            continue
        scored = [
            (max(min(sum(x * y for x, y in zip(vector, v, strict=False)), 2**63 - 1), 1 - 2**63), vec_id, other == label)
            for j, (vec_id, other, v) in enumerate(taken) if j != i
        ]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            window = [s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score]
            for rank, (found, negative, _) in enumerate(sorted(window, key=order)[:negatives], 1):
                out[(anchor, positive, rank, negative, score, found)] += 1
    return out


def mined(df, **more):
    got = tree.mine(df, F.col("vec_id") % 50 == 0, **more)
    assert dict(got.dtypes)["rank"] == "int" and len(got.columns) == 6
    return Counter(map(tuple, got.collect()))


def clustered(count, seed, dim=8, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    rows = middle[rng.integers(centres, size=count)] + 0.1 * rng.normal(size=(count, dim))
    return [(i, int(rng.integers(4)), [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


@pytest.fixture
def small_cells(monkeypatch):
    """Many cells and blocks for few rows."""
    monkeypatch.setattr(tree, "CELL", 20)
    monkeypatch.setattr(tree, "BLOCK", 15)
    monkeypatch.setattr(tree, "CHUNK", 4)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], ROWS).repartition(3)


def test_clusters_and_random_vectors(spark, small_cells):
    for rows in (clustered(700, 1), clustered(400, 2, dim=24, centres=400)):
        assert mined(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark, small_cells):
    rng = random.Random(4)
    rows = [(i, i % 3, [rng.choice([0.5, -0.25, 1.0]) for _ in range(3)]) for i in range(0, 400, 5)]
    rows += [(i, i % 4, [0.5, 0.5, 0.5]) for i in range(1000, 1200)]  # one vector of many rows: ties
    rows += [rows[0]] * 4 + [(50, 2, [0.1, 0.2, 0.3])] * 2
    rows += [
        (None, 1, [0.5, 0.5, 0.25]), (None, None, None), (300, None, [0.5, 0.5, 0.5]), (350, 1, None),
        (400, 1, [0.5, None, 0.5]), (450, 1, [0.5, float("nan"), 0.5]), (500, 1, [float("inf"), 0.5, 0.5]),
        (550, 1, []), (600, 2, [0.5]), (650, 1, [0.5, 0.5, 0.5, 0.5, 0.5]), (-50, 0, [1.0, 1.0, 1.0]), (700, 9, [0.25, 1.0, 1.0]),
    ]
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, rows), positives=2, negatives=1) == brute(rows, 2, 1)


def test_very_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [float(np.float32(rng.uniform(-1, 1) * 2.0**24)) for _ in range(4)]) for i in range(60)]
    assert mined(frame(spark, rows)) == brute(rows)
    rows += [(100, 1, [float(np.float32(3e38))] * 4), (101, 1, [float(np.float32(2e38))] * 4), (102, 0, [1.0] * 4)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert not mined(frame(spark, []))
    assert not mined(frame(spark, [(1, 1, [0.5]), (2, 1, [0.5])]))
    assert not mined(frame(spark, [(50, 1, [0.5])]))


def test_query_shifts_labels(spark):
    folder = "/root/testdata/sf0.001"
    rows = [
        (r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"])
        for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ]
    assert Counter(map(tuple, queries.op13_hyperplane_tree(spark, folder).collect())) == brute(rows)


def test_subtrees_are_eliminated_and_none_that_holds_a_result():
    rows = clustered(4000, 7)
    vectors = np.floor(256 * np.array([r[2] for r in rows]))
    labels, locators = np.array([r[1] for r in rows]), np.arange(len(rows))
    grown = tree.grow(vectors, locators)
    asked = np.arange(0, 4000, 40)
    scores = (vectors[asked] @ vectors.T).astype(np.int64)
    near = np.sort(scores, axis=1)[:, -200].astype(float)
    search = tree.Search(
        vectors, labels, locators, vectors[asked], labels[asked], locators[asked], np.arange(len(asked)),
        near, near + 3000, False, 10**6,
    )
    compared = []
    leaf = search._leaf
    search._leaf = lambda held, windows: (compared.append(len(held) * len(windows)), leaf(held, windows))
    window, row, score = search.run(grown)
    inside = (scores >= near[:, None]) & (scores <= near[:, None] + 3000) & (labels != labels[asked][:, None])
    assert Counter(zip(window.tolist(), row.tolist(), strict=True)) == Counter(zip(*(x.tolist() for x in np.nonzero(inside)), strict=True))
    assert (scores[window, row] == score).all()
    assert sum(compared) < 0.5 * len(asked) * len(rows)
