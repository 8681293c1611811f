import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repoweave.llm import mixing


def hashed(value):
    return int(hashlib.sha256(("mix" + ("" if value is None else str(value))).encode()).hexdigest()[:7], 16)


def targets(sizes):
    """Fill by weight, cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, out = 1.5 * sum(sizes.values()), {s: 0.0 for s in names}
    open_, left = set(names), total
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def brute(rows):
    sized = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in rows]
    sizes = Counter()
    for _, source, n in sized:
        sizes[source] += n
    goal, by = targets(dict(sizes)), defaultdict(list)
    for row in sized:
        by[row[1]].append(row)
    out = Counter()
    for source, members in by.items():
        step = round(goal[source] / sizes[source] * 2**30) if sizes[source] else 0
        offset = hashed(source) * 4
        for i, (doc, _, n) in enumerate(sorted(members, key=lambda r: (r[2], hashed(r[0]), r[0] is not None, r[0] or 0)), 1):
            copies = ((offset + i * step) >> 30) - ((offset + (i - 1) * step) >> 30)
            out[(doc, n, sizes[source], copies * n)] += 1
    return out, goal, sizes


@pytest.mark.parametrize("slice_rows", [50_000, 3])
def test_copies(corpora, slice_rows):
    for df, rows in corpora:
        want, goal, sizes = brute(rows)
        got = mixing.plan_mix(mixing.measure(df), slice_rows=slice_rows).collect()
        assert Counter((r["doc_id"], r["size"], r["source_size"], r["copies"] * r["size"]) for r in got) == want
        largest, taken = Counter(), Counter()
        for r in got:
            assert math.isclose(r["target"], goal[r["source"]], rel_tol=1e-12, abs_tol=1e-9) and r["copies"] <= 2
            largest[r["source"]] = max(largest[r["source"]], r["size"])
            taken[r["source"]] += r["copies"] * r["size"]
        assert all(abs(taken[s] - goal[s]) <= largest[s] + 1 for s in sizes)


def test_mix_gives_whole_rows(odd, empty):
    got = mixing.mix(odd)
    assert got.columns == odd.columns
    assert got.count() == mixing.plan_mix(mixing.measure(odd)).agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).collect() == []
    assert mixing.plan_mix(mixing.measure(empty)).collect() == []


def test_positions_beyond_32_bits_do_not_overflow(spark):
    rows = [(p, off, step) for p in (1, 2**30, 2**33, 2**33 + 7, 2**40 + 12345) for off in (0, 2**30 - 4) for step in (0, 3, 2**30 + 1, 2**31)]
    got = spark.createDataFrame(rows, "p long, offset long, step long").select("*", mixing._copies(F.col("p")).alias("n")).collect()
    for r in got:
        end = r["offset"] + r["p"] * r["step"]
        assert r["n"] == (end >> 30) - ((end - r["step"]) >> 30)


def test_any_column_name(odd):
    named = odd.withColumn("tick`and.dot", F.lit(1))
    assert mixing.mix(named).columns == named.columns
