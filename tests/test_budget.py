"""Budgets and ranks against plain sequential models, with one repository far larger than the rest."""

import random

import pytest

from repoweave.functions import fixed
from repoweave.operators import budget, rank
from repoweave.plans.options import PackOptions

MAIN = ["README.md", "package.json", "main.py", "Dockerfile"]


def random_files(seed, repos=6, large=400, small=25, top=300):
    rng = random.Random(seed)
    rows = []
    for repo in range(repos):
        sizes = [rng.randint(1, top) for _ in range(5)]
        for i in range(large if repo == 0 else rng.randint(1, small)):
            name = rng.choice(MAIN) if rng.random() < 0.2 else f"f{i}.txt"
            size = rng.choice(sizes) if rng.random() < 0.5 else rng.randint(1, top)
            rows.append((f"r{repo}", f"d{i}/{name}", size, rng.randint((size + 3) // 4, size), rng.randint(-50, 50) // 10))
    return rows


def size_walk(rows, limit):
    """One file after the other, main files first, then by size; what does not fit is skipped."""
    kept = set()
    for repo in {r[0] for r in rows}:
        order = sorted((r[1].split("/")[-1] not in MAIN, r[2], r[1], r[3]) for r in rows if r[0] == repo)
        used = 0
        for _, size, path, chars in order:
            if used + size <= limit:
                used += chars
                kept.add((repo, path))
    return kept


def token_walk(rows, limit, summarize):
    kept = {}
    for repo in {r[0] for r in rows}:
        used = 0
        for n, (_, path, size) in enumerate(sorted((-r[4], r[1], r[2]) for r in rows if r[0] == repo)):
            if n < fixed.ALWAYS_KEPT or used + size <= limit:
                cost = size
            elif summarize and used + min(size, fixed.SUMMARY_COST) <= limit:
                cost = min(size, fixed.SUMMARY_COST)
            else:
                continue
            used += cost
            kept[repo, path] = cost
    return kept


def table(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, path string, size bigint, chars bigint, score bigint")


@pytest.mark.parametrize("seed, limit, salts", [(1, 1000, 1), (2, 1500, 4), (3, 5000, 16), (4, 300, 64), (5, 40000, 8)])
def test_size_budget(spark, seed, limit, salts):
    rows = random_files(seed)
    opts = PackOptions(limit_bytes=limit, salt_buckets=salts)
    reach = budget.within_reach(table(spark, rows), opts, edge_rows=salts)
    assert {(r.repo_id, r.path) for r in reach.collect()} >= size_walk(rows, limit)
    kept = budget.size_budget(table(spark, rows), opts).collect()
    assert {(r.repo_id, r.path) for r in kept} == size_walk(rows, limit)


@pytest.mark.parametrize("edge_rows", [50_000, 10])
def test_reach_is_bounded_by_the_limit(spark, edge_rows):
    """Equal files of a large repository are cut to what the limit could hold, ranked either way."""
    rows = [("r", f"p{i:05}", 100, 100, 1) for i in range(10_000)] + [("r", "small", 8, 8, 1), ("s", "big", 5_000, 9, 1)]
    rows += [("r", f"{i:02}/README.md", 400, 400, 1) for i in range(30)] + [("t", "one", 3, 3, 1)]
    near = budget.within_reach(table(spark, rows), PackOptions(limit_bytes=2_000), edge_rows)
    assert near.columns == ["repo_id", "path", "size", "chars", "score", "is_main"]
    want = [f"{i:02}/README.md" for i in range((2_000 - 400) // 100 + 1)] + ["one"]
    want += [f"p{i:05}" for i in range((2_000 - 2 - 100) // 25 + 1)] + ["small"]
    assert sorted(r.path for r in near.collect()) == want


@pytest.mark.parametrize("seed, limit, summarize, salts", [
    (1, 4000, False, 1), (2, 9000, True, 4), (3, 20000, True, 16), (4, 300, False, 8), (5, 60000, True, 2),
])
def test_token_budget(spark, seed, limit, summarize, salts):
    rows = random_files(seed, top=2500 if summarize else 300)
    opts = PackOptions(token_limit_chars=limit, summarize_large_files=summarize, salt_buckets=salts)
    for bounded in (False, True):
        picks = budget.token_budget(table(spark, rows), opts, bounded).collect()
        assert {(r.repo_id, r.path): r.cost for r in picks} == token_walk(rows, limit, summarize)
        assert all(r.summarized == (r.cost < r["size"]) for r in picks)


def test_candidates_are_bounded_by_the_limit(spark):
    """Ten thousand equal files cannot all reach the walk."""
    rows = [("r", f"p{i:05}", 100, 100, 1) for i in range(10_000)]
    opts = PackOptions(token_limit_chars=2_000, salt_buckets=4)
    assert budget.token_candidates(table(spark, rows), opts).count() == 2_000 // 100 + fixed.ALWAYS_KEPT


def test_ranks(spark):
    rows = random_files(7)
    df = table(spark, rows)
    ranked = rank.rank_within_repo(df, rank.score_order()).collect()
    for repo in {r[0] for r in rows}:
        want = sorted((-r[4], r[1]) for r in rows if r[0] == repo)
        got = sorted((r["rank"], r.path) for r in ranked if r.repo_id == repo)
        assert got == [(i + 1, path) for i, (_, path) in enumerate(want)]


def test_caps(spark):
    df = table(spark, random_files(8))
    for cap in (1, 7, 10_000):
        kept = rank.cap_files(df, cap).collect()
        order = sorted((r.repo_id, r[1].split("/")[-1] not in MAIN, r["size"], r.path) for r in df.collect())
        want = {(o[0], o[3]) for n, o in enumerate(order) if sum(p[0] == o[0] for p in order[:n]) < cap}
        assert {(r.repo_id, r.path) for r in kept} == want


def test_priority_files_survive_any_cap(spark):
    rows = [("r", p, 1, 1, 0) for p in ["a.txt", "b/go.mod", "main.py", "z.txt"]]
    kept = {r.path for r in rank.priority_cap(table(spark, rows), 1).collect()}
    assert kept == {"b/go.mod", "main.py"}
    assert {r.path for r in rank.priority_cap(table(spark, rows), 3).collect()} == kept | {"a.txt"}
