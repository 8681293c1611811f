"""Runs of repeated words by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q, several periods long, that neither
neighbour extends.  A text's suffix array, its inverse (ISA) and its LCP table stand for the suffix
tree; the tree's nodes are the LCP intervals, visited bottom up with a stack and never built.

Two neighbouring equal stretches of d words (a square) at i show in the interval of depth d as the
suffixes i and i + d; where the word after the square differs from the one d before it, the two lie in
different children of the interval (the square branches).  So it is enough to look, from the suffixes
of all children but the largest, whether ISA[i + d] or ISA[i - d] lies in the interval: a suffix is
looked at once for each halving of its interval.  A branching square is the right end of a run with
that period; rotating it left while words agree gives the run's start.  Squares of several periods
at the same end are merged into the run of the smallest.

Texts are independent of each other, so each is handled where it is read and nothing is shuffled.
A run repeats a stretch of two thirds of the least length; a text that repeats none so long has no
runs and needs no suffix array.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.common import map_texts, words_of

#: Least length of a run in words, and least number of periods in it.
LEAST = 24
PERIODS = 3

_FACTOR = 0x9E3779B97F4A7C15

_SCHEMA = "_row long, doc_id long, starts array<long>, lengths array<long>, periods array<long>, best long, collapsed string"


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Words as numbers; equal words have equal numbers, below the number of words."""
    place = dict(zip(words, range(len(words)), strict=True))
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def may_repeat(ids: np.ndarray, length: int) -> bool:
    """False only if all stretches of ``length`` words differ (by a hash, which may err to True)."""
    if len(ids) <= length:
        return False
    factor, mask = _FACTOR, (1 << 64) - 1
    sums, have, out, done = ids.astype(np.uint64) + np.uint64(1), 1, None, 0
    # Sums over 1, 2, 4, ... words by doubling; those of the bits of ``length`` are joined.
    while True:
        if length & have:
            out = sums if out is None else out[: len(ids) - length + 1] * np.uint64(pow(factor, have, mask + 1)) + sums[done : done + len(ids) - length + 1]
            done += have
        if 2 * have > length:
            break
        sums = sums[:-have] * np.uint64(pow(factor, have, mask + 1)) + sums[have:]
        have *= 2
    found = np.sort(out[: len(ids) - length + 1])
    return bool((found[1:] == found[:-1]).any())


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and the order of each place (ISA), by prefix doubling."""
    n, step = len(ids), 1
    key = ids
    while True:
        order = np.argsort(key, kind="stable")
        found = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], found[1:] != found[:-1])))
        if n == 0 or rank[order[-1]] == n - 1:
            return order, rank
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key, step = rank * (n + 1) + after, 2 * step


def common_prefixes(ids: list[int], order: list[int], rank: list[int]) -> list[int]:
    """LCP of each suffix with the one before it in order; -1 for the first and after the last."""
    n, lcp, h = len(ids), [-1] * (len(ids) + 1), 0
    for i in range(n):
        at = rank[i]
        if not at:
            h = 0
            continue
        j = order[at - 1]
        end = n - max(i, j)
        while h < end and ids[i + h] == ids[j + h]:
            h += 1
        lcp[at] = h
        if h:
            h -= 1
    return lcp


def branching_squares(ids: list[int], order: list[int], rank: list[int], lcp: list[int], most: int) -> set[tuple[int, int]]:
    """(end, d) of all squares of twice d words, up to d = ``most``, that the word after them ends."""
    n, found = len(ids), set()
    # Open intervals: depth, first place in order, and the largest child so far (size, first, end).
    stack = [[0, 0, 0, 0, 0]]
    for at in range(1, n + 1):
        depth, first = lcp[at], at - 1
        child = at - 1
        while stack and depth < stack[-1][0]:
            d, first, size, a, b = stack.pop()
            if at - child > size:
                a, b = child, at
            if d <= most:
                last = at
                for part in (range(first, a), range(b, last)):
                    for x in part:
                        i = order[x]
                        j = i + d
                        # The next words differ, so the two suffixes are in different children.
                        if j < n and first <= rank[j] < last and (j + d == n or ids[j] != ids[j + d]):
                            found.add((j + d, d))
                        j = i - d
                        if j >= 0 and first <= rank[j] < last and (i + d == n or ids[i] != ids[i + d]):
                            found.add((i + d, d))
            child = first
        if stack and depth > stack[-1][0]:
            stack.append([depth, child, at - child, child, at])
        elif stack:
            top = stack[-1]
            if at - child > top[2]:
                top[2:] = at - child, child, at
    return found


def runs_of(ids: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``periods`` (two or more)
    periods, by start and period."""
    n = len(ids)
    # In the stretch that a run repeats: length - period, at least this for any period.
    if not may_repeat(ids, max(1, least - least // periods)):
        return []
    order, rank = suffix_array(ids)
    words, order, rank = ids.tolist(), order.tolist(), rank.tolist()
    squares = branching_squares(words, order, rank, common_prefixes(words, order, rank), n // periods)
    out, known, at = [], [], None
    for end, d in sorted(squares):
        if end != at:
            known, at = [], end
        # Within a run, the squares of several of its periods end where it ends.
        if any(d % q == 0 and end - 2 * d >= start for start, q in known):
            continue
        start = end - 2 * d
        while start and words[start - 1] == words[start - 1 + d]:
            start -= 1
        known.append((start, d))
        if end - start >= max(least, periods * d):
            out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> int | None:
    """Number of the run with the greatest length / period; ties go to the smallest start and period."""
    best = None
    for i, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = i
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _runs_step(least: int, periods: int):
    def step(texts, rest):
        out = {"starts": [], "lengths": [], "periods": [], "best": [], "collapsed": []}
        for text in texts:
            words = words_of(text)
            runs = runs_of(numbers_of(words), least, periods)
            for k, name in enumerate(("starts", "lengths", "periods")):
                out[name].append([r[k] for r in runs])
            out["best"].append(strongest(runs))
            out["collapsed"].append(b" ".join(collapsed(words, runs)).decode())
        return out | rest

    return step


def find_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """One row per row of ``docs``: doc_id, starts, lengths and periods of its runs (arrays, by start and
    then period, words numbered from 0), best (the place in them of the run with the greatest
    length / period; null without runs) and collapsed (the words that stay, joined by one blank, if
    every run is cut to its first period).

    Null and empty texts have no words and no runs.  Repeated rows are treated alike; a null doc_id
    stays null; runs that overlap are all given.  Columns other than doc_id and text are not looked
    at.  No rows give none.  Memory is that of one text's words and suffix array.
    """
    rows = docs.select("text", F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    return map_texts(rows, partial(_runs_step, least, periods), _SCHEMA).drop("_row")
