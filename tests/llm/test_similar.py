import random
from functools import partial
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repoweave.llm import similar
from repoweave.llm.common import map_texts, stored


def grams(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_count(texts):
    """Number of components over links of similarity 0.8, by all pairs."""
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i for i in range(len(texts)) if root(i) == i}


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_the_stage_drops_texts_of_similarity_from_0_8(spark):
    rng, texts = random.Random(3), []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words)] + [edited(rng, words, n) for n in (1, 4, 7, 12, 20)]
    group = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts += [edited(rng, group, rng.randrange(6)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == brute_count(texts) and len(kept) < len(texts) / 2


def test_odd_rows_keep_their_columns(spark, odd, empty):
    rows = odd.collect()
    kept = similar.drop_similar(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(brute_count([r["text"] for r in rows]))
    assert similar.drop_similar(empty).collect() == []


@pytest.mark.parametrize("block", [4096, 7])
def test_links_within_bands_connect_what_all_pairs_connect(spark, monkeypatch, block):
    """The last step alone, over whole bands and pairs of blocks of them, gives a forest per band and no more."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng, texts = random.Random(8), ["", None, "one two", "one two"]
    for changes in (0, 2, 6, 10, 18):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [edited(rng, words, rng.randrange(changes + 1)) for _ in range(25)]
    table = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(3)
    sets = stored(map_texts(table, partial(similar._sets_step, 5), similar._SETS), "t")
    members = sets.select("_row", "size", F.col("_row").alias("root"), F.posexplode("bands").alias("nth", "band"))
    many = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    rows = stored(members.join(many, "band"), "t")
    links = similar._links_within(rows, sets.select("_row", "minima"), table, 5, 0.8).collect()
    found = [grams(t) for t in texts]
    assert all(len(found[x.a] & found[x.b]) >= 0.8 * len(found[x.a] | found[x.b]) for x in links)
    assert block < 4096 or len(links) <= rows.count()
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in links:
        a, b = sorted((root(x.a), root(x.b)))
        parent[b] = a
    assert {i for i in range(len(texts)) if root(i) == i} == brute_count(texts)
