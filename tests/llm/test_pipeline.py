"""The whole chain against a plain one, and the near-duplicate stage on texts that share passages."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from repoweave.llm import quality, queries, similar

from .test_quality import base
from .test_similar import brute_count, edited

FOLDER = "/root/testdata/sf0.001"


def good(text):
    """Base rules and compression bands, chunk by chunk."""
    data, pack = (text or "").encode(), zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False)
    ratio = lambda part: len(part) / len(pack.compress(part)) if part else 1.0
    chunks = [data[i : i + quality.CHUNK] for i in range(0, len(data), quality.CHUNK)]
    if chunks and len(chunks[-1]) < quality.LEAST_CHUNK:
        chunks.pop()
    if len(data) <= quality.CHUNK and chunks:
        chunks = [data]
    least, most = quality.CHUNK_BAND
    bad = sum(not least <= ratio(c) <= most for c in chunks)
    low, high = next((lo, hi) for size, lo, hi in quality.BANDS if len(data) <= size)
    return not base(text)["base_failed"] and low <= ratio(data) <= high and bad <= quality.BAD_CHUNKS * len(chunks)


def test_run_against_a_plain_chain(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = [r for r in rows if good(r["text"])]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    rows = sorted((min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values()), key=lambda r: r["doc_id"])
    rows = [rows[i] for i in sorted(brute_count([r["text"] for r in rows]))]
    documents = pa.Table.from_pylist(rows)  # noqa: F841
    copies = dict(duckdb.sql(queries._OP8).select("doc_id, copies").fetchall())
    coder = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    coder.encode_special_tokens = True
    tokens = {r["doc_id"]: len(coder.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows}
    want = {d: (n * tokens[d], tokens[d]) for d, n in copies.items() if n}
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    got = defaultdict(int)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert {d: (n, tokens[d]) for d, n in got.items()} == want
    # Each copy is whole: every token of a document is in as many pieces as it has copies.
    spans = defaultdict(Counter)
    for p in pieces:
        spans[p["doc_id"]].update(range(p["start"], p["start"] + p["length"]))
    assert all(set(spans[d].values()) == {copies[d]} and len(spans[d]) == tokens[d] for d in want)
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans_of in windows.values():
        at = 0
        for offset, length in sorted(spans_of):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in w) < 2048 for w in windows.values()) <= 1


@pytest.mark.parametrize("block", [similar.BLOCK, 7])
def test_many_texts_with_a_common_passage(spark, block, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(150)]
    texts = [" ".join(passage + [word() for _ in range(130)]) for _ in range(150)]
    texts += [edited(rng, passage + [word() for _ in range(130)], 3) for _ in range(20)]
    group = [word() for _ in range(200)]
    texts += [edited(rng, group, n) for n in (0, 1, 2, 3, 9, 10, 11, 30, 31, 32) * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in similar.drop_similar(docs).collect()}
    assert kept == brute_count(texts)
    assert 170 < len(kept) < len(texts)


def test_the_stage_links_by_fingerprints_first(spark):
    words = [f"w{i * 37 % 911}" for i in range(500)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join(words[:-1] + ["changed"]), "other text of its own words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    sets = similar.map_texts(rows, similar.partial(similar._sets_step, 5), similar._SETS)
    pairs = {(min(r), max(r)) for r in similar._by_fingerprint(sets).select("a", "b").collect()}
    assert (0, 1) in pairs and all(3 not in p for p in pairs)
    assert similar.linked(rows).agg(F.countDistinct("root")).first()[0] == 1
