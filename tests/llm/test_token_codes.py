from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repoweave.llm import token_codes
from repoweave.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_any_id_and_any_range(ids, data):
    codes = token_codes.Codes(token_codes.Codes.encode(np.array(ids, np.uint64)))
    assert len(codes) == len(ids)
    assert codes.slice(0, len(ids)).tolist() == ids
    if ids:
        at = data.draw(st.integers(0, len(ids) - 1))
        end = data.draw(st.integers(at, len(ids)))
        assert codes[at] == ids[at] and codes.slice(at, end).tolist() == ids[at:end]
        with pytest.raises(IndexError):
            codes[len(ids)]


@pytest.mark.parametrize("segment_ids", [1 << 16, 50])
def test_round_trip(corpora, segment_ids):
    tokenizer = Tokenizer.from_file(PATH)
    for df, rows in corpora:
        got = sorted(token_codes.encode_documents(df, PATH, 2, segment_ids).collect(), key=lambda r: r["start"])
        want = Counter(
            (r["doc_id"], np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
            for r in rows
        )
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
        at = 0
        for r in got:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
            at += r["n_tokens"]
        known = [r["doc_id"] for r in got if r["doc_id"] is not None]
        assert known == sorted(known) and got[-1]["doc_id"] is not None


def test_no_rows(empty, spark):
    assert token_codes.encode_documents(empty, PATH, 2).collect() == []


def test_segments_are_bounded(sample, spark):
    path = new_folder(spark, "segments")
    token_codes.write_tokens(sample, path, PATH, 2, segment_ids=1000)
    for r in token_codes.placed_segments(spark, path).collect():
        assert r["n_ids"] == sum(r["counts"]) == len(token_codes.Codes(bytes(r["codes"])))
        assert r["n_ids"] - r["counts"][-1] < 1000
