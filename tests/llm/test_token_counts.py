import re
from collections import Counter

import public_tokenizers
import pytest

from repoweave.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def best(word):
    """Viterbi over one word alone, with all segmentations' scores kept per position."""
    pieces, longest, byte_score = token_counts.unigram_scores(PATH)
    score = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(score[-1][0] + n * byte_score, score[-1][1] + n)]
        options += [
            (score[a][0] + pieces[word[a:end]], score[a][1] + 1)
            for a in range(max(0, end - longest), end) if word[a:end] in pieces
        ]
        score.append(min(options, key=lambda o: (-round(o[0], 9), o[1])))
    return score[-1]


@pytest.mark.parametrize("max_nodes", [400_000, 90])
def test_counts(corpora, max_nodes):
    for df, rows in corpora:
        memo, want = {}, Counter()
        for r in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
            for w in set(words) - set(memo):
                memo[w] = best("▁" + w)[1]
            want[(r["doc_id"], len(r["text"] or ""), len(words), len(set(words)), sum(memo[w] for w in words))] += 1
        got = token_counts.count_tokens(df, PATH, max_nodes).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["n_pretokens"], r["n_distinct"], r["n_tokens"]) for r in got) == want


def test_a_shared_prefix_is_computed_once():
    pieces, _, byte_score = token_counts.unigram_scores(PATH)
    trie = token_counts.ForwardTrie(pieces, byte_score)
    for word in ("▁intern", "▁internal", "▁international", "▁internal"):
        trie.lookup(word)
    assert trie.computed == len("▁international") - 2 + len("al") - 0 or trie.computed <= len("▁internation") + 4
    assert trie.lookup("▁international")[0] == best("▁international")[1]


def test_no_rows(empty):
    assert token_counts.count_tokens(empty, PATH).collect() == []
