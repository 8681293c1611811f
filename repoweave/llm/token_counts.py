"""Token counts by a unigram model over a trie of the distinct pre-tokens.

The best segmentation of a prefix is the same for all words that begin with it.  Distinct pre-tokens
are inserted in a trie whose nodes hold the forward score of their prefix (the best sum of piece
scores that ends there), its number of pieces, and the pieces that began in it and may go on, as places in
a trie of pieces; a node is computed once, from the one above it, however many words share it.  Where a pre-token ends, its count is stored, and a document's count is
the sum over its pre-tokens.  Tries live in the tasks, start anew when they are full, and so bound
memory; nothing is shuffled.
"""

from __future__ import annotations

import gc
from functools import lru_cache, partial
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.common import map_texts, words_of

#: Mark of a word's beginning in the piece file (fixed value).
MARK = "▁"
#: Nodes after which a task's trie starts anew.
MAX_NODES = 1_000_000
#: Longest pre-token that is kept in the trie; longer ones are computed and forgotten.
KEPT_LENGTH = 64

_SCHEMA = "doc_id long, n_chars long, n_pretokens long, n_distinct long, n_tokens long, score double"


@lru_cache(maxsize=2)
def unigram_scores(path: str) -> tuple[dict[str, float], int, float]:
    """Pieces with log probabilities by Zipf's law over their rank, the longest piece's length, and
    the score of a byte of a character that no piece holds.

    The file has merge ranks and no probabilities, so a piece of rank r weighs 1 / (r + 1).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    whole = log(sum(1 / r for r in range(1, len(pieces) + 1)))
    scores = {p: -log(r) - whole for r, p in enumerate(pieces, 1)}
    return scores, max(map(len, pieces)), -2 * log(len(pieces)) - whole


class ForwardTrie:
    """Forward scores by prefix; ties go to fewer pieces.

    A node is one list: the score and the number of pieces of its prefix, the first character below it and
    its node, the others as a dictionary, and then in turn places in the trie of pieces that may go on and
    the nodes where these began.
    """

    def __init__(self, pieces: dict[str, float], byte_score: float, max_nodes: int = MAX_NODES):
        self.byte_score, self.max_nodes = byte_score, max_nodes
        #: A place has the places one character on, and the score of the piece that ends there by "".
        self.pieces: dict = {}
        for piece, score in pieces.items():
            place = self.pieces
            for char in piece:
                place = place.setdefault(char, {})
            place[""] = score
        self.computed = 0
        self.clear()

    def clear(self) -> None:
        self.root: list = [0.0, 0, "", None, None]
        self.nodes = 1
        self.terminal: dict[str, tuple[int, float]] = {}

    def _forward(self, above: list, char: str) -> list:
        """Node for the prefix of ``above`` and one more character."""
        n = 1 if char < "\x80" else len(char.encode())
        score, count = above[0], above[1]
        best, pieces = score + n * self.byte_score, count + n
        node = [0.0, 0, "", None, None]
        place = self.pieces.get(char)
        if place is not None:
            node += place, above
            s = place.get("")
            if s is not None:
                s, k = score + s, count + 1
                if s > best or (s == best and k < pieces):
                    best, pieces = s, k
        for i in range(5, len(above), 2):
            place = above[i].get(char)
            if place is not None:
                begun = above[i + 1]
                node += place, begun
                s = place.get("")
                if s is not None:
                    s, k = begun[0] + s, begun[1] + 1
                    if s > best or (s == best and k < pieces):
                        best, pieces = s, k
        node[0], node[1] = best, pieces
        self.computed += 1
        return node

    def lookup(self, word: str) -> tuple[int, float]:
        """Number of pieces of a pre-token, and the score of its best segmentation."""
        found = self.terminal.get(word)
        if found is None:
            found = self._insert(word)
        return found

    def _insert(self, word: str) -> tuple[int, float]:
        kept = len(word) <= KEPT_LENGTH
        if kept and self.nodes + len(word) > self.max_nodes:
            self.clear()
        node, shared = self.root, 0
        if kept:
            for char in word:
                below = node[3] if node[2] == char else node[4].get(char) if node[4] else None
                if below is None:
                    break
                node, shared = below, shared + 1
        for char in word[shared:]:
            below = self._forward(node, char)
            if kept:
                if node[3] is None:
                    node[2], node[3] = char, below
                elif node[4] is None:
                    node[4] = {char: below}
                else:
                    node[4][char] = below
                self.nodes += 1
            node = below
        found = (node[1], node[0])
        if kept:
            self.terminal[word] = found
        return found


def _count_step(path: str, max_nodes: int):
    pieces, _, byte_score = unigram_scores(path)
    trie = ForwardTrie(pieces, byte_score, max_nodes)

    def step(texts, rest):
        # Tries hold no cycles, and the collector would walk all their nodes again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return counted(texts) | {"doc_id": rest["doc_id"]}
        finally:
            if collecting:
                gc.enable()

    def counted(texts):
        out = {name: [] for name in ("n_chars", "n_pretokens", "n_distinct", "n_tokens", "score")}
        for text in texts:
            words = words_of(text)
            distinct = {w: trie.lookup(MARK + w.decode()) for w in set(words)}
            found = [distinct[w] for w in words]
            out["n_chars"].append(len(text.decode()))
            out["n_pretokens"].append(len(words))
            out["n_distinct"].append(len(distinct))
            out["n_tokens"].append(sum(f[0] for f in found))
            out["score"].append(float(sum(f[1] for f in found)))
        return out

    return step


def count_tokens(docs: DataFrame, pieces: str, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row per row of ``docs``: characters, pre-tokens (words), distinct ones, tokens and score.

    ``pieces`` is the path of a piece file.  Null text is empty: no tokens, score 0.  Characters
    that no piece holds count one token per UTF-8 byte.  Repeated rows are counted as often as they
    come.  Columns other than doc_id and text are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_texts(rows, partial(_count_step, pieces, max_nodes), _SCHEMA)
