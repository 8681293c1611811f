"""Byte-level BPE by replaying merges over many words at once, and its inverse.

Texts are cut into pieces by a pattern.  The distinct new pieces of many texts lie behind each other in
one array of tokens, bytes at first, linked to their neighbours.  An inverted index leads from the
rank of each pair of neighbours to all places that hold it.  Merges are applied to all pieces at once in
order of their rank, places from left to right; a merge looks only at its own places and changes the
index for the two neighbours of each.  Pieces never touch, so this gives each what its own merges would.

Pieces repeat, so what a worker has merged it remembers, up to a bounded number of pieces; texts stay
where they are read, and nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.common import Remembered, map_texts

#: Pieces that a worker remembers before it forgets those not met since (twice as many at most).
KEPT_PIECES = 300_000
#: Characters above which a piece is not remembered.
KEPT_LENGTH = 48

_ENCODED = "_row long, doc_id long, ids array<int>"


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens with their ranks, which are their ids, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Splitter:
    """Matches of a pattern as the rank files' library finds them.

    Letters and numbers newer than that library's Unicode tables count as other characters there;
    they are found by asking it and stand aside while the pattern is matched.
    """

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        newer = self._newer(pattern, regex)
        self.newer = frozenset(newer)
        self.aside = dict.fromkeys(map(ord, newer), "\uffff")
        # In ASCII texts, letters, numbers and blanks are these.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.plain = re.compile(plain, re.ASCII) if r"\p" not in plain else None

    @staticmethod
    def _newer(pattern: str, regex) -> list[str]:
        import tiktoken

        known = (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
        asked = regex.findall(r"[\p{L}\p{N}]", "".join(known))
        # A token for each of these after "!": one token comes back only if both are in one piece.
        tokens = {bytes([b]) for b in range(256)}
        for c in asked:
            data = c.encode()
            tokens |= {b"!" + data[:k] for k in range(1, len(data) + 1)}
        ranks = {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (len(t), t)))}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return [c for c in asked if len(probe.encode_ordinary("!" + c)) == 1]

    def cut(self, text: str) -> list[str]:
        if self.plain and text.isascii():
            return self.plain.findall(text)
        if not self.newer.isdisjoint(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.aside))]
        return self.pattern.findall(text)


class Merges:
    """Ranks of all pairs of tokens that make a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.width = ranks, max(ranks.values()) + 1
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        #: For a token, ranks by the token after it and by the token before it.
        self.after: dict[int, dict[int, int]] = {}
        self.before: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.after.setdefault(left, {})[right] = rank
                    self.before.setdefault(right, {})[left] = rank
        #: The same for pairs of bytes, by their values; the width stands for none.
        self.first = np.full(1 << 16, self.width, np.int64)
        for a in range(256):
            for b in range(256):
                rank = ranks.get(bytes([a, b]))
                if rank is not None:
                    self.first[a << 8 | b] = rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by one replay of the merges over all of them."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        n, none, nothing = len(flat), self.width, {}
        last, begin = ends[sizes > 0] - 1, (ends - sizes)[sizes > 0]
        held = np.full(n, none, np.int64)
        held[:-1] = self.first[flat[:-1] << 8 | flat[1:]]
        held[last] = none
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last], before[begin] = -1, -1
        # The inverted index: places by the rank of the pair that begins there.
        order = np.argsort(held, kind="stable")
        order = order[: np.searchsorted(held[order], none)]
        ranks, starts = np.unique(held[order], return_index=True)
        index = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(order, starts[1:])), strict=True)) if len(order) else {}
        token = np.array(self.bytes)[flat].tolist()
        held, after, before = held.tolist(), after.tolist(), before.tolist()
        queue = list(index)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            with_next = self.after.get(rank, nothing).get
            with_last = self.before.get(rank, nothing).get
            for i in sorted(index.pop(rank)):
                if held[i] != rank:
                    continue  # an earlier merge took one of the two
                j = after[i]
                k = after[j]
                token[i], after[i], held[j], held[i] = rank, k, none, none
                if k >= 0:
                    before[k] = i
                    found = with_next(token[k])
                    if found is not None:
                        held[i] = found
                        if found in index:
                            index[found].append(i)
                        else:
                            index[found] = [i]
                            heappush(queue, found)
                h = before[i]
                if h >= 0:
                    found = with_last(token[h])
                    if found is None:
                        held[h] = none
                    else:
                        held[h] = found
                        if found in index:
                            index[found].append(h)
                        else:
                            index[found] = [h]
                            heappush(queue, found)
        out = []
        for at, size in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
            ids, i = [], at if size else -1
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out


class Encoder:
    """Ids of texts; remembers those of short pieces."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_PIECES):
        self.merges, self.splitter, self.kept = Merges(load_ranks(path)), Splitter(pattern), kept
        self.recent = Remembered({})

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        known = self.recent
        found = [list(map(known.__getitem__, self.splitter.cut(t.decode()))) for t in texts]
        new, known.new = known.new, {}
        merged = []
        for piece, ids in new.items():
            # A piece that is a token is that token.
            data = piece.encode()
            rank = self.merges.ranks.get(data)
            if rank is None:
                merged.append((piece, data))
            else:
                known[piece] = ids[:] = array("i", (rank,)).tobytes()
        for (piece, _), numbers in zip(merged, self.merges.replay([data for _, data in merged]), strict=True):
            known[piece] = new[piece][:] = array("i", numbers).tobytes()
        for piece in new:
            if len(piece) > KEPT_LENGTH:
                del known[piece]
        if len(known) > self.kept:
            known.older = {}
            self.recent = Remembered(known)
        return [np.frombuffer(b"".join(ids), np.int32) for ids in found]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, file and pattern; what it remembers outlives a task."""
    return Encoder(path, pattern)


def _encode_step(path: str, pattern: str):
    coder = encoder(path, pattern)

    def step(texts, rest):
        return rest | {"ids": coder.encode(texts)}

    return step


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id and ids (array of int), as the rank file's library encodes
    the whole text without special tokens.

    Null and empty texts have no ids.  Repeated rows are encoded alike; a null doc_id stays null.
    Columns other than doc_id and text are not looked at.  No rows give none.  A text is encoded with others
    of up to 8 MB, or alone if it is longer.
    """
    rows = docs.select("text", F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    return map_texts(rows, partial(_encode_step, path, pattern), _ENCODED).drop("_row")


@lru_cache(maxsize=2)
def tokens_of(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _decode(batches, path: str, schema: pa.Schema):
    table = tokens_of(path)
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False)
        starts = ids.offsets.to_pylist()
        data = [b"".join(map(table.__getitem__, values[a:b].tolist())) for a, b in zip(starts, starts[1:], strict=False)]
        columns = {f.name: batch.column(f.name) for f in schema if f.name in batch.schema.names}
        columns["decoded"] = pa.array(data, pa.binary())
        yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes of its ids as a column decoded; null ids have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_decode, path=path, schema=schema), "doc_id long, ids array<int>, decoded binary"
    )
