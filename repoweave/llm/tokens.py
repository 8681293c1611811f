"""Token ids of whole texts by a public tokenizer file, piece by piece with bounded memory.

Both tokenizers used here cut a text by a pattern before any merge, so the ids of a text are those of
its pieces in order.  Texts are cut by that pattern, which the tokenizer file names, as it reads for
ASCII and the letters up to U+00FF; a word with other characters is one piece.  Pieces repeat, so a worker remembers their ids and forgets
those not met for long; only pieces that it does not know go to the library.  A text that holds blanks
other than ASCII ones, which the libraries count as white space too, or the text of a special token, is
encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from repoweave.llm.common import ODD_BLANKS, Remembered, lower_ascii, quiet_tokenizers

_PIECE = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
#: A blank and a word: such pieces can be joined as they are.
_ONE_BLANK = re.compile(r" [^\x20\x09-\x0D]+")
#: Letters whose kind every Unicode table agrees on and which no normalizer joins with others.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_OTHER = re.compile(rf"[^\x00-\x7f{_LETTERS}]")
#: A word that holds another character.
_OTHER_WORD = rf"[\x21-\x7e{_LETTERS}]*[^\x00-\x7f{_LETTERS}][^\x20\x09-\x0D]*"
#: Pieces that are encoded in one call.
JOINED = 500
#: Pieces a worker remembers before it forgets those not met since (twice as many at most).
KEPT_PIECES = 400_000
#: Characters above which a piece is not remembered.
KEPT_LENGTH = 48
#: The pattern that byte-level tokenizers cut by if their file names none (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _cut_pattern(tokenizer) -> re.Pattern[str]:
    """What the tokenizer matches before it merges, in texts of ASCII and the letters up to U+00FF.

    Words with the blanks before them, if the file says it in another way.
    """
    rules = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
    rules = rules.get("pretokenizers", [rules])
    cut = [r for r in rules if r.get("type") != "ByteLevel" or r.get("use_regex", True)]
    if len(cut) != 1:
        return _PIECE
    if cut[0].get("type") == "ByteLevel" and not cut[0]["add_prefix_space"]:
        pattern = BYTE_LEVEL_PATTERN
    elif cut[0].get("type") == "Split" and cut[0]["invert"] and cut[0]["behavior"] == "Removed":
        pattern = cut[0]["pattern"].get("Regex", "")
    else:
        return _PIECE
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}0-9]")
    for kind, known in ((r"\p{L}", _LETTERS), (r"\p{N}", "0-9")):
        pattern = pattern.replace(f"[{kind}]", f"[{known}]").replace(kind, f"[{known}]")
    if not pattern or r"\p" in pattern:
        return _PIECE
    return re.compile(pattern, re.ASCII)


class TextEncoder:
    """Ids of texts as little-endian numbers of two bytes, or four for large vocabularies."""

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        self.special = [m.encode() for m in self.marks]
        #: Stands between pieces that are encoded in one call: its id shows where they part.
        self.mark, self.mark_id = next(((t.content, i) for i, t in added.items()), (None, None))
        #: Byte-level vocabularies show a piece's blank in its first token, which parts pieces without a mark.
        self.blank = None
        if self.tokenizer.normalizer is None and "ByteLevel" in type(self.tokenizer.pre_tokenizer).__name__:
            self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        #: Whether blanks only part words and ASCII case does not matter, as for vocabularies of lower-case
        #: words; then pieces are words in lower case, which are fewer.
        self.words_only = self._ask(" \n") == [] and self._ask("\nAn  Oak.") == self._ask("an") + self._ask("oak.")
        plain = _cut_pattern(self.tokenizer)
        blank = "" if self.words_only else " ?"
        mixed = plain if plain is _PIECE else re.compile(f"{blank}{_OTHER_WORD}|{plain.pattern}", re.ASCII)
        self.cut_plain, self.cut_mixed = plain.findall, mixed.findall
        self.known = Remembered({})
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        known = self.known.__getitem__
        found = [None if self._whole(t) else list(map(known, self._pieces(t))) for t in texts]
        self._learn()
        return [
            self._encoded(t.decode()).tobytes() if ids is None else b"".join(ids)
            for t, ids in zip(texts, found, strict=True)
        ]

    def _pieces(self, text: bytes) -> list[str]:
        text = (lower_ascii(text) if self.words_only else text).decode()
        plain = text.isascii() or not _OTHER.search(text)
        return self.cut_plain(text) if plain else self.cut_mixed(text)

    def _learn(self) -> None:
        """Gives new pieces their ids; forgets long ones, and at times all not met since the last time."""
        known = self.known
        new, known.new = known.new, {}
        for (piece, place), ids in zip(new.items(), self._ids(list(new)), strict=True):
            place[:] = ids
            if len(piece) > KEPT_LENGTH:
                del known[piece]
            else:
                known[piece] = ids
        if len(known) > KEPT_PIECES:
            known.older = {}
            self.known = Remembered(known)

    def _ask(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: bytes) -> bool:
        if any(s in text for s in self.special):
            return True
        return not text.isascii() and bool(ODD_BLANKS.search(text.decode())) or (
            text.isascii() and any(c in text for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f"))
        )

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece.  Many short pieces go to the library as one text, as each call costs more."""
        out: list[bytes] = [b""] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if self.blank is not None and _ONE_BLANK.fullmatch(p)]
        chosen = set(plain)
        other = [i for i in range(len(pieces)) if i not in chosen]
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = self._encoded("".join([pieces[i] for i in some]))
            begins = np.flatnonzero(self.blank[ids])
            self._part(out, some, ids, begins, np.append(begins[1:], len(ids)))
        step = JOINED if self.mark else 1
        for at in range(0, len(other), step):
            some = other[at : at + step]
            if len(some) == 1 or any(m in pieces[i] for i in some for m in self.marks):
                for i in some:
                    out[i] = self._encoded(pieces[i]).tobytes()
                continue
            ids = self._encoded(self.mark.join([pieces[i] for i in some]))
            marks = np.flatnonzero(ids == self.mark_id)
            self._part(out, some, ids, np.append(0, marks + 1), np.append(marks, len(ids)))
        return out

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.encode_batch([text], add_special_tokens=False)[0].ids, self.dtype)

    @staticmethod
    def _part(out: list[bytes], places: list[int], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        if len(begins) != len(places):
            raise AssertionError("pieces cannot be told apart")
        data, width = ids.tobytes(), ids.itemsize
        for i, a, b in zip(places, (width * begins).tolist(), (width * ends).tolist(), strict=True):
            out[i] = data[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One per worker process and file; the cache outlives a task."""
    return TextEncoder(path)


def id_type(path: str) -> str:
    return encoder(path).dtype
