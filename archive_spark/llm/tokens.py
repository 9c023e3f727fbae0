"""Token ids of whole texts with the tokenizers library.

A byte-pair tokenizer encodes each piece that its pre-tokenizer cuts on its own, so pieces between white space always
get the same ids. Each Python worker keeps the ids of pieces it has met (a bounded number) and gives only new ones to
the tokenizer, all those of a batch at once. Pieces are cut where both pre-tokenizers used here must cut.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
from tokenizers import Tokenizer

# Spark runs a task on each core already; more threads only take memory of their own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space in Unicode, and the Latin letters up to U+024F but for U+0130, of which folding makes a letter
#: and a mark.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
#: A run of Latin letters before an ASCII character that is no letter is a piece of either pre-tokenizer.
_LETTERS = f"[{LATIN}]+(?=[\x01-@\\[-`{{-\x7f]|$)"
_LEADING = re.compile(f" ?{_LETTERS}| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_DROPPED = re.compile(f"{_LETTERS}|[^{WHITE}]+")
#: Pieces that a worker keeps at most, unless told otherwise; when there are more, those met once since the last time are forgotten.
MAX_PIECES = 600_000
#: Bytes of text encoded at once.
ENCODE_BYTES = 1 << 19
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class PieceEncoder:
    """Encodes texts; keeps_space: white space has ids of its own and case counts (byte-level), else it only parts words
    and A-Z count as a-z."""

    def __init__(self, path: str, keeps_space: bool, max_pieces: int = MAX_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special tokens' names in a text are ordinary text
        self.keeps_space, self.max_pieces = keeps_space, max_pieces
        self.number: dict[str, int] = {}
        self.uses = np.zeros(0, dtype=np.int64)
        self.offsets = np.zeros(1, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _flat(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered pieces one after another, and how many each has."""
        begin, sizes = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(sizes)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)], sizes

    def _forget(self) -> None:
        """Keep the pieces that were met again."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.max_pieces // 2:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.max_pieces // 2])
        pieces = list(self.number)
        self.pool, sizes = self._flat(keep)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.number = {pieces[i]: k for k, i in enumerate(keep.tolist())}
        self.uses = np.zeros(len(keep), dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        known = len(self.number)
        self.number.update(zip(pieces, range(known, known + len(pieces))))
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum()))))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes)))
        self.uses = np.concatenate((self.uses, np.zeros(len(pieces), dtype=np.int64)))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The pieces' numbers, -1 for new ones."""
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        if self.keeps_space:
            cut = [_LEADING.findall(t) for t in texts]
        else:
            cut = [_DROPPED.findall(t.encode().translate(_FOLD).decode()) for t in texts]
        counts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        flat = list(chain.from_iterable(cut))
        at = self._numbers(flat)
        if len(missing := np.flatnonzero(at < 0).tolist()):
            new = list(dict.fromkeys([flat[i] for i in missing]))
            if len(self.number) + len(new) > self.max_pieces:
                self._forget()
                self._learn(list(set(flat).difference(self.number)))
                at = self._numbers(flat)
            else:
                self._learn(new)
                at[missing] = self._numbers([flat[i] for i in missing])
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, sizes = self._flat(at)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        return np.split(ids, ends[:-1]) if len(texts) else []


_encoders: dict[tuple[str, bool, int], PieceEncoder] = {}


def encoder(path: str, keeps_space: bool, max_pieces: int = MAX_PIECES) -> PieceEncoder:
    """One for each worker process."""
    if (key := (path, keeps_space, max_pieces)) not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(path, keeps_space, max_pieces)
    return _encoders[key]
