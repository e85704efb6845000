"""Token ids of whole texts with a vocabulary file of the ``tokenizers`` library.

A text is cut at runs of 0x20 and 0x09-0x0D, and each distinct piece is encoded once per
process.  That equals encoding the whole text where the vocabulary's normaliser works within
pieces and its pre-tokeniser drops white space, as with the word-end vocabulary used here;
``test_tokens.py`` compares both.  The cache is emptied when it holds ``CACHE`` pieces.
"""

from __future__ import annotations

import os
from array import array
from itertools import repeat

import numpy as np

CACHE = 800_000
_OPEN: dict[str, PieceCache] = {}


class PieceCache:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat, self.start, self.size = array("I"), array("Q"), array("I")

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        n = len(pieces)
        code = np.fromiter(map(self.code.get, pieces, repeat(-1)), dtype=np.int64, count=n)
        new = np.flatnonzero(code < 0)
        if len(new):
            if len(self.code) + len(new) > CACHE:
                self.clear()
                new = range(n)
            self._learn(list({pieces[i] for i in new}))
            if len(new) == n:
                code = np.fromiter(map(self.code.__getitem__, pieces), dtype=np.int64, count=n)
            else:
                code[new] = [self.code[pieces[i]] for i in new]
        size = np.frombuffer(self.size, dtype=np.uint32)[code].astype(np.int64) if n else np.zeros(0, dtype=np.int64)
        if not size.sum():
            return np.zeros(0, dtype=np.uint32), size
        ends = np.cumsum(size)
        at = np.repeat(np.frombuffer(self.start, dtype=np.uint64)[code].astype(np.int64) - (ends - size), size) + np.arange(ends[-1])
        return np.frombuffer(self.flat, dtype=np.uint32)[at], size

    def _learn(self, new: list[bytes]) -> None:
        """Encodes many pieces as one text, cut by the places of its tokens: far fewer calls than one for each piece."""
        for i in range(0, len(new), 512):
            part = new[i : i + 512]
            texts = [x.decode("utf-8", "replace") for x in part]
            starts = np.cumsum([0] + [len(x) + 1 for x in texts])
            e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            owner = np.searchsorted(starts, np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e.ids)), side="right") - 1
            size = np.bincount(owner, minlength=len(part))
            first = len(self.flat) + np.cumsum(size) - size
            base = len(self.size)
            self.flat.extend(e.ids)
            self.start.extend(first.tolist())
            self.size.extend(size.tolist())
            self.code.update(zip(part, range(base, base + len(part)), strict=True))


def pieces_of(path: str) -> PieceCache:
    if path not in _OPEN:
        _OPEN[path] = PieceCache(path)
    return _OPEN[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
