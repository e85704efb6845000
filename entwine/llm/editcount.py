"""Token counts that follow edits: a segment tree of pre-tokens per document.

Method.  A text is cut into pre-tokens by the vocabulary's pattern; blocks of them are the
leaves of a segment tree whose nodes hold sums of characters and tokens.  An edit descends
the tree to its place, re-cuts from two pre-tokens before it (a pre-token depends on at most
two characters after its end) until a new boundary falls on an old one behind the edit, as
everything after that is unchanged.  Only pre-tokens in between are encoded again, and only
the sums on the paths of the touched blocks are updated.  Encoded pre-tokens are remembered
per process, ``CACHE`` at most.

Defined results.  Null or empty text: no tokens, no edits.  Null id: kept as null.  Rows that
share an id, and repeated rows, are counted each.  Other columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

CACHE = 800_000
_BLOCK, _SPLIT = 64, 512
_BACK = 2


class PieceCounter(dict):
    """Tokens of a pre-token, encoded on first sight."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut: Callable[[str], list[str]] = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


_OPEN: dict[tuple[str, str], PieceCounter] = {}


def counter(path: str | None = None, pattern: str | None = None) -> PieceCounter:
    import public_tokenizers

    key = (path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    if key not in _OPEN:
        _OPEN[key] = PieceCounter(*key)
    return _OPEN[key]


class TokenTree:
    """Segment tree over blocks of pre-tokens; node 1 is the root, leaf i is node ``half`` + i."""

    def __init__(self, text: str, pieces: PieceCounter):
        self.pieces = pieces
        self.encoded = 0
        self._build(pieces.cut(text))

    def _build(self, cut: list[str]) -> None:
        self.blocks = [cut[i : i + _BLOCK] for i in range(0, len(cut), _BLOCK)] or [[]]
        self.half = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.half), [0] * (2 * self.half)
        count = self.pieces.__getitem__
        for i, block in enumerate(self.blocks, self.half):
            self.chars[i] = sum(map(len, block))
            self.tokens[i] = sum(map(count, block))
        for i in range(self.half - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _locate(self, at: int) -> tuple[int, int, int]:
        """(block, pre-token in it, character at which that starts) for the pre-token that holds ``at``, or the end."""
        node, before = 1, 0
        while node < self.half:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        block = node - self.half
        if block >= len(self.blocks):
            block = len(self.blocks) - 1
        for k, piece in enumerate(self.blocks[block]):
            if at < before + len(piece):
                return block, k, before
            before += len(piece)
        return block, len(self.blocks[block]), before

    def _update(self, block: int) -> None:
        i = self.half + block
        self.chars[i] = sum(map(len, self.blocks[block]))
        self.tokens[i] = sum(map(self.pieces.__getitem__, self.blocks[block]))
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters [start, end) by ``new``."""
        if not 0 <= start <= end <= self.chars[1]:
            raise IndexError((start, end))
        block, k, at = self._locate(start)
        for _ in range(_BACK):
            while k == 0 and block:
                block -= 1
                k = len(self.blocks[block])
            if k:
                k -= 1
                at -= len(self.blocks[block][k])
        # old pre-tokens from there on: up to the edit's end, then more until boundaries meet
        old, b, i, size, more = [], block, k, at, 4
        while True:
            left = more
            while left and b < len(self.blocks):
                if i >= len(self.blocks[b]):
                    b, i = b + 1, 0
                    continue
                piece = self.blocks[b][i]
                old.append(piece)
                size += len(piece)
                i += 1
                left -= size >= end
            whole = left > 0
            text = "".join(old)
            text = text[: start - at] + new + text[end - at :]
            shift = len(new) - (end - start)
            edges, x = {}, 0
            for n, piece in enumerate(old, 1):
                x += len(piece)
                if at + x >= end:
                    edges[x + shift] = n
            cut, x, meet = self.pieces.cut(text), 0, None
            least = start - at + len(new)
            for n, piece in enumerate(cut, 1):
                x += len(piece)
                if x >= least and x in edges and (x + 2 <= len(text) or whole):
                    meet = (n, edges[x])
                    break
            if meet or whole:
                break
            more *= 2
        fresh, gone = (cut[: meet[0]], meet[1]) if meet else (cut, len(old))
        self.encoded += len(fresh)
        first = block
        while True:
            have = self.blocks[block]
            drop = min(gone, len(have) - k)
            have[k : k + drop] = fresh
            gone -= drop
            self._update(block)
            if not gone:
                break
            block, k, fresh = block + 1, 0, []
        if len(self.blocks[first]) > _SPLIT:
            self._build([p for x in self.blocks for p in x])


# What a revision masks: addresses, long keys, long numbers.
MASKS = (
    (re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "[email]"),
    (re.compile(r"\b[0-9a-fA-F]{16,}\b"), "[key]"),
    (re.compile(r"\+?\d(?:[ ().-]{0,3}\d){8,}"), "[number]"),
)


def mask_edits(text: str) -> list[tuple[int, int, str]]:
    """Disjoint edits (start, end, new text) in ascending order; the earlier mask wins an overlap."""
    found: list[tuple[int, int, str]] = []
    for k, (mask, new) in enumerate(MASKS):
        if k == 0 and "@" not in text:
            continue
        found += [(m.start(), m.end(), new) for m in mask.finditer(text)]
    found.sort(key=lambda e: e[0])
    out: list[tuple[int, int, str]] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def token_counts(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = mask_edits, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, n_tokens, n_edits, n_tokens_edited, n_reencoded.

    ``edits`` gives a text's disjoint edits in ascending order; n_tokens_edited counts the text
    after them, n_reencoded the pre-tokens encoded again for them.
    """
    arrow_rows(docs.sparkSession)
    names = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path, pattern)
        for batch in batches:
            out: list[list[int]] = [[] for _ in names[1:]]
            for value in batch.column(1):
                text = value.as_py() or ""
                tree = TokenTree(text, pieces)
                before = tree.n_tokens
                todo = edits(text)
                for start, end, new in reversed(todo):
                    tree.edit(start, end, new)
                for to, x in zip(out, (len(text), before, len(todo), tree.n_tokens, tree.encoded), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, ", ".join(f"{n} long" for n in names))
