"""Substring dedup: words covered by a window of words that also starts earlier are removed.

Method.  Suffix automata of reference passages; every other passage is streamed through the
automaton of its reference, and the matching statistics (longest match that ends at each
word) give the spans of at least ``window`` words.  One automaton of the whole corpus can't
be broadcast within a bound, so the reference is sharded by document and only what can match
meets it:

1. *Anchors.*  In every window the 8-word gram with the least hash is its anchor, so equal
   windows have equal anchors at equal places.  Anchors go out in packed arrays by hash.
2. *References.*  The first place (document, word) of an anchor that occurs again is its
   reference; every later place is linked to it.
3. *Automata.*  The passages around the references of a document make one automaton.  The
   linked passages of other documents join it by the reference document (a sort-merge join
   whose skewed keys Spark splits) and are streamed.  A match of ``window`` words whose first
   place is earlier is a repeat.
4. *The rest.*  Windows around a linked anchor that differ from its reference can still equal
   each other; they are grouped by their own hash, and all but the first are repeats.

Words are compared by 64-bit hashes.

Defined results.  Null or blank text: no words, nothing removed, kept text empty.  Null id:
comes before every other id.  Rows that share an id are ordered by a hash of their text;
identical rows (id and text) are one document from the first links on, however many they are,
and get the same result each.  Other columns of the input are ignored, whatever their names.
Very long texts: read in slices of one document.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, arrow_rows, partitions

GRAM = 8
_TOP = np.uint64(2**64 - 1)
_LEAST = -(2**63)


class SuffixAutomaton:
    """Suffix automaton over integers, with the first place at which each state ends.

    ``add`` appends a sequence whose first symbol is at ``place``; sequences are added in
    ascending order of place.  ``stream`` yields, for each symbol, the length of the longest
    suffix that occurs in the automaton and the first place at which the suffix of ``least``
    symbols ends (-1 if shorter).
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.end = [-1]

    def add(self, symbols: list[int], place: int) -> None:
        nxt, link, length, end = self.next, self.link, self.len, self.end
        last = 0
        for at, c in enumerate(symbols, place):
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            end.append(at)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        self.len.append(self.len[p] + 1)
        self.end.append(self.end[q])
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def stream(self, symbols: list[int], least: int) -> tuple[list[int], list[int]]:
        nxt, link, length, end = self.next, self.link, self.len, self.end
        state = size = 0
        sizes, ends = [], []
        for c in symbols:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is not None:
                state, size = to, size + 1
            sizes.append(size)
            if size < least:
                ends.append(-1)
                continue
            at = state
            while length[link[at]] >= least:
                at = link[at]
            ends.append(end[at])
        return sizes, ends


def anchors(words: K.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: grams that are the least in some whole window."""
    w = window - GRAM + 1
    n = len(words.start)
    at, gram = words.grams(GRAM)
    if n < window or not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    key = np.full(n, _TOP)
    key[at] = np.minimum(gram, _TOP - np.uint64(1))
    least = K.sliding(np.minimum, key, w)
    whole = np.arange(len(least)) + window <= words.first[1:][words.doc][: len(least)]
    least = np.where(whole, least, np.uint64(0))
    pad = np.zeros(w - 1, dtype=np.uint64)
    most = K.sliding(np.maximum, np.concatenate([pad, least, pad]), w)[:n]
    found = np.flatnonzero((most == key) & (key != _TOP))
    return found, key[found]


_PACKED = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("id", pa.binary()), ("h", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary())])
_PACKED_DDL = "bucket int, key binary, id binary, h binary, doc binary, pos binary"


def _pack(key, ident, h, pos, n_buckets: int) -> pa.RecordBatch:
    """One row for each bucket of keys; documents are numbered within the row."""
    bucket = (key % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    rows: list[list] = [[], [], [], [], [], []]
    for b in range(n_buckets):
        at = order[cuts[b] : cuts[b + 1]]
        if not len(at):
            continue
        docs, doc = _number(ident[at], h[at])
        for to, x in zip(rows, (b, key[at].tobytes(), docs[0].tobytes(), docs[1].tobytes(), doc.astype(np.uint32).tobytes(), pos[at].astype(np.int32).tobytes()), strict=True):
            to.append(x)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _PACKED, strict=True)], schema=_PACKED)


def _number(ident: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct runs of (id, hash); entries of a document are adjacent, as they come from a scan."""
    new = np.ones(len(ident), dtype=bool)
    new[1:] = (ident[1:] != ident[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return (ident[at], h[at]), np.cumsum(new) - 1


def _emit(pending: list, n_buckets: int, most: int, last: bool) -> Iterator[pa.RecordBatch]:
    if pending and (last or sum(len(x[0]) for x in pending) >= most):
        yield _pack(*(np.concatenate(x) for x in zip(*pending, strict=True)), n_buckets)
        pending.clear()


def _find_anchors(window: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list = []
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, data, bounds in K.slices(batch.column(2)):
                words = K.split_words(data, bounds)
                at, key = anchors(words, window)
                if len(at):
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    pending.append((key, ids[i + doc], hs[i + doc], at - words.first[doc]))
                yield from _emit(pending, n_buckets, 1 << 20, False)
        yield from _emit(pending, n_buckets, 0, True)

    return run


_LINK = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("id0", pa.int64()), ("h0", pa.int64()), ("pos0", pa.int32())])
_LINK_DDL = "id long, h long, pos int, id0 long, h0 long, pos0 int"


def _later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key, every place but the first, with the first; input is sorted by bucket."""
    held: list[tuple] = []
    current = None

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, ident, h, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        uniq, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(count[inverse] > 1)
        if not len(keep):
            return
        key, ident, h, pos = key[keep], ident[keep], h[keep], pos[keep]
        order = np.lexsort((pos, h, ident, key))
        key, ident, h, pos = key[order], ident[order], h[order], pos[order]
        new = np.ones(len(key), dtype=bool)  # identical rows are one document
        new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]) | (h[1:] != h[:-1]) | (pos[1:] != pos[:-1])
        key, ident, h, pos = key[new], ident[new], h[new], pos[new]
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = np.flatnonzero((ident != ident[first]) | (h != h[first]) | (pos != pos[first]))
        to = first[later]
        for i in range(0, len(later), 1 << 17):
            a, b = later[i : i + (1 << 17)], to[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ident[a], h[a], pos[a], ident[b], h[b], pos[b])], schema=_LINK)

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != current:
                yield from close()
                current = row["bucket"]
            doc = np.frombuffer(row["doc"], dtype=np.uint32)
            held.append((np.frombuffer(row["key"], dtype=np.uint64), np.frombuffer(row["id"], dtype=np.int64)[doc], np.frombuffer(row["h"], dtype=np.int64)[doc], np.frombuffer(row["pos"], dtype=np.int32)))
    yield from close()


def _links(packed: DataFrame, n: int) -> DataFrame:
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_later_places, _LINK_DDL)


_PIECE = pa.schema([("is_ref", pa.bool_()), ("id0", pa.int64()), ("h0", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("at", pa.binary()), ("upto", pa.binary()), ("anchor", pa.binary()), ("words", pa.large_binary())])
_PIECE_DDL = "is_ref boolean, id0 long, h0 long, id long, h long, at binary, upto binary, anchor binary, words binary"


def _cut(pos: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the merged passages around sorted anchors: all windows that hold one of them."""
    lo = np.maximum(pos - (window - GRAM), 0)
    hi = np.minimum(pos + window, n)
    new = np.ones(len(pos), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:] - 1, len(pos) - 1)]


def _pieces(window: int):
    """For a document with links: its reference passages, and its linked passages for each reference document.

    Rows come sorted by document; identical ones give one result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marks = batch.column(3)
            for i, j, data, bounds in K.slices(batch.column(2)):
                out: list[list] = [[] for _ in _PIECE]
                words = K.split_words(data, bounds)
                for k in range(i, j):
                    if (ids[k], hs[k]) == last:
                        continue
                    last = ids[k], hs[k]
                    flat = marks[k].values
                    kind, pos, id0, h0 = (flat.field(x).to_numpy(zero_copy_only=False) for x in range(4))
                    a, b = words.first[k - i], words.first[k - i + 1]
                    mine = words.hash[a:b]
                    order = np.lexsort((pos, h0, id0, kind))
                    kind, pos, id0, h0 = kind[order], pos[order], id0[order], h0[order]
                    new = np.ones(len(pos), dtype=bool)
                    new[1:] = (kind[1:] != kind[:-1]) | (id0[1:] != id0[:-1]) | (h0[1:] != h0[:-1])
                    edges = np.append(np.flatnonzero(new), len(pos))
                    for s, e in zip(edges[:-1], edges[1:], strict=True):
                        p = np.unique(pos[s:e])
                        lo, hi = _cut(p, b - a, window)
                        ref = bool(kind[s])
                        body = np.concatenate([mine[x:y] for x, y in zip(lo, hi, strict=True)])
                        for to, x in zip(out, (ref, ids[k] if ref else id0[s], hs[k] if ref else h0[s], ids[k], hs[k], lo.astype(np.int32).tobytes(), hi.astype(np.int32).tobytes(), b"" if ref else p.astype(np.int32).tobytes(), body.tobytes()), strict=True):
                            to.append(x)
                if out[0]:  # a batch for each slice, so that batches stay small
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PIECE, strict=True)], schema=_PIECE)

    return run


_FOUND = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("at", pa.binary()), ("rest", pa.binary()), ("rest_key", pa.binary())])
_FOUND_DDL = "id long, h long, at binary, rest binary, rest_key binary"


def _match(window: int):
    """Streams linked passages through the automaton of their reference document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, sam = None, None
        for batch in batches:
            out: list[list] = [[] for _ in _FOUND]
            for r in range(batch.num_rows):
                row = {f: batch.column(c)[r] for c, f in enumerate(batch.schema.names)}
                key = (row["id0"].as_py(), row["h0"].as_py())
                if key != have:
                    have, sam = key, SuffixAutomaton()
                    for lo, symbols in _passages(row, "r_"):
                        sam.add(symbols.tolist(), lo)
                anchor = np.frombuffer(row["anchor"].as_buffer(), dtype=np.int32)
                same = key == (row["id"].as_py(), row["h"].as_py())
                got, rest, keys = [], [], []
                for lo, symbols in _passages(row, ""):
                    n = len(symbols) - window + 1
                    if n <= 0:
                        continue
                    _, ends = sam.stream(symbols.tolist(), window)
                    ends = np.array(ends[window - 1 :], dtype=np.int64)
                    start = np.arange(lo, lo + n)
                    hit = (ends >= 0) & ((ends - (window - 1) < start) if same else True)
                    near = np.searchsorted(anchor, start + window - GRAM, side="right") > np.searchsorted(anchor, start)
                    left = np.flatnonzero(near & ~hit)
                    got.append(start[hit])
                    rest.append(start[left])
                    keys.append(K.runs(symbols, left, left + window, K._GRAM))
                if got and sum(map(len, got)) + sum(map(len, rest)):
                    for to, x in zip(out, (row["id"].as_py(), row["h"].as_py(), np.concatenate(got).astype(np.int32).tobytes(), np.concatenate(rest).astype(np.int32).tobytes(), np.concatenate(keys).tobytes()), strict=True):
                        to.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return run


def _passages(row: dict, prefix: str) -> Iterator[tuple[int, np.ndarray]]:
    lo, hi = (np.frombuffer(row[prefix + x].as_buffer(), dtype=np.int32) for x in ("at", "upto"))
    symbols = np.frombuffer(row[prefix + "words"].as_buffer(), dtype=np.uint64)
    at = 0
    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
        yield x, symbols[at : at + y - x]
        at += y - x


def _pack_rest(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list = []
        for batch in batches:
            for row in batch.to_pylist():
                pos = np.frombuffer(row["rest"], dtype=np.int32)
                if len(pos):
                    pending.append((np.frombuffer(row["rest_key"], dtype=np.uint64), np.full(len(pos), row["id"]), np.full(len(pos), row["h"]), pos))
            yield from _emit(pending, n_buckets, 1 << 20, False)
        yield from _emit(pending, n_buckets, 0, True)

    return run


def _remove(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text + ["spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            marks = batch.column(2)
            n_words, n_removed, sha, kept_text, spans = [0] * n, [0] * n, [""] * n, [""] * n, [[] for _ in range(n)]
            for i, j, data, bounds in K.slices(batch.column(1)):
                words = K.split_words(data, bounds, hashes=False)
                raw = data.tobytes()
                for k in range(i, j):
                    a, b = int(words.first[k - i]), int(words.first[k - i + 1])
                    n_words[k] = b - a
                    body = raw[bounds[k - i] : bounds[k - i + 1]].split()
                    starts = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in marks[k].values] if marks[k].is_valid else []
                    if starts and sum(map(len, starts)):
                        starts = np.unique(np.concatenate(starts))
                        cover = np.zeros(b - a + 1, dtype=np.int64)
                        cover[starts] += 1
                        np.subtract.at(cover, starts + window, 1)
                        gone = np.cumsum(cover)[:-1] > 0
                        n_removed[k] = int(gone.sum())
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                        spans[k] = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                        body = [x for x, g in zip(body, gone.tolist(), strict=True) if not g]
                    text = b" ".join(body)
                    sha[k] = hashlib.sha256(text).hexdigest()
                    if with_text:
                        kept_text[k] = text.decode()
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            columns += [pa.array(kept_text, pa.string())] * with_text
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text (on request), spans.

    ``spans`` are the removed word ranges [start, end).  A word goes if a window of ``window``
    words that covers it also starts earlier.  See the module's text for method and defined
    results.  ``window`` must exceed the anchor gram of 8 words.
    """
    if window <= GRAM:
        raise ValueError(f"window must exceed {GRAM} words")
    spark = docs.sparkSession
    arrow_rows(spark)
    n = partitions(spark)
    buckets = 4 * n
    scratch = Scratch(spark, "substring")
    ident = F.col(id_col).cast("long")
    keyed = docs.select(F.coalesce(ident, F.lit(_LEAST)).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), ident.isNotNull().alias("has_id"))
    links = scratch.write(_links(keyed.select("id", "h", "text").mapInArrow(_find_anchors(window, buckets), _PACKED_DDL), n))
    marks = (
        links.select("id", "h", F.struct(F.lit(0).alias("kind"), "pos", "id0", "h0").alias("m"))
        .union(links.select("id0", "h0", F.struct(F.lit(1).alias("kind"), F.col("pos0").alias("pos"), F.lit(0).cast("long").alias("id0"), F.lit(0).cast("long").alias("h0")).alias("m")).distinct())
        .groupBy("id", "h")
        .agg(F.collect_list("m").alias("marks"))
    )
    pieces = scratch.write(keyed.select("id", "h", "text").join(marks.hint("merge"), ["id", "h"]).mapInArrow(_pieces(window), _PIECE_DDL))
    refs = pieces.filter("is_ref").select("id0", "h0", F.col("at").alias("r_at"), F.col("upto").alias("r_upto"), F.col("words").alias("r_words")).dropDuplicates(["id0", "h0"])
    refs = scratch.write(refs)  # so that both sides of the join are plain exchanges, which Spark can split where one reference is hot
    met = pieces.filter("not is_ref").drop("is_ref").join(refs.hint("merge"), ["id0", "h0"])
    arrow_rows(spark, 32)  # a row carries two passages, each as long as a document
    found = scratch.write(met.mapInArrow(_match(window), _FOUND_DDL))
    arrow_rows(spark)
    rest = _links(found.select("id", "h", "rest", "rest_key").mapInArrow(_pack_rest(buckets), _PACKED_DDL), n)
    gone = scratch.write(
        found.select("id", "h", "at").union(rest.groupBy("id", "h").agg(F.collect_set("pos").alias("p")).mapInArrow(_pack_pos, "id long, h long, at binary"))
        .filter(F.length("at") > 0).groupBy("id", "h").agg(F.collect_list("at").alias("at"))
    )
    scratch.drop(links, pieces, refs, found)
    joined = keyed.join(gone, ["id", "h"], "left").select(F.when(F.col("has_id"), F.col("id")).alias("doc_id"), "text", "at")
    text = "kept_text string, " if with_text else ""
    return joined.mapInArrow(_remove(window, with_text), f"doc_id long, n_words long, n_removed long, kept_sha256 string, {text}spans array<struct<start: int, end: int>>")


def _pack_pos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [np.asarray(x.values, dtype=np.int32).tobytes() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary())], names=["id", "h", "at"])
