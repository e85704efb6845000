"""Benchmark decontamination: documents that hold a benchmark item up to a few edits.

Method.  Words are runs of letters and digits of the lower-cased text; of scripts that are written
without spaces (Han, kana, Thai, Lao, Burmese, Khmer) each character is a word.  An item matches where
the edit distance (in words) between it and some passage is at most ``edits(n)``: ``rate``
of its n words, and few enough that an unedited run of three words must remain.

1. *Windows.*  A passage that matches shares a three-word gram with the item (q-gram lemma),
   so windows of the item's size are laid only where a document holds a gram of some item, at
   the place the gram has in it.  Nothing that can match is passed over.
2. *CGK.*  A random walk over a window copies one symbol per step and moves on by a bit that
   depends on step and symbol (Chakraborty, Goldenberg and Koucky 2016): edit distance turns
   into Hamming distance.  ``walks`` independent walks are used.
3. *Bit sampling.*  Each table samples ``coordinates`` steps of a walk; equal samples make a
   candidate.  The number of tables is set on the items themselves: copies with the most
   edits allowed are simulated, of up to 500 items for each size group (sizes between powers of
   two), and each group gets tables until the share found reaches ``recall``.  A group that
   200 tables leave short has each window compared with all items of its size.
4. *Verification.*  Edit distance of the item to the best passage around the window, exactly,
   where enough of the item's words occur there at all.

The benchmark goes to the executors in blocks of at most ``block_words`` words, one pass over
the documents for each block; its size is counted first.

Defined results.  Items of one or two words match verbatim, at their first place; such words
occur in clean texts too, so ``decontaminate`` drops nothing for items under ``least_words``
(three).  Null items and items without a word are passed over; items with equal text are
reported each.  Null or empty documents match nothing.  One row for each row of the documents
and item that match: the passage with the fewest edits, the first of
those.  A null doc_id or item_id is reported as null.  Repeated rows are reported each.
Other columns are ignored.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_rows, free_names

_PAD = np.uint64(0)
#: A walk has left most windows after two thirds of its steps; later ones tell nothing.
_REACH = 0.6
_SEED = 4


def _inside(data: np.ndarray) -> np.ndarray:
    """Bytes of words: ASCII letters and digits, and other characters but Latin-1 signs, general, CJK and fullwidth punctuation."""
    low = data | 32
    out = ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    n = len(data)
    if n > 1 and (data >= 128).any():
        two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0))
        out[two] = out[two + 1] = False
        a, b, c = data[:-2], data[1:-1], data[2:]
        wide = (a == 0xEF) & (((b == 0xBC) & ((c < 0x90) | ((c >= 0x9A) & (c <= 0xA0)) | (c >= 0xBB))) | ((b == 0xBD) & ((c == 0x80) | ((c >= 0x9B) & (c <= 0xA5)))))
        three = np.flatnonzero((((a == 0xE2) | (a == 0xE3)) & (b == 0x80)) | wide)
        for k in range(3):
            out[three + k] = False
    return out


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Bounds of the characters of scripts written without spaces."""
    n = len(data)
    if n < 3 or not (data >= 0xE0).any():
        return np.zeros(0, dtype=np.int64)
    a, b = data[:-2], data[1:-1]
    south = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F)))
    kana = (a == 0xE3) & (b >= 0x81) & (b <= 0x83)
    han = ((a == 0xE3) & (b >= 0x90)) | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB))
    three = np.flatnonzero(south | kana | han)
    four = np.flatnonzero((a == 0xF0) & (b >= 0xA0))
    return np.concatenate([three, three + 3, four, np.minimum(four + 4, n)])


def words_of(data: np.ndarray, bounds: np.ndarray) -> K.Words:
    words = K.split_words(data, bounds, inside=_inside(data), cuts=_unspaced(data))
    words.hash |= np.uint64(1)  # never the pad
    return words


def edits(n: int, rate: float) -> int:
    return max(0, min(int(rate * n), (n - 3) // 3))


def _group(size: np.ndarray) -> np.ndarray:
    """Size groups, between powers of two."""
    return np.floor(np.log2(size)).astype(np.int64)


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of ``text`` nearest to ``item``; the first of the shortest."""
    n = len(text)
    steps = np.arange(n + 1)
    cost, start = np.zeros(n + 1, dtype=np.int64), steps.copy()
    for k, w in enumerate(item, 1):
        swap, drop = cost[:-1] + (text != w), cost[1:] + 1
        take = np.where(swap <= drop, swap, drop)
        new = np.concatenate([[k], take])
        origin = np.concatenate([[0], np.where(swap <= drop, start[:-1], start[1:])])
        flat = new - steps
        best = np.minimum.accumulate(flat)
        at = np.maximum.accumulate(np.where(flat == best, steps, 0))
        # the step that reached the running minimum first is the nearest to the left that attains it
        cost, start = best + steps, origin[at]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Index:
    """Hash tables of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, recall: float, walks: int, coordinates: int, least_words: int = 1):
        texts = [t.encode() for _, t in items]
        bounds = np.cumsum([0] + [len(t) for t in texts])
        words = words_of(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
        size = np.diff(words.first)
        keep = np.flatnonzero(size >= max(3, least_words))
        short = [np.flatnonzero(size == n) if n >= least_words else keep[:0] for n in (1, 2)]
        self.ids = [items[i][0] for i in np.concatenate([keep, *short])]
        self.items = [words.hash[words.first[i] : words.first[i + 1]] for i in keep]
        self.size = size[keep]
        self.limit = np.array([edits(int(n), rate) for n in self.size], dtype=np.int64)
        self.coordinates, self.walks = coordinates, walks
        self.steps = 3 * int(self.size.max(initial=1))
        rng = np.random.default_rng(_SEED)
        self.odd = rng.integers(1, 2**62, (walks, self.steps)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self._short(words, short)
        self._grams()
        #: walk, steps sampled, and the size group it is for
        self.tables: list[tuple[int, np.ndarray, int]] = []
        if self.items:
            self._fill(recall, rng)

    def _short(self, words: K.Words, short: list[np.ndarray]) -> None:
        """Keys of the items of one and of two words, with their places in ``ids``."""
        self.short, at = [], len(self.items)
        for n, rows in enumerate(short, 1):
            key = K.runs(words.hash, words.first[rows], words.first[rows] + n, K._GRAM)
            order = np.argsort(key, kind="stable")
            self.short.append((key[order], at + order))
            at += len(rows)

    def _grams(self) -> None:
        found = [(int(h), len(x), i) for x in self.items for i, h in enumerate(K.runs(x, np.arange(len(x) - 2), np.arange(3, len(x) + 1), K._GRAM))]
        found = sorted(set(found))
        self.gram = np.array([f[0] for f in found], dtype=np.uint64)
        self.gram_size, self.gram_at = (np.array([f[k] for f in found], dtype=np.int64) for k in (1, 2))
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.gram & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def walk(self, k: int, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Walk k over the windows [start, start + size) of symbols, cut at ``stop``; one row for each step."""
        end = np.minimum(start + size, stop)
        at = start.copy()
        padded = np.append(symbols, _PAD)
        out = np.empty((3 * int(size.max(initial=1)), len(start)), dtype=np.uint64)
        for j in range(len(out)):
            s = padded[np.where(at < end, at, len(symbols))]
            out[j] = s
            at += (s * self.odd[k, j] >> np.uint64(63)).astype(np.int64) | (s == _PAD)
        return out

    def _keyed(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places among the windows, keys) for each table; walks stay within some 32 MB."""
        group = _group(size)
        for g in np.unique(group).tolist():
            members, step = np.flatnonzero(group == g), max(1, (1 << 22) // (6 << g))
            mine = [(t, *table) for t, table in enumerate(self.tables, 1) if table[2] == g]
            for i in range(0, len(members), step):
                at = members[i : i + step]
                for k in sorted({table[1] for table in mine}):
                    walked = self.walk(k, symbols, start[at], size[at], stop[at])
                    for t, own, steps, _ in mine:
                        if own == k:
                            yield at, self.keys(t, steps, walked, size[at])

    def keys(self, table: int, steps: np.ndarray, walked: np.ndarray, size: np.ndarray) -> np.ndarray:
        """steps: fractions of 3 * size; equal sizes sample equal steps."""
        key = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(table)
        column = np.arange(walked.shape[1])
        for f in steps:
            key = K.mix(key ^ walked[(f * 3 * size).astype(np.int64), column])
        return key

    def _fill(self, recall: float, rng: np.random.Generator) -> None:
        """Adds tables until the simulated copies with the most edits are found often enough in every size group."""
        group = _group(self.size)
        for g in np.unique(group).tolist():
            self._fill_group(g, np.flatnonzero(group == g), recall, rng)
        stop = np.cumsum(self.size)
        owner, keys = (np.concatenate(x) for x in zip(*self._keyed(np.concatenate(self.items), stop - self.size, self.size, stop), strict=True))
        order = np.lexsort([owner, keys])
        self.key, self.owner = keys[order], owner[order]

    def _fill_group(self, g: int, members: np.ndarray, recall: float, rng: np.random.Generator) -> None:
        some = rng.permutation(members)[:500]
        wanted = max(200, min(2000, (1 << 22) // (3 * int(self.size[members].max()))))
        some = some[:wanted]
        copies, of = [], []
        for i in some:
            for _ in range(-(-wanted // len(some))):
                x = self.items[i].tolist()
                for _ in range(int(self.limit[i])):
                    at, kind, new = rng.integers(len(x)), rng.integers(3), int(rng.integers(1, 2**62)) | 1
                    x[at : at + (kind != 0)] = [] if kind == 1 and len(x) > 1 else [new]
                copies.append(np.array(x, dtype=np.uint64))
                of.append(i)
        size = self.size[np.array(of)]
        ours, theirs = np.concatenate([self.items[i] for i in of]), np.concatenate(copies)
        ours_stop, stop = np.cumsum(size), np.cumsum([len(x) for x in copies])
        start = stop - np.array([len(x) for x in copies])
        walked = [(self.walk(k, ours, ours_stop - size, size, ours_stop), self.walk(k, theirs, start, size, stop)) for k in range(self.walks)]

        # a passage is met by a window at each of its unedited grams; one window is simulated, so the true share is higher
        found, added = np.zeros(len(copies), dtype=bool), 0
        while found.mean() < recall and added < 200:
            k, steps = added % self.walks, rng.random(self.coordinates) * _REACH
            self.tables.append((k, steps, g))
            t = len(self.tables)
            found |= self.keys(t, steps, walked[k][0], size) == self.keys(t, steps, walked[k][1], size)
            added += 1
        if found.mean() < recall:
            del self.tables[-added:]
            self.tables.append((0, np.zeros(0), g))  # samples nothing: every window meets every item of its size

    def windows(self, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, size) of the windows that can match."""
        at, gram = words.grams(3)
        some = self.filter[(gram & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at, gram = at[some], gram[some]
        lo, hi = np.searchsorted(self.gram, gram), np.searchsorted(self.gram, gram, side="right")
        count = hi - lo
        rep = np.repeat(np.arange(len(at)), count)
        entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        doc = np.searchsorted(words.first, at[rep], side="right") - 1
        size = self.gram_size[entry]
        start = np.maximum(at[rep] - self.gram_at[entry], words.first[doc])
        key, pick = np.unique(start * (self.steps + 1) + size, return_index=True)
        return doc[pick], start[pick], size[pick]

    def verbatim(self, words: K.Words) -> list[tuple[int, int, int, int, int]]:
        """The first places of items of one or two words, as ``search`` gives them."""
        out: list[tuple[int, int, int, int, int]] = []
        for n, (keys, items) in enumerate(self.short, 1):
            if not len(keys):
                continue
            at, gram = words.grams(n)
            lo, hi = np.searchsorted(keys, gram), np.searchsorted(keys, gram, side="right")
            hit = np.flatnonzero(hi > lo)
            doc = np.searchsorted(words.first, at[hit], side="right") - 1
            _, first = np.unique(np.stack([doc, lo[hit]], 1), axis=0, return_index=True)
            for d, w in zip(doc[first].tolist(), hit[first].tolist(), strict=True):
                place = int(at[w] - words.first[d])
                out += [(d, int(i), place, place + n, 0) for i in items[lo[w] : hi[w]]]
        return out

    def search(self, words: K.Words) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, edits) of all matches; words are counted within the document."""
        short = self.verbatim(words)
        if not self.items:
            return short
        doc, start, size = self.windows(words)
        if not len(doc):
            return short
        stop = words.first[doc + 1]
        pairs = []
        for at, key in self._keyed(words.hash, start, size, stop):
            lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
            for w in np.flatnonzero(hi > lo):
                pairs.append(np.stack([np.full(hi[w] - lo[w], at[w]), self.owner[lo[w] : hi[w]]], 1))
        if not pairs:
            return short
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for w, i in np.unique(np.concatenate(pairs), axis=0).tolist():
            d, base, limit = int(doc[w]), int(words.first[doc[w]]), int(self.limit[i])
            lo, hi = max(base, int(start[w]) - limit), min(int(stop[w]), int(start[w] + size[w]) + limit)
            if (i, lo, hi) in done:
                continue
            done.add((i, lo, hi))
            # each unedited word of the item is in the text: a bound that costs little
            if np.isin(self.items[i], words.hash[lo:hi]).sum() < self.size[i] - limit:
                continue
            cost, a, b = least_edits(self.items[i], words.hash[lo:hi])
            if cost <= limit:
                found = (cost, lo + a - base, lo + b - base)
                best[d, i] = min(best.get((d, i), found), found)
        return short + [(d, i, a, b, cost) for (d, i), (cost, a, b) in best.items()]


def _search(index: Index, names: list[str]):
    """Matches of batches whose last column is the text; the columns before it are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, text = batch.columns
            for i, _, data, bounds in K.slices(text):
                hits = index.search(words_of(data, bounds))
                if hits:
                    d, item, a, b, cost = zip(*hits, strict=True)
                    at = pa.array([i + x for x in d])
                    columns = [*(x.take(at) for x in keys), pa.array([index.ids[x] for x in item], pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(cost, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.999, walks: int = 6, coordinates: int = 2, block_words: int = 1 << 20, least_words: int = 1) -> DataFrame:
    """Matches: doc_id, item_id, start, end (words of the document), edits."""
    return _matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, rate, recall, walks, coordinates, block_words, least_words)


def _matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.999, walks: int = 6, coordinates: int = 2, block_words: int = 1 << 20, least_words: int = 1) -> DataFrame:
    """Matches in ``docs``, whose columns are long keys and text: keys, item_id, start, end, edits."""
    spark = docs.sparkSession
    arrow_rows(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = 1 + size // (6 * block_words)
    keys = docs.columns[:-1]
    names = [*keys, "item_id", "start", "end", "edits"]
    ddl = ", ".join(f"{k} long" for k in keys) + ", item_id long, start int, end int, edits int"
    base = docs.select(*keys, F.lower("text").alias("text"))
    out = None
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        found = base.mapInArrow(_search(Index(rows, rate, recall, walks, coordinates, least_words), names), ddl)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_words: int = 3, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``least_words`` or more; all columns stay.  Rows are told apart by id, null or not, and text."""
    key = free_names(docs.columns, "id", "h")
    rows = docs.select(F.col("doc_id").cast("long").alias(key[0]), F.xxhash64("text").alias(key[1]), "text")
    bad = _matches(rows, benchmark, least_words=least_words, **options).select(*key).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad[key[0]]) & (F.xxhash64(docs["text"]) == bad[key[1]])
    return docs.join(bad, same, "left_anti").select(*docs.columns)
