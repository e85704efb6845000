"""Quality rules: statistics of rules over whole texts, judged by an isolation forest.

Method.  Each text gives the counts that quality rules use.  An isolation forest over shares
made of them splits random features at random places; texts that few splits set apart are
anomalous.  The forest is fitted on about ``sample_rows`` labelled rows, chosen by a hash of
their id (that bound is the only one).  Then all labelled rows are scored and counted by score,
rounded up to 1 / 65536.  The threshold is the score at which the share of the good rows above
it, times ``care``, plus the share of the bad rows at or below it, is least, the highest of
those; only rows that pass the base rules count.

Base rules: fewer than 50 words, or more than half of the words in repeated 3-word windows.

Defined results.  Null or blank text: all counts 0, base_failed, not kept.  No usable label
(no row with a quality and a document): only the base rules decide.  Null id: judged like
others, never used as a label.  Several labels of an id: each counts.  Repeated rows get
equal results.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, arrow_rows

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[np.frombuffer(b".,;:!?", dtype=np.uint8)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punct", "n_upper", "n_distinct"]
MIN_WORDS, REPEAT_PERCENT = 50, 50
_BINS = 1 << 16


def _grouped(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by document then value, whether each entry equals the one before it in that order)."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (values[order[1:]] == values[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return order, same


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of COUNTS for each document."""
    n = len(bounds) - 1
    words = K.split_words(data, bounds)
    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    out[:, 0] = np.diff(words.first)
    out[:, 1] = K.sums_between(~K.SPACE[data] & ((data & 0xC0) != 0x80), bounds)
    for column, table in ((2, _SYMBOL), (5, _PUNCT), (6, _UPPER)):
        out[:, column] = K.sums_between(table[data], bounds)
    # lines with a word
    cuts = np.unique(np.concatenate([bounds, np.flatnonzero(data == 10) + 1]))
    start, end = cuts[:-1], cuts[1:]
    end = np.where((end > start) & (data[np.maximum(end, 1) - 1] == 10), end - 1, end) if len(data) else end
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has], end[has]
    doc = np.searchsorted(bounds, start, side="right") - 1
    order, same = _grouped(K.runs(K._BYTE[data], start, end, K._BASE), doc)
    out[:, 3] = np.bincount(doc[order][same], minlength=n)
    # words in repeated windows
    at, gram = words.grams(3)
    doc = np.searchsorted(words.first, at, side="right") - 1
    order, same = _grouped(gram, doc)
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(words.start) + 3, dtype=bool)
    for k in range(3):
        cover[at[order[twice]] + k] = True
    out[:, 4] = K.sums_between(cover[: len(words.start)], words.first)
    order, same = _grouped(words.hash, words.doc)
    out[:, 7] = out[:, 0] - np.bincount(words.doc[order][same], minlength=n)
    return out


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS for each row of ``docs``."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.zeros((batch.num_rows, len(COUNTS)), dtype=np.int64)
            for i, j, data, bounds in K.slices(batch.column(1)):
                c[i:j] = counts(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in c.T)], names=["doc_id", *COUNTS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def shares(c: np.ndarray) -> np.ndarray:
    """Features of the forest: word length, symbols and marks per word, capitals per character, spread of the vocabulary.

    Repeated lines and windows are left to the base rules; as features they only made good
    texts with a refrain anomalous.
    """
    n = np.maximum(c[:, 0], 1)
    return np.stack([c[:, 1] / n, c[:, 2] / n, c[:, 5] / n, c[:, 6] / np.maximum(c[:, 1], 1), np.log(np.maximum(c[:, 7], 1)) / np.log(n + 1)], 1)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), cut, the two children, path length at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = 200, rows: int = 256, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.rows)))))
        self.trees = [self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def node(x: np.ndarray, depth: int) -> int:
            me = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (path, depth + float(_mean_path(len(x))))):
                column.append(value)
            lo, hi = (x.min(0), x.max(0)) if len(x) else (0, 0)
            varies = np.flatnonzero(hi > lo) if len(x) > 1 else []
            if depth < self.depth and len(varies):
                f = int(rng.choice(varies))
                c = rng.uniform(lo[f], hi[f])
                feature[me], cut[me] = f, c
                left[me] = node(x[x[:, f] <= c], depth + 1)
                right[me] = node(x[x[:, f] > c], depth + 1)
            return me

        node(x, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score from 0 to 1; about 0.5 for ordinary rows."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[row, f] <= cut[at], left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_mean_path(self.rows)), 1e-9))


def _base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > REPEAT_PERCENT * c[:, 0])


def fit(c: np.ndarray) -> IsolationForest | None:
    """c: COUNTS of labelled rows."""
    c = c[~_base_failed(c)]
    return IsolationForest(shares(c)) if len(c) else None


def threshold(bins: list[int], good: list[int], bad: list[int], care: float) -> float | None:
    """The score to keep up to, from the counts of good and bad rows by score bin; None without good rows."""
    order = np.argsort(np.array(bins, dtype=np.int64))
    g, b = (np.array(x, dtype=np.int64)[order] for x in (good, bad))
    if not g.sum():
        return None
    cost = care * (1 - np.cumsum(g) / g.sum()) + np.cumsum(b) / max(1, b.sum())
    at = np.flatnonzero(g > 0)  # a cut above a good row is never worse than one just below
    best = at[len(at) - 1 - int(cost[at][::-1].argmin())]
    return float(bins[order[best]]) / _BINS


def _scored(forest: IsolationForest | None, c: np.ndarray) -> np.ndarray:
    """Anomaly scores, rounded up to whole bins."""
    return np.ceil(forest.score(shares(c)) * _BINS) / _BINS if forest and len(c) else np.zeros(len(c))


def _matrix(columns: list[pa.Array], n: int) -> np.ndarray:
    return np.stack([x.to_numpy() for x in columns], 1) if n else np.zeros((0, len(COUNTS)), dtype=np.int64)


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, care: float = 4.0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.write(rule_counts(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null and quality is not null")
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = known.filter(draw < min(1.0, sample_rows / max(1, n))).join(stats, "doc_id").select("quality", *COUNTS).toArrow()
    rows = np.array(sorted(zip(*(sample.column(k).to_pylist() for k in range(1 + len(COUNTS))), strict=True)), dtype=np.int64).reshape(-1, 1 + len(COUNTS))
    forest = fit(rows[:, 1:])
    arrow_rows(docs.sparkSession, 10_000)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _matrix(batch.columns[1:], batch.num_rows)
            use = pa.array(~_base_failed(c))
            at = pa.array((_scored(forest, c) * _BINS).astype(np.int64))
            yield pa.RecordBatch.from_arrays([at.filter(use), batch.column(0).filter(use)], names=["bin", "good"])

    judged = known.select("doc_id", (F.col("quality") > 0).alias("good")).join(stats, "doc_id").select("good", *COUNTS)
    one = judged.mapInArrow(labelled, "bin long, good boolean").groupBy("bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect() if forest else []
    most = threshold([r.bin for r in one], [r.good for r in one], [r.bad for r in one], care)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _matrix(batch.columns[1:], batch.num_rows)
            failed, score = _base_failed(c), _scored(forest, c)
            kept = ~failed & (score <= most if most is not None else True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(kept), pa.array(score)], names=[*batch.schema.names[:6], "base_failed", "kept", "anomaly"])

    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, anomaly double")
