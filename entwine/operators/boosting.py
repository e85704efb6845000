"""Gradient-boosted trees as Spark ML fits them, without a Spark job for each level of each tree.

Trees see a row by the bins of its features only.  So rows are binned (all rows decide the cuts; Spark
takes a sample beyond 10,000), equal rows of bins are summed by label, which loses nothing, and one task
boosts the sums.  The result is Spark's own model.  Of splits that are equal but for rounding the first
counts, by feature and threshold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEAST = 2.0**-52  # as Spark's MLUtils.EPSILON: below it a node is pure, or a split gains nothing
_NODES = "org.apache.spark.ml.tree.DecisionTreeModelReadWrite"


def cuts(values: np.ndarray, weights: np.ndarray, most: int) -> list[float]:
    """Thresholds that part ascending distinct values into at most ``most`` bins of about equal weight."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < most:
        return middle.tolist()
    total = np.cumsum(weights)
    half = (total[:-1] + total[1:]) / 2  # a cut before a value is nearer to its target than one after it if half is beyond
    out, at, k = [], 0, 1
    while (at := max(at, int(np.searchsorted(half, k * total[-1] / most, "right")))) < len(middle):
        out.append(float(middle[at]))
        at, k = at + 1, k + 1
    return out


def _grow(bins: np.ndarray, sizes: list[int], w: np.ndarray, s: np.ndarray, q: np.ndarray, n: np.ndarray, depth: int) -> tuple[list[dict], np.ndarray]:
    """One regression tree by variance, level by level: its nodes and the prediction for each row.

    bins: a row for each feature; w, s, q: sums of weights, of weighted values and of their squares.  A node's
    split is (feature, bin); bins up to it go left.
    """
    nodes: list[dict] = []
    out, rows, slot, ids = np.zeros(len(w)), np.arange(len(w)), np.zeros(len(w), np.int64), [0]
    which = np.repeat(np.arange(len(sizes)), [x - 1 for x in sizes])
    first = np.concatenate([[0], np.cumsum([x - 1 for x in sizes])])
    for level in range(depth + 1):
        m, rw, rs = len(ids), w[rows], s[rows]
        tw, ts, tq, tn = (np.bincount(slot, x, m) for x in (rw, rs, q[rows], n[rows]))
        mean, impurity = ts / tw, (tq - ts * ts / tw) / tw
        nodes += [
            {"id": i, "prediction": float(mean[j]), "impurity": float(impurity[j]), "impurityStats": [float(tw[j]), float(ts[j]), float(tq[j])], "rawCount": int(tn[j]), "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": None}
            for j, i in enumerate(ids)
        ]
        out[rows] = mean[slot]
        if level == depth or not len(which):
            break
        gains = np.full((m, len(which)), -np.inf)
        for f, size in enumerate(sizes):
            if size > 1:
                code = slot * size + bins[f][rows]
                lw, ls = (np.bincount(code, x, m * size).reshape(m, size).cumsum(1)[:, :-1] for x in (rw, rs))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = ls * ls / lw + (ts[:, None] - ls) ** 2 / (tw[:, None] - lw) - (ts * ts / tw)[:, None]
                gains[:, first[f] : first[f + 1]] = np.where((lw > 0) & (lw < tw[:, None]), gain, -np.inf)
        best = gains.max(1)
        chosen = np.argmax(gains >= (best - 1e-9 * np.abs(best))[:, None], 1)
        split = (best / tw > _LEAST) & (impurity > _LEAST)
        child, after = np.full(m, -1), []
        for j in np.flatnonzero(split):
            child[j] = len(after)
            left = len(nodes) + len(after)
            after += [left, left + 1]
            nodes[ids[j]] |= {"gain": float(best[j] / tw[j]), "leftChild": left, "rightChild": left + 1, "split": (int(which[chosen[j]]), int(chosen[j] - first[which[chosen[j]]]))}
        if not after:
            break
        keep = split[slot]
        rows, slot = rows[keep], slot[keep]
        right = bins[which[chosen[slot]], rows] > (chosen - first[which[chosen]])[slot]
        slot, ids = child[slot] + right, after
    return nodes, out


def boosted(bins: np.ndarray, sizes: list[int], w0: np.ndarray, w1: np.ndarray, n: np.ndarray, trees: int, rate: float, depth: int) -> Iterator[list[dict]]:
    """Nodes of each tree, by Spark's log loss; w0, w1: weights of both labels."""
    w, margin = w0 + w1, np.zeros(len(w0))
    for k in range(trees):
        r0, r1 = (np.full(len(w), x) for x in (-1.0, 1.0)) if k == 0 else (-4 / (1 + np.exp(-2 * margin)), 4 / (1 + np.exp(2 * margin)))
        nodes, out = _grow(bins, sizes, w, w0 * r0 + w1 * r1, w0 * r0 * r0 + w1 * r1 * r1, n, depth)
        margin += out if k == 0 else rate * out
        yield nodes


def _json(nodes: list[dict], at: list[list[float]]) -> str:
    def split(x: tuple[int, int] | None) -> dict:
        return {"featureIndex": x[0], "leftCategoriesOrThreshold": [at[x[0]][x[1]]], "numCategories": -1} if x else {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}

    return json.dumps([x | {"split": split(x["split"])} for x in nodes], allow_nan=False)


def _cut(most: int):
    def run(table: pa.Table) -> pa.Table:
        v, w = (table.column(c).to_numpy() for c in ("v", "w"))
        order = np.argsort(v)
        return pa.table({"f": table.column("f")[:1], "cuts": pa.array([cuts(v[order], w[order], most)], pa.list_(pa.float64()))})

    return run


def _bin(at: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, one, w = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(at)), b.column("y").to_numpy() > 0, b.column("w").to_numpy()
            k = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(at)], 1).astype(np.uint8)
            keys = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer((np.arange(len(k) + 1) * len(at)).astype(np.int32)), pa.py_buffer(k.tobytes())])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.where(one, 0.0, w)), pa.array(np.where(one, w, 0.0)), pa.array(np.ones(len(k), np.int64))], ["k", "w0", "w1", "n"])

    return run


def _boost(at: list[list[float]], trees: int, rate: float, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []
        for b in batches:
            keys.append(np.frombuffer(b"".join(b.column("k").to_pylist()), np.uint8).reshape(-1, len(at)))
            sums.append([b.column(c).to_numpy() for c in ("w0", "w1", "n")])
        if keys:
            bins = np.concatenate(keys).T
            order = np.lexsort(bins)  # sums of floats depend on the order
            w0, w1, n = (np.concatenate(x)[order] for x in zip(*sums, strict=True))
            for k, nodes in enumerate(boosted(np.ascontiguousarray(bins[:, order]), [len(c) + 1 for c in at], w0, w1, n, trees, rate, depth)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_json(nodes, at)])], ["tree", "nodes"])

    return run


def _fitted(rows: DataFrame, features: int, most: int, trees: int, rate: float, depth: int) -> list[str]:
    """The nodes of each tree as JSON.  rows: x (array of features), y (label), w (weight)."""
    values = rows.select(F.posexplode("x").alias("f", "v"), "w").groupBy("f", "v").agg(F.sum("w").alias("w"))
    at = dict(values.groupBy("f").applyInArrow(_cut(most), "f int, cuts array<double>").collect())
    if not at:
        raise ValueError("boosted trees need a row at least")
    thresholds = [at[f] for f in range(features)]
    binned = rows.mapInArrow(_bin(thresholds), "k binary, w0 double, w1 double, n long")
    groups = binned.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("w0", "w1", "n")))
    return [r.nodes for r in groups.repartition(1).mapInArrow(_boost(thresholds, trees, rate, depth), "tree int, nodes string").orderBy("tree").collect()]


class BoostedTrees(GBTClassifier):
    """GBTClassifier for numeric features, all rows and all features in each tree."""

    def _fit_java(self, dataset: DataFrame):
        x = vector_to_array(self.getFeaturesCol())
        rows = dataset.select(x.alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), F.col(self.getWeightCol()).cast("double").alias("w"))
        features = dataset.select(F.size(x)).first()
        trees = _fitted(rows, features[0] if features else 0, self.getMaxBins(), self.getMaxIter(), self.getStepSize(), self.getMaxDepth())
        sc = dataset.sparkSession.sparkContext
        jvm, ml = sc._jvm, sc._jvm.org.apache.spark.ml
        mapper = jvm.com.fasterxml.jackson.databind.ObjectMapper()
        mapper.registerModule(jvm.com.fasterxml.jackson.module.scala.DefaultScalaModule())
        kind, build = jvm.java.lang.Class.forName(f"[L{_NODES}$NodeData;"), getattr(jvm.java.lang.Class.forName(f"{_NODES}$").getField("MODULE$"), "get")(None)
        models, weights = (sc._gateway.new_array(c, len(trees)) for c in (ml.regression.DecisionTreeRegressionModel, jvm.double))
        for k, nodes in enumerate(trees):
            root = build.buildTreeFromNodes(mapper.readValue(nodes, kind), "variance")
            models[k] = ml.regression.DecisionTreeRegressionModel(ml.util.Identifiable.randomUID("dtr"), root, features[0])
            weights[k] = self.getStepSize() if k else 1.0
        return ml.classification.GBTClassificationModel(self.uid, models, weights, features[0], 2)
