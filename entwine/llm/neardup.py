"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Method (Dahlgaard, Knudsen and Thorup 2017).  A sketch has ``t`` bins.  In round i < t every
shingle is thrown into a random bin, in round t <= i < 2t into bin i - t, and a bin keeps the
least (round, hash).  Later rounds are run only while a bin is empty, so every coordinate
fills, agreement of two sketches is an unbiased and concentrated estimate of the Jaccard
similarity, and a large set costs one or two rounds.

1. Documents with equal shingle sets form a class; from here on a class is one row.
2. ``bands`` bands of ``rows`` coordinates each: a pair at the threshold of 0.75 misses all
   24 bands of 3 with probability 2e-6.
3. Each class is paired with the leader (least id) of each of its buckets: as many pairs as
   rows, whatever the bucket's size.  Pairs are verified on the full shingle sets, and
   verified links joined to components.
4. Where members of a bucket remain in different components, blocks of up to 2048 members are
   compared with each other: pairs from different components with at least half of the
   sketch's coordinates equal (a pair at 0.75 fails this once in a million) are verified on
   the full sets there and then, and only links leave the task.  So no bucket is capped and no
   link is lost to the choice of leaders.

Shingle sets are compared by 64-bit hashes of the shingles.

Defined results.  Null, empty or blank text: n_shingles 0, linked with nothing, kept.  Fewer
than five words: the whole sequence is the one shingle.  Null id: comes before every other
id.  Rows that share an id and a text get equal results; rows that share an id only are
separate documents that report the same id.  Other columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, arrow_rows, free_names, partitions
from .components import connected_components

_NULL = -(2**63)
_BLOCK, _BLOCK_BYTES = 2048, 1 << 22


def shingles(data: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the sorted distinct shingles of document i are hashes[first[i]:first[i + 1]]."""
    words = K.split_words(K.LOWER[data], bounds)
    at, gram = words.grams(n)
    doc = np.searchsorted(words.first, at, side="right") - 1
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < n))
    gram = np.concatenate([gram, K.runs(words.hash, words.first[short], words.first[short + 1], K._GRAM)])
    doc = np.concatenate([doc, short])
    order = np.argsort(gram, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16) if words.n_docs < 65536 else doc[order], kind="stable")]
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return np.searchsorted(doc, np.arange(words.n_docs + 1)), gram


def sketch(first: np.ndarray, hashes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t values for each set; all ones for an empty set."""
    n = len(first) - 1
    top = np.uint64(2**64 - 1)
    out = np.full(n * t, top)
    doc = np.repeat(np.arange(n), np.diff(first))
    for i in range(2 * t):
        if not len(doc):
            break
        h = K.mix(hashes ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        # a value of round i is less than every value of a later round
        np.minimum.at(out, doc * t + bins, (np.uint64(i) << np.uint64(55)) | (K.mix(h) >> np.uint64(9)))
        full = (out.reshape(n, t) != top).all(1)
        left = ~full[doc]
        doc, hashes = doc[left], hashes[left]
    return out.reshape(n, t)


def _bands(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93), len(sk), 0)
    for r in range(rows):
        key = K.mix(key ^ sk[:, r::rows][:, :bands]) * np.uint64(0x9FB21C651E98DF25)
    return key.view(np.int64)


def _sets(bands: int, rows: int):
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size = np.zeros(n, dtype=np.int64)
            c, keys, sk8 = np.zeros((n, 2), dtype=np.uint64), np.zeros((n, bands), dtype=np.int64), np.zeros((n, t), dtype=np.uint8)
            for i, j, data, bounds in K.slices(batch.column(1)):
                first, h = shingles(data, bounds)
                size[i:j] = np.diff(first)
                for k, x in enumerate((h, K.mix(h ^ np.uint64(0xA0761D6478BD642F)))):
                    total = np.zeros(len(h) + 1, dtype=np.uint64)
                    np.cumsum(x, out=total[1:])
                    c[i:j, k] = total[first[1:]] - total[first[:-1]]
                s = sketch(first, h, t)
                keys[i:j] = _bands(s, bands, rows)
                sk8[i:j] = K.mix(s).astype(np.uint8)
            c[:, 0] += size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()).fill_null(_NULL),
                    batch.column(2),
                    pa.array(size),
                    pa.Array.from_buffers(pa.binary(16), n, [None, pa.py_buffer(c.tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                    pa.Array.from_buffers(pa.binary(t), n, [None, pa.py_buffer(sk8.tobytes())]).cast(pa.binary()),
                ],
                names=["id", "h", "n", "c", "bands", "sk"],
            )

    return run


def _verify(least: int):
    """Pairs (c, text, c0, text0) whose sets' Jaccard similarity is at least ``least`` percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, mine = None, None
        for batch in batches:
            lead = batch.column(2).to_pylist()
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i, j, data, bounds in K.slices(batch.column(1)):
                first, h = shingles(data, bounds)
                for k in range(i, j):
                    if lead[k] != have:
                        raw = np.frombuffer(batch.column(3)[k].as_buffer(), dtype=np.uint8)
                        have, mine = lead[k], shingles(raw, np.array([0, len(raw)]))[1]
                    other = h[first[k - i] : first[k - i + 1]]
                    if not len(mine) or not len(other):
                        continue
                    small, large = (other, mine) if len(other) < len(mine) else (mine, other)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    ok[k] = 100 * both >= least * (len(small) + len(large) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(2).filter(pa.array(ok))], names=["a", "b"])

    return run


_BLOCK_DDL = "block long, comps binary, cs binary, ns binary, sks binary, sets binary"


def _set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = []
        for i, j, data, bounds in K.slices(batch.column(1)):
            first, h = shingles(data, bounds)
            out += [h[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["c", "set"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs consecutive members into blocks of at most _BLOCK members and about _BLOCK_BYTES of shingles."""
    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close() -> pa.RecordBatch:
        comps, cs, ns, sks, sets = zip(*held, strict=True)
        row = (b"".join(comps), b"".join(cs), np.array(ns, dtype=np.int64).tobytes(), b"".join(sks), b"".join(sets))
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["block", "comps", "cs", "ns", "sks", "sets"])

    for batch in batches:
        for row in batch.to_pylist():
            held.append((row["comp"], row["c"], row["n"], row["sk"], row["set"]))
            size += len(row["set"])
            if len(held) == _BLOCK or size >= _BLOCK_BYTES:
                yield close()
                n, held, size = n + 1, [], 0
    if held:
        yield close()


def _block_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, cs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            members = [cs[i : i + 16] for i in range(0, len(cs), 16)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(members), pa.int64()), pa.array(members, pa.binary())], names=["block", "c"])


def _cross(least: int, t: int):
    """Links between members of two blocks that lie in different components, verified on the full sets."""

    def side(row: dict, x: str) -> tuple:
        n = np.frombuffer(row[f"ns{x}"], dtype=np.int64)
        return np.frombuffer(row[f"comps{x}"], dtype="V16"), np.frombuffer(row[f"cs{x}"], dtype="V16"), n, np.frombuffer(row[f"sks{x}"], dtype=np.uint8).reshape(-1, t), np.frombuffer(row[f"sets{x}"], dtype=np.uint64), np.concatenate([[0], np.cumsum(n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for row in batch.to_pylist():
                (pa_, ca, na, sa, va, oa), (pb, cb, nb, sb, vb, ob) = side(row, ""), side(row, "1")
                for i in range(len(ca)):
                    at = np.flatnonzero((100 * np.minimum(na[i], nb) >= least * np.maximum(na[i], nb)) & (pb != pa_[i]))
                    if row["block"] == row["block1"]:
                        at = at[at > i]
                    at = at[(sb[at] == sa[i]).sum(1) >= t // 2]
                    if not len(at):
                        continue
                    mine = va[oa[i] : oa[i + 1]]
                    theirs = np.concatenate([vb[ob[k] : ob[k + 1]] for k in at])
                    found = np.searchsorted(mine, theirs)
                    equal = mine[np.minimum(found, len(mine) - 1)] == theirs
                    both = K.sums_between(equal, np.concatenate([[0], np.cumsum(nb[at])]))
                    at = at[100 * both >= least * (na[i] + nb[at] - both)]
                    out[0].extend([ca[i].tobytes()] * len(at))
                    out[1].extend(x.tobytes() for x in cb[at])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])

    return run


def _residual(inside: DataFrame, classes: DataFrame, text_of, percent: int, t: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different components of one bucket; ``inside`` has key, c, comp.

    A member lies in one block only, next to members of its buckets; two blocks meet if a
    bucket has members in both.
    """
    spark = inside.sparkSession
    inside = scratch.write(inside.select("key", "c", "comp"))
    # members whose buckets overlap get one label, so that most of them share a block
    mine = inside.groupBy("c").agg(F.min("key").alias("l"), F.min("comp").alias("comp"))
    shared = inside.select("key", "c").join(mine.select("c", "l"), "c").groupBy("key").agg(F.min("l").alias("l"))
    label = inside.select("key", "c").join(shared, "key").groupBy("c").agg(F.min("l").alias("label"))
    placed = scratch.write(mine.join(label, "c"))
    sets = text_of(placed.select("c")).mapInArrow(_set_of, "c binary, set binary")
    members = placed.join(classes.select("c", "n", "sk"), "c").join(sets, "c").select("label", "l", "comp", "c", "n", "sk", "set")
    members = scratch.write(members)
    blocks = scratch.write(members.repartitionByRange(partitions(spark), "label", "l", "c").sortWithinPartitions("label", "l", "c").mapInArrow(_block_rows, _BLOCK_DDL))
    member_block = blocks.select("block", "cs").mapInArrow(_block_members, "block long, c binary")
    touched = inside.select("key", "c").join(member_block, "c").select("key", "block").distinct()
    meet = touched.join(touched.withColumnRenamed("block", "block1"), "key").filter("block < block1").select("block", "block1").distinct()
    other = [F.col(x).alias(f"{x}1") for x in blocks.columns]
    alone = blocks.select("*", *other)
    pairs = meet.join(blocks.hint("merge"), "block").join(blocks.select(*other).hint("merge"), "block1").select(*alone.columns)
    arrow_rows(spark, 2)
    links = scratch.write(alone.union(pairs).mapInArrow(_cross(percent, t), "a binary, b binary"))
    arrow_rows(spark)
    scratch.drop(inside, placed, members, blocks)
    return links


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, n_links (links of its class found on verified pairs), text_hash.

    Documents are linked at a Jaccard similarity of their 5-word shingle sets of ``percent``
    or more.  See the module's text for method and defined results.
    """
    return _marked(docs, **options).drop("first")


def _marked(docs: DataFrame, percent: int = 75, bands: int = 24, rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``near_duplicates`` with ``first``: id and text are the least of their component, or there are no shingles."""
    spark = docs.sparkSession
    arrow_rows(spark)
    scratch = Scratch(spark, "neardup")
    t = bands * rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    sets = scratch.write(texts.mapInArrow(_sets(bands, rows), "id long, h long, n long, c binary, bands array<long>, sk binary"))
    first = sets.filter("n > 0").groupBy("c").agg(F.min(F.struct("id", "h", "n", "bands", "sk")).alias("r"))
    classes = scratch.write(first.select("c", "r.*"))
    members = classes.select("c", "id", "n", F.explode("bands").alias("key"))
    leaders = members.groupBy("key").agg(F.min(F.struct("id", "c", "n")).alias("l"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "l")
    buckets = scratch.write(members.join(leaders, "key").select("key", "c", "n", F.col("l.c").alias("c0"), F.col("l.n").alias("n0")))
    alike = F.least("n", "n0") * 100 >= F.greatest("n", "n0") * percent
    pairs = scratch.write(buckets.filter((F.col("c") != F.col("c0")) & alike).select("c", "c0").distinct())

    def text_of(need: DataFrame) -> DataFrame:
        """(c, text) of the classes in ``need``."""
        where = need.join(classes.select("c", "id", "h"), "c")
        keyed = texts.withColumn("id", F.coalesce("id", F.lit(_NULL)))
        return keyed.join(where.hint("merge"), ["id", "h"]).select("c", "text").dropDuplicates(["c"])

    text = scratch.write(text_of(pairs.select("c").union(pairs.select("c0")).distinct()))
    left = pairs.join(text.hint("merge"), "c").select("c", "text", "c0")
    both = left.join(text.select(F.col("c").alias("c0"), F.col("text").alias("text0")).hint("merge"), "c0")
    links = scratch.write(both.select("c", "text", "c0", "text0").mapInArrow(_verify(percent), "a binary, b binary"))
    scratch.drop(text)
    labels = connected_components(links, scratch)
    placed = buckets.select("key", "c").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    if mixed.head(1):
        links = scratch.write(links.union(_residual(placed.join(mixed, "key"), classes, text_of, percent, t, scratch)))
        labels = connected_components(links, scratch)
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("a", "c")
    named = classes.select("c", "id", "h").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = named.groupBy("comp").agg(F.min(F.struct("id", "h")).alias("l")).select("comp", F.col("l.id").alias("component"), F.col("l.h").alias("first_h"))
    by_class = scratch.write(named.join(least, "comp").join(degree, "c", "left").select("c", "component", "first_h", "n_links"))
    scratch.drop(classes, buckets, pairs)
    out = sets.drop("bands", "sk").join(by_class, "c", "left")
    component = F.coalesce("component", "id")
    null = F.lit(_NULL)
    return out.select(
        F.when(F.col("id") != null, F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component != null, component).alias("component_id"),
        (component == F.col("id")).alias("kept"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("h").alias("text_hash"),
        (F.col("component").isNull() | ((F.col("component") == F.col("id")) & (F.col("first_h") == F.col("h")))).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, one row for each id and text; all columns stay.

    A component keeps its least id, and of rows that share that id the least text hash.  Rows
    of different components, and rows without shingles, stay whether they share an id or have none.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key = free_names(docs.columns, "id", "h")
    kept = _marked(docs, **options).filter("first").select(F.col("doc_id").alias(key[0]), F.col("text_hash").alias(key[1])).distinct()
    keyed = docs.withColumns({key[0]: docs[id_col].cast("long"), key[1]: F.xxhash64(text_col)})
    same = keyed[key[0]].eqNullSafe(kept[key[0]]) & (keyed[key[1]] == kept[key[1]])
    return keyed.join(kept.hint("merge"), same, "left_semi").dropDuplicates(key).select(*docs.columns)
