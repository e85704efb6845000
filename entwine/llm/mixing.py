"""Mixing sources to target weights with a low-discrepancy source schedule.

Method.  Slot n of the mix takes the point frac(n * golden ratio); the cumulative targets map
it to a source.  Slots are ranked per source by counts of fixed chunks of slots, so no source
is ranked in one task.  Each source's documents, in the order of a seeded hash, make a cyclic
stream of words that is cut into blocks of ``block_words``; the slot of rank k takes block k.
The last block of a source is cut where its target ends; slots beyond that stay empty, and
blocks the points leave over get slots at the end.  So the schedule decides at which slots a
document stands in the mix, and the targets how much of it is taken.

Targets.  Sources in code-point order (null last) weigh ``weights`` in turn and share
``share`` times the words of all documents; a target stops at ``most`` times its source's
words and the excess is shared again by weight until none is above.  One row per source, and
nothing larger, reaches the driver.

Defined results.  Null or blank text: size 0, taken 0, no slot.  A source without words has
target 0.  Null source: a source of its own, ordered last.  Rows that share an id are separate
documents; K identical rows are K documents that stand next to each other in the stream.  Null
id: a document like others.  Other columns are ignored, whatever their names.  Very long
texts: many blocks.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, Scratch, free_names, n_words, partitions

_PHI = 0x9E3779B97F4A7C15
_CHUNK = 1 << 16


def targets(sizes: list[int], weights: tuple[float, ...], share: float, most: float) -> list[float]:
    """Words each source is to give; sources are in order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    active = [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while active:
        per = left / sum(w[i] for i in active)
        over = [i for i in active if per * w[i] > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = per * w[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        active = [i for i in active if per * w[i] <= most * sizes[i]]
    return out


def _slots(first: int, n: int, cuts: np.ndarray, step: int = _PHI) -> np.ndarray:
    """Source of the slots first .. first + n - 1."""
    at = np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(step)
    return np.searchsorted(cuts, at, side="right")


def _cuts(words: list[int]) -> np.ndarray:
    """Points at which one source ends and the next begins."""
    total, so_far, out = sum(words), 0, []
    for w in words[:-1]:
        so_far += w
        out.append(min(2**64 - 1, so_far * 2**64 // total) if total else 0)
    return np.array(out, dtype=np.uint64)


def _schedule(spark, n_slots: int, words: list[int], need: list[int], step: int) -> DataFrame:
    """(slot, sid, rank): exactly the ranks 0 .. need - 1 of every source."""
    cuts = _cuts(words)
    chunks = max(1, -(-n_slots // _CHUNK))
    k = len(words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                n = np.bincount(_slots(c * _CHUNK, min(_CHUNK, n_slots - c * _CHUNK), cuts, step), minlength=k)
                s = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), c)), pa.array(s.astype(np.int32)), pa.array(n[s].astype(np.int64))], names=["chunk", "sid", "n"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.array(need, dtype=np.int64)
        for batch in batches:
            for c, sids, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                start = np.zeros(k, dtype=np.int64)
                start[sids] = base
                s = _slots(c * _CHUNK, min(_CHUNK, n_slots - c * _CHUNK), cuts, step)
                order = np.argsort(s, kind="stable")
                rank = np.empty(len(s), dtype=np.int64)
                rank[order] = np.arange(len(s)) - np.searchsorted(s[order], s[order])
                rank += start[s]
                ok = rank < limit[s]
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(ok) + c * _CHUNK), pa.array(s[ok].astype(np.int32)), pa.array(rank[ok])], names=["slot", "sid", "rank"])

    counts = spark.range(0, chunks, numPartitions=min(chunks, partitions(spark))).mapInArrow(counted, "chunk long, sid int, n long")
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.withColumn("base", F.coalesce(before, F.lit(0).cast("long")))
    by_chunk = bases.groupBy("chunk").agg(F.collect_list("sid").alias("sids"), F.collect_list("base").alias("bases"))
    slots = by_chunk.mapInArrow(ranked, "slot long, sid int, rank long")
    have = {r.sid: r.n for r in counts.groupBy("sid").agg(F.sum("n").alias("n")).collect()}
    tail, at = [], n_slots
    for s in range(k):
        if need[s] > have.get(s, 0):
            tail.append((at, s, have.get(s, 0), need[s] - have.get(s, 0)))
            at += need[s] - have.get(s, 0)
    if tail:
        rest = spark.createDataFrame(tail, "slot long, sid int, rank long, n long").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        slots = slots.union(rest.select(F.col("slot") + F.col("i"), "sid", F.col("rank") + F.col("i")))
    return slots


def _order(id_col: str, text_col: str, seed: int) -> Column:
    """Place of a document in its source's stream: 60 bits of MD5 of seed, id and text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 256, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", step: int = _PHI, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: row, copy, doc_id, size, source_size, target, one for each row of ``docs``.
    ``row`` (sid, r, doc_id, h, x) is a number of the source, the place in its stream, id, text hash
    and the column ``row``; rows that agree in it are told apart by ``copy`` 0, 1, ...
    pieces: slot, row, copy, pass, start, end: in slot order the words [start, end) that
    the mix takes; ``pass`` 0 is the first time through the source's stream.
    ``step`` is the way from one point to the next, in 2**-64: the golden ratio.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    each = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        _order(id_col, text_col, seed).alias("r"),
        F.xxhash64(text_col).alias("h"),
        (F.lit(0).cast("long") if row is None else row).alias("x"),
    )
    # identical rows are one row with a count from here to the explosion into copies
    sized = scratch.write(each.groupBy("source", "r", "doc_id", "h", "x", "size").agg(F.count(F.lit(1)).alias("copies")))
    sums = {x.source: (x.size, x.n) for x in sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(x for x in sums if x is not None) + [None] * (None in sums)
    sizes = [sums[x][0] for x in names]
    goal = targets(sizes, weights, share, most)
    words = [min(int(g + 0.5), int(most * s)) for g, s in zip(goal, sizes, strict=True)]
    need = [-(-w // block_words) for w in words]
    sources = spark.createDataFrame([(i, x, s, g, w) for i, (x, s, g, w) in enumerate(zip(names, sizes, goal, words, strict=True))], "sid int, source string, source_size long, target double, words long")
    sources = F.broadcast(sources) if sum(len(x or "") + 40 for x in names) <= 1 << 23 else sources
    # a bucket holds about a thousand rows; sums over buckets are taken in two levels, so that no source is summed in one task
    bits = max(0, (sum(n for _, n in sums.values()) >> 10).bit_length())
    known = sized.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    known = known.withColumn("bucket", F.shiftrightunsigned("r", 60 - bits)).withColumn("words_of", F.col("size") * F.col("copies"))
    per_bucket = known.groupBy("sid", "bucket").agg(F.sum("words_of").alias("n")).withColumn("block", F.shiftright("bucket", 10))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    over = per_bucket.groupBy("sid", "block").agg(F.sum("n").alias("n")).select("sid", "block", F.coalesce(F.sum("n").over(before.partitionBy("sid").orderBy("block")), zero).alias("outer"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("sid", "block").orderBy("bucket")), zero)
    bases = per_bucket.withColumn("inner", inner).join(over, ["sid", "block"]).select("sid", "bucket", (F.col("inner") + F.col("outer")).alias("base"))
    so_far = F.coalesce(F.sum("words_of").over(before.partitionBy("sid", "bucket").orderBy("r", F.col("doc_id").asc_nulls_first(), "h", "x")), zero)
    placed = known.withColumn("so_far", so_far).join(bases, ["sid", "bucket"])
    placed = placed.withColumn("copy", F.explode(F.sequence(zero, F.col("copies") - 1)))
    off = F.col("base") + F.col("so_far") + F.col("copy") * F.col("size")
    placed = scratch.write(placed.select(F.struct("sid", "r", "doc_id", "h", "x").alias("row"), "copy", "doc_id", "sid", "size", "source_size", "target", "words", off.alias("off")))
    # passes of the source's stream that reach the document, then the blocks that each pass touches
    passes = placed.filter("size > 0 and words > 0").withColumn("pass", F.explode(F.sequence(zero, F.expr("(words - 1) div source_size"))))
    span = passes.withColumn("lo", F.col("pass") * F.col("source_size") + F.col("off")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "words")).filter("lo < hi")
    cut = span.withColumn("rank", F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})")))
    cut = cut.select("row", "copy", "sid", "pass", "rank", (F.greatest("lo", F.col("rank") * block_words) - F.col("lo")).alias("start"), (F.least("hi", (F.col("rank") + 1) * block_words) - F.col("lo")).alias("end"))
    n_slots = -(-sum(words) // block_words)
    pieces = scratch.write(cut.join(_schedule(spark, n_slots, words, need, step), ["sid", "rank"]).select("slot", "row", "copy", "pass", "start", "end"))
    return placed.select("row", "copy", "doc_id", "size", "source_size", "target"), pieces


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, first_slot, last_slot, n_pieces (slots null where nothing is taken)."""
    documents, pieces = mix_sources(docs, **options)
    taken = pieces.groupBy("row", "copy").agg(F.sum(F.col("end") - F.col("start")).alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("n_pieces"))
    zero = F.lit(0).cast("long")
    return documents.join(taken, ["row", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), "first_slot", "last_slot", F.coalesce("n_pieces", zero).alias("n_pieces"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``, in the order of slots: one row for each pass through a document.

    A document stands at the slot of its first piece.  Rows are range-partitioned by slot and
    sorted, so files written of them are in mix order.  A document cut by the end of its
    source's target keeps the words before the cut, joined by one space; ``n_chars`` is set to
    the text's code points.  K identical rows give the takes of K documents.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    whole_row = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    documents, pieces = mix_sources(docs, row=whole_row, **options)
    takes = pieces.groupBy("row", "copy", "pass").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.min("slot").alias("slot"))
    key = free_names(docs.columns, "id", "h", "x", "lo", "hi", "slot")
    some = F.lit(-(2**63))  # a null id; equal keys on both sides of the join save a shuffle
    takes = takes.select(F.coalesce("row.doc_id", some).alias(key[0]), *(F.col(c).alias(k) for c, k in zip(("row.h", "row.x", "lo", "hi", "slot"), key[1:], strict=True)))
    keyed = docs.withColumns({key[0]: F.coalesce(F.col(id_col).cast("long"), some), key[1]: F.xxhash64(text_col), key[2]: whole_row})
    out = keyed.dropDuplicates(key[:3]).join(takes.hint("merge"), key[:3])
    lo, hi, slot = (F.col(k) for k in key[3:])
    whole = (lo == 0) & (hi == n_words(F.col(text_col)))
    part = F.array_join(F.slice(F.array_remove(F.split(text_col, WS), ""), (lo + 1).cast("int"), (hi - lo).cast("int")), " ")
    out = out.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"]))
    most = (pieces.agg(F.max("slot")).head()[0] or 0) + 1
    out = out.repartitionById(n, F.expr(f"cast({key[5]} * {n} div {most} as int)"))
    return out.sortWithinPartitions(key[5], key[3], id_col).select(*docs.columns)
