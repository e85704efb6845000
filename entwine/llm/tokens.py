"""Token ids in segment files: a concatenated id array with Elias-Fano document boundaries.

Documents are range-partitioned by id and sorted (or, with ``stored_order``, by their place in
the table they are read from); each partition writes segments of about ``segment_ids`` ids (a
document is never split, so one longer document is a segment of its own).  A segment is one self-contained binary image, held in the ``image`` column of a
Parquet table, so that any store Spark can write to will do and Spark's committer makes a
lost task's retry safe.  Layout, little-endian:

    "EFT1" | documents u32 | null ids u32 | ids u64 | bytes per id u8 | plain u8 | 2 zero bytes
    Elias-Fano part of the ends | Elias-Fano part of the document ids above the first
    first document id i64 | document ids i64, if plain | ids

``plain`` is 1 where document ids do not ascend; they are then stored as they are, with the
least 64-bit integer for a null id, and the second Elias-Fano part is empty.

An Elias-Fano part holds n ascending values below u: low bits l = floor(log2(u / n)) of each
value packed, high parts in unary in a bit vector, and the place of every 64th one of the
bit vector as u32 for ``select``.  It takes about 2 + log2(u / n) bits a value instead of 64.

Defined results.  Null text: no tokens but the end id.  Null id: before every other id.  Rows
that share an id: ordered by a hash of their text, each a document of its own; identical rows
in any order.  Other columns are ignored.  An empty table writes no segment and reads as empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, arrow_rows, partitions
from .vocab import default_path, pieces_of

_NULL = -(2**63)
_STEP = 64


class EliasFano:
    """Ascending values below 2**62 in near-minimal space, with random access by ``select``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, dtype=np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), ones[::_STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<IBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<IBIII", raw)
        at = struct.calcsize("<IBIII")
        return cls(n, low_bits, bytes(raw[at : at + a]), bytes(raw[at + a : at + a + b]), np.frombuffer(raw[at + a + b : at + a + b + 4 * c], dtype=np.uint32)), at + a + b + 4 * c

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def select(self, i: int) -> int:
        """Value i, from the sample before it and a scan of at most 63 further ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // _STEP]), i % _STEP
        while left:
            at += 1
            byte = self.high[at >> 3] >> (at & 7)
            if not byte:
                at |= 7
                continue
            at += (byte & -byte).bit_length() - 1
            left -= 1
        low = int.from_bytes(self.low[i * self.low_bits >> 3 : ((i + 1) * self.low_bits + 7) >> 3], "little") >> (i * self.low_bits & 7)
        return (at - i) << self.low_bits | low & ((1 << self.low_bits) - 1)


def segment_image(ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, wide: bool) -> bytes:
    """docs: the least 64-bit integer stands for a null id."""
    nulls = int((docs == _NULL).sum())
    plain = bool((docs[1:] < docs[:-1]).any())
    known = docs[:0] if plain else docs[nulls:]
    first = int(known[0]) if len(known) else 0
    above = (known.view(np.uint64) - np.uint64(first % 2**64)) if len(known) else known.view(np.uint64)
    head = struct.pack("<4sIIQBB2x", b"EFT1", len(docs), nulls, len(ids), 4 if wide else 2, plain)
    return head + EliasFano.build(ends).to_bytes() + EliasFano.build(above).to_bytes() + struct.pack("<q", first) + docs.astype("<i8").tobytes() * plain + ids.astype("<u4" if wide else "<u2").tobytes()


class Segment:
    """Reader of one image; ``document(i)`` touches only its own ids."""

    def __init__(self, image: bytes):
        raw = memoryview(image)
        magic, self.n_docs, self.nulls, self.n_ids, width, plain = struct.unpack_from("<4sIIQBB2x", raw)
        if magic != b"EFT1":
            raise ValueError("not a token segment")
        at = struct.calcsize("<4sIIQBB2x")
        self.ends, used = EliasFano.from_bytes(raw[at:])
        at += used
        self.above, used = EliasFano.from_bytes(raw[at:])
        at += used
        (self.first,) = struct.unpack_from("<q", raw, at)
        self.plain = np.frombuffer(raw[at + 8 :], dtype="<i8", count=self.n_docs) if plain else None
        at += 8 * self.n_docs * plain
        self.ids = np.frombuffer(raw[at + 8 :], dtype="<u4" if width == 4 else "<u2", count=self.n_ids)

    def doc_ids(self) -> list[int | None]:
        if self.plain is not None:
            return [None if x == _NULL else x for x in self.plain.tolist()]
        known = (self.above.values() + np.uint64(self.first % 2**64)).view(np.int64)
        return [None] * self.nulls + known.tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


_MARK, _ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[np.frombuffer(b".,;:!?#*$%&|)", dtype=np.uint8)] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _spread(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same tokens from fewer distinct pieces: lower case, and a space between a letter or digit and a mark after it.

    The vocabulary's pattern always cuts there.  A slice where "<|" could begin a special
    string stays as it is.
    """
    if b"<|" in data.tobytes():
        return data, bounds
    at = np.flatnonzero(_MARK[data[1:]] & _ALNUM[data[:-1]]) + 1
    return np.insert(K.LOWER[data], at, 32), bounds + np.searchsorted(at, bounds)


def encode_texts(path: str, end_id: int, data: np.ndarray, bounds: np.ndarray, lower_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents in a row, each followed by ``end_id``; end of each document).

    ``lower_case``: the vocabulary lower-cases and cuts words from marks.
    """
    if lower_case:
        data, bounds = _spread(data, bounds)
    raw = data.tobytes()
    split = [raw[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    ids, size = pieces_of(path).encode(list(chain.from_iterable(split)))
    total = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=total[1:])
    ends = total[np.cumsum(counts)]
    out = np.insert(ids, ends, end_id)
    return out, ends + np.arange(1, len(ends) + 1)


def _segments(path: str, end_id: int, segment_ids: int, wide: bool, lower_case: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, held, n_held = 0, [], 0

        def close() -> pa.RecordBatch:
            ids, ends, docs = zip(*held, strict=True)
            base = np.cumsum([0] + [len(x) for x in ids[:-1]])
            docs = np.concatenate(docs)
            image = segment_image(np.concatenate(ids), np.concatenate([e + b for e, b in zip(ends, base, strict=True)]), docs, wide)
            known = docs[docs != _NULL]
            edge = (int(known.min()), int(known.max())) if len(known) else (None, None)
            row = {"part": [part], "seq": [seq], "n_docs": [len(docs)], "n_ids": [n_held], "first_doc": [edge[0]], "last_doc": [edge[1]], "image": [image]}
            return pa.RecordBatch.from_pydict(row, schema=_SEGMENT)

        for batch in batches:
            docs = batch.column(0).cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False)
            for i, j, data, bounds in K.slices(batch.column(1)):
                ids, ends = encode_texts(path, end_id, data, bounds, lower_case)
                held.append((ids, ends, docs[i:j]))
                n_held += len(ids)
                if n_held >= segment_ids:
                    yield close()
                    seq, held, n_held = seq + 1, [], 0
        if held:
            yield close()

    return run


_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("image", pa.binary())])
_SEGMENT_DDL = "part int, seq int, n_docs long, n_ids long, first_doc long, last_doc long, image binary"


def token_segments(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, segment_ids: int = 1 << 21, vocabulary_size: int = 49408, id_col: str = "doc_id", text_col: str = "text", lower_case: bool = True, stored_order: bool = False) -> DataFrame:
    """One row per segment: part, seq (their order is the order of documents), n_docs, n_ids, first_doc, last_doc, image.

    ``lower_case``: the vocabulary lower-cases and cuts words from marks, as the default one does;
    a vocabulary that does not needs False.  ``stored_order``: documents come in the order of the
    files and rows that ``docs`` is read from, which must be a plain scan, not in that of their ids.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")] if stored_order else []))
    if stored_order:
        order = [F.length("part"), "part", "file", "at"]
        ordered = base.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("id", "text")
    else:
        order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]  # the hash also deals out the rows of one id
        ordered = base.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(_segments(vocabulary or default_path(), end_id, segment_ids, vocabulary_size > 65536, lower_case), _SEGMENT_DDL)


def write_tokens(docs: DataFrame, path: str, **options) -> None:
    """Writes the segments of ``docs`` as a table at ``path``."""
    token_segments(docs, **options).write.option("compression", "zstd").parquet(path)


def _decode(with_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(image.as_buffer())
                ends = s.ends.values().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                body = memoryview(s.ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(s.doc_ids(), pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(np.append(starts, ends[-1])), pa.array(s.ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the table at ``path``: doc_id, start, n_tokens, ids_crc32, and ids on request.

    ``start`` counts all ids before the document.  One sum per partition of the writer, and
    nothing larger, reaches the driver.
    """
    arrow_rows(spark, 1)
    segments = spark.read.parquet(path)
    sums = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")).alias("inside"))
    places = inside.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))
    out = segments.select("part", "seq", "image").join(places, ["part", "seq"]).select("base", "image")
    return out.mapInArrow(_decode(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_table(docs: DataFrame, **options) -> DataFrame:
    """Writes the segments of ``docs`` to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'tokens').root}/segments"
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)
