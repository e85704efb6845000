"""Language identification in two steps: the family, then the language within the family.

Method.  Features are shares of hashed 3- and 4-byte grams of the lower-cased letters.  One
linear support vector machine per family, against the rest, gives the family; within it one
machine for every two languages votes.  Machines are trained here by dual coordinate descent
(squared hinge loss) on a sample of about ``sample_rows`` labelled rows, even over languages
and chosen by a hash of the id; that bound is the only one, and every text is read whole.

Learning uses text and lang of rows whose crc32(id as text) mod 4 is not 2; a prediction uses
the text only.

Defined results.  Null text, or a text without a letter: ``und``, score 0.  Null id: never
learnt from, held_out false.  Null lang: never learnt from.  A language code without a known
family is a family of its own.  Nothing to learn from: every prediction is ``und``, score 0.
One language only: it is predicted for every text with a letter.  Ties: the more negative
side, that is the language later in code-point order.  Repeated rows get equal results.
Other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from . import kernels as K
from .common import arrow_rows, free_memory, free_names

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "indic": "hi bn mr ne pa gu or as ur sa".split(),
    "semitic": "ar he mt am".split(),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 12
_HEAD = 1024
_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[:] = 32
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shares of hashed grams, one row for each document."""
    n, size = len(bounds) - 1, 1 << BITS
    text = _LETTERS[data].astype(np.uint32)
    letter = text != 32
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n * size)
    for order in (3, 4):
        m = len(text) - order + 1
        if m <= 0:
            continue
        h = np.full(m, 0x9E3779B1 * order & 0xFFFFFFFF, dtype=np.uint32)
        some = np.zeros(m, dtype=bool)
        for k in range(order):
            h = (h ^ text[k : k + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            some |= letter[k : k + m]
        ok = some & (doc[:m] == doc[order - 1 :])
        out += np.bincount(doc[:m][ok] * size + (h[ok] >> np.uint32(32 - BITS)), minlength=n * size)
    out = out.reshape(n, size).astype(np.float32)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = K.sums_between(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128), bounds) > 0
    for i in np.flatnonzero(~out & (K.sums_between(data >= 128, bounds) > 0)):
        out[i] = any(ch.isalpha() for ch in data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60, seed: int = 0) -> np.ndarray:
    """Weights of a linear machine for labels +1 and -1; both classes get the same total cost."""
    gram = x @ x.T
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, ridge = np.zeros(len(y)), 1 / (2 * cost)
    value = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = max(0.0, alpha[i] - (y[i] * value[i] - 1 + alpha[i] * ridge[i]) / (gram[i, i] + ridge[i]))
            step = new - alpha[i]
            if step:
                alpha[i] = new
                value += step * y[i] * gram[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    side = alpha * y
    return np.concatenate([side @ x[:, k : k + 512] for k in range(0, x.shape[1], 512)])  # as doubles, some columns at a time


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    of: list[int]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.ones((len(x), 1), dtype=np.float32)], 1) @ self.weights

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language numbers, scores)."""
        n = len(x)
        m = self.margins(x)
        if len(self.families) > 1:
            fam = m[:, : len(self.families)]
            best = fam.argmax(1)
            top = np.sort(fam, 1)
            sure = (top[:, -1] - top[:, -2]) / 2
        else:
            best, sure = np.zeros(n, dtype=int), np.full(n, np.inf)
        votes = np.where(np.array(self.of)[None] == best[:, None], 0.0, -np.inf)
        least = np.full((n, len(self.languages)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            v = m[:, len(self.families) + k]
            votes[:, a] += v > 0
            votes[:, b] += v <= 0
            least[:, a] = np.minimum(least[:, a], v)
            least[:, b] = np.minimum(least[:, b], -v)
        choice = (votes + 1e-3 * np.tanh(np.clip(least, -20, 20))).argmax(1)
        sure = np.minimum(sure, least[np.arange(n), choice])
        return choice, 1 / (1 + np.exp(-np.clip(3 * sure, -30, 30)))


def fit(x: np.ndarray, lang: list[str]) -> Model:
    """x: features of the sample; lang: their languages."""
    z = np.ones((len(x), x.shape[1] + 1), dtype=np.float32)
    z[:, :-1] = x
    return _fit(z, lang)


def _fit(z: np.ndarray, lang: list[str]) -> Model:
    """z: features and a column of ones; it is scaled in place, so that the driver holds the sample once."""
    x = z[:, :-1]
    languages = sorted(set(lang))
    family = [FAMILY.get(v.lower().split("-")[0].split("_")[0], f"={v}") for v in languages]
    families = sorted(set(family))
    of = [families.index(f) for f in family]
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    np.multiply(x, scale, out=x, casting="same_kind")
    y = np.array([languages.index(v) for v in lang])
    fy = np.array(of)[y]
    columns = [train_svm(z, np.where(fy == f, 1.0, -1.0)) for f in range(len(families))] if len(families) > 1 else [np.zeros(z.shape[1])]
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if of[a] == of[b]]
    for a, b in pairs:
        at = np.flatnonzero((y == a) | (y == b))
        columns.append(train_svm(z[at], np.where(y[at] == a, 1.0, -1.0)))
    return Model(languages, families, of, pairs, (np.stack(columns, 1) * np.append(scale, 1)[:, None]).astype(np.float32))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model from the rows that may be learnt from; None if there is none."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in K.slices(batch.column(0), 1 << 20):
                ok = has_letter(data, bounds)
                x = features(data, bounds)[ok]
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary()), batch.column(1).slice(i, j - i).filter(pa.array(ok))], names=["x", "lang"])

    sample = rows.filter(draw < share[F.col("lang")]).select("text", "lang").mapInArrow(run, "x binary, lang string").toArrow()
    if not sample.num_rows:
        return None
    packed, lang = (c.to_pylist() for c in sample.columns)
    del sample
    free_memory(docs.sparkSession)
    return _fit(*_sample(packed, lang))


def _sample(packed: list[bytes], lang: list[str]) -> tuple[np.ndarray, list[str]]:
    """Features with a column of ones, and languages, in an order that doesn't hang on that of arrival."""
    tied: dict[tuple[str, bytes], list[int]] = {}
    for i, v in enumerate(packed):
        tied.setdefault((lang[i], zlib.decompressobj().decompress(v, _HEAD)), []).append(i)
    order = []
    for key in sorted(tied):  # by language, then by all bytes; rows are unpacked whole only where their heads are equal
        order += sorted(tied[key], key=lambda i: zlib.decompress(packed[i])) if len(tied[key]) > 1 else tied[key]
    z = np.ones((len(order), (1 << BITS) + 1), dtype=np.float32)
    for k, i in enumerate(order):
        z[k, :-1] = np.frombuffer(zlib.decompress(packed[i]), dtype=np.float32)
    return z, [lang[i] for i in order]


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` untouched, then the prediction: lang_pred and score, renamed by ``free_names`` if they are taken."""
    arrow_rows(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = free_names(docs.columns, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            for i, j, data, bounds in K.slices(batch.column(at), 1 << 20) if model else ():
                ok = np.flatnonzero(has_letter(data, bounds))
                choice, sure = model.predict(features(data, bounds))
                lang[i + ok] = np.array(model.languages, dtype=object)[choice[ok]]
                score[i + ok] = sure[ok]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, *names])

    schema = StructType(list(docs.schema)).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.mapInArrow(run, schema)


def identify_language(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score."""
    model = learn(docs, sample_rows)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
