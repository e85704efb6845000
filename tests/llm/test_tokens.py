import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from entwine.llm import kernels as K
from entwine.llm.tokens import EliasFano, Segment, encode_texts, read_tokens, segment_image, token_table, write_tokens
from entwine.llm.vocab import default_path
from .fixtures import DOC, documents

TOKENIZER = Tokenizer.from_file(default_path())


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    ef, used = EliasFano.from_bytes(memoryview(EliasFano.build(np.array(values, dtype=np.uint64)).to_bytes() + b"tail"))
    assert ef.values().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    assert len(EliasFano.build(values).to_bytes()) < 50_000 * 14 / 8


TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x0b\x1c\x85 　'sSΣİß́é<|endoftext|>0٣")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_pieces_equal_whole_texts(texts):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(x) for x in raw])
    ids, ends = encode_texts(default_path(), 1, np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    start = 0
    for t, e in zip(texts, ends.tolist()):
        assert ids[start:e].tolist() == whole(t)
        start = e


def test_special_strings():
    for t in ("a<|endoftext|>b <|startoftext|>", "<|endoftext|> x", "it's they'LL", "x" * 5000):
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        assert encode_texts(default_path(), 1, raw, np.array([0, len(raw)]))[0].tolist() == whole(t)


@pytest.mark.parametrize("wide", [False, True])
def test_segment(wide):
    docs = np.array([-(2**63), -5, 7, 7, 2**62])
    ids, ends = np.arange(20) % 11, np.array([1, 5, 5, 12, 20])
    s = Segment(segment_image(ids, ends, docs, wide))
    assert s.doc_ids() == [None, -5, 7, 7, 2**62]
    assert [s.document(i).tolist() for i in range(5)] == [ids[a:b].tolist() for a, b in zip([0, 1, 5, 5, 12], ends)]


@pytest.mark.parametrize("segment_ids", [50, 1 << 21])
def test_round_trip(spark, tmp_path, segment_ids):
    df = spark.createDataFrame(documents(), DOC).withColumnRenamed("lang", "part").repartition(3)
    write_tokens(df, f"{tmp_path}/t", segment_ids=segment_ids)
    out = read_tokens(spark, f"{tmp_path}/t", with_ids=True).orderBy("start").collect()
    texts = {}
    for r in documents():
        texts.setdefault(r[0], []).append(whole(r[1]))
    assert [r.doc_id for r in out] == sorted((r[0] for r in documents()), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in out:
        assert r.start == at
        texts[r.doc_id].remove(list(r.ids))
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens


def test_empty(spark):
    assert token_table(spark.createDataFrame([], DOC)).count() == 0
    assert K.split_words(np.zeros(0, dtype=np.uint8), np.array([0])).n_docs == 0
