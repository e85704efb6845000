import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from entwine.llm.mixing import mix_digest
from entwine.llm.vocab import default_path
from .fixtures import DOC
from .test_decontaminate import brute as contaminated
from .test_langid import WORDS
from .test_mixing import water
from .test_neardup import brute as groups


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = {k: v + [f"{k}{i}" for i in range(200)] for k, v in WORDS.items()}
    rows = []
    items = [(i, " ".join(rng.choice(vocabulary["en"]) for _ in range(30))) for i in range(5)]
    for i in range(240):
        lang = rng.choice(sorted(WORDS))
        text = " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.choice([8, 60, 200])))
        if i % 9 == 0 and i:
            text = rows[rng.randrange(len(rows))][1]
        if i % 10 == 3:
            text += " " + rng.choice(items)[1]
        if i % 40 == 7:
            text = "123 456"
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = rows_of(1)
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = out.collect()
        if k == 0:
            assert {r.doc_id for r in got} == {i for i, t in kept.items() if t != "123 456"}
        elif k == 1:
            assert sorted(r.doc_id for r in got) == sorted(i for i, (_, _, first) in groups(list(kept.items())).items() if first)
        elif k == 2:
            bad = {d for d, _ in contaminated(list(kept.items()), items)}
            assert bad and {r.doc_id for r in got} == set(kept) - bad
        elif k == 3:
            source = {r[0]: r[3] for r in rows}
            sizes, taken = {}, {}
            for i, t in kept.items():
                sizes[source[i]] = sizes.get(source[i], 0) + len(t.split())
            for r in got:
                taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
                assert " ".join(kept[r.doc_id].split()).startswith(" ".join(r.text.split())) and r.n_chars == len(r.text)
            want = water([sizes[s] for s in sorted(sizes)], (3, 1, 2), 1.5, 2.0)
            assert all(abs(taken[s] - w) <= 1 for s, w in zip(sorted(sizes), want))
        else:
            tokenizer = Tokenizer.from_file(default_path())
            want = sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts)
            assert sorted((r.doc_id, r.n_tokens) for r in got) == want
        if k < 4:
            texts = [(r.doc_id, r.text) for r in got]
            kept = dict(texts)
            spark.createDataFrame(got, DOC).coalesce(1).write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")


def test_run(spark, tmp_path):
    rows, items = rows_of(2)
    spark.createDataFrame(rows + [(None, None, None, None, None)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert out and [r.doc_id for r in out] != sorted(r.doc_id for r in out)  # the mix, not the order of ids


def test_tokens_are_in_mix_order(spark, tmp_path):
    rows, _ = rows_of(3)
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.mixing(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mix")
    first = {r.doc_id: r.first_slot for r in mix_digest(docs).collect()}
    out = corpus_pipeline.token_output(spark, spark.read.parquet(f"{tmp_path}/mix"), str(tmp_path)).orderBy("start").collect()
    order = [r.doc_id for r in out]
    seen = list(dict.fromkeys(order))
    assert len(order) > len(seen) > 100 and seen == sorted(seen, key=lambda d: first[d])


@pytest.mark.parametrize("front", [True, False])
def test_rows_and_columns_survive(spark, tmp_path, front):
    """50 rows without an id, rows that share one, and columns with the names that operators use."""
    rng = random.Random(5)
    vocabulary = {k: v + [f"{k}{i}" for i in range(300)] for k, v in WORDS.items()}
    extra = ["_id", "score", "lang_pred", "key", "row", "id", "h", "slot", "lo", "x"]
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(WORDS))
        text = " ".join(rng.choice(vocabulary[lang]) for _ in range(60))
        rows.append((None if i < 50 else 7 if i < 60 else i, text, lang, f"s{i % 3}", len(text)))
    mine = "doc_id long, text string, lang string, source string, n_chars long"
    more = ", ".join(f"{c} double" for c in extra)
    values = [tuple(k + i / 8 for k in range(len(extra))) for i in range(len(rows))]
    df = spark.createDataFrame([(v + r if front else r + v) for r, v in zip(rows, values)], f"{more}, {mine}" if front else f"{mine}, {more}")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {r[1]: v for r, v in zip(rows, values)}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == df.columns
        got = docs.collect()
        if k < 3:
            assert len(got) == 120 and sum(r.doc_id is None for r in got) == 50 and sum(r.doc_id == 7 for r in got) == 10
            assert all(tuple(r[c] for c in extra) == want[r.text] for r in got)
    assert all(any(t.startswith(r.text) and tuple(r[c] for c in extra) == v for t, v in want.items()) for r in got)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
