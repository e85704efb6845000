import random

from hypothesis import given, settings
from hypothesis import strategies as st

from entwine.llm.editcount import TokenTree, counter, mask_edits, token_counts
from .fixtures import DOC, documents, prose

TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\n\tab'sST0 é日")), max_size=40)


def whole(text):
    return len(counter().encode(text))


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 50), st.integers(0, 12), TEXT), max_size=4))
def test_edits_equal_a_recount(text, edits):
    tree = TokenTree(text, counter())
    assert tree.n_tokens == whole(text) and tree.text == text
    for a, n, new in edits:
        a = min(a, len(text))
        b = min(a + n, len(text))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert tree.text == text
        assert tree.blocks == [] or [p for x in tree.blocks for p in x] == counter().cut(text)
        assert tree.n_tokens == whole(text) and tree.chars[1] == len(text)


def test_long_documents():
    rng = random.Random(0)
    text = prose(rng, 20_000)
    tree = TokenTree(text, counter())
    for _ in range(60):
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.choice([0, 1, 5, 3000]))
        new = rng.choice(["", "x", " some words here", prose(rng, 700), "\n\n "])
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
    assert tree.text == text and tree.n_tokens == whole(text)
    assert all(tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1] for i in range(1, tree.half))


def test_an_edit_touches_little():
    tree = TokenTree("word " * 50_000, counter())
    tree.edit(125_000, 125_004, "term")
    assert tree.encoded < 10


def test_table(spark):
    rows = documents() + [(700, "mail me@example.org or +49 (30) 1234-56789, key 0123456789abcdef0123", "en", "s", 1)]
    out = token_counts(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    assert len(out) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    for r in out:
        assert r.n_tokens in {whole(t) for t in texts[r.doc_id]}
    masked = next(r for r in out if r.doc_id == 700)
    text = rows[-1][1]
    for a, b, new in reversed(mask_edits(text)):
        text = text[:a] + new + text[b:]
    assert text == "mail [email] or [number], key [key]"
    assert (masked.n_edits, masked.n_tokens_edited) == (3, whole(text))
    assert token_counts(spark.createDataFrame([], DOC)).count() == 0
