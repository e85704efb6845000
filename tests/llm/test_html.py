import random
import time

import numpy as np
import pytest

from entwine.llm.html import blocks, extract_text, repeated
from .fixtures import prose

PAGE = "page_id long, url string, html string"


def text_of(page):
    return " ".join(t for t, main, never in blocks(page) if main and not never)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>A&amp;B</h1><p>x  y\n z<b>bold</b>er</p></article>", "A&B x y zbolder"),
        ("<nav>menu</nav><article><p><b>one<br><p>two</p><p>three</article><footer>f", "one two three"),
        ("<main>a<aside>no</aside><form>no</form><p>b &eacute;&#33; &quo</main>tail", "a b é! &quo"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style><!-- c <p>no</p> -->b</article>", "ab"),
        ("<article>a<div class='reader-comments'><p>no</p></div><div id=ad>no</div><p class=\"a>b\">yes</article>", "a yes"),
        ("<div role=main>x<div role='navigation'>no</div></div>", "x"),
        ("<article>1 < 2 & 3 > 2<p>t</article", "1 < 2 & 3 > 2 t"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ("<article><p>a<b>b</p></b>c</article>", "ab c"),
        ("<article></article>", ""),
        ("<div class='site no-sidebar'><article class='has-social-share'>kept<div class='comment-free-review'>too</div></article></div>", "kept too"),
        ("<article>a<div class='sidebar-left'>no</div><div class='site-footer widget-area'>no</div><div id=ad_box>no</div><i class=ad>no</i> b</article>", "a b"),
        ("", ""),
    ],
)
def test_blocks(page, text):
    assert text_of(page) == text


def brute_cover(pages, run):
    where = {}
    for p, tokens in enumerate(pages):
        for i in range(len(tokens) - run + 1):
            where.setdefault(tuple(tokens[i : i + run]), set()).add(p)
    out = []
    for tokens in pages:
        gone = {i + k for i in range(len(tokens) - run + 1) if len(where[tuple(tokens[i : i + run])]) > 1 for k in range(run)}
        out += [i in gone for i in range(len(tokens))]
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 6, 8])
def test_repeated_runs(run):
    rng = random.Random(run)
    for _ in range(30):
        pages = [[rng.randrange(4) for _ in range(rng.randrange(1, 20))] for _ in range(rng.randrange(1, 6))]
        page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        assert repeated(np.array(sum(pages, [])), page, run).tolist() == brute_cover(pages, run)


def brute_text(pages, run=6, share=0.5, least=10):
    """{page number: text} of (host, html) by counting runs of tokens in dictionaries, page by page."""
    found = [(h, blocks(p)) for h, p in pages]

    def runs_of(texts):
        tokens = " ".join(texts).split()
        return [tuple(tokens[i : i + run]) for i in range(len(tokens) - run + 1)]

    outside, inside, contents = {}, {}, {}
    for h, bs in found:
        rest, main = [t for t, m, _ in bs if not m], [t for t, m, n in bs if m and not n]
        for r in set(runs_of(rest)):
            outside.setdefault((h, r), []).append(tuple(rest))
        if any(m for _, m, _ in bs):
            contents.setdefault(h, set()).add(tuple(main))
            for r in set(runs_of(main)):
                inside.setdefault((h, r), set()).add(tuple(main))
    common = {k: len(v) for k, v in outside.items() if len(set(v)) > 1}
    deep = {k for k in common if len(inside.get(k, ())) >= least and 2 * len(inside[k]) > len(contents[k[0]])}

    def covered(h, texts, known):
        runs = runs_of(texts)
        gone, at = {i + k for i, r in enumerate(runs) if (h, r) in known for k in range(run)}, 0
        out = []
        for t in texts:
            n = len(t.split())
            near = [common[h, runs[i]] for i in range(max(0, at - run + 1), min(at + n, len(runs))) if (h, runs[i]) in common]
            out.append((sum(i in gone for i in range(at, at + n)) > share * n, min(near, default=0)))
            at += n
        return out

    size = lambda texts: sum(len(t.split()) for t in texts)
    result = {}
    for k, (h, bs) in enumerate(found):
        main, rest = [t for t, m, n in bs if m and not n], [(t, n) for t, m, n in bs if not m]
        out = covered(h, [t for t, _ in rest], common)
        free = [t for (t, n), (c, _) in zip(rest, out) if not n and not c]
        if any(m for _, m, _ in bs):
            gone = [c for c, _ in covered(h, main, deep)]
            gone = [False] * len(gone) if all(gone) else gone
            if size(free) <= size(main):
                result[k] = " ".join(t for t, c in zip(main, gone) if not c)
            else:
                a, b = iter(gone), iter(out)
                flags = [(next(a) if m and not n else True if m else next(b)[0] or n) for _, m, n in bs]
                result[k] = " ".join(t for (t, _, _), f in zip(bs, flags) if not f)
        else:
            few = [t for (t, n), (_, c) in zip(rest, out) if not n and 2 * c <= max((c for _, c in out), default=0)]
            result[k] = " ".join(free or few or [t for t, n in rest if not n])
    return result


def mixed_pages(seed):
    """Pages of two hosts with and without main containers: menus, notices inside articles, teasers, copies, quoted passages."""
    rng = random.Random(seed)
    out = []
    for host in "ab":
        menu, notice, foot, quote = prose(rng, 9), prose(rng, 8), prose(rng, 7), prose(rng, 12)
        bodies = [prose(rng, rng.choice([20, 40])) for _ in range(30)]
        for i in range(45):
            body = bodies[i % len(bodies)]
            links = "".join(f"<li>{w}</li>" for w in menu.split())
            kind = rng.choice(["article", "article", "article", "plain", "teaser", "copy"])
            said = f"<p>{quote}</p>" if rng.random() < 0.3 else ""
            advert = f"<div class=ad>{notice}</div>" if rng.random() < 0.5 else ""
            if kind == "article":
                page = f"<nav><ul>{links}</ul></nav><article><h1>T {i}</h1><p>{body}</p><p>{notice}</p>{said}</article>{advert}<footer>{foot}</footer>"
            elif kind == "teaser":
                page = f"<ul>{links}</ul><article>see {i}</article><div><p>{body} {i}</p>{said}</div>{advert}<div>{foot}</div>"
            elif kind == "copy":
                page = f"<ul>{links}</ul><div>{bodies[0]}</div><footer>{foot} {i}</footer>"
            else:
                page = f"<ul>{links}</ul><div><p>{body} {i}</p></div>{said}{advert}<div>{foot}</div>"
            out.append((host, page))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_extraction_matches_brute_force_at_any_shard_count(spark, seed):
    pages = mixed_pages(seed)
    want = brute_text(pages)
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, (h, p) in enumerate(pages)], PAGE)
    rules = set()
    for shards, parts in ((1000, 1), (7, 3), (1, 4)):
        out = extract_text(df.repartition(parts), shard_pages=shards).collect()
        assert {r.page_id: r.text for r in out} == want
        rules |= {r.rule for r in out}
    assert rules >= {"main, cleaned", "teaser", "unique", "copy"}


def test_long_and_deep_pages(spark):
    deep = "<div>" * 200_000 + "x" + "</div>" * 200_000
    inline = "<i>" * 100_000 + "<b>" * 3 + "y" + "</b></i>" * 100_000
    began = time.time()
    assert [t for t, _, _ in blocks(deep)] == ["x"] and [t for t, _, _ in blocks(inline)] == ["y"]
    assert [t for t, _, _ in blocks("<p>z" * 200_000)] == ["z"] * 200_000
    assert time.time() - began < 60
    rows = [(i, "http://a/x", f"<article>{'w ' * 500_000}{i}</article>{deep}") for i in range(3)]
    assert [r.n_chars for r in extract_text(spark.createDataFrame(rows, PAGE)).collect()] == [1_000_001] * 3


def test_pages_without_main(spark):
    rng = random.Random(2)
    menu, foot = prose(rng, 12), prose(rng, 9)
    rows, want = [], {}
    for i in range(60):
        body = prose(rng, 40)
        rows.append((i, f"https://h{i % 3}.example/{i}", f"<body><div>{menu}</div><div><p>{body}</p></div><nav>go</nav><div>{foot} {i}</div></body>"))
        want[i] = body
    out = extract_text(spark.createDataFrame(rows, PAGE).repartition(4), shard_pages=8).collect()
    assert {r.page_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("n", [40, 400])
def test_repeats_are_judged_over_the_whole_host(spark, n):
    """Blocks on a few pages of a host are boilerplate, however many pages the host has."""
    rng = random.Random(n)
    few = [prose(rng, 10) for _ in range(n // 4)]
    rows, want = [], {}
    for i in range(n):
        body = prose(rng, 30)
        rows.append((i, "http://a.example/x", f"<div>{body}</div><div>{few[i % len(few)]}</div>"))
        want[i] = body
    rows += [(n, "http://b.example/x", f"<div>{few[0]}</div>"), (n + 1, "http://b.example/y", f"<div>{few[0]}</div>")]
    want |= {n: few[0], n + 1: few[0]}  # once on their own host, and copies of one another
    out = extract_text(spark.createDataFrame(rows, PAGE).repartition(4), shard_pages=8).collect()
    assert {r.page_id: r.text for r in out} == want


def test_edge_rows(spark):
    long = "word " * 200_000
    rows = [(1, None, None), (2, "not a url", ""), (None, "http://a/x", "<article>é  x</article>"), (4, "http://a/y", f"<article>{long}</article>"), (5, "http://a/z", "plain"), (5, "http://a/z", "plain")]
    df = spark.createDataFrame(rows, PAGE).withColumnRenamed("page_id", "page_id").selectExpr("*", "'x' as host", "1 as salt")
    out = sorted(extract_text(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.url, r.n_chars) for r in out] == [(1, None, 0), (2, "not a url", 0), (4, "http://a/y", len(long) - 1), (5, "http://a/z", 5), (5, "http://a/z", 5), (None, "http://a/x", 3)]
    assert extract_text(spark.createDataFrame([], PAGE)).count() == 0


@pytest.mark.parametrize("n, parts", [(12, 1), (200, 3)])
def test_repeats_inside_main_texts_alone(spark, n, parts):
    """A notice in most articles of a host goes though nothing outside repeats it; copied articles and a few quotes stay."""
    rng = random.Random(n)
    notice, quote, copied = prose(rng, 9), prose(rng, 12), prose(rng, 40)
    rows, want = [], {}
    for i in range(n):
        body = prose(rng, 30)
        said = f"<p>{quote}</p>" if i % 4 == 0 else ""
        own = f"<p>{notice}</p>" if i % 6 else ""
        rows.append((i, "http://a.example/x", f"<article><h1>T {i}</h1><p>{body}</p>{own}{said}</article>"))
        want[i] = f"T {i} {body}" + (f" {quote}" if said else "")
        rows.append((n + i, "http://b.example/x", f"<article><h1>T {i}</h1><p>{copied}</p></article>"))
        want[n + i] = f"T {i} {copied}"
        if i < 9:  # too few texts on this host
            rows.append((2 * n + i, "http://c.example/x", f"<article><p>{body}</p><p>{notice}</p></article>"))
            want[2 * n + i] = f"{body} {notice}"
    out = extract_text(spark.createDataFrame(rows, PAGE).repartition(parts)).collect()
    assert {r.page_id: r.text for r in out} == want
    assert {r.rule for r in out} == {"main", "main, cleaned"}
