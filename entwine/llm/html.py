"""Main text of web pages: runs of tokens that repeat over each host's pages, with page structure as a prior.

Method.  A page becomes a stream of text blocks; each knows whether it lies in a container of
the main text (article, main) and whether it lies in one that never holds main text (menus,
headers, footers, sidebars, notices, adverts, forms, comments; by tag, role, class or id).
The token streams of a host's pages are searched for runs of ``run`` tokens that repeat on
distinct pages: what a suffix array of the host, sorted to that depth, would group
(``repeated`` does this in memory), found by 64-bit hashes of host and run.  A block is
*covered* if more than ``share`` of its tokens lie in such runs.

1. *Outside.*  The runs of all blocks outside main containers are aggregated over the host.
   Those on two distinct pages or more are the host's boilerplate.
2. *Inside.*  The runs of the blocks inside main containers are counted over the host's distinct
   main texts.  Those in most of them, ``LEAST_TEXTS`` or more, are boilerplate (a notice or an
   advert in the article), and so is a block that they cover.  Where most of a main text would
   go, it is a copied article: only runs that are boilerplate outside too count there.  Other
   runs that repeat inside are shared passages and titles that menus or adverts quote: they stay.
3. *Decision*, in the column ``rule``:
   ``main``: a page with a main container gives the blocks inside it.
   ``main, cleaned``: the same, without boilerplate inside it (unless nothing would be left).
   ``teaser``: where blocks outside, neither excluded by structure nor covered, hold more tokens
   than the main containers, those blocks too.
   ``unique``: a page without a main container gives its blocks that are neither excluded by
   structure nor covered.
   ``copy``: where those are none, the blocks whose runs are on at most half as many pages as
   the page's most frequent ones, or else all that structure doesn't exclude.
   ``empty``: there is no such block at all.

Pages are read four times: for the runs outside, for short hashes of those inside, for those
inside that may be boilerplate, and for the texts.  A host's distinct main texts are dealt into
groups of about ``_GROUP`` by content: what is in most of them is in most of some group, so only
such runs are counted over the host.  Pages are packed ``shard_pages`` at a time, as they are read, and a pack names each of its runs
once, with the number of its pages that hold it and the least and greatest content hash of
those.  These rows are aggregated by run over all packs, so a run is judged over the whole
host, whatever its size, and results don't depend on the packs.  Bloom filters of the
boilerplate runs (16 MB at most; a fuller one only lets more runs through) go to every task,
so that only runs that probably are boilerplate, of pages that hold one, are joined with them.

Defined results.  Null or empty html: empty text.  Null url or one without a host: the pages
of the host ''.  Null page_id: kept as it is.  Repeated rows: each gives its result, and they
count as one page for repeats (pages with equal blocks are copies, not boilerplate).  Broken
markup: unclosed elements end with the element around them, unknown closing tags are passed
over, an unclosed tag at the end is dropped.  Other columns are ignored, whatever their names.
Very long pages and deep nesting: read whole, in time that grows with their length.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, arrow_rows

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s>/]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s>/]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head nav header footer aside form button select dialog menu svg canvas object audio video map".split())
_MAIN = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_NAMES = frozenset(
    "nav navbar navigation menu submenu header masthead footer sidebar side aside ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond breadcrumb breadcrumbs newsletter subscribe signup login search searchbox widget toolbar pagination pager disclaimer copyright".split()
)
#: Words at the end of a class name that only say that it is some container.
_PLAIN = frozenset("container wrapper wrap box block area section region left right top bottom inner outer list item items link links bar button buttons posts widget widgets text content main 1 2 3".split())
_NOT = frozenset("no not non has have with without free hide hidden show is".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


def _named_never(value: str) -> bool:
    """Whether a class or id attribute names a container without main text.

    The head of each name decides: "reader-comments" and "sidebar-left" do, "no-sidebar",
    "has-social-share" and "comment-free-review" do not.
    """
    for name in value.split():
        parts = [x for x in _SPLIT.split(name) if x]
        while len(parts) > 1 and parts[-1] in _PLAIN:
            parts.pop()
        if parts and parts[-1] in _NAMES and _NOT.isdisjoint(parts):
            return True
    return False


def _flags(tag: str, attributes: str) -> tuple[bool, bool]:
    """(starts a main container, never holds main text)."""
    main, never = tag in _MAIN, tag in _NEVER
    if attributes and not never and tag not in ("html", "body"):
        for name, *values in _ATTR.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "role":
                never |= value in _ROLES
                main |= value in ("main", "article")
            elif name in ("class", "id") and not main:
                never |= _named_never(value)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                never = True
    return main and not never, never


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in a main container, excluded by structure) of the blocks of a page, in order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    open_at: dict[str, list[int]] = {}  # places on the stack of each open tag
    solid: list[int] = [0]  # places of elements that aren't inline
    parts: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][1], stack[-1][2]))
            parts.clear()

    def pop() -> None:
        tag = stack.pop()[0]
        open_at[tag].pop()
        if solid[-1] == len(stack):
            solid.pop()

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE and tag not in _RAW:
            flush()
        if m[1] or m[4]:
            places = open_at.get(tag)
            if places and (tag not in _INLINE or solid[-1] < places[-1]):  # an inline closing tag doesn't close the blocks inside it
                if tag in _INLINE and stack[-1][2] != stack[places[-1] - 1][2]:
                    flush()
                for _ in range(len(stack) - places[-1]):
                    pop()
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _VOID or attributes.rstrip().endswith("/") and tag in _INLINE:
            continue
        main, never = _flags(tag, attributes)
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and stack[-1][0] == tag:
            pop()
        _, in_main, out_of = stack[-1]
        if tag in _INLINE and never != out_of:
            flush()
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in _INLINE:
            solid.append(len(stack))
        stack.append((tag, in_main or (main and not out_of), out_of or never))
    flush()
    return out


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


def repeated(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Tokens covered by a run of ``run`` tokens that occurs on distinct pages.

    The suffix array is built by rank doubling to the depth of ``run``; a run never crosses
    from one page to the next.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(n, dtype=bool)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < run:
        step = min(have, run - have)
        ahead = np.concatenate([rank[step:], np.full(step, -1)])
        key = rank * (rank.max() + 2) + ahead + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        have += step
    last = np.append(np.flatnonzero(np.diff(page)), n - 1)
    whole = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(n) >= run - 1
    at = np.flatnonzero(whole)
    order = at[np.argsort(rank[at], kind="stable")]  # the suffix array; equal ranks are in page order
    first = np.ones(len(order), dtype=bool)
    first[1:] = rank[order[1:]] != rank[order[:-1]]
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(order)) - 1
    many = (page[order[starts]] != page[order[ends]])[group] if len(order) else np.zeros(0, dtype=bool)
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, order[many], 1)
    np.add.at(mark, order[many] + run, -1)
    return np.cumsum(mark[:n]) > 0


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PACK_BYTES = 1 << 20
_FILTER_BITS = 27
_GROUP = 64
LEAST_TEXTS = 10


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _run_keys(pages: list[tuple[int, list[str]]], run: int) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words of all blocks, page, first word and key of each run) of pages (host, blocks); a key is of host and tokens."""
    raw = [t.encode("utf-8", "replace") for _, texts in pages for t in texts]
    words = K.split_words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    ends = words.first[np.cumsum([0] + [len(texts) for _, texts in pages])]
    page = np.repeat(np.arange(len(pages)), np.diff(ends))
    at = np.flatnonzero(ends[page + 1] - np.arange(len(page)) >= run)
    host = K.mix(np.array([h for h, _ in pages], dtype=np.int64).view(np.uint64))
    return words, page[at], at, K.mix(K.runs(words.hash, at, at + run, K._GRAM) ^ host[page[at]])


_PACK_DDL = "runs binary, low binary, high binary, n binary"


def _packs(run: int, most: int):
    """Packs of up to ``most`` pages and about _PACK_BYTES: their distinct runs outside main containers.

    low, high: least and greatest content of the pages of the pack that hold the run; n: how many do.
    """

    def close(held: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
        _, page, _, key = _run_keys([(host, texts) for host, _, texts in held], run)
        order = np.lexsort((page, key))
        key, page = key[order], page[order]
        content = np.array([c for _, c, _ in held], dtype=np.int64)[page]
        head = np.append(True, key[1:] != key[:-1])[: len(key)]
        first = np.flatnonzero(head)
        fresh = (head | np.append(True, page[1:] != page[:-1])[: len(key)]).astype(np.int64)
        columns = (key[first], *(f.reduceat(x, first) if len(first) else x for f, x in ((np.minimum, content), (np.maximum, content), (np.add, fresh))))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=["runs", "low", "high", "n"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for host, page in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                rest = [t for t, main, _ in blocks(page.as_py() or "") if not main]
                if rest:
                    held.append((host, _hash("\0".join(rest)), rest))
                    size += sum(map(len, rest))
                if len(held) == most or size >= _PACK_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return go


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of packs as rows."""
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[k], dtype=np.int64)) for k in ("runs", "low", "high", "n")], names=["run", "low", "high", "n"])


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bloom filter of the column ``run`` with two bits a key, as 64-bit words."""
    bits = min(_FILTER_BITS, max(16, (16 * keys.count()).bit_length()))
    place = F.explode(F.array(F.col("run"), F.shiftrightunsigned("run", 32))).alias("p")
    words = keys.select(place).select((F.col("p").bitwiseAND(F.lit((1 << bits) - 1))).alias("p"))
    words = words.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint64)


def _maybe(bloom: np.ndarray, key: np.ndarray) -> np.ndarray:
    last = np.uint64(64 * len(bloom) - 1)
    ok = np.ones(len(key), dtype=bool)
    for p in (key & last, (key >> np.uint64(32)) & last):
        ok &= (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) > 0
    return ok


def _kept(found: list[tuple[str, bool, bool]]) -> tuple[list[str], list[str], list[str]]:
    """(main blocks, blocks outside main containers, those of them that structure doesn't exclude)."""
    return [t for t, main, never in found if main and not never], [t for t, main, _ in found if not main], [t for t, main, never in found if not main and not never]


def _size(texts: list[str]) -> int:
    return sum(len(t.split()) for t in texts)


_OPEN = pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_()), ("never", pa.bool_())]))
_OPEN_DDL = "array<struct<text: string, main: boolean, never: boolean>>"
_SEEN_DDL = f"page_id long, url string, text string, rule string, ref long, host long, blocks {_OPEN_DDL}, inside binary, outside binary"


def _some_keys(pages: list[tuple[int, list[str]]], bloom: np.ndarray, run: int, own: np.ndarray | None = None) -> list[bytes]:
    """For each page (host, blocks) its distinct runs that the filter lets through, or ``own``, one of short hashes."""
    _, page, _, key = _run_keys(pages, run)
    some = _maybe(bloom, key)
    if own is not None:
        some |= _maybe(own, _wide(_short(key)))
    cuts = np.searchsorted(page[some], np.arange(len(pages) + 1))
    key = key[some]
    return [np.unique(key[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _short(key: np.ndarray) -> np.ndarray:
    """Hashes of 32 bits, as they are dealt out, of the keys of runs."""
    return (key >> np.uint64(32)).astype(np.uint32)


def _wide(short: np.ndarray) -> np.ndarray:
    """Short hashes as the keys of a filter."""
    return K.mix(short.astype(np.uint64))


def _main_runs(run: int):
    """(host, content, runs) of the distinct main texts of a task: short hashes of all their runs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for batch in batches:
            pages, contents = [], []
            for host, page in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = blocks(page.as_py() or "")
                texts = [t for t, main, never in found if main and not never]
                content = _hash("\0".join(texts))
                if any(m for _, m, _ in found) and (host, content) not in known:
                    known.add((host, content))
                    pages.append((host, texts))
                    contents.append(content)
            _, page, _, key = _run_keys(pages, run)
            cuts = np.searchsorted(page, np.arange(len(pages) + 1))
            runs = [np.unique(_short(key[i:j])).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in pages], pa.int64()), pa.array(contents, pa.int64()), pa.array(runs, pa.binary())], names=["host", "content", "runs"])

    return go


def _in_most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are in most texts of a group, as keys of a filter; rows (host, groups, part, content, runs) come sorted."""

    def close(texts: list[bytes], groups: int) -> pa.RecordBatch:
        few = groups == 1 and len(texts) < LEAST_TEXTS
        short, n = np.unique(np.frombuffer(b"" if few else b"".join(texts), dtype=np.uint32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(_wide(short[2 * n > len(texts)]).view(np.int64))], names=["run"])

    at, last, texts = None, None, []
    for batch in batches:
        for host, groups, part, content, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (host, groups, part):
                if at:
                    yield close(texts, at[1])
                at, last, texts = (host, groups, part), None, []
            if content != last:
                texts.append(runs)
                last = content
    if at:
        yield close(texts, at[1])


def _ask_inside(bloom: np.ndarray, own: np.ndarray, run: int):
    """(host, content, runs) of the main texts: runs that may be boilerplate, outside or in most of the host's main texts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page.as_py() or "") for page in batch.column(3)]
            pages = [(host, [t for t, main, never in x if main and not never]) for host, x in zip(batch.column(2).to_pylist(), found, strict=True)]
            has_main = pa.array([any(m for _, m, _ in x) for x in found])
            columns = [batch.column(2), pa.array([_hash("\0".join(texts)) for _, texts in pages], pa.int64()), pa.array(_some_keys(pages, bloom, run, own), pa.binary())]
            yield pa.RecordBatch.from_arrays([x.filter(has_main) for x in columns], names=["host", "content", "runs"])

    return go


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, run): one row for each run of pages or main texts."""
    for batch in batches:
        for page, host, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key = np.frombuffer(runs, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), page)), pa.array(np.full(len(key), host)), pa.array(key)], names=["page", "host", "run"])


def _look_up(outer: np.ndarray, inner: np.ndarray, run: int):
    """Text of the pages that hold no run of the filters; blocks and those runs of the others."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = TaskContext.get().partitionId() << 32
        for batch in batches:
            found = [blocks(page.as_py() or "") for page in batch.column(3)]
            split = [_kept(x) for x in found]
            hosts = batch.column(2).to_pylist()
            has_main = [any(m for _, m, _ in x) for x in found]
            # outside blocks count where there is no main container, or more outside than in it
            asks = [not m or _size(usable) > _size(inside) for m, (inside, _, usable) in zip(has_main, split, strict=True)]
            runs = [
                _some_keys(list(zip(hosts, (x[0] for x in split), strict=True)), inner, run),
                _some_keys([(host, x[1] if ask else []) for host, x, ask in zip(hosts, split, asks, strict=True)], outer, run),
            ]
            text, rule, kept = [], [], []
            for x, (inside, _, usable), m, ask, a, b in zip(found, split, has_main, asks, *runs, strict=True):
                closed = not a and not b and not (m and ask)
                text.append(" ".join(inside if m else usable) if closed else None)
                rule.append(("main" if m else "unique" if usable else "empty") if closed else None)
                kept.append([] if closed else [{"text": t, "main": main, "never": never} for t, main, never in x])
            refs = pa.array(np.arange(ref, ref + batch.num_rows))
            ref += batch.num_rows
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(rule, pa.string()), refs, batch.column(2), pa.array(kept, _OPEN), *(pa.array(x, pa.binary()) for x in runs)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "rule", "ref", "host", "blocks", "inside", "outside"])

    return go


def _cover(texts: list[str], host: int, runs: dict[int, int], run: int, share: float) -> tuple[list[bool], list[int]]:
    """Whether each block is covered by ``runs``, and the least number of pages of a run that touches it (0 if none does)."""
    words, _, at, key = _run_keys([(host, texts)], run)
    n = np.array([runs.get(k, 0) for k in key.view(np.int64).tolist()], dtype=np.int64)
    at, n = at[n > 0], n[n > 0]
    mark = np.zeros(len(words.start) + 1, dtype=np.int64)
    mark[at] += 1
    mark[at + run] -= 1
    gone = K.sums_between(np.cumsum(mark[:-1]) > 0, words.first) > share * np.diff(words.first)
    least = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        i, j = np.searchsorted(at, [a - run + 1, b])
        least.append(int(n[i:j].min()) if j > i else 0)
    return gone.tolist(), least


def _decide(found: list[tuple[str, bool, bool]], host: int, inside: dict[int, int], outside: dict[int, int], run: int, share: float) -> tuple[str, str]:
    """(text, rule) of a page, given the boilerplate runs among its own, those inside with 0 if they aren't outside."""
    main, rest, usable = _kept(found)
    if any(m for _, m, _ in found):
        gone, _ = _cover(main, host, dict.fromkeys(inside, 1), run, share)
        if 2 * _size([t for t, g in zip(main, gone, strict=True) if g]) > _size(main):  # a copied article
            gone, _ = _cover(main, host, inside, run, share)
        rule = "main, cleaned" if any(gone) and not all(gone) else "main"
        if rule == "main":
            gone = [False] * len(main)
        covered, _ = _cover(rest, host, outside, run, share)
        if _size([t for t, g, x in zip(rest, covered, [x for _, m, x in found if not m], strict=True) if not g and not x]) <= _size(main):
            return " ".join(t for t, g in zip(main, gone, strict=True) if not g), rule
        marks = {True: iter(gone), False: iter(covered)}
        out = []
        for t, m, never in found:
            if m and never:
                continue
            if not next(marks[m]) and not never:
                out.append(t)
        return " ".join(out), "teaser"
    if not usable:
        return "", "empty"
    gone, least = _cover(rest, host, outside, run, share)
    never = [x[2] for x in found]
    out = [t for t, g, x in zip(rest, gone, never, strict=True) if not g and not x]
    if out:
        return " ".join(out), "unique"
    few = [t for t, n, x in zip(rest, least, never, strict=True) if not x and 2 * n <= max(least)]
    return " ".join(few or usable), "copy"


def _clean(run: int, share: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, rule = [], []
            for host, found, inside, outside in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                mine, around = ({r["run"]: r["n"] for r in x or []} for x in (inside, outside))
                t, r = _decide([(x["text"], x["main"], x["never"]) for x in found], host, mine, around, run, share)
                text.append(t)
                rule.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(rule, pa.string())], names=["page_id", "url", "text", "rule"])

    return go


def extract_text(pages: DataFrame, run: int = 6, share: float = 0.5, shard_pages: int = 1000) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars, rule.  See the module's text."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    arrow_rows(spark, 64)
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    packs = scratch.write(base.mapInArrow(_packs(run, shard_pages), _PACK_DDL))
    arrow_rows(spark, 2)
    flat = packs.mapInArrow(_flat, "run long, low long, high long, n long")
    repeats = flat.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    repeats = scratch.write(repeats.filter("low <> high").select("run", "n"))
    arrow_rows(spark, 64)
    outer = _filter_of(repeats)
    asked_ddl = "page long, host long, run long"
    texts_ddl = "host long, content long, runs binary"
    groups = base.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / _GROUP).alias("groups")).filter("groups > 1")
    dealt = base.mapInArrow(_main_runs(run), texts_ddl).join(F.broadcast(groups), "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = dealt.select("host", "groups", F.expr("pmod(content, groups)").alias("part"), "content", "runs")
    dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "groups", "part", "content")
    most = scratch.write(dealt.mapInArrow(_in_most, "run long").distinct())
    texts = scratch.write(base.mapInArrow(_ask_inside(outer, _filter_of(most), run), texts_ddl))
    inside = texts.select("content", "host", "runs").mapInArrow(_asked, asked_ddl)
    per_host = texts.groupBy("host").agg(F.count_distinct("content").alias("texts"))
    inside = inside.groupBy("host", "run").agg(F.count_distinct("page").alias("in_texts")).join(per_host, "host")
    inside = inside.filter(f"in_texts >= {LEAST_TEXTS} and 2 * in_texts > texts").join(repeats, "run", "left")
    inside = scratch.write(inside.select("run", F.coalesce("n", F.lit(0)).alias("n")))
    seen = scratch.write(base.mapInArrow(_look_up(outer, _filter_of(inside), run), _SEEN_DDL))
    still = seen.filter("rule is null")
    entry = F.struct("run", "n")

    def known(column: str, runs: DataFrame) -> DataFrame:
        asked = still.select("ref", "host", column).mapInArrow(_asked, asked_ddl)
        return asked.join(runs, "run").groupBy(F.col("page").alias("ref")).agg(F.collect_list(entry).alias(f"{column}_runs"))

    opened = still.select("page_id", "url", "host", "blocks", "ref").join(known("inside", inside), "ref", "left").join(known("outside", repeats), "ref", "left")
    opened = opened.select("page_id", "url", "host", "blocks", "inside_runs", "outside_runs")
    cleaned = scratch.write(opened.mapInArrow(_clean(run, share), "page_id long, url string, text string, rule string"))
    scratch.drop(packs, repeats, most, texts, inside)
    out = seen.filter("rule is not null").select("page_id", "url", "text", "rule").unionByName(cleaned)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "rule")
