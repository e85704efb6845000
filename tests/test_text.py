import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from entwine.functions import text as T
from entwine.functions.words import ADDRESS_ALIASES, GENERIC_ADDRESS_WORDS, STOPWORDS
from .helpers import values

NAMES = {
    "Société Générale S.A.": ["generale"],
    "Café & Co": ["cafe"],
    "Telecom": ["tele"],
    "Martin": ["mart"],
    "Costco ": ["costco"],
    "acme.com": ["acme"],
    "acme.company": ["acme"],
    "www.acme.co.in": ["www", "acme"],
    "Joe's Diner t/a Blue Moon": ["joe", "diner", "blue", "moon"],
    "Joe’s Diner": ["joes", "diner"],
    "ACME INC d/b/a Zed": ["acme", "zed"],
    "St Mary": ["street", "mary"],
    "A–B Tools": ["ab", "tools"],
    "नमस्ते": [],
    "": [],
    "7 Eleven": ["7", "eleven"],
    "Smith formerly known as Jones": ["smith", "jones"],
    "Ohio": ["oh"],
    "the and of": [],
}

ADDRESSES = {
    "B-8-03, 12 MG Rd, Bengaluru 560001": (["803", "12", "mg", "bengaluru", "560001"], ["803", "12"], ["560001"]),
    "6-2-101 Main St": (["62101", "main"], [], ["62101"]),
    "Cambridge MA 02139": (["cambridge", "ma", "02139"], ["2139"], []),
    "Cambridge MA 02139-1234": (["cambridge", "ma", "021391234"], [], []),
    "5th Ave, Austin": (["5th", "aust"], ["5"], []),
    "12 Trl Apt 4 Pl": (["12", "trail", "apartment", "4"], ["12", "4"], []),
    "12 Main St, Austin": (["12", "main", "aust"], ["12"], []),
}


def test_name_tokens(spark):
    assert values(spark, [(n,) for n in NAMES] + [(None,)], T.name_tokens) == [*NAMES.values(), []]


def test_address_tokens_and_numbers(spark):
    rows = [(a,) for a in ADDRESSES]
    assert values(spark, rows, T.address_tokens) == [x[0] for x in ADDRESSES.values()]
    got = values(spark, rows, lambda c: T.bldg_postal(T.address_tokens(c)))
    assert [(r.bldg, r.postal) for r in got] == [x[1:] for x in ADDRESSES.values()]
    assert values(spark, [("Cambridge MA 02139-1234",)], lambda c: T.address_tokens(c, False)) == [["cambridge", "ma", "02139", "1234"]]


def test_accents_of_every_character(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    rows = [("".join(map(chr, points[i : i + 4096])),) for i in range(0, len(points), 4096)]
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii") for (t,) in rows]
    assert values(spark, rows, T.strip_accents) == want
    assert values(spark, [(None,), ("½ № ﬁ",)], T.strip_accents) == ["", "12 No fi"]


@pytest.mark.parametrize(
    "text, want",
    [("x.COM y", "x  y"), ("x.comé", "x.comé"), ("a.co_m", "a.co_m"), ("Telecom\n", "Tele\n"), ("com", ""), ("coin", "co"), ("x.in", "x "), (None, "")],
)
def test_clean_domain(spark, text, want):
    assert values(spark, [(text,)], T.clean_domain) == [want]


def test_small_functions(spark):
    assert values(spark, [("6-2-101",), ("a-1-b",), ("٣-٤",)], T.join_hyphen_digits) == ["62101", "a-1-b", "٣٤"]
    assert values(spark, [("12 Main St, Austin TX 78701",), ("Paris",), ("a b",), (None,)], T.extract_city) == ["tx 78701", "paris", "a b", ""]
    assert values(spark, [("abc",), ("नमस्ते",), ("ༀ",), (None,)], T.is_indic) == [False, True, False, False]
    assert values(spark, [("ÀBCdef",), (None,)], lambda c: T.raw_prefix(c, 3)) == ["àbc", ""]
    assert values(spark, [(" a, b ,,a",), (None,), ("",)], T.split_cell) == [["a", "b"], [], []]
    assert values(spark, [("abc", "b"), ("b", "abc"), ("a", "b")], T.either_contains) == [True, True, False]
    assert values(spark, [("S2-1",), ("S3-1",)], lambda c: T.from_source(c, "S2-")) == [True, False]
    assert values(spark, [("007 x5 12a034",)], lambda c: T.clean_digits(F.split(c, " "))) == [["12", "34"]]


def test_tables_agree_with_plain_definition(spark):
    """The native pipeline against a direct reading of the rules, on awkward strings."""
    raw = ["A & B Ltd.", "12, Rue de la Paix 75002 Paris", "x.in.com", "--", "Nr. 7 Opp. Park", "ÅNGSTRÖM c/o Bob", "1 st st ST", "a\tb\nc", "co co", "x" * 300]

    def norm(t):
        s = re.sub(r"\.(com|c0m|in|org|net|co|io|fr)\b", " ", t, flags=re.I)
        s = re.sub(r"(com|c0m|in|org|net|co|io|fr)$", "", s, flags=re.I)
        s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().replace("&", " and ")
        return " ".join(re.sub("[^a-z0-9]+", " ", s).split())

    def toks(t, stop):
        named = [ADDRESS_ALIASES.get(w, w) for w in norm(t).split()]
        return [w for w in named if (len(w) > 1 or w.isdigit()) and w not in stop]

    assert values(spark, [(t,) for t in raw], T.normalize_text) == [norm(t) for t in raw]
    assert values(spark, [(t,) for t in raw], lambda c: T.address_tokens(c, False)) == [toks(t, STOPWORDS + GENERIC_ADDRESS_WORDS) for t in raw]
