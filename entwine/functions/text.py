"""Normalisation of names and addresses as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import ADDRESS_ALIASES, GENERIC_ADDRESS_WORDS, STOPWORDS, TRADING_MARKERS, WEB_SUFFIXES

_WORD = r"[\p{L}\p{N}_]"
_BEYOND = r"[^\x00-\x7F]"


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII that decompose to one ASCII character, those characters, and the longer decompositions."""
    one, to, many = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(char)
            to.append(plain)
        elif plain:
            many[char] = plain
    return "".join(one), "".join(to), many


def _lookup(table: dict[str, str]) -> Column:
    """A constant map in three nodes; a map built of literals would slow every plan that holds it."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _ranges(chars: list[str]) -> str:
    """A regex class of the characters, neighbours joined to ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition, then everything beyond ASCII dropped; null becomes empty.

    Characters with one ASCII letter or digit in their decomposition are translated, the rest is
    dropped; only texts that hold one of the few with several are spread out and looked up.
    """
    c = _text(c)
    one, to, many = _decompositions()
    longer = _lookup(many)
    spread = F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(_BEYOND), F.coalesce(longer[ch], ch)).otherwise(ch)), "")
    beyond = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    return (
        F.when(~c.rlike(_BEYOND), c)
        .when(beyond.rlike(_ranges(list(many))), F.regexp_replace(F.translate(spread, one, to), _BEYOND + "+", ""))
        .otherwise(F.regexp_replace(F.translate(c, one, to), _BEYOND + "+", ""))
    )


def clean_domain(c: Column) -> Column:
    """Web suffixes after a dot become a space; then one suffix at the very end goes."""
    suffixes = "|".join(WEB_SUFFIXES)
    c = F.regexp_replace(_text(c), rf"(?iu)\.({suffixes})(?!{_WORD})", " ")
    return F.regexp_replace(c, rf"(?iu)({suffixes})(?=\n?\z)", "")


def normalize_text(c: Column) -> Column:
    """Lower-case ASCII words and digits, single spaces; null becomes empty."""
    plain = F.lower(strip_accents(clean_domain(c)))
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def clean_dba(c: Column) -> Column:
    """Trading-name markers become a space; the names on both sides stay."""
    return F.regexp_replace(_text(c), rf"(?iu)(?<!{_WORD})({'|'.join(TRADING_MARKERS)})(?!{_WORD})", " ")


def join_hyphen_digits(c: Column) -> Column:
    """Removes hyphens between digits."""
    return F.regexp_replace(_text(c), r"(?<=\p{Nd})-(?=\p{Nd})", "")


def _tokens(normal: Column, stop: list[str]) -> Column:
    alias = _lookup(ADDRESS_ALIASES)
    named = F.transform(F.split(normal, " "), lambda t: F.coalesce(alias[t], t))
    return F.filter(named, lambda t: ((F.length(t) > 1) | t.rlike("^[0-9]$")) & ~t.isin(stop))


def name_tokens(c: Column) -> Column:
    return _tokens(normalize_text(clean_dba(c)), STOPWORDS)


def address_tokens(c: Column, join_hyphens: bool = True) -> Column:
    return _tokens(normalize_text(join_hyphen_digits(c) if join_hyphens else c), STOPWORDS + GENERIC_ADDRESS_WORDS)


def extract_city(c: Column) -> Column:
    """The last two words of the normalised address, or all of them if there are fewer."""
    normal = normalize_text(c)
    words = F.split(normal, " ")
    return F.when(F.size(words) > 2, F.array_join(F.slice(words, -2, 2), " ")).otherwise(normal)


def _numbers(tokens: Column) -> Column:
    """Digit runs of the tokens without leading zeros."""
    runs = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1))))
    return F.transform(runs, lambda r: F.regexp_replace(r, "^0+", ""))


def bldg_postal(tokens: Column) -> Column:
    """Struct of building numbers (up to 4 digits) and postal codes (5 or 6), distinct, in order of appearance."""
    numbers = _numbers(tokens)
    bldg = F.array_distinct(F.filter(numbers, lambda n: F.length(n).between(1, 4)))
    postal = F.array_distinct(F.filter(numbers, lambda n: F.length(n).between(5, 6)))
    return F.struct(bldg.alias("bldg"), postal.alias("postal"))


def clean_digits(tokens: Column) -> Column:
    """Distinct numbers of at least two digits without leading zeros."""
    return F.array_distinct(F.filter(_numbers(tokens), lambda n: F.length(n) >= 2))


def is_indic(c: Column) -> Column:
    return _text(c).rlike("[\\u0900-\\u0D7F]")


def compact(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def raw_prefix(c: Column, n: int) -> Column:
    """The first n characters of the raw text, then lower-cased."""
    return F.lower(F.substring(_text(c), 1, n))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def split_cell(c: Column) -> Column:
    """Distinct trimmed parts of a comma-separated cell; null gives none."""
    return F.array_distinct(F.filter(F.transform(F.split(_text(c), ","), lambda x: F.trim(x)), lambda x: x != ""))


def from_source(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))
