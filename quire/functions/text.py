"""Column functions on text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Vulgar fraction glyphs and what they stand for.
FRACTIONS = {
    "¼": "1/4", "½": "1/2", "¾": "3/4", "⅐": "1/7", "⅑": "1/9", "⅒": "1/10", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5", "⅖": "2/5",
    "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8",
}


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


#: Characters and what canonical decomposition without combining marks makes of them: one character, nothing, or several.
_CHANGED = {c: b for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and (b := _bare(c)) != c}
_ONE = {c: b for c, b in _CHANGED.items() if len(b) == 1}
_GONE = [c for c, b in _CHANGED.items() if not b]
#: Those with several, mostly Hangul, as a class of ranges.
_SEVERAL = [ord(c) for c, b in _CHANGED.items() if len(b) > 1]


def _ranges(points: list[int]) -> str:
    out, start = [], 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i] != points[i - 1] + 1:
            out.append(f"\\x{{{points[start]:x}}}-\\x{{{points[i - 1]:x}}}")
            start = i
    return "[" + "".join(out) + "]"


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else _bare(t))


def strip_accents(text: Column | str) -> Column:
    """Canonical decomposition without combining marks. A translation in the JVM; only texts with characters that become several go through Python, and those without a character of several bytes stay as they are."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(text) == F.char_length(text)
    simple = F.translate(text, "".join(_ONE) + "".join(_GONE), "".join(_ONE.values()))
    # A class of many ranges is slow for each character; one range tells first whether any can be meant.
    several = ~plain & text.rlike(f"[\\x{{{min(_SEVERAL):x}}}-\\x{{10ffff}}]") & text.rlike(_ranges(_SEVERAL))
    return F.when(plain, text).when(several, _decomposed(F.when(several, text))).otherwise(simple)


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column | str) -> Column:
    """Compatibility composition. Only texts with a character of several bytes go through Python."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_compatible(F.when(F.octet_length(text) > F.char_length(text), text)), text)


def squash(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def expand_fractions(text: Column) -> Column:
    for glyph, plain in FRACTIONS.items():
        text = F.replace(text, F.lit(glyph), F.lit(" " + plain))
    return text


def phrase_form(text: Column) -> Column:
    """The form in which phrases are compared: fractions spelled out, quotes and dashes plain, lower case, squashed."""
    text = nfkc(expand_fractions(text))
    return squash(F.lower(F.translate(text, "⁄’‘–—", "/''--")))


def tokens(text: Column) -> Column:
    """Word runs, lower case, without diacritics."""
    return F.regexp_extract_all(F.lower(strip_accents(text)), F.lit(r"(?U)(\w+)"), 1)
