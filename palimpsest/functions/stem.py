"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) for ASCII words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published suffixes of steps 2, 3 and 4.
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w.removesuffix(end) + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        cut = next((w.removesuffix(e) for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w.removesuffix(e))), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-1:] == w[-2:-1] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (end := _longest(w, table)) and _measure(w.removesuffix(end)):
            w = w.removesuffix(end) + table[end]
    if end := _longest(w, STEP4):
        rest = w.removesuffix(end)
        if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stemmed(term: Column) -> Column:
    @F.pandas_udf("string")
    def f(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return f(term)


#: Of which words the stem may differ.
stemmed.alters = lambda term: term.rlike("^[A-Za-z]{3,}$")
