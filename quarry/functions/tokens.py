"""Search tokens: folded letters and stems.

Folding is a column expression. Stemming (Porter's published algorithm of 1980) runs
over distinct terms only, in Arrow batches, and is joined back to whatever has them.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.columns import WORD


@functools.cache
def _letters() -> tuple[str, str]:
    """Lower-case letters with one diacritic mark or more, and the plain letters that decomposition gives."""
    pairs = {}
    for code in [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]) and chr(code) == chr(code).lower():
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


def folded(text: Column) -> Column:
    """Lower case without diacritic marks, composed or not."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *_letters()), r"\p{Mn}+", "")


def tokens(text: Column, fold: bool = True) -> Column:
    """Runs of letters and digits, folded or only lower-cased."""
    return F.regexp_extract_all(folded(text) if fold else F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


# Suffixes of the published algorithm and what replaces them, longest first within a step.
_STEP2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _shape(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _ends_short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules, least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + new if _measure(rest) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word of a-z; other words and those of two letters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (m := re.fullmatch("(.*)(ed|ing)", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2, 0), _STEP3, 0)
    for suffix in _STEP4:
        if word.endswith(suffix):
            word = word[: -len(suffix)] if _measure(word[: -len(suffix)]) > 1 else word
            break
    else:
        if word.endswith(("sion", "tion")) and _measure(word[:-3]) > 1:
            word = word[:-3]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stems(rows: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms of rows."""

    @F.pandas_udf("string")
    def of(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    return rows.select(term).distinct().withColumn("stem", of(term))
