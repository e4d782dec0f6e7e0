"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), over batches of words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and what they become, by step (fixed values of the algorithm).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends with consonant, vowel and a consonant other than w, x and y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:  # noqa: ANN001
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of up to two letters, and those with other characters than a-z, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    word = base + "e"
                elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                    word = base[:-1]
                else:
                    word = base + "e" if _measure(base) == 1 and _short(base) else base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, _STEP4)
    if suffix:
        base = word[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stems(words: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(words)  # each word of a batch once
    return pd.Series([None if c < 0 else stem(distinct[c]) for c in codes])


def stemmed(word: Column) -> Column:
    """Stems of words; null stays null."""
    return F.pandas_udf(_stems, "string")(word)
