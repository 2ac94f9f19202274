"""Suffix stripping after M. F. Porter (1980), with the two later departures (bli to ble, logi to log)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the published algorithm: suffixes and what replaces them, where the measure of the stem is positive.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that are dropped where the measure of the stem is above one.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowels(word: str) -> str:
    """The word as a string of v and c; y after a consonant is a vowel."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _vowels(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _vowels(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plurals_and_participles(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _vowels(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _vowels(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def stem(word: str | None) -> str | None:
    """The stem of a lower-case word; words of one or two letters stay as they are."""
    if word is None or len(word) <= 2:
        return word
    word = _plurals_and_participles(word)
    if word.endswith("y") and "v" in _vowels(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, STEP_4)
    if suffix:
        rest = word[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    """Apply it to distinct terms and join the stems back."""
    return words.map(stem)
