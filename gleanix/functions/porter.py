"""The Porter stemming algorithm (1980), in its published region form.

A word is read as consonants and vowels; y counts as a consonant (then written
Y) at the start and after a vowel.  Region 1 is what follows the first
consonant after a vowel, region 2 the same within region 1.  Words of one and
two letters are treated like all others.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The suffixes of the published algorithm.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "eli": "e", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alli": "al", "alism": "al", "aliti": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ative": "", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]

_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$")
_VOWEL = re.compile(r"[aeiouy]")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = re.sub(r"([aeiouy])y", r"\1Y", re.sub(r"^y", "Y", word))
    first = _REGION.match(w)
    second = _REGION.match(w, first.end()) if first else None
    r1 = first.end() if first else len(w)
    r2 = second.end() if second else len(w)

    # plurals
    if (s := _longest(w, ("sses", "ies", "ss", "s"))) in ("sses", "ies"):
        w = w[:-2]
    elif s == "s":
        w = w[:-1]

    # past and progressive
    s = _longest(w, ("eed", "ed", "ing"))
    if s == "eed":
        if len(w) - 3 >= r1:
            w = w[:-1]
    elif s and _VOWEL.search(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(tuple(DOUBLES)):
            w = w[:-1]
        elif len(w) == r1 and _SHORT.search(w):
            w += "e"

    if w.endswith(("y", "Y")) and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"

    for table in (STEP_2, STEP_3):
        if (s := _longest(w, table)) and len(w) - len(s) >= r1:
            w = w[: -len(s)] + table[s]

    if (s := _longest(w, STEP_4)) and len(w) - len(s) >= r2 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]

    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
