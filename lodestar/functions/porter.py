"""Suffix stripping for English words (M. F. Porter, "An algorithm for suffix stripping", 1980).

A word is mapped to a string of ``c`` and ``v``, from which the paper's measure is a count of
``vc`` transitions; the rules themselves are the tables of the paper.
"""

from __future__ import annotations

import re

# The rule tables of the paper, (suffix, replacement).
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    out = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes: list[str]) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _table_step(word: str, rules: list[tuple[str, str]]) -> str:
    table = dict(rules)
    suffix = _longest(word, list(table))
    if suffix is None:
        return word
    base = word.removesuffix(suffix)
    return base + table[suffix] if _measure(base) > 0 else word


def _plurals_and_participles(word: str) -> str:
    suffix = _longest(word, ["sses", "ies", "ss", "s"])
    if suffix in ("sses", "ies"):
        word = word[:-2]
    elif suffix == "s":
        word = word[:-1]

    suffix = _longest(word, ["eed", "ed", "ing"])
    if suffix == "eed":
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif suffix and "v" in _shape(word.removesuffix(suffix)):
        word = word.removesuffix(suffix)
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double_consonant(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"

    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return word


def _strip_residue(word: str) -> str:
    suffix = _longest(word, STEP_4)
    if suffix is not None:
        base = word.removesuffix(suffix)
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    return word


def _tidy_ending(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def porter_stem(word: str) -> str:
    """The stem of one lower-cased word; words of one or two letters are left alone."""
    if len(word) <= 2:
        return word
    word = _plurals_and_participles(word)
    word = _table_step(word, STEP_2)
    word = _table_step(word, STEP_3)
    return _tidy_ending(_strip_residue(word))
