"""Porter's suffix stripper (1980), with the usual later rules for ``ies`` and ``ied`` on short words left out."""

from __future__ import annotations

from functools import lru_cache

VOWELS = "aeiou"

# Suffixes and replacements of steps 2, 3 and 4 of the published algorithm.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in VOWELS and not (c == "y" and i > 0 and out[i - 1]))
    return out


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = _consonants(stem)
    return sum(not a and b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _consonants(word)[-3:] == [True, False, True] and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    if s := _longest(word, ("sses", "ies", "ss", "s")):
        word = word[: len(word) - {"sses": 2, "ies": 2, "ss": 0, "s": 1}[s]]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif (s := _longest(word, ("ed", "ing"))) and _has_vowel(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (dict(STEP_2), dict(STEP_3)):
        if (s := _longest(word, table)) and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    if (s := _longest(word, STEP_4)) and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
