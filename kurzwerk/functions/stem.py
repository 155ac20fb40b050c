"""English suffix stripping (Porter, "An algorithm for suffix stripping", 1980) for ROUGE.

The variant in common use for ROUGE: the published rules with the widely
adopted amendments (short ``-ies``/``-ied`` words, ``y`` after a consonant,
``-bli``, ``-fulli``, ``-logi``, a list of irregular words), applied to words of
more than three characters.
"""

from __future__ import annotations

import functools
import re

# Suffix rules and irregular words of the published algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
SINGLE_SUFFIXES = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
LAST_SUFFIXES = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def shape(stem: str) -> str:
    """The word as consonants and vowels; ``y`` is a vowel after a consonant."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def short_end(word: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x, y (or is vowel-consonant)."""
    s = shape(word)
    return s == "vc" or (s.endswith("cvc") and word[-1] not in "wxy")


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    ending = longest(word, ("ed", "ing"))
    if ending is None or "v" not in shape(word[: -len(ending)]):
        return word
    stem = word[: -len(ending)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and short_end(stem) else stem


def final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        return word[:-1] + "i"
    return word


def double(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return double(word[:-2])
    ending = longest(word, DOUBLE_SUFFIXES)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    tested = word[:-3] if ending == "logi" else stem
    return stem + DOUBLE_SUFFIXES[ending] if measure(tested) > 0 else word


def single(word: str) -> str:
    ending = longest(word, SINGLE_SUFFIXES)
    if ending and measure(word[: -len(ending)]) > 0:
        return word[: -len(ending)] + SINGLE_SUFFIXES[ending]
    return word


def last(word: str) -> str:
    ending = longest(word, LAST_SUFFIXES)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    if measure(stem) <= 1 or (ending == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def final_e(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of one lower-case word; words of up to three characters stay."""
    if len(word) <= 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    for step in (plural, past, final_y, double, single, last, final_e):
        word = step(word)
    return word
