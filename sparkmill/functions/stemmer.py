"""Porter's stemmer for English words, as he published it."""

from __future__ import annotations

from functools import lru_cache

# Suffixes and what they become, by step of the algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for at, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and at and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def short_end(word: str) -> bool:
    """Consonant, vowel, consonant, the last not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def longest_suffix(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in shape(word[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                word = cut + "e"
            elif double_end(cut) and cut[-1] not in "lsz":
                word = cut[:-1]
            else:
                word = cut + "e" if measure(cut) == 1 and short_end(cut) else cut
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for step in (STEP_2, STEP_3):
        if (end := longest_suffix(word, step)) and measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + step[end]
    if (end := longest_suffix(word, STEP_4)) and measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)][-1:] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word
