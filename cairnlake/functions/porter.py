"""Porter's stemming algorithm (M. F. Porter, 1980) on lower-case words, as full-text indexes apply it."""

from __future__ import annotations

#: Endings of steps 2 to 4 of the paper and what replaces them where the stem before them is long enough.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``v`` for vowels and ``c`` for consonants; y is a vowel behind a consonant."""
    out = ""
    for char in word:
        out += "v" if char in "aeiou" or (char == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


#: Words of fewer or more UTF-8 bytes stay as they are.
LEAST, MOST = 3, 64


def stem(word: str) -> str:
    if not LEAST <= len(word.encode()) <= MOST:
        return word
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"

    for table in (STEP2, STEP3):
        if (end := _longest(word, table)) and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    if (end := _longest(word, STEP4)) and _measure(rest := word[: -len(end)]) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
        word = rest
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
