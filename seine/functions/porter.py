"""Porter's suffix stripper (1980) with the common extensions: short words stay, -ies and -ied of four letters keep
their e, final y changes only after a consonant that is not the first letter, and a few irregular words."""

from __future__ import annotations

import re
from functools import lru_cache

#: Irregular words.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes and replacements of steps 2 to 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(stem: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(stem):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    s = shape(stem)
    return s.endswith("cvc") and stem[-1] not in "wxy" or s == "vc"


def double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


def step1(w: str) -> str:
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if "v" not in shape(stem):
                break
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if double_end(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and short_end(stem) else stem
    return w


def step1c(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c" else w


def step2(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]):
        return step2(w[:-4] + "al")
    end = longest(w, STEP2)
    if end is None:
        return w
    stem = w[: -len(end)]
    return stem + STEP2[end] if measure(stem + "l" if end == "logi" else stem) else w


def step3(w: str) -> str:
    end = longest(w, STEP3)
    return w[: -len(end)] + STEP3[end] if end and measure(w[: -len(end)]) else w


def step4(w: str) -> str:
    end = longest(w, STEP4)
    if not end or measure(stem := w[: -len(end)]) < 2 or end == "ion" and stem[-1] not in "st":
        return w
    return stem


def step5(w: str) -> str:
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    return w if len(w) <= 2 else step5(step4(step3(step2(step1c(step1(w))))))
