"""The published English stemming algorithm known as Porter2, on lower-case words."""

from __future__ import annotations

import re

#: Whole words with stems of their own, words left as they are after plurals, beginnings whose rest is R1.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
BEGINNINGS = ("gener", "commun", "arsen")
#: The suffixes of steps 2 to 4 and what takes their place.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

#: The suffixes of each step, longest first.
ENDS_PAST, ENDS2, ENDS3, ENDS4 = (tuple(sorted(x, key=len, reverse=True)) for x in (("eedly", "eed", "ingly", "edly", "ing", "ed"), STEP2, STEP3, STEP4))

VOWEL = "[aeiouy]"
HAS_VOWEL = re.compile(VOWEL)
REGION = re.compile(rf"{VOWEL}[^aeiouy]")
SHORT_END = re.compile(rf"(?:[^aeiouy]{VOWEL}[^aeiouywxY]|^{VOWEL}[^aeiouy])$")
DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and again within R1."""
    first = next((len(b) for b in BEGINNINGS if word.startswith(b)), None)
    if first is None:
        m = REGION.search(word)
        first = m.end() if m else len(word)
    m = REGION.search(word, first)
    return first, m.end() if m else len(word)


def _longest(word: str, ends: tuple[str, ...]) -> str | None:
    return next(filter(word.endswith, ends)) if word.endswith(ends) else None


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if HAS_VOWEL.search(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    end = _longest(word, ENDS_PAST)
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    if end is None or not HAS_VOWEL.search(word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if DOUBLE.search(word):
        return word[:-1]
    return word + "e" if SHORT_END.search(word) and len(word) <= r1 else word


def _derived(word: str, r1: int, r2: int) -> str:
    end = _longest(word, ENDS2)
    if end and len(word) - len(end) >= r1:
        body = word[: -len(end)]
        if not (end == "ogi" and not body.endswith("l") or end == "li" and not body.endswith(tuple("cdeghkmnrt"))):
            word = body + STEP2[end]
    end = _longest(word, ENDS3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]
    end = _longest(word, ENDS4)
    if end and len(word) - len(end) >= r2 and not (end == "ion" and not word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.removeprefix("'")
    if "y" in word:
        word = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(word)
    if "'" in word:
        word = re.sub(r"'(?:s'?)?$", "", word)
    word = _plural(word)
    if word in SETTLED:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
