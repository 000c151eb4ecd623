"""English stemming of one lower-case word (the published Porter2 rules)."""

from __future__ import annotations

import re

VOWELS = "aeiouy"

# Words with their own stem, and words that stop after step 1a.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Suffix and its replacement, for steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
    "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "", "ative": "",
}
STEP_4 = {
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion",
}
PAST = {"eed", "eedly", "ed", "edly", "ing", "ingly"}
LI_ENDING = set("cdeghkmnrt")

_REGION = re.compile(r".*?[aeiouy][^aeiouy]", re.S)
_VOWEL = re.compile(r"[aeiouy]")
_SPECIAL_START = re.compile(r"gener|commun|arsen")
_SHORT_END = re.compile(r"(^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", re.S)


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 start."""
    start = _SPECIAL_START.match(word) or _REGION.match(word)
    r1 = start.end() if start else len(word)
    again = _REGION.match(word, r1)
    return r1, again.end() if again else len(word)


def _has_vowel(part: str) -> bool:
    return _VOWEL.search(part) is not None


def _by_last_letter(suffixes) -> dict[str, list[str]]:
    """The suffixes by their last letter, longest first."""
    found: dict[str, list[str]] = {}
    for suffix in sorted(suffixes, key=len, reverse=True):
        found.setdefault(suffix[-1], []).append(suffix)
    return found


_PAST, _STEP_2, _STEP_3, _STEP_4 = map(_by_last_letter, (PAST, STEP_2, STEP_3, STEP_4))


def _longest(word: str, suffixes: dict[str, list[str]]) -> str | None:
    for suffix in suffixes.get(word[-1], ()):
        if word.endswith(suffix):
            return suffix
    return None


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, _PAST)
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    if suffix in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not _has_vowel(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
        return base[:-1]
    if _SHORT_END.match(base) and r1 >= len(base):
        return base + "e"
    return base


def _derived(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, _STEP_2)
    if suffix and len(word) - len(suffix) >= r1:
        before = word[: -len(suffix)]
        refused = (suffix == "ogi" and before[-1:] != "l") or (suffix == "li" and before[-1:] not in LI_ENDING)
        if not refused:
            word = before + STEP_2[suffix]
    suffix = _longest(word, _STEP_3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + STEP_3[suffix]
    suffix = _longest(word, _STEP_4)
    if suffix and len(word) - len(suffix) >= r2:
        before = word[: -len(suffix)]
        if suffix != "ion" or before.endswith(("s", "t")):
            word = before
    return word


def _final(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT_END.match(word[:-1]))):
        return word[:-1]
    if word.endswith("ll") and at >= r2:
        return word[:-1]
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # a y that starts the word or follows a vowel is a consonant
    if "y" in word:
        word = re.sub(r"([aeiouy])y", r"\1Y", re.sub(r"^y", "Y", word))
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in SETTLED:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    return _final(word, r1, r2).lower()
