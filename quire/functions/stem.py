"""English stems (the published Snowball "english" rules), cached by word."""

from __future__ import annotations

import functools
import re

VOWELS = "aeiouy"

# Fixed values of the published rules: exceptions, suffixes and what they become.
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
PREFIXES = "gener commun arsen".split()
DERIVED = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
LI_ENDING = "cdeghkmnrt"
FORMED = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
DROPPED = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
DOUBLES = "bb dd ff gg mm nn pp rr tt".split()


def _after(word: str, start: int) -> int:
    """Place behind the first consonant that follows a vowel, from ``start`` on."""
    found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
    return found.end() if found else len(word)


def _regions(word: str) -> tuple[int, int]:
    prefix = next((p for p in PREFIXES if word.startswith(p)), None)
    first = len(prefix) if prefix else _after(word, 0)
    return first, _after(word, first)


def _ends_short(word: str) -> bool:
    """Does the word end in a short syllable?"""
    return bool(re.search(f"(?:^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])$", word))


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@functools.lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(f"(^|[{VOWELS}])y", r"\1Y", word.removeprefix("'"))
    one, two = _regions(word)
    for s in ("'s'", "'s", "'"):
        if word.endswith(s):
            word = word[: -len(s)]
            break
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", word[:-1]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word
    # Past and progressive forms.
    s = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(word) - len(s) >= one:
            word = word[: -len(s)] + "ee"
    elif s and re.search(f"[{VOWELS}]", word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(tuple(DOUBLES)):
            word = word[:-1]
        elif one >= len(word) and _ends_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # Derived forms, longest suffix first; what it fails to fulfil ends the step.
    s = _longest(word, DERIVED)
    if s and len(word) - len(s) >= one and (s != "ogi" or word[-4:-3] == "l") and (s != "li" or word[-3:-2] in tuple(LI_ENDING)):
        word = word[: -len(s)] + DERIVED[s]
    s = _longest(word, FORMED)
    if s and len(word) - len(s) >= (two if s == "ative" else one):
        word = word[: -len(s)] + FORMED[s]
    s = _longest(word, DROPPED)
    if s and len(word) - len(s) >= two and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e") and (len(word) > two or (len(word) > one and not _ends_short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > two:
        word = word[:-1]
    return word.lower()
