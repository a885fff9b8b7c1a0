"""English stems by Porter's second algorithm, and stop words: for distinct words, never word by word of a text."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
#: Letters after which -li falls away.
LI = "cdeghkmnrt"
# Words with a stem of their own.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
OWN |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
# Words that end once their plural is off.
ENDED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffixes of the second and third step with what takes their place, and those that the fourth takes off.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = {s: "" for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")}
# Words that say nothing.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a
    an the and but if or because as until while of at by for with about against between into through during before after above below to from
    up down in out on off over under again further then once here there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don should now""".split()
)


def region(word: str, start: int) -> int:
    """Where the part of word behind the first other letter after a vowel begins, from start on."""
    found = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return found.end() if found else len(word)


def short_syllable(word: str) -> bool:
    """Whether word ends in a vowel and one other letter that closes it, alone or behind another letter that is no vowel."""
    return bool(re.search("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


def longest(word: str, suffixes: dict[str, str] | tuple[str, ...]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def swapped(word: str, suffixes: dict[str, str], first: int) -> tuple[str, str, str]:
    """What stands before the longest suffix, that suffix if it begins at first or later, and what takes its place."""
    suffix = longest(word, suffixes)
    at = len(word) - len(suffix)
    return (word[:at], suffix, suffixes[suffix]) if suffix and at >= first else (word, "", "")


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of two letters stay, as does what is no English word but for its endings."""
    if len(word) <= 2:
        return word
    if word in OWN:
        return OWN[word]
    word = word.removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    r1 = len(prefix) or region(word, 0)
    r2 = region(word, r1)

    word = word[: len(word) - len(longest(word, ("'", "'s", "'s'")))]
    ending = longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in ENDED:
        return word

    ending = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    before = word[: len(word) - len(ending)]
    if ending in ("eed", "eedly"):
        word = before + "ee" if len(before) >= r1 else word
    elif ending and re.search("[aeiouy]", before):
        word = before
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and short_syllable(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    before, suffix, other = swapped(word, SECOND, r1)
    if suffix and (suffix != "ogi" or before.endswith("l")) and (suffix != "li" or before[-1:] in tuple(LI)):
        word = before + other
    before, suffix, other = swapped(word, THIRD, r1)
    if suffix and (suffix != "ative" or len(before) >= r2):
        word = before + other
    before, suffix, other = swapped(word, FOURTH, r2)
    if suffix and (suffix != "ion" or before[-1:] in ("s", "t")):
        word = before
    if word.endswith("e") and (len(word) > r2 or len(word) > r1 and not short_syllable(word[:-1])) or word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")
