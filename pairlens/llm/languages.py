"""The language of a short text, by script and function words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Frequent function words of each language that is written in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in is was that which for with from by on at this it be are not have has but both here one so though while because than its could would an any only still were after before since behind near over under without moved adds supports overall as apart most last well once too more also been may can will there then first into what how why",
    "es": "el la los las de del en que con una un por para se su al fue es más entre sobre sin no cerca junto tono según aunque durante quedó cambió pasó luego ni lo como hay está diga hacia",
    "de": "der die das und in im den dem des von zu mit auf um ist war nicht ein eine einer am bei wurde sich aus nach obwohl laut nördlich zur zum kaum etwas oder wie ob dann",
    "fr": "le la les des du de et en une un est été que qui dans sur pour par au aux avec même si plus peu près c'est n'a autour nord ou",
    "pt": "os as do da dos das de em no na nos nas um uma que com por para se ao foi mais sem não perto junto segundo embora durante ficou mudou passou há equipe anotou permaneceu ele ela isso este esta seu sua são está foram pelo pela ao dos",
    "it": "il gli dello della delle nel nella nelle è sono stato stata più questo questa dopo prima senza molto tra fra degli dei dal dalla alla ed di perché",
    "nl": "het een van niet voor zijn ook maar naar bij werd wordt deze dit tussen geen nog wel heeft aan uit zich tot omdat onder hun veel",
}
_LANGUAGES_OF: dict[str, list[str]] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGES_OF.setdefault(_w, []).append(_code)
_APART = {i: " " for i in range(128) if not chr(i).isalpha() and chr(i) != "'"}
_BEYOND, _SMALL = re.compile(r"[^\x00-\x7f]"), re.compile(r"[a-z]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?", re.UNICODE)
# Scripts that stand for one language here.
SCRIPT_LANGUAGE = {"CYRILLIC": "ru", "DEVANAGARI": "hi", "ARABIC": "ar", "HIRAGANA": "ja", "KATAKANA": "ja", "CJK": "zh", "HANGUL": "ko", "GREEK": "el", "HEBREW": "he", "THAI": "th"}
CODES = (*FUNCTION_WORDS, *sorted(set(SCRIPT_LANGUAGE.values())), "und")


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


@lru_cache(maxsize=256)
def language_of(text: str | None, least: int = 2) -> str:
    """A language code, or "und" where the text gives too little to tell. Names and capitals in Latin letters don't count
    against another script."""
    if not text:
        return "und"
    if not text.isascii():
        # Signs of measurement are of no language.
        text = text.replace("Δ", " ").replace("°", " ")
    if not text.isascii():
        foreign: dict[str, int] = {}
        rest = ""
        for c in _BEYOND.findall(text):
            s = _script(c) if c.isalpha() else ""
            if s in SCRIPT_LANGUAGE:
                foreign[s] = foreign.get(s, 0) + 1
            else:
                rest += c
        if foreign:
            s = max(foreign, key=lambda k: (foreign[k], k))
            # A name or two in Latin letters stands in every such text.
            if foreign[s] >= 4 and foreign[s] * 2 >= len(_SMALL.findall(text)) + sum(map(str.islower, rest)):
                return SCRIPT_LANGUAGE[s]
    words = text.lower().translate(_APART).split() if text.isascii() else _WORD.findall(text.lower())
    scores = dict.fromkeys(FUNCTION_WORDS, 0)
    for ks in filter(None, map(_LANGUAGES_OF.get, words)):
        for k in ks:
            scores[k] += 1
    best = max(scores, key=lambda k: scores[k])
    rest = max(v for k, v in scores.items() if k != best)
    if scores[best] <= rest or (scores[best] < least and (rest or len(words) < 4)):
        return "und"
    return best
