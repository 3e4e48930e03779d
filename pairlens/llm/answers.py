"""Problem 4, row by row: the parts of an answer and what is wrong with it.

A pushdown parser reads fences, braces, brackets, quotations, lists and fields; copies are found by greedy string tiling
over words, answers in another language by script and function words, refusals by a small grammar.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pairlens.llm.languages import language_of
from pairlens.llm.leaks import plain_words
from pairlens.llm.unify import caseless_text, readable_text

#: Words of the shortest tile, and how much of an answer may lie outside the tiles of a copy.
TILE_WORDS = 2
LOOSE_SHARE = 0.1
#: Least words of an answer that can be a copy.
COPY_WORDS = 4

# Words for the classes, which are answers of one word and no reasons, by language.
CLASS_WORDS = {
    "en": ("stable", "decline", "increase", "uncertain", "fire", "unchanged"),
    "es": ("estable", "descenso", "disminución", "aumento", "incierto", "incendio", "sin cambios"),
    "pt": ("estável", "diminuição", "declínio", "aumento", "incerto", "incêndio", "sem alteração"),
    "fr": ("stable", "diminution", "baisse", "hausse", "augmentation", "incertain", "incendie", "inchangé"),
    "de": ("stabil", "Rückgang", "Abnahme", "Zunahme", "unsicher", "Feuer", "unverändert"),
    "ru": ("стабильно", "снижение", "рост", "неопределённо", "пожар", "без изменений"),
    "hi": ("स्थिर", "कमी", "वृद्धि", "अनिश्चित", "आग"),
}

_LETTER, _SOMETHING = re.compile(r"[^\W_]"), re.compile(r"[^{}\[\]\s]")
_DANGLING = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s*$|<[a-zA-Z/][^<>]*$")
_STRIPPED = ".,;:!?()[]{}\"'*_>`-+"
_TOKEN = re.compile(r"```|\\.|[\"{}\[\]()“”«»]|<(/?)([a-zA-Z][\w-]*)(?:\s[^<>]*)?(/?)>", re.S)
# Elements of markup that have no end, and those whose end may be left out.
VOID_TAGS = frozenset("br hr img input meta link wbr col area base".split())
LOOSE_TAGS = frozenset("p li td th tr dt dd option body html".split())
_FENCE = re.compile(r"```[a-zA-Z]*")
_FIELD = re.compile(r"\"justification\"\s*:\s*(?:\"((?:[^\"\\]|\\.)*)(\"?)|null)", re.S)
_CLASS_REASON = re.compile(r"^\s*class\s*:\s*([^\n]*)\n+\s*reason\s*:(.*)$", re.S | re.I)
_CLASS_TAG = re.compile(r"\(\s*class\s*:[^()]*\)", re.I)
_KEY_ONLY = re.compile(r"(?:^|\n)\s*(?:class|reason)\s*:\s*$", re.I)
_CLOSES = {"}": "{", "]": "[", ")": "(", "”": "“", "»": "«"}
ENDERS = ".;!?।।…。"


def open_parts(text: str) -> list[str]:
    """What is still open at the end of a text, outermost first: fences, braces, brackets, quotations, elements of markup.

    In braces and brackets strings and escapes are read as in JSON; elsewhere a straight quote opens only before a word and after
    a blank or bracket. An element whose end may be left out is open only inside of one that must be closed.
    """
    stack: list[str] = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if stack and stack[-1] == '"':
            if t == '"':
                stack.pop()
        elif m[2]:
            tag = "<" + m[2].lower()
            if m[1]:
                if tag in stack and not {"{", "["} & set(stack[stack.index(tag) :]):
                    del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            elif not m[3] and tag[1:] not in VOID_TAGS and "{" not in stack:
                stack.append(tag)
        elif t == "```":
            if stack and stack[-1] == "```":
                stack.pop()
            elif "```" not in stack:
                stack.append(t)
        elif t == '"':
            if any(s in "{[" for s in stack):
                stack.append(t)
            elif stack and stack[-1] == "quote":
                stack.pop()
            elif (m.start() == 0 or text[m.start() - 1] in " \n(") and text[m.end() : m.end() + 1].isalnum():
                stack.append("quote")
        elif t in "{[(“«":
            stack.append(t)
        elif t in _CLOSES and stack and stack[-1] == _CLOSES[t]:
            stack.pop()
    while stack and stack[-1][1:] in LOOSE_TAGS and stack[-1][0] == "<" and not any(x[0] == "<" and x[1:] not in LOOSE_TAGS for x in stack):
        stack.pop()
    return stack


@dataclass
class Answer:
    """The parts of an answer."""

    reason: str  # without class, field names and fences; "" where there is none
    open: bool  # a structure was never closed
    closed: bool  # the text ends with a closed structure or a sentence's end
    blank: bool  # nothing that can be read, or an empty structure
    structured: bool  # the answer is an object of fields
    text: str = ""  # the whole answer as it is read


def _unescaped(s: str) -> str:
    try:
        return json.loads(f'"{s}"', strict=False)
    except ValueError:
        return s


def _bare(text: str) -> str:
    """Letters and digits of a visible text."""
    return re.sub(r"[\W_]+", " ", readable_text(text)).strip().lower()


_CLASS_FORMS = frozenset(x for ws in CLASS_WORDS.values() for w in ws for x in _bare(w).split())
_CLASS_LANGUAGES: dict[str, set[str]] = {}
for _code, _words in CLASS_WORDS.items():
    for _w in _words:
        _CLASS_LANGUAGES.setdefault(_bare(_w), set()).add(_code)


def only_class(text: str) -> bool:
    words = _bare(text).split()
    return 0 < len(words) <= 3 and all(w in _CLASS_FORMS for w in words)


def foreign_class(text: str, asked: str) -> bool:
    """Whether a class named alone is a word of other languages than the one that was asked in."""
    known = _CLASS_LANGUAGES.get(_bare(text), set())
    return asked != "und" and bool(known) and asked not in known


def read_answer(raw: str | None) -> Answer:
    """The parts of a raw answer; null is blank."""
    visible = readable_text(raw)
    if not visible:
        return Answer("", False, True, True, False)
    text = visible
    stack = open_parts(text)
    body = (_FENCE.sub(" ", text) if "```" in text else text).strip()
    if not _SOMETHING.search(body):
        return Answer("", False, True, True, True)
    # A closed object in a fence that was never closed reads as finished.
    is_open = bool([s for s in stack if s != "```"]) or (stack == ["```"] and not body.endswith("}"))
    if is_open and stack[-1] == "(" and "{" not in stack and body[-1] in ENDERS and not body.endswith("..."):
        is_open = False
    structured = body.startswith("{")
    if structured:
        m = _FIELD.search(body)
        return Answer(_unescaped(m[1] or "") if m else "", is_open, not is_open, False, True, text)
    m = _CLASS_REASON.match(body)
    reason = m[2] if m else body
    if not m:
        first, _, rest = body.partition("\n")
        if rest and only_class(first):
            reason = rest
        elif re.match(r"(?i)\s*class\s*:", first) and not rest:
            reason = ""
    reason = (_CLASS_TAG.sub(" ", reason) if "(" in reason else reason).strip()
    hanging = bool(_DANGLING.search(body)) or (body.rstrip(".… ")[-1:] in tuple(",:+-–(/=\ufffd") and not _KEY_ONLY.search(body))
    ends = body[-1] in ENDERS and not body.endswith(("...", "…")) and not re.search(r"\d\.$", body)
    # A class tag closes an answer; so does a finished "reason:" without a reason.
    ends = ends or bool(re.search(r"\(\s*class\s*:[^()]*\)$", body, re.I)) or bool(_KEY_ONLY.search(body))
    return Answer(reason, is_open or hanging, ends and not is_open and not hanging, False, False, text)


# The refusal grammar. A refusing clause is a subject, a denied ability and a verb of answering, with an excuse before
# it at most, or a denied answer as the subject. A refusal has such a clause; beside it may stand only excuses and courtesies.
_EXCUSE = r"(?:(?:i(?:'m| am) )?(?:very |so |truly )?sorry[,;:]?(?: but)? |unfortunately,? |regrettably,? |i apologi[sz]e,?(?: but)? |(?:my )?apologies[,;:]?(?: but)? |as an? (?:large )?(?:ai|language|virtual|text)(?:[- ](?:based|only|language))*(?: model| assistant)?,? |i(?:'m| am) (?:only |just )?an? (?:ai|language model|assistant)[^.]{0,40}?(?:,| and)? )?"
_WHO = r"(?:i|we|this (?:model|assistant|system)|the (?:model|assistant))"
_CANT = r"(?:(?:really |simply |just )?(?:can(?:no|')?t|can not|could not|couldn't|won't|will not|would rather not|may not)|(?:am|are|is|was|were|'m|'re) (?:really |simply )?(?:unable|not able|not in a position|not allowed|not permitted|not equipped|incapable)(?: to| of)?|(?:must|have to|has to|need to) (?:decline|refuse)(?: to)?|(?:have|has) no (?:way|means|ability)(?: to| of)?|(?:do not|don't|does not|doesn't|lack) (?:have )?(?:the |any )?(?:ability|means|way|capacity|permission)(?: to)?)"
_DO = r"(?:answer|help|assist|comply|comment|determine|judge|assess|view|see|say|tell|provide|give|decide|evaluate|describe|classify|analy[sz]e|respond|fulfil\w*|process|interpret|look|open|compare|explain|identify|make|offer|continue|complete|inspect|access|read|do (?:that|this|so)|be able)"
_REFUSING = [
    rf"{_WHO}(?: |(?='))?{_CANT}(?: be able to| possibly| to| really)* ?{_DO}",
    r"i (?:do not|don't) have (?:access|enough|the ability|permission|any information|sufficient)",
    r"(?:i|we) (?:decline|refuse) to \w+",
    r"(?:i am|we are) unable to",
    rf"(?:it is|it's|that is|that's) (?:not possible|impossible|beyond (?:me|my (?:abilities|ability|capabilities)))(?: for (?:me|us))?(?: to {_DO})?",
    r"(?:my|the) (?:guidelines?|polic(?:y|ies)|instructions|rules) (?:do not|don't|does not|doesn't|prevent|forbid|prohibit)",
    r"no (?:answer|class|response|verdict|judg(?:e)?ment) (?:can|could) be (?:provided|given|made)",
    r"(?:the|this|that|your) (?:question|request|task) (?:can(?:no|')?t|can not|cannot|is (?:beyond|outside)|exceeds)",
    r"(?:there is |there's )?(?:not enough|insufficient|too little) (?:information|data|evidence|context)",
    r"unable to (?:comply|answer|help|assist|determine|process|view|provide|judge|assess)",
    r"unanswerable\b",
    r"(?:request|answer) (?:denied|refused|declined)",
    r"cannot (?:answer|comply|determine|help|assist|judge|assess)",
    # Spanish
    r"(?:lo siento,? (?:pero )?)?(?:no (?:puedo|podemos|me es posible|es posible|se puede|soy capaz)|como modelo de lenguaje|lo siento|esta (?:pregunta|petición|solicitud) (?:no se puede|supera|excede))",
    # German
    r"(?:das|dies|die frage|diese frage) kann ich (?:leider )?nicht|(?:leider|tut mir leid,?)? ?(?:ich|wir) (?:kann|können) (?:ich )?(?:das |dies |hierzu )?(?:leider )?(?:nicht|keine)|(?:leider )?kann ich (?:das |dies )?(?:leider )?nicht|als sprachmodell|dazu liegen mir keine|es tut mir leid|eine antwort ist nicht möglich|mir ist (?:das|es) nicht möglich|diese (?:frage|anfrage) übersteigt",
    # French, Portuguese, Italian, Dutch
    r"(?:désolée?,? )?(?:mais )?je (?:ne (?:peux|suis|saurais)|regrette)|nous ne (?:pouvons|sommes)|il (?:ne m'est pas|m'est impossible)|en tant que modèle|(?:cette|votre) (?:demande|question) (?:dépasse|ne peut|excède)",
    r"(?:desculpe|lamento|sinto muito),?|não (?:posso|podemos|consigo|me é possível)|como modelo de linguagem|(?:este|esse) pedido (?:ultrapassa|excede)",
    r"(?:mi dispiace,? )?(?:ma )?non (?:posso|possiamo|sono in grado|mi è possibile)|het spijt me|ik kan (?:dit|dat|hier)? ?(?:helaas )?(?:niet|geen)",
    # Russian, Hindi
    r"(?:извините|простите|к сожалению),?|я не могу|мы не можем|как языковая модель|не могу ответить|этот (?:вопрос|запрос) (?:выходит|превышает)",
    r"क्षमा करें|माफ़? करें|मैं इसका उत्तर नहीं|.{0,60}उत्तर देना (?:मेरे लिए )?संभव नहीं|.{0,40}(?:असमर्थ हूँ|असमर्थ हूं)",
]
_REFUSAL = re.compile(rf"^\W*{_EXCUSE}(?:{'|'.join(_REFUSING)})", re.I)
_COURTESY = re.compile(r"^\W*(?:thank(?:s| you)\b|please\b|is there anything|feel free|let me know|have a (?:nice|good)|gracias|por favor|danke|bitte|vielen dank|merci|obrigad|спасибо|पुनः|धन्यवाद|sorry\W*$|(?:i'm|i am) (?:very |so )?sorry\b|(?:my )?apologies\b|i apologi[sz]e\b|(?:class|reason)\s*:)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?।;])\s+|\n+|(?<=unanswerable)\s+", re.I)


def is_refusal(reason: str) -> bool:
    """Whether a text declines to answer and says nothing else."""
    text = readable_text(reason).replace("’", "'").strip(" >*_\"'`-")
    if not text:
        return False
    # Most answers start with what is neither: their first sentence tells.
    if not _REFUSAL.match(text) and not _COURTESY.match(text):
        return False
    sentences = [s for s in _SENTENCE.split(text) if _bare(s)]
    return any(map(_REFUSAL.match, sentences)) and all(_REFUSAL.match(s) or _COURTESY.match(s) or only_class(s) for s in sentences)


def tiled(answer: list[str], source: list[str], least: int = TILE_WORDS) -> list[bool]:
    """Which words of the answer lie in tiles: the longest runs of words that also stand in the source, longest first.

    A run of the source may serve several tiles, so an answer that repeats its prompt is covered whole.
    """
    n = len(answer)
    covered = [False] * n
    places: dict[str, list[int]] = {}
    for j, w in enumerate(source):
        places.setdefault(w, []).append(j)
    # longest[i]: the longest common run that starts at answer[i]; only places with equal words are kept.
    below: dict[int, int] = {}
    longest = [0] * n
    for i in range(n - 1, -1, -1):
        below = {j: below.get(j + 1, 0) + 1 for j in places.get(answer[i], ())}
        longest[i] = max(below.values(), default=0)
    for i in sorted(range(n), key=lambda k: -longest[k]):
        run = 0
        while run < longest[i] and not covered[i + run]:
            run += 1
        if run >= least:
            covered[i : i + run] = [True] * run
    return covered


def is_copy(reason: str, prompt: str | None) -> tuple[bool, bool]:
    """(whether a reason is a copy of its prompt, whether its last word is part of the copy)."""
    source = caseless_text(prompt)
    plain = bool(source) and "<" not in source and "&" not in source
    if plain and "<" not in reason and "&" not in reason:
        # Words that stand between blanks and not in the prompt's characters can't be in a tile.
        outside = most = 0
        for t in (reason.lower() if reason.isascii() else caseless_text(reason)).split():
            t = t.strip(_STRIPPED)
            if t.isalnum():
                most += 1
                outside += t not in source
            else:
                most += len(t) // 2 + 1
        if outside > max(1, LOOSE_SHARE * most):
            return False, False
    a = plain_words(reason)
    if len(a) < COPY_WORDS or not source:
        return False, False
    most = max(1, LOOSE_SHARE * len(a))
    # A word that isn't in the prompt's characters isn't among its words, unless marks stand inside of them.
    if plain and len(a) - sum(map(source.__contains__, a)) > most:
        return False, False
    p = plain_words(prompt)
    known = {tuple(p[i : i + TILE_WORDS]) for i in range(len(p) - TILE_WORDS + 1)}
    shared = sum(tuple(a[i : i + TILE_WORDS]) in known for i in range(len(a) - TILE_WORDS + 1))
    # A copy's tiles hold 90 % of its words, and each tile of L words L - 1 of these runs: fewer can't make a copy.
    if shared * 4 < len(a) - 4:
        return False, False
    covered = tiled(a, p)
    return covered.count(False) <= most, covered[-1]


def reason_cut(justification: str | None, answer: Answer, raw: str | None) -> bool:
    """Whether a parsed reason stops before the reason, or the whole text, of the raw answer; a class tag behind it is no part."""
    if not justification or justification == raw or justification == answer.reason:
        return False
    j = " ".join(readable_text(justification).split())
    if not j:
        return False
    for whole in (answer.reason, raw):
        w = " ".join(readable_text(whole).split())
        if len(w) > len(j) and w.startswith(j) and _LETTER.search(_CLASS_TAG.sub(" ", w[len(j) :])):
            return True
    return False


def defect_of(raw: str | None, justification: str | None, prompt: str | None, wanted: str | None) -> tuple[str | None, Answer, bool]:
    """(defect without truncation of the raw text, the answer's parts, whether the defect may yet turn out to be a truncation).

    Order: an answer of nothing is empty, a refusal a refusal, a copy a copy; then a parsed reason that alone stops early, then
    another language. Where the parsed reason stops early the raw text may have been cut as well. ``wanted`` is "short" where one word was asked for, so that no reason is missed there.
    """
    answer = read_answer(raw)
    if answer.blank:
        return ("empty" if not readable_text(justification) or raw is not None else None), answer, False
    if is_refusal(answer.reason):
        return "refusal", answer, False
    if answer.open and answer.structured:
        return "truncated", answer, False
    bare = not _LETTER.search(answer.reason) or (wanted != "short" and only_class(answer.reason))
    if wanted == "short" and only_class(alone := answer.reason if _LETTER.search(answer.reason) else readable_text(raw)):
        # One word was asked for, so the word itself is the answer whose language counts; beside a reason it wouldn't.
        return ("other_language" if foreign_class(alone, language_of(prompt)) else None), answer, not answer.structured
    if bare:
        return "empty", answer, not answer.structured and bool(_LETTER.search(answer.reason))
    copy, whole = is_copy(answer.reason, prompt)
    if copy:
        return "copied", answer, not whole
    if answer.open or reason_cut(justification, answer, raw):
        return "truncated", answer, not answer.open
    asked, given = language_of(prompt), language_of(answer.reason)
    if asked != "und" and given != "und" and asked != given:
        return "other_language", answer, True
    return None, answer, True
