"""Problem 9: one consistent form for texts that look alike but are made of different characters.

Only segments that a quick check calls unstable are normalised, each with the character before it as context, and spliced
back into the unchanged rest. The form keeps everything that can be seen, so digits, accents, letter case and raised
figures stay apart.
"""

from __future__ import annotations

import glob
import hashlib
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.skew import salted_join, spread
from pairlens.session import materialize
from pairlens.sources.tables import table

# Signs that look alike, and what they become. Letters come from the public table of confusable characters.
LOOK_ALIKES = {"∆": "Δ", "º": "°", "˚": "°", "∘": "°", "‐": "-", "‑": "-", "µ": "μ", "Ω": "Ω", "ꞌ": "'", "ǃ": "!"}
# Letters that look Latin though the table has them not, or by another letter.
MORE_LETTERS = {"Ԛ": "Q", "Һ": "h", "ӏ": "l"}

# Compatibility forms that differ from their letters only in width, joining or context.
SAME_LOOK_TAGS = frozenset({"<wide>", "<narrow>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>", "<font>"})
#: The table of confusable characters: a member of the Unicode library that comes with Spark.
CONFUSABLES = "com/ibm/icu/impl/data/icudata/confusables.cfu"

_LETTERS, _ASCII_LETTER = re.compile(r"[^\W\d_]+"), re.compile("[A-Za-z]")
_LINE_BREAKS = re.compile("\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_CONTROLS = re.compile("[\x00-\x08\x0b-\x1f\x7f]")
_SPACE_RUN = re.compile(r"[\t ]{2,}|\t")
_LINE_EDGE = re.compile(r"(?: +(?=\n)|(?<=\n) +)")


def _ignorable(cp: int) -> bool:
    """Characters that are not drawn: format controls, variation selectors, fillers, tags."""
    if cp in (0x00AD, 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE0FFF:
        return True
    c = chr(cp)
    kind = unicodedata.category(c)
    return (kind == "Cf" and not 0x0600 <= cp <= 0x08E2 and cp != 0x110BD) or (kind == "Cc" and c not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x85")


def _confusable_bytes() -> bytes:
    """The table as it lies in the library's archive; the setting PAIRLENS_CONFUSABLES may name another copy of the file."""
    if named := os.environ.get("PAIRLENS_CONFUSABLES"):
        with open(named, "rb") as f:
            return f.read()
    import pyspark

    homes = [os.environ.get("SPARK_HOME", ""), *pyspark.__path__, os.path.join(pyspark.__path__[0], *[os.pardir] * 3)]
    for archive in (a for h in homes if h for a in sorted(glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))):
        with zipfile.ZipFile(archive) as z:
            return z.read(CONFUSABLES)
    raise FileNotFoundError("no table of confusable characters: set PAIRLENS_CONFUSABLES or SPARK_HOME")


def _prototypes(raw: bytes) -> dict[str, str]:
    """The prototype of each confusable character: big-endian sections of keys (code point, length), places and UTF-16 units."""
    body = raw[struct.unpack_from(">H", raw)[0] :]
    keys, n, places, _, units, n_units = struct.unpack_from(">6i", body, 12)
    text = body[units : units + 2 * n_units]
    out = {}
    for k, v in zip(struct.unpack_from(f">{n}i", body, keys), struct.unpack_from(f">{n}H", body, places)):
        length = ((k >> 24) & 0xFF) + 1
        out[chr(k & 0xFFFFFF)] = chr(v) if length == 1 else text[2 * v : 2 * (v + length)].decode("utf-16-be")
    return out


@lru_cache(maxsize=1)
def look_alike_letters() -> dict[str, str]:
    """Letters that look like another one, and that one: an ASCII letter of the same case where there is one, else their prototype.

    Only single letters count; ASCII letters, raised and lowered ones, the parts of Korean syllables and those whose only likeness has another case stay.
    """
    proto = _prototypes(_confusable_bytes())
    plain: dict[tuple[str, str], str] = {}
    for c in map(chr, range(0x41, 0x7B)):
        if c.isalpha():
            plain[(proto.get(c, c), unicodedata.category(c))] = c
    out = {}
    for c, p in proto.items():
        kind, tag = unicodedata.category(c), unicodedata.decomposition(c).split(" ")[0]
        p = unicodedata.normalize("NFD", p)
        if c.isascii() or 0x1100 <= ord(c) <= 0x11FF or 0xA960 <= ord(c) <= 0xA97F or 0xD7B0 <= ord(c) <= 0xD7FF or kind[0] != "L" or kind == "Lm" or len(p) != 1 or tag in ("<super>", "<sub>", "<circle>", "<square>"):
            continue
        other = unicodedata.category(p)
        if kind in ("Lu", "Ll"):
            to = plain.get((p, kind)) or (p if other == kind else c)
        else:
            to = p if other[0] == "L" else c
        if to != c and unicodedata.normalize("NFD", c) == c:
            out[c] = to
    return out | MORE_LETTERS


def _folded(c: str, letters: bool = True) -> str:
    """The form of one fully decomposed character; without ``letters`` a letter keeps its script."""
    if _ignorable(ord(c)):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    like = look_alike_letters() if letters else {}
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in SAME_LOOK_TAGS:
        plain = unicodedata.normalize("NFKD", c)
        # Spacing accents are no accents on a blank.
        if not (plain[:1] == " " and len(plain) > 1) and (plain.isascii() or c not in like):
            return "".join(LOOK_ALIKES.get(x, like.get(x, x)) for x in plain)
    return like.get(c, c)


@lru_cache(maxsize=2)
def _tables(letters: bool = True) -> tuple[re.Pattern[str], dict[int, str]]:
    """The pattern of unstable segments and the folding of decomposed characters, with that of letters or without."""
    fold: dict[int, str] = {}
    unstable: list[int] = []
    known = LOOK_ALIKES.keys() | (look_alike_letters().keys() if letters else set()) | {"\u115f", "\u3164", "\uffa0"}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or 0x4E00 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF or 0x2FA20 <= cp <= 0xDFFFF or cp >= 0xE1000:
            continue  # nothing in these ranges changes
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cn" or (kind[0] in "LNPS" and c not in known and not unicodedata.decomposition(c) and not 0x1160 <= cp <= 0x11C2):
            continue  # stands for itself
        to = _folded(c, letters)
        if to != c:
            fold[cp] = to
        whole = unicodedata.normalize("NFC", "".join(_folded(x, letters) for x in unicodedata.normalize("NFD", c)))
        # Marks and jamo may compose with what stands before them (quick check: maybe).
        if cp > 0xFFFF:
            continue
        if whole != c or unicodedata.combining(c) or 0x1161 <= cp <= 0x11C2 or unicodedata.category(c) == "Mc":
            unstable.append(cp)
    for cp in (*range(0, 9), *range(14, 28), 0x1F, 0x7F):
        fold[cp] = ""
        unstable.append(cp)
    ranges, start = [], None
    for a, b in zip(sorted(unstable), [*sorted(unstable)[1:], -1]):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
            start = None
    # Beyond the basic plane every character counts as unstable: one range keeps the class a table look-up.
    return re.compile(f"[{''.join(ranges)}\U00010000-\U0010ffff]+"), fold


def _normal(text: str, letters: bool = True) -> str:
    fold = _tables(letters)[1]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(fold)))


def _spliced(text: str, letters: bool = True) -> str:
    """``text`` with each unstable run, and the character before it, replaced by its form."""
    parts, done = [], 0
    for m in _tables(letters)[0].finditer(text):
        start = max(m.start() - 1, done)
        parts += (text[done:start], _normal(text[start : m.end()], letters))
        done = m.end()
    return "".join([*parts, text[done:]]) if parts else text


@lru_cache(maxsize=1)
def _mixed_words() -> tuple[re.Pattern[str], dict[int, str], dict[str, dict[int, str]]]:
    """Letters that look Latin, the Latin letters of these, and the letters of each other script that look like Latin ones."""
    to_latin = {c: t for c, t in look_alike_letters().items() if t.isascii()}
    back: dict[str, dict[int, str]] = {}
    for c, t in sorted(to_latin.items()):
        script = unicodedata.name(c, "?").split(" ")[0]
        if unicodedata.category(c) == unicodedata.category(t) and script != "LATIN":
            back.setdefault(script, {}).setdefault(ord(t), c)
    # Beyond the basic plane one range, as in the pattern of unstable segments.
    letters = "".join(re.escape(c) for c in sorted(to_latin) if c <= "\uffff")
    return re.compile(f"[{letters}\U00010000-\U0010ffff]"), {ord(c): t for c, t in to_latin.items()}, back


def _one_script(m: re.Match[str]) -> str:
    """A word of Latin and other letters in the script that all of its letters can be taken for; Latin first, unchanged if there is none."""
    word = m[0]
    if word.isascii() or not _ASCII_LETTER.search(word):
        return word
    latin, back = _mixed_words()[1:]
    folded = word.translate(latin)
    if all(unicodedata.name(c, "").startswith("LATIN") for c in folded):
        return folded
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in word if not c.isascii()}
    own = back.get(scripts.pop(), {}) if len(scripts) == 1 else {}
    return word.translate(own) if all(ord(c) in own for c in word if c.isascii()) else word


def readable_text(text: str | None) -> str:
    """The form of a text for readers: that of :func:`canonical_text`, but letters keep their script, save in words that mix scripts."""
    if not text:
        return ""
    if not text.isascii() or _CONTROLS.search(text):
        text = _LINE_BREAKS.sub("\n", _spliced(text, letters=False))
        if not text.isascii() and _mixed_words()[0].search(text):
            text = _LETTERS.sub(_one_script, text)
    return _even_spaces(text)


@lru_cache(maxsize=1)
def caseless_letters() -> tuple[re.Pattern[str], dict[int, str]]:
    """Small letters of other scripts whose capital, or else they themselves, look Latin, as a pattern and with the Latin small letter."""
    like = look_alike_letters()
    out = {}
    for c in {x.lower() for x in like} | like.keys():
        to = like.get(c.upper(), "") if like.get(c.upper(), "").isascii() and c.upper() in like else like.get(c, "")
        if len(c) == 1 and c == c.casefold() and to and to.isascii():
            out[ord(c)] = to.lower()
    return re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(out) if c <= 0xFFFF) + "\U00010000-\U0010ffff]+"), out


def caseless_text(text: str | None) -> str:
    """The form of a text in which case and look-alike letters make no difference, whichever case they are alike in."""
    t = readable_text(text).casefold()
    if t.isascii():
        return t
    pattern, letters = caseless_letters()
    return pattern.sub(lambda m: m[0].translate(letters), t)


def canonical_text(text: str | None) -> str:
    """The one form of a text; "" for null and for a text without a visible character.

    Characters that are not drawn vanish, letters are composed, widths, ligatures and look-alikes become plain letters,
    every run of blanks in a line becomes one blank, blanks at the ends of lines and of the text and blank ends of text go.
    Letters of any script that the public table calls confusable with a Latin letter become that one, so this form serves to compare.
    """
    if not text:
        return ""
    if not text.isascii() or _CONTROLS.search(text):
        text = _LINE_BREAKS.sub("\n", _spliced(text))
    return _even_spaces(text)


def _even_spaces(text: str) -> str:
    if "  " in text or "\t" in text:
        text = _SPACE_RUN.sub(" ", text)
    if " \n" in text or "\n " in text:
        text = _LINE_EDGE.sub("", text)
    return text.strip(" \n")


def whole_text_form(text: str) -> str:
    """The form of :func:`canonical_text` without segments: every character is folded. For tests."""
    return _LINE_EDGE.sub("", _SPACE_RUN.sub(" ", _LINE_BREAKS.sub("\n", _normal(text)))).strip(" \n")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        form = [canonical_text(t) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "form_hash": [_digest(f) if f else None for f in form], "text_hash": [_digest(t) if t else None for t in pdf["text"]]})


def form_hashes(documents: DataFrame) -> DataFrame:
    """(``doc_id``, ``form_hash``, ``text_hash``), 128 bits each; the form's hash is null where nothing is visible."""
    return spread(documents.select("doc_id", "text")).mapInPandas(_forms, "doc_id long, form_hash binary, text_hash binary")


def look_alike_classes(documents: DataFrame) -> DataFrame:
    """(``doc_id``, ``class_id``, ``n_forms``, ``n_docs``) of documents whose look another document shares in other characters.

    The class id is the least ``doc_id`` with the same form; ``n_forms`` counts the different texts. Documents with a null or
    invisible text, and those whose look-alikes are all byte-equal, are left out. Groups are counted, never gathered.
    """
    h = materialize(form_hashes(documents).filter(F.col("form_hash").isNotNull()), "forms")
    texts = h.groupBy("form_hash", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    several = texts.groupBy("form_hash").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_docs"), F.min("first").alias("class_id")).filter("n_forms > 1")
    return salted_join(h.select("doc_id", "form_hash"), several, ["form_hash"], F.col("doc_id")).select("doc_id", "class_id", "n_forms", "n_docs")


def _spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [None if t is None else readable_text(t) for t in pdf["text"]], "form": [None if t is None else canonical_text(t) for t in pdf["text"]]})


def p9_texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document's text as it is to be read (``text``) and in the one form in which look-alikes are equal (``form``); null stays null."""
    return spread(table(spark, data_dir, "documents").select("doc_id", "text")).mapInPandas(_spelled, "doc_id long, text string, form string")


def p9_classes(spark: SparkSession, data_dir: str) -> DataFrame:
    """The class of each document that looks like another one in other characters."""
    return look_alike_classes(table(spark, data_dir, "documents"))


def p9_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs of documents that look the same but differ in their characters."""
    h = materialize(form_hashes(table(spark, data_dir, "documents")).filter(F.col("form_hash").isNotNull()), "forms")
    several = h.groupBy("form_hash", "text_hash").agg(F.lit(1).alias("one")).groupBy("form_hash").agg(F.count("one").alias("n")).filter("n > 1").select("form_hash")
    some = materialize(salted_join(h, several, ["form_hash"], F.col("doc_id")), "look-alikes")
    a = some.select("form_hash", F.col("doc_id").alias("doc_a"), F.col("text_hash").alias("hash_a"))
    b = some.select("form_hash", F.col("doc_id").alias("doc_b"), F.col("text_hash").alias("hash_b"))
    return salted_join(b, a, ["form_hash"], F.col("doc_b")).filter((F.col("doc_a") < F.col("doc_b")) & (F.col("hash_a") != F.col("hash_b"))).select("doc_a", "doc_b")


QUERIES = {"p9_found": p9_found, "p9_classes": p9_classes, "p9_texts": p9_texts}
SQL: dict[str, str] = {}
