"""Problems 1 and 4: texts cut off before their end, and defective answers.

The end of a text is judged by a backward character n-gram model. Its contexts are the last characters before a place where
a word, a digit or a sign ends, with digits and names masked; it counts how often a sentence ends there and how often it goes on.
A second family of contexts reaches back to the start of the last word and counts how often the word is whole. Ends of texts
themselves are never counted, so a cut can't vouch for itself. Every answer is asked for, whatever it ends with: a final sign is
part of the context. A text is cut if the log-odds of an end in its final context lie under the threshold of its language and
column; where a structure was left open the parser has seen the cut already.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.answers import ENDERS, defect_of
from pairlens.llm.languages import CODES, language_of
from pairlens.llm.unify import readable_text
from pairlens.operators.skew import salted_join, spread
from pairlens.session import materialize
from pairlens.sources.tables import table

#: Characters of the contexts, longest first; the longest one that was seen LEAST_SEEN times decides.
ORDERS = (28, 18, 12, 8, 5)
LEAST_SEEN = 3
#: Parts of a language's own log-odds, of an end and of a whole word, that are its thresholds; behind a sign an end must be likelier than not.
THRESHOLD_SHARE = 0.5
WORD_SHARE = 2.5
#: Contexts that one task holds before it merges them.
HELD_KEYS = 4_000_000
#: Characters that are hashed at once.
PACK_CHARS = 500_000
#: Ranks of final contexts behind a sign start here.
BEHIND_SIGN = 100

_NAME = re.compile(r"\b[A-ZÀ-ÖØ-ÞĀ-Ž][a-zß-öø-ÿā-ž]{2,}\b")
_BLANK = re.compile(r"\s")
_BEGIN, _END = "\x02", "\x03"
_CLOSERS = ")]\"'”»*_`"
_SIGNS = ENDERS.replace("…", "") + ")]}"
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(pow(int(_P), -1, 1 << 64))


def masked(text: str) -> str:
    """Capitalised words become X; the length may change."""
    return _NAME.sub("X", text)


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(31))).view(np.int64)


class _Packed:
    """Texts as one array of characters, with hashes of any stretch that ends at a place."""

    def __init__(self, texts: list[str], same_digits: bool = False) -> None:
        whole = "".join(f"{_BEGIN}{t}{_END}" for t in texts)
        self.c = np.frombuffer((whole + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = self.c.size
        kinds = {int(u): (2 if chr(u).isdecimal() or chr(u) == "%" or unicodedata.category(chr(u))[0] == "S" else 1 if chr(u).isalpha() or chr(u) in "्ंः" or 0x0300 <= u <= 0x036F or 0x0900 <= u <= 0x0963 else 0) for u in np.unique(self.c)}
        keys = np.fromiter(kinds, np.uint32, len(kinds))
        self.kind = np.fromiter(kinds.values(), np.int8, len(kinds))[np.searchsorted(keys, self.c)]
        if same_digits:
            self.c = np.where(np.isin(self.c, [u for u in kinds if chr(u).isdecimal()]), np.uint32(ord("0")), self.c)
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.full(n + 1, _P, np.uint64))
            down = np.multiply.accumulate(np.full(n, _Q, np.uint64))
            self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.c.astype(np.uint64) + np.uint64(1)) * down)])
        starts = np.flatnonzero(self.c == ord(_BEGIN))
        self.begin = np.zeros(n, np.int64)
        self.begin[starts] = starts
        np.maximum.accumulate(self.begin, out=self.begin)
        self.ends = np.flatnonzero(self.c == ord(_END))

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sum[stop] - self.sum[start]) * self.up[stop]

    def contexts(self, stop: np.ndarray) -> list[np.ndarray]:
        first = self.begin[stop - 1]
        return [_mix(self.hash(np.maximum(stop - k, first), stop), 0xA0 + r) for r, k in enumerate(ORDERS)]


_ENDER_CODES = np.array([ord(x) for x in ENDERS if x not in "…"], np.uint32)
_CLOSER_CODES = np.array([ord(x) for x in _CLOSERS], np.uint32)
_SIGN_CODES = np.array([ord(x) for x in _SIGNS], np.uint32)
_AFTER_CODES = np.array([ord(x) for x in " \n\t\"}]*" + _END], np.uint32)


def _events(p: _Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a word, a digit or a sign ends, apart from ends of texts, whether a sentence ends there, and whether behind a sign."""
    k, c = p.kind, p.c
    sign = np.isin(c, _SIGN_CODES)
    stop = np.flatnonzero(((k[:-4] == 1) & (k[1:-3] != 1)) | (k[:-4] == 2) | sign[:-4]) + 1
    at = stop.copy()
    for _ in range(3):
        shut = np.isin(c[at], _CLOSER_CODES) & (c[at] != ord('"'))
        at = np.where(shut, at + 1, at)
    a, b = c[at], c[at + 1]
    behind = sign[stop - 1]
    dots = (a == ord("…")) | ((a == ord(".")) & ((b == ord(".")) | behind))
    end = np.where(behind, np.isin(a, _AFTER_CODES), (np.isin(a, _ENDER_CODES) & np.isin(b, _AFTER_CODES)) | (a == 10) | (a == ord('"')))
    keep = (a != ord(_END)) & ~dots
    return stop[keep], end[keep], behind[keep]


def _word_starts(p: _Packed, at: np.ndarray, back: bool) -> np.ndarray:
    """Where the word of each letter starts, or with ``back`` the word before it (the text's begin where there is none)."""
    k = p.kind == 1
    first = np.flatnonzero(k & ~np.concatenate([[False], k[:-1]]))
    if not len(first):
        return p.begin[at]
    nth = np.searchsorted(first, at, "right") - 1
    if not back:
        return first[np.maximum(nth, 0)]
    return np.where(nth > 0, np.maximum(first[np.maximum(nth - 1, 0)], p.begin[at]), p.begin[at])


def _word_events(p: _Packed, back: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop, wholeness and number of each beginning of a word, equal words folded; and where each word starts, and its letters.

    A beginning starts at its word, or with ``back`` at the word before it. Words cut by a text's end are left out.
    """
    k = p.kind == 1
    first = np.flatnonzero(k & ~np.concatenate([[False], k[:-1]]))
    stop = np.flatnonzero(k & ~np.concatenate([k[1:], [False]])) + 1
    begin = _word_starts(p, first, True) if back else first
    keep = (p.c[stop] != ord(_END)) & ~((p.c[stop] == ord(".")) & (p.c[stop + 1] == ord(".")))
    first, stop, begin = first[keep], stop[keep], begin[keep]
    _, one, n = np.unique(p.hash(begin, stop), return_index=True, return_counts=True)
    letters = stop[one] - first[one]
    upto = np.repeat(first[one], letters) + np.arange(int(letters.sum())) - np.repeat(np.cumsum(letters) - letters, letters) + 1
    return np.repeat(begin[one], letters), upto, upto == np.repeat(stop[one], letters), np.repeat(n, letters), first, stop - first


@lru_cache(maxsize=None)
def _language_key(code: str, family: int = 0x1A) -> int:
    """The key under which a language's ends (or, with WORDS, its whole words) are counted."""
    return int(_mix(np.array([CODES.index(code)], np.uint64), family)[0])


WORDS = 0x1B


def _sign_keys(codes: np.ndarray, p: _Packed, stop: np.ndarray) -> np.ndarray:
    """A key of the language, the sign before a place and the kind of character before the sign: what a sign says by itself."""
    what = p.c[stop - 1].astype(np.int64) * 4 + p.kind[np.maximum(stop - 2, 0)]
    return _mix((codes ^ (what << 8)).view(np.uint64), 0x1C)


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, times seen, times at an end) of all contexts of the texts."""
    keys, seen, ends = [], [], []

    def add(key: np.ndarray, n: np.ndarray, end: np.ndarray) -> None:
        keys.append(key)
        seen.append(n)
        ends.append(n * end)

    m, w = _Packed([masked(t) for t in texts], same_digits=True), _Packed(texts)
    stop, end, behind = _events(m)
    # Places with the same longest context have the same shorter ones, so only one of them is looked at.
    longest = _mix(m.hash(np.maximum(stop - ORDERS[0], m.begin[stop - 1]), stop) ^ (end.astype(np.uint64) << np.uint64(63)), 0x9F)
    _, one, n = np.unique(longest, return_index=True, return_counts=True)
    for h in m.contexts(stop[one]):
        add(h, n, end[one])
    start, upto, whole, n, word_at, letters = _word_events(w)
    add(_mix(w.hash(start, upto), 0x30), n, whole)
    start, upto, whole, n, _, _ = _word_events(m, back=True)
    add(_mix(m.hash(start, upto), 0x31), n, whole)
    languages = [language_of(t) for t in texts]
    codes = np.fromiter(map(_language_key, languages), np.int64, len(texts))
    text_of = np.searchsorted(m.ends, stop, "left")
    add(_sign_keys(codes[text_of[behind]], m, stop[behind]), np.ones(int(behind.sum()), np.int64), end[behind])
    # Ends and whole words of each language, summed by text first.
    word_of = np.searchsorted(w.ends, word_at, "left")
    count = lambda x, by: np.bincount(x, weights=by, minlength=len(texts)).astype(np.int64)
    for family, n, k in ((0x1A, count(text_of, ~behind), count(text_of, end & ~behind)), (WORDS, count(word_of, letters), count(word_of, None))):
        keys.append(np.fromiter((_language_key(c, family) for c in languages), np.int64, len(texts)))
        seen.append(n)
        ends.append(k)
    return _summed(np.concatenate(keys), np.concatenate(seen), np.concatenate(ends))


def _summed(key: np.ndarray, seen: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, where = np.unique(key, return_inverse=True)
    return key, *(np.bincount(where, weights=x, minlength=len(key)).astype(np.int64) for x in (seen, ended))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return _summed(*(np.concatenate([x[i] for x in parts]) for i in range(3)))


def _batch(m: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in m], ["key", "seen", "ended"])


def _packs(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of PACK_CHARS characters at most, or of one text."""
    pack, size = [], 0
    for t in texts:
        if pack and size + len(t) > PACK_CHARS:
            yield pack
            pack, size = [], 0
        pack.append(t)
        size += len(t)
    if pack:
        yield pack


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list = []
    for b in batches:
        texts = [t for t in (readable_text(x) for x in b.column(0).to_pylist()) if t]
        for some in _packs(texts):
            parts.append(_counts(some))
        if sum(len(x[0]) for x in parts) > HELD_KEYS:
            parts = [_merged(parts)]
            if len(parts[0][0]) > HELD_KEYS // 2:
                yield _batch(parts.pop())
    if parts:
        yield _batch(_merged(parts))


def end_model(texts: DataFrame, column: str) -> DataFrame:
    """(``key``, ``seen``, ``ended``) of every context of a column; null, empty and invisible texts count nothing."""
    c = spread(texts.select(column)).mapInArrow(_count_batches, "key long, seen long, ended long")
    return c.groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))


def _final_keys(texts: list[str], closed: list[bool], languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, keys and how many of them each text has, of the final contexts: ranks count ORDERS, what the sign alone says, the last word and the last two.

    A text that isn't ``closed`` is taken without its closing signs; of the others the last sign stays and their ranks start at BEHIND_SIGN.
    """
    core = []
    for t, shut in zip(texts, closed):
        s = t.rstrip()
        if shut:
            s = s.rstrip("\"'”»*_` \n")
        else:
            if s.endswith(("...", "…")):
                s = s.rstrip(".… ")
            s = s.rstrip(ENDERS + _CLOSERS + " \n")
        core.append(s)
    m, w = _Packed([masked(t) for t in core], same_digits=True), _Packed(core)
    word = _mix(w.hash(_word_starts(w, w.ends - 1, False), w.ends), 0x30)
    two = _mix(m.hash(_word_starts(m, m.ends - 1, True), m.ends), 0x31)
    alone = _sign_keys(np.fromiter(map(_language_key, languages), np.int64, len(languages)), m, m.ends)
    keys = np.stack([*m.contexts(m.ends), alone, word, two], axis=1)
    shut = np.array(closed, bool)
    # Of a text of one word the masked context says nothing: only the word counts.
    several = np.fromiter((_BLANK.search(s) is not None for s in core), bool, len(core))
    ends_in_word = (w.kind[w.ends - 1] == 1) & ~shut
    kept = np.stack([*[several] * len(ORDERS), shut, ends_in_word, ends_in_word], axis=1)
    ranks = np.arange(keys.shape[1])[None, :] + np.where(shut, BEHIND_SIGN, 0)[:, None]
    return ranks[kept], keys[kept], kept.sum(axis=1)


_FINALS = pa.struct([("rank", pa.int32()), ("key", pa.int64())])


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, just, prompt, wanted = (b.column(n).to_pylist() for n in ("raw_text", "justification", "prompt_text", "answer_format"))
        found = [defect_of(*x) for x in zip(raw, just, prompt, wanted)]
        some = [i for i, (_, a, may) in enumerate(found) if may and not a.open and not a.blank]
        texts = [found[i][1].text for i in some]
        languages = [language_of(found[i][1].reason or t) for i, t in zip(some, texts)]
        ranks, keys, n = _final_keys(texts, [found[i][1].closed for i in some], languages) if some else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        codes: list = [None] * len(raw)
        many = np.zeros(len(raw) + 1, np.int32)
        for i, code, k in zip(some, languages, n.tolist()):
            codes[i], many[i + 1] = code, k
        finals = pa.ListArray.from_arrays(pa.array(np.cumsum(many, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(ranks, pa.int32()), pa.array(keys, pa.int64())], fields=list(_FINALS)))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("row_id"),
                b.column("combo_id"),
                pa.array([d for d, _, _ in found], pa.string()),
                pa.array([a.open and d == "truncated" for d, a, _ in found], pa.bool_()),
                pa.array(codes, pa.string()),
                finals,
            ],
            ["row_id", "combo_id", "defect", "open", "language", "finals"],
        )


def judged_answers(rows: DataFrame) -> DataFrame:
    """(``row_id``, ``combo_id``, ``cut``, ``defect``) of every answer.

    ``rows`` needs ``row_id``, ``combo_id``, ``prompt_text``, ``raw_text``, ``justification`` and ``answer_format``. ``cut``: the raw text
    stops before its end. ``defect``: null, or one of empty, refusal, truncated, copied, other_language. A null or invisible
    answer is empty and not cut. Repeated rows are judged each; columns beside these are ignored.
    """
    rows = rows.select("row_id", "combo_id", "prompt_text", "raw_text", "justification", "answer_format")
    model = materialize(end_model(rows, "raw_text"), "ends")
    seen = materialize(spread(rows).mapInArrow(_examine, "row_id long, combo_id string, defect string, open boolean, language string, finals array<struct<rank:int,key:long>>"), "answers")
    seen = seen.withColumn("final", F.when(F.size("finals") > 0, F.xxhash64("language", "finals")))
    # Equal ends are looked up once, however many rows have them.
    finals = seen.filter("final is not null").select("final", "language", "finals").dropDuplicates(["final"])
    asked = finals.select("final", "language", F.explode("finals").alias("f")).select("final", "language", F.col("f.rank").alias("rank"), F.col("f.key").alias("key"))
    odds = lambda ended, n: F.log((ended + 0.5) / (n - ended + 0.5))
    # One row for each language code at most.
    code_of = lambda family: [F.struct(F.lit(c).alias("language"), F.lit(_language_key(c, family)).alias("key")) for c in CODES]
    named = lambda family, part, name: model.join(F.broadcast(model.sparkSession.range(1).select(F.explode(F.array(*code_of(family))).alias("c")).select("c.*")), "key").select("language", (odds(F.col("ended"), F.col("seen")) * part).alias(name))
    base = named(0x1A, THRESHOLD_SHARE, "threshold").join(named(WORDS, WORD_SHARE, "word_threshold"), "language", "full")
    met = salted_join(asked, model.filter(F.col("seen") >= LEAST_SEEN), ["key"], F.col("final"))
    met = met.join(F.broadcast(base), "language", "left").withColumn("odds", odds(F.col("ended"), F.col("seen")))
    met = met.withColumn("threshold", F.when(F.col("rank") >= BEHIND_SIGN, F.lit(0.0)).otherwise(F.coalesce("threshold", F.lit(0.0))))
    sentence = F.pmod(F.col("rank"), F.lit(BEHIND_SIGN)) <= len(ORDERS)
    scores = met.groupBy("final").agg(
        F.min(F.when(sentence, F.struct("rank", "odds", "threshold"))).alias("context"),
        F.min(F.when(~sentence, F.col("odds") - F.col("word_threshold"))).alias("word"),
    )
    low = F.coalesce(F.col("context.odds") < F.col("context.threshold"), F.lit(False)) | F.coalesce(F.col("word") < 0, F.lit(False))
    verdicts = finals.select("final").join(scores.select("final", low.alias("unfinished")), "final", "left").select("final", F.coalesce("unfinished", F.lit(False)).alias("unfinished"))
    columns = ["row_id", "combo_id", "defect", "open", "unfinished"]
    judged = salted_join(seen.filter("final is not null"), verdicts, ["final"], F.col("row_id")).select(columns)
    out = judged.unionByName(seen.filter("final is null").withColumn("unfinished", F.lit(False)).select(columns))
    out = out.withColumn("cut", F.col("open") | F.col("unfinished"))
    return out.select("row_id", "combo_id", "cut", F.when(F.col("cut"), F.lit("truncated")).otherwise(F.col("defect")).alias("defect"))


def _answers(spark: SparkSession, data_dir: str) -> DataFrame:
    t = table(spark, data_dir, "predictions_explain")
    return judged_answers(t.withColumn("justification", F.col("parsed.justification")))


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows whose raw text was cut before its end."""
    return _answers(spark, data_dir).filter("cut").select("row_id")


def p1_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """For each run its rows, its cut rows and their share."""
    got = _answers(spark, data_dir).groupBy("combo_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("cut").cast("long")).alias("n_cut"))
    return got.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_rows"), 6))


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows whose answer is defective, with the defect."""
    return _answers(spark, data_dir).filter(F.col("defect").isNotNull()).select("row_id", "defect")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p4_found": p4_found}
SQL: dict[str, str] = {}
