"""Problem 8: passages of held-out items inside a corpus, exact or edited.

A passage is ``PASSAGE_WORDS`` running words of an item or more, of which at most one in ``WORDS_PER_EDIT`` is changed, missing
or added in the document. Every passage holds one of 25 words with two edits, 30 with three or 40 with four (a longer one can be
cut in two, and one half is a passage again). Seeds are runs of ``SEED_WORDS`` words, and an edit destroys five at most, so such
a window keeps ``MIN_SEEDS`` of them, and of its rarest 11, 16 or 21 at least one.

The corpus is read once: a bitmap of fixed size, made from the items' seeds, picks the texts that can hold a passage. Their
rare seeds are joined with the items' by shuffle, the pairs that meet are aligned by Smith-Waterman in a band around the runs
of words they share, and the limits are then checked word by word.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.unify import caseless_text
from pairlens.operators.skew import salted_join, spread
from pairlens.session import BROADCAST_ROWS, materialize, small_or_not
from pairlens.sources.tables import table

#: Words of the shortest passage that counts, and how many words one edit needs.
PASSAGE_WORDS = 25
WORDS_PER_EDIT = 10
SEED_WORDS = 5
#: Seeds that every passage keeps, and how many places in a document they spread over at most (40 words and 4 added ones).
MIN_SEEDS = 11
SEED_SPAN = 40
#: Windows of seeds (of 25, 30 and 40 words) and how many of their rarest ones hold a seed that the edits left.
RARE = ((21, 11), (26, 16), (36, 21))
#: Least score of an alignment with a passage: 25 words with 2 edits that each cost a match and a point.
MIN_SCORE = 21
#: Words before and behind a run that a window around it can reach, and how far its edits can move it off the run's diagonal.
REACH, BAND = 40, 4
#: Bits of the bitmap for each seed, and the least and most bits of it (at most 8 MB are sent to a worker).
BITS_PER_SEED, MIN_BITS, MAX_BITS = 32, 1 << 16, 1 << 26
#: Characters of items up to which their words are broadcast to the alignment; beyond they are joined by shuffle.
BLOCK_CHARS = 8_000_000
#: Words whose hashes a worker remembers, pairs of equal seeds and runs that are looked at together.
KNOWN_WORDS, PAIRS_AT_ONCE, RUNS_AT_ONCE = 1_000_000, 1_000_000, 16_384
MATCH, MISMATCH, GAP = 1, -1, -1

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W_]+(?:[.,](?=\d)[^\W_]+)*")
_known: dict[str, int] = {}


def plain_words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, white space, markup and look-alike characters; [] for null."""
    if not text:
        return []
    t = caseless_text(text)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = html.unescape(t)
    return _WORD.findall(t)


def _hash_of(word: str) -> int:
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    h = _known[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return h


def word_ids(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    words, look = plain_words(text), _known.get
    return np.array([h if (h := look(w)) is not None else _hash_of(w) for w in words], np.int64)


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of each run of SEED_WORDS words."""
    n = len(ids) - SEED_WORDS + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED_WORDS if n > 0 else 0):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _crowded(places: np.ndarray) -> bool:
    """Whether MIN_SEEDS of the ascending places lie within SEED_SPAN."""
    return len(places) >= MIN_SEEDS and bool((places[MIN_SEEDS - 1 :] - places[: 1 - MIN_SEEDS] < SEED_SPAN).any())


def shared_runs(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(item place, document place, length) of every maximal run of SEED_WORDS equal words or more, the longest first."""
    gi, gj = _grams(item), _grams(doc)
    order = np.argsort(gi, kind="stable")
    sorted_gi = gi[order]
    low = np.searchsorted(sorted_gi, gj, "left")
    n = np.searchsorted(sorted_gi, gj, "right") - low
    found = []
    places = np.flatnonzero(n)
    cuts = np.flatnonzero(np.diff(np.cumsum(n[places]) // PAIRS_AT_ONCE)) + 1
    for some in np.split(places, cuts):
        m = n[some]
        j = np.repeat(some, m)
        i = order[np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[some], m)]
        first = (i == 0) | (j == 0) | (item[i - 1] != doc[j - 1])
        found += list(zip(i[first].tolist(), j[first].tolist()))
    runs = np.empty((len(found), 3), np.int64)
    for k, (i, j) in enumerate(found):
        length, step, most = SEED_WORDS, 32, min(len(item) - i, len(doc) - j)
        while length < most:
            stop = min(length + step, most)
            apart = item[i + length : i + stop] != doc[j + length : j + stop]
            if apart.any():
                length += int(apart.argmax())
                break
            length, step = stop, step * 2
        runs[k] = i, j, length
    return runs[np.argsort(-runs[:, 2], kind="stable")]


def _near_enough(runs: np.ndarray) -> np.ndarray:
    """The runs that lie among MIN_SEEDS seeds in a stretch of the document that a window can span."""
    order = np.argsort(runs[:, 1], kind="stable")
    j, seeds = runs[order, 1], runs[order, 2] - SEED_WORDS + 1
    total = np.concatenate([[0], np.cumsum(seeds)])
    reach = REACH + BAND + PASSAGE_WORDS
    around = total[np.searchsorted(j, j + reach, "right")] - total[np.searchsorted(j, j - reach, "left")]
    return runs[np.sort(order[around >= MIN_SEEDS])]


def banded_scores(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The best Smith-Waterman score of each row of ``item`` (n x words) and ``doc`` (n x words + band - 1), in a band around the diagonal."""
    n, rows = item.shape
    band = doc.shape[1] - rows + 1
    h = np.full((n, band + 1), -(1 << 20), np.int32)
    h[:, :band] = 0
    best, slope = np.zeros(n, np.int32), np.arange(band, dtype=np.int32) * -GAP
    for r in range(rows):
        row = h[:, :band] + np.where(item[:, r, None] == doc[:, r : r + band], MATCH, MISMATCH)
        np.maximum(row, h[:, 1:] + GAP, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        h[:, :band] = row
        np.maximum(best, row.max(axis=1), out=best)
    return best


def smith_waterman(item: np.ndarray, doc: np.ndarray) -> tuple[int, list[tuple[int | None, int | None, bool]]]:
    """The best local alignment without a band: its score and its steps (item place or None, document place or None, equal). For tests."""
    m, n = len(item), len(doc)
    h = np.zeros((m + 1, n + 1), np.int32)
    slope = np.arange(n + 1) * -GAP
    for i in range(1, m + 1):
        row = np.zeros(n + 1, np.int32)
        np.maximum(h[i - 1, :-1] + np.where(doc == item[i - 1], MATCH, MISMATCH), h[i - 1, 1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        h[i] = np.maximum.accumulate(row + slope) - slope
    i, j = divmod(int(h.argmax()), n + 1)
    score, path = int(h[i, j]), []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = bool(item[i - 1] == doc[j - 1])
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j = i - 1, j - 1
            path.append((i, j, same))
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
            path.append((i, None, False))
        else:
            j -= 1
            path.append((None, j, False))
    return score, path[::-1]


def _reach(a: list[int], b: list[int], most: int, beside: int) -> list[tuple[int, int]]:
    """For 0, 1, .. edits the most words of ``a`` that can be aligned from its start with the start of ``b``, and how many of the
    edits add a word. Ends after ``most`` edits, at the end of ``a``, or where no words that are left, with ``beside`` on the other side, pay for
    the edits.
    """
    m, n = len(a), len(b)

    def slide(x: int, y: int) -> int:
        while x < m and y < n and a[x] == b[y]:
            x += 1
            y += 1
        return x

    x = slide(0, 0)
    front = {0: (x, 0)}
    out = [(x, 0)]
    for e in range(1, most + 1):
        if out[-1][0] == m or min(m, n + e) + beside < WORDS_PER_EDIT * e:
            break
        new: dict[int, tuple[int, int]] = {}
        for k in range(-e, e + 1):
            ways = []
            if (f := front.get(k)) is not None and f[0] < m and f[0] + k < n:
                ways.append((f[0] + 1, f[1]))
            if (f := front.get(k + 1)) is not None and f[0] < m:
                ways.append((f[0] + 1, f[1]))
            if (f := front.get(k - 1)) is not None and f[0] + k - 1 < n:
                ways.append((f[0], f[1] + 1))
            if ways:
                x, added = max(ways)
                new[k] = (slide(x, x + k), added)
        if not new:
            break
        front = new
        out.append(max(max(front.values()), out[-1]))
    return out


def passage_around(item: np.ndarray, doc: np.ndarray, run: tuple[int, int, int]) -> tuple[int, int, int] | None:
    """(words, edits, score) of the longest passage through a run of equal words, or None.

    The words on either side are followed to the farthest place that each number of edits allows, and the best allowed
    combination of both sides is taken. Changed words at the passage's ends count as its words.
    """
    i, j, length = run
    best = None
    for most in sorted({4, max(4, len(item) // WORDS_PER_EDIT)}):
        # Every passage has one of at most four edits in it, so a run without such a one needs no wider search.
        span = len(item) + most + 1
        right = _reach(item[i + length :].tolist(), doc[j + length : j + length + span].tolist(), most, length + i)
        left = _reach(item[:i][::-1].tolist(), doc[max(0, j - span) : j][::-1].tolist(), most, length + right[-1][0])
        best = None
        for e1, (r, added_r) in enumerate(right):
            for e2, (l, added_l) in enumerate(left):
                words, edits = length + r + l, e1 + e2
                if words >= PASSAGE_WORDS and edits * WORDS_PER_EDIT <= words and (best is None or (words, -edits) > (best[0], -best[1])):
                    best = (words, edits, words - 2 * edits + added_r + added_l)
        if best is None:
            return None
    return best


def align_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int] | None]:
    """(words, edits, score) of a passage of each pair (item, document) of word arrays, or None.

    A run of 25 equal words is a passage by itself; the shorter runs of all pairs are scored together by Smith-Waterman in a
    band, and those that score enough are followed word by word, the best first.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(pairs)
    waiting: list[tuple[int, np.ndarray]] = []
    for p, (item, doc) in enumerate(pairs):
        runs = shared_runs(item, doc)
        if not len(runs):
            continue
        if runs[0, 2] >= PASSAGE_WORDS:
            out[p] = passage_around(item, doc, tuple(runs[0].tolist()))
        elif len(near := _near_enough(runs)):
            waiting += [(p, some) for some in np.split(near, range(RUNS_AT_ONCE, len(near), RUNS_AT_ONCE))]
    at = 0
    while at < len(waiting):
        upto, n = at, 0
        while upto < len(waiting) and (n == 0 or n + len(waiting[upto][1]) <= RUNS_AT_ONCE):
            n += len(waiting[upto][1])
            upto += 1
        rows = 2 * REACH + PASSAGE_WORDS
        a, d = np.full((n, rows), 1, np.int64), np.full((n, rows + 2 * BAND), 2, np.int64)
        k = 0
        for p, runs in waiting[at:upto]:
            item, doc = pairs[p]
            for i, j, _ in runs.tolist():
                for target, source, start in ((a[k], item, i - REACH), (d[k], doc, j - REACH - BAND)):
                    first, last = max(start, 0), min(start + len(target), len(source))
                    target[first - start : last - start] = source[first:last]
                k += 1
        score = banded_scores(a, d)
        k = 0
        for p, runs in waiting[at:upto]:
            s = score[k : k + len(runs)]
            k += len(runs)
            for r in np.argsort(-s, kind="stable"):
                if s[r] < MIN_SCORE or out[p] is not None:
                    break
                out[p] = passage_around(*pairs[p], tuple(runs[r].tolist()))
        at = upto
    return out


class ItemIndex:
    """Items in memory, to search single texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, word_ids(t)) for i, t in items]

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, words, edits, score) of each item of which the text holds a passage."""
        doc = word_ids(text)
        return [(i, *hit) for (i, _), hit in zip(self.items, align_pairs([(w, doc) for _, w in self.items])) if hit]


def rare_seeds(freq: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which seeds of an item, in their order, are looked up: those among the rarest of some window (equal ones by their hash)."""
    rank = np.empty(len(seeds), np.int64)
    rank[np.lexsort((seeds, freq))] = np.arange(len(seeds))
    chosen = np.zeros(len(seeds), bool)
    for width, rarest in RARE:
        for start in range(0, len(seeds) - width + 1, 8192):
            part = rank[start : start + 8192 + width - 1]
            view = np.lib.stride_tricks.sliding_window_view(part, width)
            places = np.argpartition(view, rarest - 1, axis=1)[:, :rarest] + np.arange(len(view))[:, None] + start
            chosen[places.ravel()] = True
    return chosen


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [word_ids(t) for t in b.column("text").to_pylist()]
        raw = [w.tobytes() for w in ids]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([_key(r) for r in raw], pa.binary()), pa.array(raw, pa.binary()), pa.array([_grams(w) for w in ids], pa.list_(pa.int64()))], ["item_id", "item", "item_words", "seeds"])


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of the seeds' lowest digits; its size is bounded, so the driver gets at most MAX_BITS / 32 rows."""
    n = seeds.count()
    bits = min(max(1 << (BITS_PER_SEED * max(n, 1)).bit_length(), MIN_BITS), MAX_BITS)
    words = seeds.selectExpr(f"cast(shiftright(seed & {bits - 1}L, 5) as int) as at", "shiftleft(1L, cast(seed & 31 as int)) as bit")
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _candidate_texts(documents: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(``doc_id``, ``doc``, ``doc_words``, ``hits``) of the documents with enough seeds of any items close together."""
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        mask = np.int64(len(bits) * 32 - 1)
        for b in batches:
            keep, key, words, hits = [], [], [], []
            for at, text in enumerate(b.column("text").to_pylist()):
                ids = word_ids(text)
                if len(ids) < PASSAGE_WORDS - PASSAGE_WORDS // WORDS_PER_EDIT:
                    continue
                g = _grams(ids)
                low = g & mask
                met = (bits[low >> 5] >> (low & 31).astype(np.uint32)) & 1 != 0
                if _crowded(np.flatnonzero(met)):
                    raw = ids.tobytes()
                    keep.append(at)
                    key.append(_key(raw))
                    words.append(raw)
                    hits.append(np.unique(g[met]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(key, pa.binary()), pa.array(words, pa.binary()), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "doc", "doc_words", "hits"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, doc binary, doc_words binary, hits array<long>")


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        item, chosen = [], []
        for key, freq, seeds in zip(b.column("item").to_pylist(), b.column("freq").to_pylist(), b.column("seeds").to_pylist()):
            freq, seeds = np.array(freq, np.int64), np.array(seeds, np.int64)
            some = np.unique(seeds[rare_seeds(freq, seeds) & (freq > 0)])
            item += [key] * len(some)
            chosen.append(some)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.binary()), pa.array(np.concatenate(chosen) if chosen else [], pa.int64())], ["item", "seed"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = align_pairs([(np.frombuffer(i, np.int64), np.frombuffer(d, np.int64)) for i, d in zip(b.column("item_words").to_pylist(), b.column("doc_words").to_pylist())])
        keep = pa.array([k for k, hit in enumerate(found) if hit], pa.int64())
        cols = list(zip(*[hit for hit in found if hit])) or [[]] * 3
        yield pa.RecordBatch.from_arrays([b.column("doc").take(keep), b.column("item").take(keep), *[pa.array(c, pa.int32()) for c in cols]], ["doc", "item", "words", "edits", "score"])


def leaked_items(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(``doc_id``, ``item_id``, ``words``, ``edits``, ``score``): the documents that hold a passage of an item.

    ``words`` and ``edits`` are those of the longest passage around the longest, or best scored, run of words that lies in one; ``score`` has
    a point for each equal word less one for each edit. Null, empty and short texts of either side match nothing; repeated
    documents and items are reported each, but equal texts are aligned once. Other columns are ignored.

    The documents are read once and only texts that can hold a passage are kept; nothing but the fixed bitmap is sent
    to all workers, unless the items have at most ``block_chars`` characters of words. Seeds, texts and items that are held by very many
    rows are split over tasks.
    """
    given = materialize(spread(items.select(F.col("item_id").cast("long").alias("item_id"), "text")).mapInArrow(_item_rows, "item_id long, item binary, item_words binary, seeds array<long>").filter(F.size("seeds") > PASSAGE_WORDS - SEED_WORDS), "items")
    one_item = given.dropDuplicates(["item"])
    at = one_item.select("item", F.posexplode("seeds").alias("at", "seed"))
    held = materialize(_candidate_texts(documents, _bitmap(at.select("seed"))), "texts")
    texts = held.dropDuplicates(["doc"])
    hits = texts.select("doc", F.explode("hits").alias("seed"))
    # How many texts hold a seed of the items; the seeds that a window doesn't need are never joined.
    freq = hits.join(small_or_not(materialize(at.select("seed").distinct(), "seeds")), "seed", "left_semi").groupBy("seed").agg(F.count(F.lit(1)).alias("freq"))
    known = at.join(freq, "seed", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "seed", F.coalesce("freq", F.lit(0)).alias("freq")))).alias("s"))  # an item's own seeds
    rare = materialize(known.select("item", F.col("s.freq").alias("freq"), F.col("s.seed").alias("seeds")).mapInArrow(_choose, "item binary, seed long"), "rare")
    met = materialize(salted_join(hits, rare, ["seed"], F.col("doc")).select("doc", "item").distinct(), "met")
    words = one_item.select("item", "item_words")
    # A word's hash takes eight bytes.
    size = one_item.agg(F.coalesce(F.sum(F.length("item_words")), F.lit(0))).first()[0]
    with_text = texts.select("doc", "doc_words").join(F.broadcast(met), "doc") if met.count() <= BROADCAST_ROWS else salted_join(met, texts.select("doc", "doc_words"), ["doc"], F.col("item"))
    pairs = with_text.join(F.broadcast(words), "item") if size <= block_chars else salted_join(with_text, words, ["item"], F.col("doc"))
    sc = documents.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = materialize(pairs.select("doc", "item", "doc_words", "item_words").repartition(tasks).mapInArrow(_align, "doc binary, item binary, words int, edits int, score int"), "passages")
    of_docs = salted_join(held.select("doc_id", "doc"), found, ["doc"], F.xxhash64("doc_id"))
    return salted_join(of_docs, given.select("item_id", "item"), ["item"], F.xxhash64("doc_id")).select("doc_id", "item_id", "words", "edits", "score")


def p8_leaks(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each document and item with the length, edits and score of the leaked passage."""
    return leaked_items(table(spark, data_dir, "documents"), table(spark, data_dir, "eval_items"))


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each document that holds a passage of an item, with the item."""
    return p8_leaks(spark, data_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every item with the number of documents that leak it."""
    n = p8_leaks(spark, data_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("words").alias("longest"))
    return table(spark, data_dir, "eval_items").select("item_id", "item_kind").join(n, "item_id", "left").select("item_id", "item_kind", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "longest")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items}
SQL: dict[str, str] = {}
