"""Overlap of texts: ROUGE-L, pooled distinct bigrams, near-duplicate shares."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairlens.functions.text import bigrams, tokens
from pairlens.operators.skew import salted_join
from pairlens.session import materialize, small_or_not


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, one row of the table at a time.

    Bits of an integer mark where the row rises, so a step costs one addition of len(b) bits.
    """
    where: dict[str, int] = {}
    for i, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        same = row & where.get(t, 0)
        row = ((row + same) | (row - same)) & full
    return len(b) - row.bit_count()


def _f1(a: Sequence[str], b: Sequence[str]) -> float:
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    k = lcs_length(a, b)
    return 2 * (k / n) * (k / m) / (k / n + k / m) if k else 0.0


@F.pandas_udf(DoubleType())
def _rouge(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_f1(x, y) for x, y in zip(a, b)], dtype=np.float64)


def rouge_l(hyp: Column, ref: Column) -> Column:
    """ROUGE-L F1 of two texts over their tokens; 0 where one has none."""
    return _rouge(tokens(hyp), tokens(ref))


def distinct_2(df: DataFrame, text: Column, by: Sequence[str]) -> DataFrame:
    """Different over all bigrams of a group's texts; bigrams don't cross texts; 0 without any.

    Bigrams are counted by value first, so a hot group is spread over its bigrams.
    """
    b = df.select(*by, F.explode_outer(bigrams(tokens(text))).alias("bigram"))
    c = b.groupBy(*by, "bigram").agg(F.count("bigram").alias("n"))
    return c.groupBy(*by).agg(F.count("bigram").alias("n_distinct"), F.sum("n").alias("n_total")).withColumn("distinct_2", F.coalesce(F.col("n_distinct") / F.nullif(F.col("n_total"), F.lit(0)), F.lit(0.0)))


#: Tokens of one group that a task of the search holds, and as many of those that visit them.
BLOCK_TOKENS = 1 << 20


def _near_found(n: np.ndarray, words: np.ndarray, settled: np.ndarray, home: np.ndarray, own: bool, cutoff: float) -> np.ndarray:
    """Marks of the texts that have a near duplicate here: a home text near a visitor or, with ``own``, near another home text.

    ``words`` are the numbered words of all texts, ``n`` of each; pairs of two ``settled`` texts are not looked at.
    """
    size, share, count = len(n), cutoff / (2 - cutoff), np.bincount(words)
    start, text = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    r = rank[words]
    # A word's bit in 256; the most frequent words have one of their own.
    bits, b = np.zeros((size, 4), np.uint64), (len(count) - 1 - r) % 256
    np.bitwise_or.at(bits, (text, b // 64), np.uint64(1) << (b % 64).astype(np.uint64))
    o = np.argsort(text * len(count) + r, kind="stable")
    word = r[o]
    fresh = np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])]
    place = np.maximum.accumulate(np.where(fresh, np.arange(len(o)), 0)) - start[text]
    kept = place <= (n - np.ceil(n * share - 1e-9))[text]
    word, at, text = word[kept], (o - start[text])[kept], text[kept]
    o = np.argsort(word * (n.max() + 1) + at, kind="stable")
    word, at, text = word[o], at[o], text[o]
    long, bits, inside = n[text], bits[text], home[text]
    wide = (1 - cutoff) * (1 + 1 / share) * long + 1e-6
    found, seen = np.zeros(size, bool), set()
    open_ = ~settled
    # Each row meets the rows of its word one, two, three ... rows further on, as far as their places are near enough.
    i, step = np.arange(len(word)), 1
    while len(i := i[i < len(word) - step]):
        j = i + step
        go = (word[i] == word[j]) & (at[j] - at[i] <= wide[i])
        i, j = i[go], j[go]
        shift, more = at[i] - at[j], long[i] - long[j]
        most = (1 - cutoff) * (long[i] + long[j]) + 1e-6
        go = (np.abs(shift) + np.abs(more - shift) <= most) & (open_[text[i]] | open_[text[j]]) & ((inside[i] | inside[j]) if own else (inside[i] != inside[j]))
        a, b, most = i[go], j[go], most[go]
        go = np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= most
        for x, y in zip(text[a[go]].tolist(), text[b[go]].tolist()):
            if x != y and (open_[x] or open_[y]) and (pair := (x, y) if x < y else (y, x)) not in seen:
                if _f1(words[start[x] : start[x] + n[x]].tolist(), words[start[y] : start[y] + n[y]].tolist()) > cutoff:
                    found[[x, y]], open_[[x, y]] = True, False
                else:
                    seen.add(pair)
        step += 1
    return found


def _search(cutoff: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        words = pc.split_pattern(t["_t"], " ").combine_chunks()
        role = t["_role"].to_numpy()
        found = _near_found(pc.list_value_length(words).to_numpy().astype(np.int64), words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), t["copies"].to_numpy() > 1, role > 0, bool((role == 2).any()), cutoff)
        return pa.table({"_id": t["_id"].filter(pa.array(found))})

    return run


def near_duplicate_texts(df: DataFrame, text: Column, by: Sequence[str] = (), cutoff: float = 0.9, block: int = BLOCK_TOKENS) -> DataFrame:
    """``by``, ``_t``, ``copies`` and ``near_duplicate`` of every different text of a group, ``_t`` being its tokens with blanks between.

    Equal token lists are folded first (each is a near duplicate of the others, if it has a token). Of the others only one
    near duplicate must be found. F1 over the cutoff leaves at most (1 - cutoff) * (n + m) tokens of both texts outside of the
    common subsequence, so its rarest word is, by the words in order of rarity, one of the first n - ceil(n * cutoff / (2 - cutoff)) + 1
    of both texts, and stands so near to the same place in both, from either end, as those tokens allow. Texts meet on these
    words and places; then the words that only one of them has are counted by bits, and the exact score decides.

    Texts are met in memory, so no pair is ever written. A group of more than ``block`` tokens is cut into bands of length, so
    that a text's near duplicates are in its own band or in one beside it, and a large band into blocks by hash; each two
    blocks that may hold a pair meet in one task.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("")  # a null is a group of its own
    t = df.select(*by, F.concat_ws(" ", tokens(text)).alias("_t"))
    folded = t.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("copies"))
    folded = materialize(folded.select("*", group.alias("_g"), F.size(F.split("_t", " ")).alias("_n"), F.monotonically_increasing_id().alias("_id")), "folded")
    some = folded.filter(F.col("_t") != "").select("_g", "_id", "_t", "_n", "copies")
    length = some.groupBy("_g", "_n").agg(F.sum("_n").alias("_sum"))
    total = F.sum("_sum").over(Window.partitionBy("_g"))
    # A band is a little wider than the largest ratio of lengths.
    length = length.withColumn("_k", F.when(total <= block, 0).otherwise(F.floor(F.log(F.col("_n").cast("double")) / F.lit(log((2 - cutoff) / cutoff) + 1e-6)).cast("int")))
    band = length.groupBy("_g", "_k").agg(F.sum("_sum").alias("_sum"), F.collect_list("_n").alias("_lengths")).withColumn("_s", F.ceil(F.col("_sum") / F.lit(block)).cast("int"))
    beside = lambda name, k: band.select("_g", (F.col("_k") - k).alias("_k"), F.col("_s").alias(name))
    band = band.join(beside("_up", 1), ["_g", "_k"], "left").join(beside("_down", -1), ["_g", "_k"], "left").select("_g", "_k", "_s", F.coalesce("_up", F.lit(1)).alias("_up"), F.coalesce("_down", F.lit(0)).alias("_down"), "_sum", F.explode("_lengths").alias("_n"))
    band = materialize(band, "bands")
    placed = some.join(small_or_not(band.drop("_sum")), ["_g", "_n"]).withColumn("_i", F.pmod(F.xxhash64("_t"), F.col("_s")).cast("int"))
    upto = lambda n, f: F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), f)
    task = lambda k, kind, i, j, role: F.struct(k.alias("_band"), F.lit(kind).alias("_kind"), i.alias("_home"), j.alias("_visitor"), role.cast("int").alias("_role"))
    k, i = F.col("_k"), F.col("_i")
    # At home against each block of the band above, the first time against its own block too; a visitor in the band below; and against the other blocks of its band.
    tasks = F.concat(
        upto(F.col("_up"), lambda j: task(k, 1, i, j, F.when(j == 0, 2).otherwise(1))),
        upto(F.col("_down"), lambda j: task(k - 1, 1, j, i, F.lit(0))),
        F.transform(F.filter(upto(F.col("_s"), lambda j: j), lambda j: j != i), lambda j: task(k, 0, F.least(i, j), F.greatest(i, j), F.when(i < j, 1).otherwise(0))),
    )
    keys = ["_g", "_band", "_kind", "_home", "_visitor"]
    met = placed.select("_g", "_id", "_t", "copies", F.explode(tasks).alias("_task")).select("_g", "_id", "_t", "copies", "_task.*")
    tokens_met = band.select("_g", "_k", "_s", "_up", "_down", "_sum").distinct().agg(F.sum(F.col("_sum") * (F.col("_up") + F.col("_down") + F.col("_s") - 1))).first()[0] or 0
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, ceil(2 * tokens_met / block))
    hits = met.repartition(parts, *keys).groupBy(*keys).applyInArrow(_search(cutoff), "_id long").distinct().withColumn("_hit", F.lit(True))
    near = F.coalesce("_hit", F.lit(False)) | ((F.col("copies") > 1) & (F.col("_t") != ""))
    return folded.join(hits, "_id", "left").select(*by, "_t", "copies", near.alias("near_duplicate"))


def near_duplicates(df: DataFrame, key: str, text: Column, by: Sequence[str] = (), cutoff: float = 0.9) -> DataFrame:
    """``by``, ``key``, ``copies`` and ``near_duplicate`` of every text: whether another text of its group has a ROUGE-L over ``cutoff``."""
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    t = df.select(*by, F.col(key).alias("_key"), group.alias("_g"), F.concat_ws(" ", tokens(text)).alias("_t"))
    marked = near_duplicate_texts(df, text, by, cutoff).select(group.alias("_g"), "_t", "copies", "near_duplicate")
    return salted_join(t, marked, ["_g", "_t"], F.col("_key")).select(*by, F.col("_key").alias(key), "copies", "near_duplicate")


def near_duplicate_share(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of near duplicates among the texts of each group, from its different texts and their ``copies``."""
    near = F.sum(F.when(F.col("near_duplicate"), F.col("copies")).otherwise(0))
    return texts.groupBy(*by).agg(F.sum("copies").alias("n"), (near / F.sum("copies")).alias("share"))
