"""Permutation tests on neighbours' labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.skew import ranked_within

#: Rounds of a permutation, pairs looked at together.
ROUNDS, BLOCK = 8, 16_384


def _tables(n: int, rep: int, seed: int) -> list[np.ndarray]:
    """The random functions of one permutation of 0 .. n - 1, each over one of two digits to the bases of about the root of n."""
    a = max(int(np.ceil(np.sqrt(n))), 1)
    b = -(-n // a)
    rng = np.random.default_rng([seed, rep])
    return [rng.integers(0, *((a, b) if k % 2 == 0 else (b, a)), dtype=np.int64) for k in range(ROUNDS)]


def permuted(x: np.ndarray, n: int, tables: list[np.ndarray]) -> np.ndarray:
    """The places of ``x`` under a permutation of 0 .. n - 1 that is computed place by place: by turns one digit is shifted by a
    random function of the other; what falls beyond n - 1 goes round again."""
    b = len(tables[0])
    a = len(tables[1])
    out = x
    todo: np.ndarray | None = None
    while True:
        hi, lo = np.divmod(out if todo is None else out[todo], b)
        for k, f in enumerate(tables):
            if k % 2 == 0:
                hi = hi + f[lo]
                hi -= a * (hi >= a)
            else:
                lo = lo + f[hi]
                lo -= b * (lo >= b)
        y = hi * b + lo
        if todo is None:
            out = y
            todo = np.flatnonzero(out >= n)
        else:
            out[todo] = y
            todo = todo[y >= n]
        if not len(todo):
            return out


def same_label_test(neighbours: DataFrame, labels: DataFrame, replicates: int = 100, seed: int = 42) -> DataFrame:
    """One row: the share of ids whose neighbour has their label, the mean of that share under permuted labels, and
    p = (1 + replicates at or above) / (1 + replicates).

    ``neighbours``: (``id``, ``nn``), one row per id; ``labels``: (``id``, ``label``). The ids are numbered once; a replicate permutes the
    numbers and deals the labels out in that order, so each has its own number of times. A permutation is a function of the
    number, so each pair is counted in all replicates where it lies: no task holds a replicate, and only sums are moved.
    """
    spark = labels.sparkSession
    lab = labels.filter(F.col("label").isNotNull()).select("id", "label")
    sizes = sorted((r["label"], r["n"]) for r in lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per label
    upto = np.cumsum([k for _, k in sizes], dtype=np.int64)
    n = int(upto[-1]) if len(upto) else 0
    number = ranked_within(lab, [], [F.xxhash64("id", F.lit(seed)), F.col("id")], F.col("id"), 256, "place").select("id", (F.col("place") - 1).alias("place"), "label")
    pairs = neighbours.select("id", "nn").join(number.withColumnsRenamed({"place": "i", "label": "li"}), "id").join(number.withColumnsRenamed({"id": "nn", "place": "j", "label": "lj"}), "nn")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, seen, m = np.zeros(replicates + 1, dtype=np.int64), 0, np.zeros(replicates + 1, dtype=np.int64)

        def add(p: pd.DataFrame) -> None:
            nonlocal seen
            i, j = p["i"].to_numpy(np.int64), p["j"].to_numpy(np.int64)
            hits[0] += int(p["same"].sum())
            seen += len(p)
            both = np.concatenate([i, j])
            for rep in range(1, replicates + 1):
                label = np.searchsorted(upto, permuted(both, n, _tables(n, rep, seed)), side="right")
                hits[rep] += int((label[: len(i)] == label[len(i) :]).sum())

        kept: list[pd.DataFrame] = []
        for p in batches:
            kept.append(p)
            if sum(map(len, kept)) >= BLOCK:
                add(pd.concat(kept))
                kept = []
        if kept:
            add(pd.concat(kept))
        if seen:
            m[:] = seen
            yield pd.DataFrame({"rep": np.arange(replicates + 1), "hits": hits, "m": m})

    sums = pairs.select("i", "j", (F.col("li") == F.col("lj")).alias("same")).repartition(spark.sparkContext.defaultParallelism).mapInPandas(count, "rep long, hits long, m long")
    # Hits of whole pairs are compared as whole numbers; replicate 0 is the sample itself.
    share = sums.groupBy("rep").agg(F.sum("hits").alias("hits"), F.sum("m").alias("m"))
    seen = F.max(F.when(F.col("rep") == 0, F.col("hits"))).over(Window.partitionBy("m"))  # a row per replicate
    return share.withColumn("seen", seen).filter("rep > 0").groupBy((F.col("seen") / F.col("m")).alias("observed")).agg(
        F.count(F.lit(1)).alias("replicates"), F.avg(F.col("hits") / F.col("m")).alias("null_mean"), ((1 + F.sum((F.col("hits") >= F.col("seen")).cast("long"))) / (1 + F.count(F.lit(1)))).alias("p")
    )
