"""Tests and intervals over grouped counts."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.numeric import mcnemar_p
from pairlens.operators.metrics import hit
from pairlens.schemas import CLASSES


def paired_runs(preds: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair of runs (``family``, ``run_a``, ``run_b``) the discordant counts on their common ids and the exact p.

    ``preds`` needs ``run``, ``id``, ``gold``, ``pred`` with one row per run and id. Hits are reduced to (run, id, hit) before the join.
    """
    h = preds.select("run", "id", hit(F.col("gold"), F.col("pred")).alias("h"))
    wanted = F.broadcast(pairs)  # one row per planned test
    a = h.join(wanted, h["run"] == F.col("run_a")).select("family", "run_a", "run_b", "id", F.col("h").alias("ha"))
    b = h.select(F.col("run").alias("run_b"), "id", F.col("h").alias("hb"))
    j = a.join(b, ["run_b", "id"])
    g = j.groupBy("family", "run_a", "run_b").agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("ha") == 1) & (F.col("hb") == 0)).cast("long")).alias("b"), F.sum(((F.col("ha") == 0) & (F.col("hb") == 1)).cast("long")).alias("c"))
    return g.withColumn("p", mcnemar_p(F.col("b"), F.col("c")))


def holm(tests: DataFrame, family: str, p: str, tie: str, name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each family; tests without a p don't count. One row per test, so windows are small."""
    t = tests.filter(F.col(p).isNotNull())
    w = Window.partitionBy(family)
    o = w.orderBy(p, tie)
    scaled = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(o) + 1) * F.col(p))
    return t.withColumn("_s", scaled).withColumn(name, F.max("_s").over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def kappa(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cohen's kappa of ``gold`` and ``pred``; the expected agreement runs over the three classes, other values count in n."""
    is_ = lambda c, k: F.coalesce(F.col(c) == k, F.lit(False)).cast("long")
    sums = [F.sum(is_(x, c)).alias(f"{x}_{c}") for x in ("gold", "pred") for c in CLASSES]
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit(F.col("gold"), F.col("pred")).cast("long")).alias("agree"), *sums)
    expected = sum((F.col(f"gold_{c}") * F.col(f"pred_{c}") for c in CLASSES[1:]), F.col(f"gold_{CLASSES[0]}") * F.col(f"pred_{CLASSES[0]}")) / (F.col("n").cast("double") * F.col("n"))
    seen = F.col("agree") / F.col("n")
    return g.select(*by, "n", "agree", ((seen - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("kappa"))


def _agreement(w: np.ndarray, gold: np.ndarray, pred: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accuracy and kappa of each row of ``w``, the counts of cells with a ``gold`` and a ``pred`` class; kappa is NaN where chance alone explains all."""
    n = w.sum(axis=1).astype(float)
    seen = w @ hits / n
    expected = sum((w @ (gold == c).astype(float)) * (w @ (pred == c).astype(float)) for c in CLASSES) / (n * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return seen, np.where(expected == 1.0, np.nan, (seen - expected) / (1 - expected))


def bootstrap_agreement(df: DataFrame, by: Sequence[str], replicates: int = 5000, seed: int = 42) -> DataFrame:
    """Percentile intervals of the accuracy (``low``, ``high``) and of Cohen's kappa (``kappa_low``, ``kappa_high``) of ``gold`` and ``pred``.

    Rows are first counted by group, gold, prediction and hit, a handful of cells; n rows drawn with replacement are a
    multinomial draw over these cells, so a replicate costs the same at every size, and one draw serves both figures. Of m
    sorted replicates the bounds are those at 0.025 m and at 0.975 m - 1; replicates without a kappa are left out of its bounds
    (``kappa_replicates`` counts the others). ``kappa`` is that of the rows themselves.
    """
    known = lambda c: F.when(F.col(c).isin(*CLASSES), F.col(c)).otherwise("")
    cells = df.select(*by, known("gold").alias("_g"), known("pred").alias("_p"), hit(F.col("gold"), F.col("pred")).alias("_h")).groupBy(*by, "_g", "_p", "_h").agg(F.count(F.lit(1)).alias("_n"))
    types = dict(df.dtypes)
    names = list(by)

    def draw(key: tuple, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["_g", "_p", "_h"])
        k, gold, pred, hits = c["_n"].to_numpy(np.int64), c["_g"].to_numpy(), c["_p"].to_numpy(), c["_h"].to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
        share, kappas = _agreement(rng.multinomial(k.sum(), k / k.sum(), size=replicates), gold, pred, hits)
        kappas = kappas[~np.isnan(kappas)]
        own = _agreement(k[None, :], gold, pred, hits)[1][0]

        def bounds(v: np.ndarray) -> list[float | None]:
            v = np.sort(v)
            return [float(v[int(0.025 * len(v))]), float(v[max(int(0.975 * len(v)) - 1, 0)])] if len(v) else [None, None]

        return pd.DataFrame([[*key, replicates, *bounds(share), None if np.isnan(own) else float(own), len(kappas), *bounds(kappas)]], columns=[*names, "replicates", "low", "high", "kappa", "kappa_replicates", "kappa_low", "kappa_high"])

    return cells.groupBy(*names).applyInPandas(draw, ", ".join([*(f"`{b}` {types[b]}" for b in names), "replicates long", "low double", "high double", "kappa double", "kappa_replicates long", "kappa_low double", "kappa_high double"]))
