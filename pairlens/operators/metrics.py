"""Scores of classifications: confusion, precision and recall, accuracies, baselines, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.schemas import CLASSES


def hit(gold: Column, pred: Column) -> Column:
    """1 where the prediction is right, 0 where it is wrong or missing; never null."""
    return F.coalesce(gold == pred, F.lit(False)).cast("int")


def confusion(df: DataFrame, by: Sequence[str], answered_only: bool = False) -> DataFrame:
    """Counts by gold class and ``pred_decline`` .. ``pred_none``; predictions that are no class count as none, or are left out."""
    known = F.coalesce(F.col("pred").isin(*CLASSES), F.lit(False))
    d = df.filter(F.col("gold").isin(*CLASSES))
    d = d.filter(known) if answered_only else d
    cols = [F.sum((F.coalesce(F.col("pred") == c, F.lit(False))).cast("long")).alias(f"pred_{c}") for c in CLASSES]
    return d.groupBy(*by, "gold").agg(*cols, F.sum((~known).cast("long")).alias("pred_none"))


def per_class(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 of 0 is 0. Every class comes for every group.

    One pass: each row is counted for all classes at once, and the few sums are then laid out by class.
    """
    g, p = F.col("gold"), F.col("pred")
    is_ = lambda c, k: F.coalesce(c == k, F.lit(False))
    sums = []
    for c in CLASSES:
        sums += [F.sum((is_(g, c) & is_(p, c)).cast("long")).alias(f"tp_{c}"), F.sum((~is_(g, c) & is_(p, c)).cast("long")).alias(f"fp_{c}"), F.sum((is_(g, c) & ~is_(p, c)).cast("long")).alias(f"fn_{c}")]
    wide = df.groupBy(*by).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"tp_{c}").alias("tp"), F.col(f"fp_{c}").alias("fp"), F.col(f"fn_{c}").alias("fn")) for c in CLASSES]))
    r = wide.select(*by, rows.alias("r")).select(*by, "r.*")
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    r = r.withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return r.select(*by, "class", "precision", "recall", f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def accuracies(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both accuracies: over all rows, where a missing prediction is wrong, and over answered rows (null if none is)."""
    answered = F.coalesce(F.col("pred").isin(*CLASSES), F.lit(False))
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(answered.cast("long")).alias("answered"), F.sum(hit(F.col("gold"), F.col("pred")).cast("long")).alias("k"))
    return g.withColumn("accuracy", F.col("k") / F.col("n")).withColumn("accuracy_answered", F.col("k") / F.nullif(F.col("answered"), F.lit(0)))


def dominant(df: DataFrame, by: Sequence[str], what: str, rank: Column | None = None) -> DataFrame:
    """The most frequent value of each group and its count; ties go to the smaller ``rank``, by default the value itself.

    The window runs over counted values, not over rows.
    """
    c = df.filter(F.col(what).isNotNull()).groupBy(*by, what).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), rank if rank is not None else F.col(what), F.col(what))
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def class_rank(c: Column, order: Sequence[str] = CLASSES) -> Column:
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(c == name, i).otherwise(out)
    return out


def unique_share(df: DataFrame, what: str, by: Sequence[str] = ()) -> DataFrame:
    """Different values over rows with a value; null without any. Values are counted first, so a hot one costs nothing."""
    c = df.groupBy(*by, what).agg(F.count(what).alias("_n"))
    return c.groupBy(*by).agg(F.count(what).alias("n_unique"), F.sum("_n").alias("n")).withColumn("share", F.col("n_unique") / F.nullif(F.col("n"), F.lit(0)))
