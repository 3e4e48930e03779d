"""Splits and samples with an order that is a hash of the key, so they are the same on every run and machine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.schemas import CLASSES


def shuffled(key: Column, seed: int) -> Column:
    """The sort key of a reproducible shuffle."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, key: str, stratum: str, train: float = 0.70, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: each stratum is shuffled, its first 70 % are train, the next 15 % dev, the rest test.

    Sizes are rounded half to even; of three rows or more, one at least goes to test and one to dev. A null stratum is one of its own.
    Places come from ranges of the hash that are counted first, so no stratum is sorted in one task.
    """
    h = df.withColumn("_h", shuffled(F.col(key), seed)).withColumn("_range", F.substring("_h", 1, 2))
    # 256 ranges of the hash in order: a global rank is the rank within a range plus the sizes of the ranges before.
    sizes = h.groupBy(stratum, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(stratum)
    shift = sizes.select(F.col(stratum).alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_total"))
    inner = h.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_h", key)))
    r = inner.join(shift, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).withColumn("_place", F.col("_rn") + F.col("_before"))
    n = F.col("_total")
    n_train, n_dev = F.bround(n * train, 0).cast("long"), F.bround(n * dev, 0).cast("long")
    short_test = (n - n_train - n_dev < 1) & (n >= 3)
    n_train = F.when(short_test, F.greatest(F.lit(1), n_train - 1)).otherwise(n_train)
    short_dev = (n_dev < 1) & (n >= 3)
    n_train = F.when(short_dev, F.greatest(F.lit(1), n_train - 1)).otherwise(n_train)
    n_dev = F.when(short_dev, F.lit(1)).otherwise(n_dev)
    split = F.when(F.col("_place") <= n_train, "train").when(F.col("_place") <= n_train + n_dev, "dev").otherwise("test")
    return r.withColumn("split", split).select(*df.columns, "split")


def block_bins(df: DataFrame, x: str, y: str, nx: int = 5, ny: int = 4) -> DataFrame:
    """``df`` with ``x_bin``, ``y_bin`` and ``block`` = x_bin * ny + y_bin: equal-width bins of the range, the last one closed."""
    ext = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))  # one row
    b = df.join(F.broadcast(ext))
    bin_ = lambda v, lo, hi, n: F.least(F.greatest(F.floor((F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * n), F.lit(0)), F.lit(n - 1)).cast("int")
    b = b.withColumn("x_bin", bin_(x, "_x0", "_x1", nx)).withColumn("y_bin", bin_(y, "_y0", "_y1", ny))
    return b.withColumn("block", F.col("x_bin") * ny + F.col("y_bin")).drop("_x0", "_x1", "_y0", "_y1")


def block_split(df: DataFrame, block: str, train: float = 0.70, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: whole blocks, in the order of a shuffle, go to test, then dev, then train.

    Only the few blocks are ranked.
    """
    blocks = df.select(block).filter(F.col(block).isNotNull()).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(shuffled(F.col(block), seed), block))
    n_test = F.greatest(F.lit(1), F.bround(n * F.lit(1.0 - train - dev), 0).cast("long"))
    n_dev = F.greatest(F.lit(1), F.bround(n * F.lit(dev), 0).cast("long"))
    b = blocks.select(block, F.when(place <= n_test, "test").when(place <= n_test + n_dev, "dev").otherwise("train").alias("split"))
    return df.join(b, block, "left")


def balanced_sample(df: DataFrame, key: str, stratum: str, most: int, classes: Sequence[str] = CLASSES, seed: int = 42) -> DataFrame:
    """``most`` rows spread evenly over the classes, in a shuffled order; a class that is short repeats its rows in turn.

    The remainder goes to the first classes; a class without rows gives none. ``draw`` numbers a class's draws.
    """
    per, extra = divmod(most, len(classes))
    need = F.lit(0)
    for i, c in enumerate(classes):
        need = F.when(F.col(stratum) == c, per + (1 if i < extra else 0)).otherwise(need)
    top = per + (1 if extra else 0)
    pool = df.filter(F.col(stratum).isin(*classes))
    sizes = pool.groupBy(stratum).agg(F.count(F.lit(1)).alias("_pool"))
    w = Window.partitionBy(stratum).orderBy(shuffled(F.col(key), seed), key)
    first = pool.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)  # a group limit: tasks keep the top rows only
    r = first.join(F.broadcast(sizes), stratum).withColumn("_need", need)
    draws = F.when(F.col("_rn") <= F.col("_need"), F.sequence(F.col("_rn").cast("long"), F.col("_need").cast("long"), F.col("_pool")))
    return r.withColumn("draw", F.explode(draws)).select(*df.columns, "draw")


def sample_per_stratum(df: DataFrame, key: str, stratum: str, n: int, seed: int = 2) -> DataFrame:
    """``n`` rows of each stratum at most, first in a shuffled order."""
    w = Window.partitionBy(stratum).orderBy(shuffled(F.col(key), seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def ordered_prefix(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)
