"""Thresholds and biases fitted on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.schemas import MODEL_CLASSES


def threshold_fit(df: DataFrame, value: str, low_below: float = 0.01) -> DataFrame:
    """The two cut-offs (``lo`` < ``hi``, ``lo`` < ``low_below``) among the values that give the most hits, as one row with ties.

    ``value`` is rounded to four digits, so its distinct values are bounded by its range: rows are first counted by value and class, and running sums
    and maxima over the distinct values, in one task, find the best pair without forming pairs. Ties go to the smaller lo, then hi; ``n_best`` counts them.
    Null values and golds are left out; without a candidate pair there is no row.
    """
    c = df.filter(F.col(value).isNotNull() & F.col("gold").isNotNull()).groupBy(F.round(F.col(value), 4).alias("v")).agg(*[F.sum((F.col("gold") == k).cast("long")).alias(k) for k in ("decline", "stable", "increase")], F.count(F.lit(1)).alias("n"))
    steps = Window.orderBy("v")  # distinct steps of the scale, not rows
    to_here, before = steps.rowsBetween(Window.unboundedPreceding, 0), steps.rowsBetween(Window.unboundedPreceding, -1)
    under = lambda k: F.coalesce(F.sum(k).over(before), F.lit(0))
    total = c.agg(F.sum("increase").alias("all_increase"), F.sum("n").alias("n_all"))  # one row
    # A pair's hits are the part of lo (declines up to it less stables up to it) and the part of hi (stables under it and increases from it on).
    p = c.withColumn("part_lo", F.when(F.col("v") < low_below, F.sum("decline").over(to_here) - F.sum("stable").over(to_here))).join(F.broadcast(total))
    p = p.withColumn("part_hi", under("stable") + F.col("all_increase") - under("increase"))
    # The best lo under each hi is a running maximum; its first place and the number of its equals come along.
    p = p.withColumn("top", F.max("part_lo").over(to_here)).withColumn("tie", F.col("part_lo") == F.col("top"))
    same = Window.partitionBy("top").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("first_lo", F.min(F.when(F.col("tie"), F.col("v"))).over(same)).withColumn("ties", F.sum(F.col("tie").cast("long")).over(same))
    p = p.select("v", "part_hi", "n_all", *[F.lag(k).over(steps).alias(k) for k in ("top", "first_lo", "ties")]).filter(F.col("top").isNotNull())
    best = p.groupBy((F.col("top") + F.col("part_hi")).alias("hits")).agg(F.min(F.struct(F.col("first_lo").alias("lo"), F.col("v").alias("hi"))).alias("b"), F.sum("ties").alias("n_best"), F.first("n_all").alias("n"))
    return best.orderBy(F.desc("hits")).limit(1).select(F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), "hits", "n", "n_best")


def bias_fit(df: DataFrame, scores: dict[str, Column], grid: Sequence[float] = (-1.0, -0.5, 0.0, 0.5, 1.0)) -> DataFrame:
    """The additive class biases with the most hits, as one row; the zero bias stays unless another is strictly better.

    Each row meets the grid of ``len(grid) ** 3`` biases in its own task (no shuffle of rows); only sums per bias are moved.
    Ties go to the earlier place in the grid, ties of scores to the earlier class.
    """
    a, b, c = MODEL_CLASSES
    points = [(0.0, 0.0, 0.0)] + [(x, y, z) for x in grid for y in grid for z in grid]
    s = {k: scores[k] for k in MODEL_CLASSES}
    d = df.filter(F.col("gold").isNotNull()).select("gold", *[v.alias(f"s_{k}") for k, v in s.items()])
    total = []
    for i, (x, y, z) in enumerate(points):
        sa, sb, sc = F.col(f"s_{a}") + x, F.col(f"s_{b}") + y, F.col(f"s_{c}") + z
        pred = F.when((sa >= sb) & (sa >= sc), a).when(sb >= sc, b).otherwise(c)
        total.append(F.sum(F.coalesce(pred == F.col("gold"), F.lit(False)).cast("long")).alias(f"h{i}"))
    sums = d.agg(F.count(F.lit(1)).alias("n"), *total)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(x).alias(f"bias_{a}"), F.lit(y).alias(f"bias_{b}"), F.lit(z).alias(f"bias_{c}"), F.coalesce(F.col(f"h{i}"), F.lit(0)).alias("hits")) for i, (x, y, z) in enumerate(points)]))
    return sums.select("n", rows.alias("r")).select("r.*", "n").orderBy(F.desc("hits"), "place").limit(1).drop("place")
