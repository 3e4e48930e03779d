"""Exact quantiles with linear interpolation that never hold a group's values in one task.

A mergeable sketch brackets each quantile; the values under a bracket are only counted, and the few distinct values inside of
it are ranked. Both passes combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.skew import salted_join
from pairlens.session import BROADCAST_ROWS, materialize

#: Sketch accuracy: a bracket holds about 4 / ACCURACY of a group's rows.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: Column, qs: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """(``by``, ``n``, ``q0``, ``q1``, ...) for the quantiles ``qs``; null and NaN values are left out, groups without a value give no row.

    Without ``by`` there is one row, or none for no values. A null group is a group of its own.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    v = df.select(*by, key.alias("_g"), value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    eps = 2.0 / accuracy
    probes = [p for q in qs for p in (max(0.0, q - eps), min(1.0, q + eps))]
    firsts = [F.first(c).alias(c) for c in by]
    brackets = materialize(v.groupBy("_g").agg(*firsts, F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, probes)), F.lit(accuracy)).alias("_b")), "brackets")
    rows = v.select("_g", "_v")
    if brackets.count() <= BROADCAST_ROWS:
        met = rows.withColumn("_c", F.lit(1)).join(F.broadcast(brackets.select("_g", "_b")), "_g")
    else:
        met = salted_join(rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c")), brackets.select("_g", "_b"), ["_g"], F.col("_v"))
    # For each quantile a row lies under its bracket or above (counted, with the nearest value kept) or inside of it.
    side = lambda i: F.when(F.col("_v") < F.col("_b")[2 * i], -1).when(F.col("_v") <= F.col("_b")[2 * i + 1], 0).otherwise(1)
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), side(i).alias("side")) for i in range(len(qs))]))
    spread_out = met.select("_g", "_c", "_v", spots.alias("s")).select("_g", "_c", "_v", "s.*").withColumn("x", F.when(F.col("side") == 0, F.col("_v")))
    folded = spread_out.groupBy("_g", "i", "side", "x").agg(F.sum("_c").alias("c"), F.max("_v").alias("most"), F.min("_v").alias("least"))
    counted = folded.select("_g", "i", "side", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")).alias("x"), "c")
    upto = F.sum("c").over(Window.partitionBy("_g", "i").orderBy("side", "x").rowsBetween(Window.unboundedPreceding, 0))
    place = F.element_at(F.array(*map(F.lit, map(float, qs))), F.col("i") + 1) * (F.col("n") - 1)
    ranked = counted.withColumn("_upto", upto).join(brackets.select("_g", "n"), "_g").withColumn("_at", place)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("x")))
    two = ranked.groupBy("_g", "i").agg(at(F.floor("_at")).alias("a"), at(F.ceil("_at")).alias("b"), (F.first("_at") - F.floor(F.first("_at"))).alias("f"))
    got = two.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    wide = got.groupBy("_g").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"q{i}") for i in range(len(qs))])
    return brackets.join(wide, "_g").select(*by, "n", *[f"q{i}" for i in range(len(qs))])
