"""Joins and rankings that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from pairlens.session import BROADCAST_ROWS, materialize, small_or_not

#: Rows of one key that one task may hold before the key is split.
HOT_ROWS = 20_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of ``df`` with more than ``hot_rows`` rows and the number of salts that they get."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
    )


def salted_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], spread: Column, hot_rows: int = HOT_ROWS, extra: Column | None = None
) -> DataFrame:
    """Inner equi-join in which hot keys of ``many`` are split over salts and ``few`` is repeated for each salt.

    The hot keys are counted first, by a job of its own, so ``many`` should be cheap to read twice; where none is hot this is a
    plain join. ``spread`` picks the salt of a row of ``many`` (a hash of its id). Keys that are null match nothing. Column names of the
    two sides must differ apart from ``keys``. ``extra`` is a further join condition. No row is dropped or capped.
    """
    hot = materialize(hot_keys(many, keys, hot_rows), "hot")
    if hot.isEmpty():
        out = many.join(few, list(keys), "inner")
        return out if extra is None else out.filter(extra)
    hot = small_or_not(hot)
    left = many.join(hot, list(keys), "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))).drop("_salts")
    right = few.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    out = left.join(right, [*keys, "_salt"], "inner").drop("_salt")
    return out if extra is None else out.filter(extra)


def lookup_join(many: DataFrame, few: DataFrame, keys: Sequence[str], spread: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join of ``many`` with a materialised table: broadcast where its counted rows are few, else :func:`salted_join`."""
    if few.count() <= BROADCAST_ROWS:
        return many.join(broadcast(few), list(keys), "inner")
    return salted_join(many, few, keys, spread, hot_rows)


def ranked_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], spread: Column, salts: int = 32, name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 without gathering a group in one task.

    Rows are numbered inside ``salts`` slices of a group (slice = hash of ``spread``), then each slice is shifted by the
    sizes of the slices before it. The order is by slice, then by ``order``; equal runs give equal numbers.
    """
    s = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    inner = s.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(*order)))
    sizes = s.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return inner.join(shift, [*groups, "_slice"]).withColumn(name, F.col("_rn") + F.col("_before")).drop("_rn", "_before", "_slice")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in one partition per core at least, for costly row functions over few large files; a plan with enough partitions is left as it is."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
