"""Paired periods: composites, deltas, anomalies, dilution by padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.quantiles import exact_quantiles


def paired_medians(obs: DataFrame, key: str, when: Column, value: str, t0: tuple[str, str], t1: tuple[str, str]) -> DataFrame:
    """(``key``, ``v0``, ``v1``, ``delta``): exact medians of two half-open windows and their difference; a hot key is no burden for one task.

    Rows outside of the windows and null values count nothing; keys with values in one window alone have a null delta.
    """
    inside = lambda w: (when >= F.lit(w[0]).cast("timestamp")) & (when < F.lit(w[1]).cast("timestamp"))
    o = obs.filter(inside(t0) | inside(t1)).select(F.col(key), F.when(inside(t0), 0).otherwise(1).alias("_w"), F.col(value).alias("_x"))
    m = exact_quantiles(o, F.col("_x"), [0.5], [key, "_w"])
    g = m.groupBy(key).agg(F.max(F.when(F.col("_w") == 0, F.col("q0"))).alias("v0"), F.max(F.when(F.col("_w") == 1, F.col("q0"))).alias("v1"))
    return g.withColumn("delta", F.col("v1") - F.col("v0"))


def month_anomaly(obs: DataFrame, when: Column, value: str, observed: tuple[str, str], climatology: tuple[str, str]) -> DataFrame:
    """One row (``n_months``, ``anomaly``): per month of the observed window its mean less the climatology's mean of that month, averaged.

    Months without climatology are left out; without any month the anomaly is null.
    """
    inside = lambda w: (when >= F.lit(w[0]).cast("timestamp")) & (when < F.lit(w[1]).cast("timestamp"))
    m = obs.groupBy(F.month(when).alias("month")).agg(F.avg(F.when(inside(observed), F.col(value))).alias("seen"), F.avg(F.when(inside(climatology), F.col(value))).alias("normal"))
    return m.filter("seen is not null and normal is not null").agg(F.count(F.lit(1)).alias("n_months"), F.avg(F.col("seen") - F.col("normal")).alias("anomaly"))


def month_set(start: Column, end: Column) -> Column:
    """The months (1 to 12) that a window of dates touches, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")), lambda d: F.month(d))))


def delta_summary(df: DataFrame, value: Column, band: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population and sample deviation, range, exact 10th and 90th percentile, shares beyond the band; NaN and null are left out."""
    v = df.select(*by, value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    c = F.col("v")
    tails = exact_quantiles(v, c, [0.1, 0.9], by).select(*by, F.round("q0", 5).alias("p10"), F.round("q1", 5).alias("p90"))
    rest = v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 5).alias("mean"), F.round(F.stddev_pop(c), 5).alias("std_pop"), F.round(F.stddev_samp(c), 5).alias("std_samp"),
        F.round(F.min(c), 5).alias("min"), F.round(F.max(c), 5).alias("max"),
        F.round(F.avg((c < -band).cast("double")), 4).alias("share_below"), F.round(F.avg((c > band).cast("double")), 4).alias("share_above"),
    )
    if not by:
        return rest.join(F.broadcast(tails), how="left")  # one row each
    return rest.join(tails.withColumnsRenamed({b: f"_{b}" for b in by}), [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], "left").drop(*[f"_{b}" for b in by])


def dilution(values: Column, canvas: int) -> tuple[Column, Column]:
    """(native mean, mean over a canvas of ``canvas`` cells whose padding is 0) of an array, each rounded to 4 digits."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.round(total / F.nullif(F.size(values), F.lit(0)), 4), F.round(total / canvas, 4)


# Scene classes that hide the ground (shadow, clouds, cirrus, snow).
HIDDEN_SCENES = (3, 8, 9, 10, 11)


def visible(scene_class: Column) -> Column:
    """Whether a pixel's scene class shows the ground; false for null."""
    return F.coalesce(~scene_class.isin(*HIDDEN_SCENES), F.lit(False))


def composite(obs: DataFrame, keys: Sequence[str], values: Sequence[str], keep: Column | None = None, how: str = "median") -> DataFrame:
    """Medians, sums or means of ``values`` by ``keys`` over the observations that ``keep`` admits; null values count nothing."""
    o = obs if keep is None else obs.filter(keep)
    if how == "median":
        out = o.select(*keys).distinct()
        for v in values:
            m = exact_quantiles(o, F.col(v), [0.5], keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("q0").alias(v))
            out = out.join(m, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
        return out
    agg = {"sum": F.sum, "mean": F.avg}[how]
    return o.groupBy(*keys).agg(*[agg(v).alias(v) for v in values])


def dominant_orbit(obs: DataFrame, keys: Sequence[str], orbit: str, default: str = "DESCENDING") -> DataFrame:
    """``keys`` and the most frequent orbit of each, ties by name; the default where none is known."""
    from pairlens.operators.metrics import dominant

    d = dominant(obs, keys, orbit).drop("n")
    return obs.select(*keys).distinct().join(d, list(keys), "left").withColumn(orbit, F.coalesce(orbit, F.lit(default)))


def radar_composite(obs: DataFrame, keys: Sequence[str], values: Sequence[str], orbit: str, keep: Column | None = None) -> DataFrame:
    """Medians over the observations of each key's dominant orbit."""
    o = obs if keep is None else obs.filter(keep)
    return composite(o.join(dominant_orbit(o, keys, orbit), [*keys, orbit], "left_semi"), keys, values)


def masked_fraction(obs: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """Share of the observations that are masked."""
    return obs.groupBy(*keys).agg((1 - F.avg(F.coalesce(valid, F.lit(False)).cast("double"))).alias("masked_fraction"))


def region_means(places: DataFrame, obs: DataFrame, radius_m: float, key: str, value: str) -> DataFrame:
    """(``key``, ``n``, ``mean``) of the observations within a radius of each place, whatever their number.

    Both sides need ``lon`` and ``lat``; places without observations give no row. Observations at one spot are summed first, and the
    sums travel with the spot, so nothing is joined back.
    """
    from pairlens.operators.spatial import located, near_join

    sums = F.struct(F.count(value).alias("n"), F.sum(value).alias("s")).alias("spot")
    spots = obs.filter(located(F.col("lon"), F.col("lat"))).groupBy("lon", "lat").agg(sums)
    hits = near_join(places, spots, radius_m, key, "spot")
    g = hits.groupBy(F.col("id_l").alias(key)).agg(F.sum("id_r.n").alias("n"), F.sum("id_r.s").alias("s"))
    return g.select(key, "n", (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("mean"))
