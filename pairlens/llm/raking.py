"""Problem 2: a sample whose category shares match targets, with minimums for small categories and the gaps reported.

Quotas are the target shares after the minimums are met; patches that name several classes are dealt out between these by a
maximum flow over counts; weights of cells are raked by iterative proportional fitting over the margins of class, area and
trend; rows are drawn by weighted exponential keys, found by counted buckets of the key, so no class is sorted in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.functions.keys import clean_word, patch_number
from pairlens.session import materialize, small_or_not
from pairlens.sources.tables import table

SEED = 7
RAKE_ROUNDS = 200
RAKE_TOLERANCE = 1e-9
#: Buckets of draw keys for each factor of two: a bucket at a quota's border holds about a hundredth of the quota.
BUCKETS = 64
#: What stands between the classes of a patch in the text of their set.
SEP = "\u0001"


def rake(count: np.ndarray, margins: Iterable[tuple[np.ndarray, np.ndarray]], rounds: int = RAKE_ROUNDS, tolerance: float = RAKE_TOLERANCE) -> np.ndarray:
    """Fit cell totals to margins, from ``count`` on.

    A margin is (index of each cell's category, wanted total of each category). A category without cells is left out, and
    cells of a category that is wanted 0 times become 0. Stops when no margin is off by more than ``tolerance`` of its total.
    """
    w = count.astype(float).copy()
    margins = list(margins)
    for _ in range(rounds):
        off = 0.0
        for index, want in margins:
            have = np.bincount(index, weights=w, minlength=len(want))
            factor = np.divide(want, have, out=np.ones(len(want)), where=have > 0)
            off = max(off, float(np.max(np.abs(factor - 1), initial=0.0)))
            w *= factor[index]
        if off <= tolerance:
            break
    return w


def quotas(total: int, shares: dict[str, float], least: dict[str, int]) -> dict[str, int]:
    """How many rows each class gets of ``total``: its minimum at least, the rest by the shares, by largest remainders.

    Classes whose share gives less than their minimum get the minimum, and the others share what is left, again and again.
    Where the minimums alone exceed the total each class gets its minimum.
    """
    fixed: dict[str, int] = {}
    while True:
        free = {c: s for c, s in shares.items() if c not in fixed}
        left, all_ = max(total - sum(fixed.values()), 0), sum(free.values())
        part = {c: left * s / all_ if all_ > 0 else 0.0 for c, s in free.items()}
        short = {c: least.get(c, 0) for c, p in part.items() if p < least.get(c, 0)}
        if not short:
            break
        fixed |= short
    out = {c: int(p) for c, p in part.items()}
    for c in sorted(part, key=lambda c: (out[c] - part[c], c))[: round(sum(part.values())) - sum(out.values())]:
        out[c] += 1
    return fixed | out


def deal_out(sets: dict[str, int], quota: dict[str, int]) -> dict[tuple[str, str], int]:
    """(class set, class) -> how many of the set's patches go to the class, so that as many quotas as possible are met.

    First each class takes from its sets in proportion to their size, then a maximum flow repairs what is short: a class gets
    patches that another one can replace from elsewhere. ``sets`` maps the classes of a patch, joined by SEP, to its count.
    """
    classes = {s: [c for c in s.split(SEP) if c in quota] for s in sets}
    supply = {c: sum(n for s, n in sets.items() if c in classes[s]) for c in quota}
    left = dict(sets)
    take: dict[tuple[str, str], int] = {}
    # The scarcest class first, its own patches before shared ones by their proportion.
    for c in sorted(quota, key=lambda c: (supply[c] / max(quota[c], 1), c)):
        for s in sorted((s for s in sets if c in classes[s]), key=lambda s: (len(classes[s]), s)):
            n = min(left[s], quota[c] * sets[s] // max(supply[c], 1))
            take[s, c] = n
            left[s] -= n
    short = {c: quota[c] - sum(take.get((s, c), 0) for s in sets) for c in quota}
    while True:
        # A shortest way from a class that is short, over sets and the classes that hold their patches, to a set with some left.
        start = [c for c in sorted(quota) if short[c] > 0]
        before: dict[tuple[str, str], tuple[str, str] | None] = {("class", c): None for c in start}
        todo, end = deque(before), None
        while todo and end is None:
            kind, x = todo.popleft()
            if kind == "class":
                near = [("set", s) for s in sorted(sets) if x in classes[s]]
            elif left[x] > 0:
                end = (kind, x)
                break
            else:
                near = [("class", c) for c in classes[x] if take.get((x, c), 0) > 0]
            for y in near:
                if y not in before:
                    before[y] = (kind, x)
                    todo.append(y)
        if end is None:
            return take
        way = [end]
        while before[way[-1]] is not None:
            way.append(before[way[-1]])
        amount = min([left[end[1]], short[way[-1][1]], *(take[way[k + 1][1], way[k][1]] for k in range(1, len(way) - 1, 2))])
        for k in range(0, len(way) - 1, 2):
            s, c = way[k][1], way[k + 1][1]
            take[s, c] = take.get((s, c), 0) + amount
            if k + 2 < len(way):
                take[way[k + 2][1], c] -= amount
        left[end[1]] -= amount
        short[way[-1][1]] -= amount


def _plan_mix(cells: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
    """One mix's plan from counts of cells, whose number doesn't grow with the rows: quotas, shares of sets, and weights of cells."""
    mix = want["mix_id"].iloc[0]
    columns = ["mix_id", "kind", "classes", "study_area", "trend", "candidate_class", "value"]
    total = int(want["sample_rows"].max())
    need = dict(zip(want["candidate_class"], want["need"].astype(int)))
    quota = {c: min(n, need[c]) for c, n in quotas(total, dict(zip(want["candidate_class"], want["target_share"])), dict(zip(want["candidate_class"], want["min_rows"]))).items()}
    out = [(mix, "quota", "", "", "", c, float(n)) for c, n in quota.items()]
    if len(cells):
        take = deal_out(cells.groupby("classes")["n"].sum().astype(int).to_dict(), quota)
        out += [(mix, "take", s, "", "", c, float(n)) for (s, c), n in take.items() if n]
        of_set = pd.Series({s: sum(n for (t, _), n in take.items() if t == s) for s in cells["classes"].unique()}, dtype=float)
        drawn = float(of_set.sum())
        margins = [(lambda i, names: (i, of_set[names].to_numpy()))(*pd.factorize(cells["classes"]))]
        for column in ("study_area", "trend"):
            index, kinds = pd.factorize(cells[column])
            have = np.bincount(index, weights=cells["n"], minlength=len(kinds))
            wanted = have / have.sum() * drawn
            margins.append((index, wanted))
            out += [(mix, column, "", "", "", k, float(w)) for k, w in zip(kinds, wanted)]
        fitted = rake(cells["n"].to_numpy(), margins) / cells["n"].to_numpy()
        out += [(mix, "weight", s, a, t, "", float(w)) for s, a, t, w in zip(cells["classes"], cells["study_area"], cells["trend"], fitted)]
    return pd.DataFrame(out, columns=columns)


def targets(mix: DataFrame) -> DataFrame:
    """``mix`` with ``need``: the larger of the minimum and the share of the sample, rounded half up in decimals.

    Null shares and minimums count as 0; a class word is compared without case and surrounding white space.
    """
    part = F.round(F.coalesce(F.col("target_share"), F.lit(0.0)).cast("decimal(18,9)") * F.coalesce(F.col("sample_rows"), F.lit(0)), 0).cast("long")
    return mix.select("mix_id", F.col("study_area").alias("mix_area"), "sample_rows", clean_word(F.col("candidate_class")).alias("candidate_class"), "target_share", "min_rows", F.greatest(part, F.coalesce(F.col("min_rows"), F.lit(0)).cast("long")).alias("need"))


def class_sets(rows: DataFrame) -> DataFrame:
    """Patches with the set of classes that their rows name: once for each area (``pool`` = area) and once over all of them (null).

    ``rows`` needs ``patch``, ``candidate_class`` (cleaned), ``study_area``, ``trend``. Rows without patch or class supply nothing. Of
    several areas or trends the least ones are kept. A patch's classes are few, so its set is one short text.
    """
    p = rows.filter(F.col("patch").isNotNull() & F.col("candidate_class").isNotNull())
    part = p.groupBy("patch", "study_area").agg(F.collect_set("candidate_class").alias("c"), F.min("trend").alias("trend"))
    joined = lambda c: F.array_join(F.array_sort(c), SEP)
    part = materialize(part.select("patch", "study_area", "c", "trend"), "per-area")
    whole = part.groupBy("patch").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("c"), F.min("study_area").alias("study_area"), F.min("trend").alias("trend"))
    text = lambda c: F.coalesce(c, F.lit(""))
    here = part.filter("study_area is not null").select("patch", F.col("study_area").alias("pool"), joined(F.col("c")).alias("named"), "study_area", text("trend").alias("trend"))
    everywhere = whole.select("patch", F.lit(None).cast("string").alias("pool"), joined(F.col("c")).alias("named"), text("study_area").alias("study_area"), text("trend").alias("trend"))
    return materialize(here.unionByName(everywhere), "pools")


def raked_sample(rows: DataFrame, mix: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sample (``mix_id``, ``candidate_class``, ``patch``, ``draw_key``) and the report with one row per mix and class.

    ``mix`` has ``mix_id``, ``study_area`` (null: all), ``sample_rows``, ``candidate_class``, ``target_share``, ``min_rows``. The quotas of a mix sum
    to ``sample_rows`` unless its minimums alone are more or its shares round to less (:func:`quotas`); none is above the class's need. A patch is drawn once in a mix; one that names several
    classes goes where it is needed (:func:`deal_out`). The report has ``need`` (what share and minimum ask for one by one), ``supply`` (distinct
    patches that name the class), ``quota``, ``drawn`` and ``gap`` = need - drawn. Empty pools draw nothing.

    Counts of cells are taken first; their number grows with the categories, not with the rows. Rows meet the mixes in their own
    task; what is moved are counts of key buckets, and then the rows up to each quota's border.
    """
    return _drawn(rows, mix, seed)[:2]


def _drawn(rows: DataFrame, mix: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    want = materialize(targets(mix), "targets")
    kind = dict(want.dtypes)["mix_id"]
    pools = class_sets(rows)
    # One row for each mix: its area and its classes.
    mixes = materialize(want.groupBy("mix_id").agg(F.first("mix_area").alias("mix_area"), F.collect_set("candidate_class").alias("wanted")), "mixes")
    of_mix = F.array_join(F.filter(F.split("named", SEP), lambda c: F.array_contains("wanted", c)), SEP)

    def met(p: DataFrame) -> DataFrame:
        """``p`` once for each mix of its pool, with those of its classes that the mix wants."""
        return p.join(small_or_not(mixes), F.col("pool").eqNullSafe(F.col("mix_area"))).withColumn("classes", of_mix).filter("classes <> ''").drop("mix_area", "wanted", "named")

    counts = materialize(pools.groupBy("pool", "named", "study_area", "trend").agg(F.count(F.lit(1)).alias("n")), "counts")
    cells = materialize(met(counts).groupBy("mix_id", "classes", "study_area", "trend").agg(F.sum("n").alias("n")), "cells")
    asked = want.select("mix_id", "candidate_class", F.coalesce("sample_rows", F.lit(0)).alias("sample_rows"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), "need")
    plan = materialize(cells.groupBy("mix_id").cogroup(asked.groupBy("mix_id")).applyInPandas(_plan_mix, f"mix_id {kind}, kind string, classes string, study_area string, trend string, candidate_class string, value double"), "plan")
    weights = materialize(plan.filter("kind = 'weight'").select("mix_id", "classes", "study_area", "trend", F.col("value").alias("weight")), "weights")
    # The places in the order of draw keys that each class of a set gets.
    w = Window.partitionBy("mix_id", "classes").orderBy("candidate_class")
    takes = plan.filter("kind = 'take'").select("mix_id", "classes", "candidate_class", F.col("value").cast("long").alias("n"))
    takes = materialize(takes.withColumn("upto", F.sum("n").over(w)).withColumn("above", F.col("upto") - F.col("n")), "takes")
    h = F.xxhash64(F.col("patch"), F.col("mix_id"), F.lit(seed))
    uniform = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    # Cells that the margins want 0 times come last instead of never, so that quotas can still be met.
    keyed = met(pools).join(small_or_not(weights), ["mix_id", "classes", "study_area", "trend"]).withColumn("draw_key", -F.log(uniform) / F.greatest(F.col("weight"), F.lit(1e-12)))
    keyed = keyed.withColumn("bucket", F.floor(F.log2("draw_key") * BUCKETS).cast("int"))
    in_bucket = keyed.groupBy("mix_id", "classes", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_id", "classes").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    needed = takes.groupBy("mix_id", "classes").agg(F.max("upto").alias("most"))
    borders = in_bucket.withColumn("before", F.coalesce(before, F.lit(0))).join(needed, ["mix_id", "classes"]).filter("before < most").select("mix_id", "classes", "bucket", "before")
    first = keyed.select("mix_id", "classes", "study_area", "trend", "bucket", "draw_key", "patch").join(small_or_not(materialize(borders, "borders")), ["mix_id", "classes", "bucket"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("mix_id", "classes", "bucket").orderBy("draw_key", "patch"))
    got = first.withColumn("place", place).join(small_or_not(takes), ["mix_id", "classes"]).filter("place > above and place <= upto")
    got = materialize(got.select("mix_id", "candidate_class", "patch", "draw_key", "study_area", "trend"), "sample")
    supply = cells.select("mix_id", F.explode(F.split("classes", SEP)).alias("candidate_class"), "n").groupBy("mix_id", "candidate_class").agg(F.sum("n").alias("supply"))
    drawn = got.groupBy("mix_id", "candidate_class").agg(F.count(F.lit(1)).alias("drawn"))
    quota = plan.filter("kind = 'quota'").select("mix_id", "candidate_class", F.col("value").cast("long").alias("quota"))
    report = want.join(quota, ["mix_id", "candidate_class"], "left").join(supply, ["mix_id", "candidate_class"], "left").join(drawn, ["mix_id", "candidate_class"], "left")
    report = report.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quota", "supply", "drawn")}).withColumn("gap", F.col("need") - F.col("drawn"))
    report = report.withColumn("reached_share", F.round(F.col("drawn") / F.nullif(F.sum("drawn").over(Window.partitionBy("mix_id")), F.lit(0)), 6))
    wanted = plan.filter("kind in ('study_area', 'trend')").select("mix_id", F.col("kind").alias("margin"), F.col("candidate_class").alias("category"), F.col("value").alias("wanted"))
    reached = got.select("mix_id", F.explode(F.array(F.struct(F.lit("study_area").alias("margin"), F.col("study_area").alias("category")), F.struct(F.lit("trend").alias("margin"), F.col("trend").alias("category")))).alias("m")).groupBy("mix_id", "m.margin", "m.category").agg(F.count(F.lit(1)).alias("drawn"))
    margins = wanted.join(reached, ["mix_id", "margin", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return got.select("mix_id", "candidate_class", "patch", "draw_key"), report.withColumnRenamed("mix_area", "study_area"), margins.select("mix_id", "margin", "category", F.round("wanted", 3).alias("wanted"), "drawn", F.round(F.col("drawn") - F.col("wanted"), 3).alias("residual"))


def _inputs(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, data_dir, "train_patches")
    rows = t.select(patch_number(F.col("patch_id")).alias("patch"), clean_word(F.col("candidate_class")).alias("candidate_class"), "study_area", clean_word(F.col("vegetation_trend")).alias("trend"))
    return rows, table(spark, data_dir, "target_mix")


def p2_sample(spark: SparkSession, data_dir: str) -> DataFrame:
    """The drawn patches of each mix."""
    return raked_sample(*_inputs(spark, data_dir))[0].drop("draw_key")


def p2_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """Need, supply, quota, drawn rows and gap of each mix and class."""
    return raked_sample(*_inputs(spark, data_dir))[1]


def p2_margins(spark: SparkSession, data_dir: str) -> DataFrame:
    """Wanted and drawn rows of each area and trend of each mix: what the draw leaves of the other margins."""
    return _drawn(*_inputs(spark, data_dir), SEED)[2]


def p2_supply(spark: SparkSession, data_dir: str) -> DataFrame:
    """Need and supply of each mix and class, and whether the draw keeps within both."""
    r = p2_report(spark, data_dir)
    return r.select("mix_id", "candidate_class", "need", "supply", ((F.col("drawn") <= F.col("need")) & (F.col("drawn") <= F.col("supply")) & (F.col("gap") == F.col("need") - F.col("drawn"))).alias("within"))


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Classes of a mix that the pool can't supply: those with a gap after the draw that no other way to deal the patches out could close."""
    return p2_report(spark, data_dir).filter((F.col("gap") > 0) & (F.col("supply") < F.col("need"))).select("mix_id", "candidate_class")


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample, "p2_margins": p2_margins, "p2_supply": p2_supply}
_NEED = """
with pool as (
  select distinct regexp_extract(patch_id, '(\\d+)', 1)::bigint as p, study_area as area, lower(regexp_replace(candidate_class, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as c
  from train_patches),
want as (
  select mix_id, study_area, sample_rows, candidate_class, target_share, min_rows,
    greatest(min_rows, cast(round(target_share::decimal(18,9) * sample_rows, 0) as bigint)) as need,
    (select count(distinct p) from pool where c = m.candidate_class and (m.study_area is null or area = m.study_area)) as supply
  from target_mix m)
"""
SQL = {
    "p2_found": _NEED + "select mix_id, candidate_class from want where need > supply",
    "p2_supply": _NEED + "select mix_id, candidate_class, need, supply, true as within from want",
}
