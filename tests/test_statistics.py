"""Published values of the statistics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pairlens.functions.numeric import mcnemar_p, wilson
from pairlens.operators.inference import holm, kappa, paired_runs
from pairlens.operators.metrics import accuracies, confusion, dominant, per_class


@pytest.mark.parametrize(("k", "n", "low", "high"), [(31, 55, 43.3, 68.6), (18, 55, 21.8, 45.9), (24, 55, 31.4, 56.7), (20, 55, 24.9, 49.6), (52, 55, 85.1, 98.1), (0, 55, 0.0, 6.5)])
def test_wilson(spark, k, n, low, high):
    a, b = wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (round(100 * r.a, 1) + 0.0, round(100 * r.b, 1)) == (low, high)


def test_wilson_of_nothing(spark):
    a, _ = wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(a.alias("a")).first().a is None


def test_mcnemar_is_exact(spark):
    cases = [(18, 5), (13, 3), (17, 2), (0, 0), (20, 19), (0, 2), (900, 1000), (1, 0), (7, 7)]
    got = {(r.b, r.c): r.p for r in spark.createDataFrame(cases, "b long, c long").withColumn("p", mcnemar_p(F.col("b"), F.col("c"))).collect()}
    for b, c in cases:
        n, k = b + c, min(b, c)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, j) for j in range(k + 1)) / 2**n)
        assert got[b, c] == pytest.approx(want, abs=1e-9)
    assert got[18, 5] == pytest.approx(0.010622024536132812, abs=1e-12)


def test_holm_of_nine(spark):
    b_c = [("leak_primary", 18, 5), ("leak_secondary", 18, 5), ("a_vs_const", 16, 11), ("cl_matched", 2, 0), ("cl_const", 20, 19), ("el_matched", 13, 3), ("el_const", 17, 2), ("sp_a", 15, 21), ("sp_b", 0, 0)]
    df = spark.createDataFrame(b_c, "test string, b long, c long").withColumn("p", mcnemar_p(F.col("b"), F.col("c"))).withColumn("family", F.lit("main"))
    got = {r.test: r.p_holm for r in holm(df, "family", "p", "test").collect()}
    assert round(got["leak_primary"], 4) == 0.0850 and round(got["leak_secondary"], 4) == 0.0850
    assert round(got["el_matched"], 4) == 0.1276 and round(got["el_const"], 4) == 0.0066
    assert got["sp_a"] == got["cl_const"] == 1.0


def test_kappa_of_nineteen(spark):
    cells = {("decline", "decline"): 3, ("decline", "stable"): 2, ("decline", "increase"): 1, ("stable", "stable"): 2, ("stable", "increase"): 1, ("increase", "increase"): 3, ("increase", "stable"): 3, ("increase", "decline"): 4}
    df = spark.createDataFrame([("r", g, p) for (g, p), n in cells.items() for _ in range(n)], "run string, gold string, pred string")
    r = kappa(df, ["run"]).first()
    assert r.agree == 8 and r.kappa == pytest.approx(0.15725806451612898, abs=1e-12)


MATRICES = [([18, 0, 0, 0, 5, 13, 0, 0, 0, 19, 0, 0], 31, 0.466), ([0, 18, 0, 0, 0, 18, 0, 0, 0, 19, 0, 0], 18, 0.164), ([16, 0, 2, 0, 16, 0, 2, 0, 11, 0, 8, 0], 24, 0.347), ([15, 0, 3, 0, 13, 0, 5, 0, 14, 0, 5, 0], 20, 0.271), ([0, 0, 0, 13, 0, 0, 0, 21, 0, 0, 0, 20], 0, 0.0)]


@pytest.mark.parametrize(("cells", "k", "f1"), MATRICES)
def test_published_confusions(spark, cells, k, f1):
    order = ["decline", "stable", "increase"]
    data = [("r", g, p) for i, g in enumerate(order) for j, p in enumerate([*order, None]) for _ in range(cells[4 * i + j])]
    df = spark.createDataFrame(data, "run string, gold string, pred string")
    m = {r.gold: [r.pred_decline, r.pred_stable, r.pred_increase, r.pred_none] for r in confusion(df, ["run"]).collect()}
    assert sum((m[g] for g in order), []) == cells
    assert accuracies(df, ["run"]).first().k == k
    assert round(per_class(df, ["run"]).agg(F.sum("f1") / 3).first()[0], 3) == f1


def test_two_accuracies(spark):
    df = spark.createDataFrame([("r", "decline", "decline")] * 12 + [("r", "stable", "decline")] * 24 + [("r", "increase", None)] * 19, "run string, gold string, pred string")
    r = accuracies(df, ["run"]).first()
    assert (r.answered, r.k, r.n) == (36, 12, 55) and round(r.accuracy_answered, 4) == 0.3333


def test_paired_runs(spark):
    data = [(run, str(i), "stable", p) for i, (a, b) in enumerate([("stable", None), ("stable", "stable"), ("decline", "stable"), ("stable", "decline")]) for run, p in (("a", a), ("b", b))]
    preds = spark.createDataFrame(data, "run string, id string, gold string, pred string")
    r = paired_runs(preds, spark.createDataFrame([("f", "a", "b")], "family string, run_a string, run_b string")).first()
    assert (r.n, r.b, r.c) == (4, 2, 1)


def test_dominant_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "z")], "k int, v string")
    assert sorted((r.k, r.v, r.n) for r in dominant(df, ["k"], "v").collect()) == [(1, "a", 1), (3, "z", 1)]


def test_mcnemar_at_any_size(spark):
    from math import comb

    from pyspark.sql import functions as F

    from pairlens.functions.numeric import mcnemar_p

    pairs = [(0, 0), (1, 0), (3, 3), (10, 2), (40, 60), (500, 430), (0, 700)]
    df = spark.createDataFrame(pairs, "b long, c long").select("b", "c", mcnemar_p(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        n, k = r.b + r.c, min(r.b, r.c)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, j) for j in range(k + 1)) / 2**n)
        assert abs(r.p - want) <= 1e-9 * want + 1e-300
    wide = spark.createDataFrame([(500_000_000, 500_040_000)], "b long, c long").select(mcnemar_p(F.col("b"), F.col("c")).alias("p")).first().p
    assert 0.2 < wide < 0.21  # the normal tail beyond 1.265 deviations, twice


def test_scratch_tables_go(spark):
    from pairlens.session import materialize, scratch, written_tables

    with scratch(spark):
        t = materialize(spark.range(3), "gone")
        assert t.count() == 3 and any("gone" in p for p in written_tables(spark))
    assert not any("gone" in p for p in written_tables(spark))
