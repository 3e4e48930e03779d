"""Queries over their whole tables, on small inputs with known answers."""

from __future__ import annotations

import random

import __spark_entry__ as entry

QUERIES = entry.queries()


def test_thresholds_are_fitted_on_three_decimals(spark, tmp_path):
    rng = random.Random(7)
    data = []
    for v in (k / 1000 for k in range(-45, 46)):
        right = "decline" if v <= -0.021 else "increase" if v >= 0.021 else "stable"
        data += [(f"NDVI 0.500 then {0.5 + v:.3f} (Δ {v:+.3f})", rng.choice([right] * 9 + ["stable"])) for _ in range(3)]
    data += [("no reading", "stable"), ("NDVI 0.500 then 0.400 (Δ -0.100)", None)]
    rows = [(i, "r", None, *x) for i, x in enumerate(data)]
    spark.createDataFrame(rows, "row_id long, combo_id string, pred string, prompt_text string, gold string").write.parquet(f"{tmp_path}/predictions_explain.parquet")
    pairs = [(float(p.split("Δ ")[1][:-1]), g) for p, g in data if "Δ" in p and g]
    vs = sorted({v for v, _ in pairs})
    hits = {(lo, hi): sum(g == ("decline" if v <= lo else "increase" if v >= hi else "stable") for v, g in pairs) for lo in vs if lo < 0.01 for hi in vs if hi > lo}
    top = max(hits.values())
    r = QUERIES["q_threshold_fit_exact"](spark, str(tmp_path)).first()
    assert (r.hits, r.n, r.n_best, (r.lo, r.hi)) == (top, len(pairs), sum(h == top for h in hits.values()), min(k for k, h in hits.items() if h == top))
    assert QUERIES["q_threshold_fit"](spark, str(tmp_path)).first().hits < top


def test_near_duplicates_of_every_run_are_found(spark):
    from itertools import groupby

    from pairlens.functions.text import justification, tokens
    from pairlens.operators.overlap_scores import _f1
    from tests.conftest import SMALL

    p = spark.read.parquet(f"{SMALL}/predictions_explain.parquet")
    texts = sorted((r.run, r.t) for r in p.select(p["combo_id"].alias("run"), tokens(justification(p["parsed"], p["raw_text"])).alias("t")).collect())
    want = {}
    for run, g in groupby(texts, lambda x: x[0]):
        ts = [t for _, t in g]
        want[run] = (len(ts), sum(any(i != j and _f1(a, b) > 0.9 for j, b in enumerate(ts)) for i, a in enumerate(ts)) / len(ts))
    assert {r.run: (r.n, r.share) for r in QUERIES["q_near_dup"](spark, SMALL).collect()} == want and sum(n for n, _ in want.values()) == p.count()


def test_permutation_sees_neighbours_of_all_splits(spark, tmp_path):
    when = "2024-01-01 00:00:00"
    # Pairs of neighbours, one in each of two splits; neighbours always share their class.
    rows = {"train": [], "dev": [], "test": []}
    for k in range(24):
        for j, s in enumerate([("train", "dev"), ("dev", "test"), ("train", "test")][k % 3]):
            rows[s].append((2 * k + j, f"p{2 * k + j:05d}", ("decline", "stable", "increase")[k // 3 % 3], 70.0 + 0.1 * k, 22.0 + 0.001 * j, when))
    rows["test"].append((900, "p00000", "stable", 70.0, 22.0, "2023-01-01 00:00:00"))  # an older row of a patch
    for s, x in rows.items():
        spark.createDataFrame(x, "rec_id long, patch_id string, candidate_class string, lon double, lat double, ingested_at string").write.parquet(f"{tmp_path}/{s}_patches.parquet")
    r = QUERIES["q_permutation"](spark, str(tmp_path)).first()
    assert (r.observed, r.replicates, r.p) == (1.0, 2000, 1 / 2001) and abs(r.null_mean - 15 / 47) < 0.01


def test_permutations_are_whole_and_even():
    from collections import Counter

    import numpy as np

    from pairlens.operators.permutation import _tables, permuted

    for n in (1, 2, 3, 7, 366, 1000):
        assert sorted(permuted(np.arange(n), n, _tables(n, 3, 42))) == list(range(n))
    c = Counter(tuple(permuted(np.arange(4), 4, _tables(4, rep, 1))) for rep in range(12_000))
    assert len(c) == 24 and sum((k - 500) ** 2 / 500 for k in c.values()) < 60


def test_bootstrap_of_accuracy_and_kappa(spark):
    import pytest

    from pairlens.operators.inference import bootstrap_agreement

    cells = {("decline", "decline"): 3, ("decline", "stable"): 2, ("decline", "increase"): 1, ("stable", "stable"): 2, ("stable", "increase"): 1, ("increase", "increase"): 3, ("increase", "stable"): 3, ("increase", "decline"): 4}
    data = [("r", g, p) for (g, p), n in cells.items() for _ in range(n)] + [("same", "stable", "stable")] * 5 + [("none", None, None)] * 3
    got = {r.run: r for r in bootstrap_agreement(spark.createDataFrame(data, "run string, gold string, pred string"), ["run"]).collect()}
    r = got["r"]
    assert r.replicates == 5000 and r.kappa == pytest.approx(0.15725806451612898, abs=1e-12)
    assert abs(r.kappa_low + 0.154) < 0.03 and abs(r.kappa_high - 0.455) < 0.03
    assert abs(r.low - 4 / 19) < 0.06 and abs(r.high - 12 / 19) < 0.06
    assert (got["same"].low, got["same"].high, got["same"].kappa, got["same"].kappa_replicates, got["same"].kappa_low) == (1.0, 1.0, None, 0, None)
    assert (got["none"].low, got["none"].high, got["none"].kappa) == (0.0, 0.0, 0.0)


def test_bootstrap_query_draws_5000(spark):
    from tests.conftest import SMALL

    kappas = {r.run: r.kappa for r in QUERIES["q_kappa"](spark, SMALL).collect()}
    got = QUERIES["q_bootstrap"](spark, SMALL).collect()
    assert len(got) == len(kappas) and all(r.replicates == 5000 and r.low <= r.high for r in got)
    assert all(r.kappa is None and kappas[r.run] is None or round(r.kappa, 9) == kappas[r.run] for r in got)


def test_subset_sums_are_exact_above_the_old_limit():
    from itertools import product

    from pairlens.llm.group_splits import choose_sizes

    sizes = [(250_007, 2), (100_003, 3), (70_001, 5)]
    sums = {sum(s * k for (s, _), k in zip(sizes, ks)) for ks in product(*[range(n + 1) for _, n in sizes])}
    for want in (420_011, 300_000, 777_777, 600_100):
        got = choose_sizes(sizes, [("x", want)])["x"]
        assert all(n <= dict(sizes)[s] for s, n in got.items())
        assert abs(sum(s * n for s, n in got.items()) - want) == min(abs(t - want) for t in sums)


def test_raw_text_cut_behind_an_earlier_cut_of_its_reason(spark):
    from pairlens.llm.truncation import judged_answers

    rng = random.Random(4)
    nouns, ends = ["crops", "trees", "fields", "shrubs", "slopes"], ["in the north of the tile.", "in the south of the tile.", "near the river."]
    whole = [f"The {rng.choice(nouns)} have lost much of their cover and the {rng.choice(nouns)} have kept it {rng.choice(ends)}" for _ in range(400)]
    cut = "The crops have lost much of their cover and the trees have kept it in the"
    data = [(i, t, t) for i, t in enumerate(whole)]
    data += [(1000, cut, "The crops have lost much"), (1001, whole[0], whole[0][:30]), (1002, cut, cut)]
    df = spark.createDataFrame([(i, "r", "What has changed here?", raw, just, None) for i, raw, just in data], "row_id long, combo_id string, prompt_text string, raw_text string, justification string, answer_format string")
    got = {r.row_id: (r.cut, r.defect) for r in judged_answers(df).collect() if r.row_id >= 1000}
    assert got == {1000: (True, "truncated"), 1001: (False, "truncated"), 1002: (True, "truncated")}


def test_every_customer_has_the_months_of_its_first_year(spark, tmp_path):
    from datetime import date, datetime

    days = [(1, datetime(1995, 11, 2)), (1, datetime(1996, 1, 5)), (2, datetime(1998, 3, 1)), (2, datetime(1998, 6, 9)), (2, datetime(1999, 1, 1)), (2, None)]
    spark.createDataFrame(days, "o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["q_first_year_months"](spark, str(tmp_path)).collect())
    assert got == [(1, [11], 1, date(1995, 11, 2), date(1995, 11, 2)), (2, [3, 4, 5, 6], 2, date(1998, 3, 1), date(1998, 6, 9))]
