from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import labels as L
from pairlens.functions import numeric as N
from pairlens.functions import text as X
from pairlens.operators import claims as C
from pairlens.operators import evidence as E
from pairlens.operators import fit, geometry, overlap_scores, parse, period, raster, splits, validate
from pairlens.operators.skew import ranked_within, salted_join
from tests.conftest import rows


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_labels(spark):
    v = spark.createDataFrame([(-0.02,), (0.02,), (0.0,), (None,)], "v double")
    assert [r[0] for r in v.select(L.two_threshold(F.col("v"))).collect()] == ["decline", "increase", "stable", None]
    s = spark.createDataFrame([(-0.04, 0.2, 0.0), (-0.04, 0.0, 0.0), (0.06, 0.0, 0.0), (0.01, 0.0, None), (0.0, 0.0, 0.0)], "v double, a double, b double")
    assert [r[0] for r in s.select(L.screened_label(F.col("v"), F.lit(-0.03), F.lit(0.08), F.col("a"), F.col("b"))).collect()] == ["uncertain", "decline", "uncertain", "stable", "stable"]
    d = spark.createDataFrame([("NDVI", 0.02), ("NDVI", -0.019), ("rainfall", -5.0), ("VV", None)], "i string, d double")
    assert [r[0] for r in d.select(L.direction(F.col("d"), F.col("i"))).collect()] == ["increase", "stable", "decrease", None]
    t = spark.createDataFrame([(-0.05, 0.1, 0.0), (-0.05, 0.0, 0.0), (0.03, 0.0, 0.2), (0.015, None, None), (None, None, None)], "v double, a double, b double")
    assert [r[0] for r in t.select(L.trend_word(F.col("v"), F.col("a"), F.col("b"))).collect()] == ["strong_decline", "moderate_decline", "greening", "slight_greening", "stable"]


def test_numbers(spark):
    r = one(spark, a=N.norm_diff(F.lit(3.0), F.lit(1.0)), b=N.norm_diff(F.lit(1.0), F.lit(-1.0)), c=N.fixed(F.lit(-0.1234), 3, True), d=N.fixed(F.lit(None).cast("double"), 2), e=N.percent(F.lit(0.564)), f=N.finite(F.lit(float("nan"))))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (0.5, None, "-0.123", "n/a", "56.4%", None)


def test_leaks_and_scrub(spark):
    r = one(spark, a=X.leak(F.lit("x Candidate_Class=stable")), b=X.leak(F.lit("label = Stable."), F.lit("stable")), c=X.leak(F.lit("stable"), F.lit("stable")), d=X.leak(F.lit(None).cast("string")), e=X.scrubbed(F.lit("NDVI 1\nInference for p: stable\nvegetation_trend = x\n candidate_class y\nRespond with class")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("candidate_class", "=stable", None, None, "NDVI 1\n  y")


def test_distinct_2_and_rouge(spark):
    df = spark.createDataFrame([("a", "one two three"), ("a", "one two"), ("b", None), ("b", "")], "k string, t string")
    got = {r.k: (r.n_distinct, r.n_total, r.distinct_2) for r in overlap_scores.distinct_2(df, F.col("t"), ["k"]).collect()}
    assert got == {"a": (2, 3, 2 / 3), "b": (0, 0, 0.0)}
    assert one(spark, r=overlap_scores.rouge_l(F.lit("The cat sat"), F.lit("the cat sat down"))).r == pytest.approx(2 * 1 * 0.75 / 1.75)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert overlap_scores.lcs_length(a, b) == t[-1][-1]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 25))]
        texts += [base, [w if rng.random() > 0.05 else "new" for w in base]]
    texts += [[], [], ["x"], ["x"]]
    data = [(i, "ab"[i % 3 == 0], " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "id long, g string, t string")
    got = {r.id: r.near_duplicate for r in overlap_scores.near_duplicates(df, "id", F.col("t"), ["g"]).collect()}
    for i, g, t in data:
        assert got[i] == any(j != i and h == g and overlap_scores._f1(t.split(), u.split()) > 0.9 for j, h, u in data), (i, t)


def shuffled_rows(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_near_duplicate_search_writes_no_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(250):
        base = [rng.choice(words) for _ in range(rng.randint(15, 40))]
        texts += [base, [w if rng.random() > 0.06 else rng.choice(words) for w in base]]
    df = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "id long, t string")
    before = shuffled_rows(spark)
    got = {r.id: r.near_duplicate for r in overlap_scores.near_duplicates(df, "id", F.col("t")).collect()}
    # Most of the 124,750 pairs share one of their rarer words; a text is sent to a handful of tasks at most.
    assert sum(n for k, n in shuffled_rows(spark).items() if k not in before) < 10 * len(texts)
    want = {i: any(j != i and overlap_scores._f1(t, u) > 0.9 for j, u in enumerate(texts)) for i, t in enumerate(texts)}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_near_duplicates_in_bands_and_blocks(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    texts = [[], ["x"], ["x"], ["a"] * 30, ["a"] * 32, ["a", "b"] * 15, ["b", "a"] * 15]
    for _ in range(90):
        base = [rng.choice(words) for _ in range(rng.randint(1, 45))]
        near = [w for w in base for w in ([w] if rng.random() > 0.08 else rng.choice([[], [w, "new"], ["new"]]))]
        texts += [base, near, base[len(base) // 2 :] + base[: len(base) // 2]]
    data = [(i, [None, "a"][i % 4 == 0], " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "id long, g string, t string")
    for cutoff in (0.9, 0.6):
        want = {(g, t): sum((g, t) == (h, u) for _, h, u in data) > 1 and t != "" or any((g, t) != (h, u) and g == h and overlap_scores._f1(t.split(), u.split()) > cutoff for _, h, u in data) for _, g, t in data}
        for block in (150, 600, 1 << 20):
            got = overlap_scores.near_duplicate_texts(df, F.col("t"), ["g"], cutoff, block)
            assert {(r.g, r._t): r.near_duplicate for r in got.collect()} == want, (cutoff, block)
    share = {r.g: (r.n, r.share) for r in overlap_scores.near_duplicate_share(got, ["g"]).collect()}
    for group in (None, "a"):
        marks = [want[g, t] for _, g, t in data if g == group]
        assert share[group] == (len(marks), sum(marks) / len(marks))
    assert overlap_scores.near_duplicate_texts(df.limit(0), F.col("t"), ["g"]).count() == 0


@pytest.mark.parametrize(("text", "want"), [("Stable", "stable"), ('"change_class": "stable"|"decline"', "decline"), ('{"change_class": "increase"}', "increase"), ("x" * 80 + " increase then decline", "decline"), ("unanswerable", None), ("", None), (None, None), ("Gain.", "increase"), ("Side by side: before, after: decline", "decline"), ("Reply: decline, increase, or stable please, with nothing more than that word stable: increase", "increase")])
def test_parse_class(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse.class_column(F.col("t")).alias("c")).first().c == want


def test_parse_explanation(spark):
    cases = [(1, 'Sure ```json\n{"change_class": "decline", "justification": "NDVI fell", "supporting_evidence": "one", "confidence": "0.5"}\n```'), (2, '{"a": 1} junk'), (3, "class: stable\nreason: no change"), (4, "NDVI rose, a gain"), (5, None), (6, '{"broken": '), (7, '{"confidence": "high", "evidence_bullets": ["x"]}')]
    got = {r.k: r for r in parse.parsed_explanations(spark.createDataFrame(cases, "k long, t string"), "k", "t").collect()}
    assert (got[1].parse_format, got[1].change_class, got[1].supporting_evidence, got[1].confidence) == ("json", "decline", ["one"], 0.5)
    assert got[2].parse_format == "json" and got[2].justification == ""
    assert (got[3].parse_format, got[3].change_class, got[3].justification) == ("short", "stable", "no change")
    assert (got[4].parse_format, got[4].change_class) == ("fallback", "increase")
    assert (got[5].justification, got[5].change_class) == ("", None)
    assert got[6].parse_format == "fallback" and got[7].confidence is None and got[7].supporting_evidence == ["x"]


MEASURED = {"NDVI": -0.05, "EVI": 0.005, "NDMI": -0.03, "NBR": -0.03, "green_cover": 0.0, "VV": -0.5, "VH": -0.5, "rainfall": -40.0, "soil_moisture": -0.06, "temperature": 2.4}
CHECKER = [
    ("NDVI decreased from 0.70 to 0.65.", 1, 1), ("NDVI increased strongly.", 0, 1), ("EVI increased slightly.", 0, 1), ("NDVI Δ ≤ −0.02 → decline", 1, 1), ("NDVI did not decrease.", 1, 1),
    ("NDVI may have declined a little.", 1, 1), ("NDVI and EVI both declined.", 1, 2), ("NDVI decreased. As noted, NDVI decreased.", 2, 2), ("The NDVI values show a small change within the allowed range.", 0, 0), ("Lower rainfall caused the NDVI decline.", 2, 2),
]


def test_claim_checker(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CHECKER)], "k long, t string")
    m = spark.createDataFrame([(i, k, v) for i in range(len(CHECKER)) for k, v in MEASURED.items()], "k long, indicator string, delta double")
    checked = C.checked(C.claims(df, "k", F.col("t")), m, "k")
    preds = spark.createDataFrame([(i, "decline") for i in range(len(CHECKER))], "k long, pred string")
    got = {r.k: (r.n_correct, r.n_claims) for r in C.scores(checked, preds, "k").collect()}
    for i, (text, ok, n) in enumerate(CHECKER):
        assert got[i] == (ok, n), text
    assert checked.filter("copied_rule").count() == 1 and checked.filter("negation").count() == 1


def test_stratified_sizes_and_invariants(spark):
    data = [(f"{c}{i}", c) for c, n in (("decline", 120), ("stable", 124), ("increase", 122), ("rare", 3), ("pair", 2)) for i in range(n)]
    out = splits.stratified_split(spark.createDataFrame(data, "id string, c string"), "id", "c")
    n = {(r.c, r.split): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert [n["decline", s] for s in ("train", "dev", "test")] == [84, 18, 18]
    assert [n["stable", s] for s in ("train", "dev", "test")] == [87, 19, 18]
    assert [n["increase", s] for s in ("train", "dev", "test")] == [85, 18, 19]
    assert [n.get(("rare", s), 0) for s in ("train", "dev", "test")] == [1, 1, 1]
    assert out.count() == len(data) == out.select("id").distinct().count()


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, "decline") for i in range(3)] + [(10 + i, "stable") for i in range(50)], "id long, c string")
    got = splits.balanced_sample(df, "id", "c", 16)
    n = {r.c: r["count"] for r in got.groupBy("c").count().collect()}
    assert n == {"decline": 6, "stable": 5}
    assert {r["count"] for r in got.filter("c = 'decline'").groupBy("id").count().collect()} == {2}


def test_block_split(spark):
    df = spark.createDataFrame([(i, i % 20 * 1.0, i // 20 * 1.0) for i in range(400)], "id long, x double, y double")
    b = splits.block_split(splits.block_bins(df, "x", "y"), "block")
    n = {r.split: r.n for r in b.groupBy("split").agg(F.countDistinct("block").alias("n")).collect()}
    assert n == {"test": 3, "dev": 3, "train": 14}


def test_threshold_fit_against_all_pairs(spark):
    rng = random.Random(2)
    data = [(round(rng.uniform(-0.1, 0.1), 2), rng.choice(["decline", "stable", "increase"])) for _ in range(300)]
    vs = sorted({v for v, _ in data})
    best = max(((sum(g == ("decline" if v <= lo else "increase" if v >= hi else "stable") for v, g in data), -lo, -hi) for lo in vs if lo < 0.01 for hi in vs if hi > lo))
    r = fit.threshold_fit(spark.createDataFrame(data, "v double, gold string"), "v").first()
    assert (r.hits, -r.lo, -r.hi) == best


def test_bias_fit(spark):
    df = spark.createDataFrame([(0.0, -0.9, -2.0, "decline")] * 3 + [(0.0, -3.0, -4.0, "stable")] * 2, "s double, d double, i double, gold string")
    r = fit.bias_fit(df, {"stable": F.col("s"), "decline": F.col("d"), "increase": F.col("i")}).first()
    assert r.hits == 5 and r.n == 5


def test_greedy_spacing_is_the_sequential_pass(spark):
    rng = random.Random(7)
    pts = [(i, rng.uniform(0, 8000), rng.uniform(0, 8000), f"{rng.random():.9f}") for i in range(250)]
    kept = []
    for i, x, y, _ in sorted(pts, key=lambda p: p[3]):
        if all(math.hypot(x - a, y - b) >= 960 for _, a, b in kept):
            kept.append((i, x, y))
    df = spark.createDataFrame(pts, "id long, x double, y double, rank string")
    near = geometry.touching_pairs(df, 960.0, 0.0).filter("metres < 960").select("id_a", "id_b")
    assert sorted(r.id for r in geometry.greedy_spacing(df, near).collect()) == sorted(i for i, *_ in kept)


def test_nearest_and_touching(spark):
    rng = random.Random(8)
    pts = [(i, rng.uniform(0, 9000), rng.uniform(0, 900)) for i in range(120)] + [(500, 90000.0, 90000.0), (501, None, 1.0), (502, 10.0, 10.0), (503, 10.0, 10.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    ok = [p for p in pts if p[1] is not None]
    want = {a[0]: min((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in ok if b[0] != a[0]) for a in ok}
    got = {r.id: (r.dist, r.nn) for r in geometry.nearest(df, df, 300.0, exclude_same_id=True).collect()}
    assert {k: (round(d, 6), n) for k, (d, n) in got.items()} == {k: (round(d, 6), n) for k, (d, n) in want.items()}
    pairs = sorted((a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and abs(a[1] - b[1]) < 645 and abs(a[2] - b[2]) < 645)
    assert sorted((r.id_a, r.id_b) for r in geometry.touching_pairs(df, hot_rows=7).collect()) == pairs
    assert geometry.nearest(df, df.limit(0), 300.0).count() == 0


def test_salted_join_and_rank(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    few = spark.createDataFrame([(1, "x"), (1, "y"), (999, "z"), (None, "n")], "k long, b string")
    assert salted_join(many, few, ["k"], F.col("a"), hot_rows=50).count() == 801
    r = ranked_within(many.select("k", "a"), ["k"], [F.col("a")], F.col("a"), salts=4)
    assert sorted(x.rank for x in r.filter("k = 1").collect()) == list(range(1, 401))


def test_period(spark):
    df = spark.createDataFrame([(1, "2024-01-02", 1.0), (1, "2024-01-03", 3.0), (1, "2024-01-20", 9.0), (2, "2024-01-02", 1.0), (1, "2024-02-20", 99.0), (1, "2024-01-21", None)], "k int, d string, v double").withColumn("d", F.col("d").cast("timestamp"))
    got = period.paired_medians(df, "k", F.col("d"), "v", ("2024-01-01", "2024-01-16"), ("2024-01-16", "2024-01-31"))
    assert sorted((r.k, r.v0, r.v1, r.delta) for r in got.collect()) == [(1, 2.0, 9.0, 7.0), (2, 1.0, None, None)]
    assert one(spark, m=period.month_set(F.lit("2021-11-15").cast("date"), F.lit("2022-02-01").cast("date"))).m == [1, 2, 11, 12]


def demo_scene():
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 0.02, (48, 72)), rng.normal(0, 0.02, (48, 72))
    a[18:40, 38:64] -= 0.35
    b[18:40, 38:64] -= 0.42
    return a, b


def test_demo_raster(spark):
    a, b = demo_scene()
    df = spark.createDataFrame([("s", 48, 72, a.ravel().tolist(), b.ravel().tolist()), ("none", 4, 4, None, None), ("odd", 3, 3, [0.0], [0.0])], "id string, height int, width int, delta_ndvi array<double>, delta_nbr array<double>")
    got = {r.id: r.triplets for r in raster.disturbance_triplets(df, "id").collect()}
    assert [(t.bbox, t.disturbance_type, t.severity) for t in got["s"]] == [([38, 18, 64, 40], "Fire", "High")]
    assert got["none"] == [] and got["odd"] == []
    out = raster.disturbance_triplets(df, "id").select("id", raster.class_policy(F.col("triplets"), F.lit("stable")).alias("p"), E.triplet_lines(F.col("triplets")).alias("l")).filter("id = 's'").first()
    assert out.p == [] and out.l == "1. bounding_box=[38, 18, 64, 40], disturbance_type=Fire, severity=High"


def test_boxes_and_masks():
    m = np.zeros((40, 40), np.uint8)
    m[2:30, 2:30] = 1
    m[8:24, 8:24] = 0
    m[12:20, 12:20] = 1  # stands in a hole: not outermost
    m[32:40, 30:40] = 1
    assert raster.boxes(m) == [[2, 2, 30, 30], [30, 32, 40, 40]]
    assert raster.otsu_mask(np.full((4, 5), -0.3))[0].sum() == 20
    assert raster.otsu_mask(np.full((3, 5), -0.3))[0].sum() == 0
    assert raster.otsu_mask(np.array([np.nan] * 20 + [-0.1] * 10 + [-0.9] * 10))[0].sum() == 10
    assert raster.match_boxes([[0, 0, 10, 10]], [[0, 0, 10, 9], [0, 0, 10, 10]]) == [([0, 0, 10, 10], "Fire"), ([0, 0, 10, 10], "Deforestation")]


def test_box_columns(spark):
    box = F.array(F.lit(0), F.lit(0), F.lit(64), F.lit(32))
    r = one(spark, a=raster.padded_box(box, F.lit(32), F.lit(64)), b=raster.area_share(F.array(F.lit(0), F.lit(0), F.lit(256), F.lit(256))), c=N.box_iou(box, box), d=raster.mask_share(F.array(F.lit(255.0), F.lit(0.0))), e=raster.stretched(F.array(F.lit(0.11), F.lit(-1.0), F.lit(0.3))), f=raster.tensor_ok(F.array(F.lit(1.0), F.lit(float("nan"))), F.lit(1), F.lit(1), F.lit(2), (1, 1, 2)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ([0, 128, 512, 384], 0.25, 1.0, 0.5, [127, 0, 255], False)
    s = one(spark, s=raster.rgb_stats(F.array(F.lit(0), F.lit(255)), F.array(F.lit(255), F.lit(255)), F.array(F.lit(0), F.lit(255)))).s
    assert (s.mean_g, s.green_dominant_fraction) == (1.0, 0.5)


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, float("nan"))], "id int, t string, lon double")
    assert rows(validate.broken_rules(df, "id", {"t": F.col("t") == "a", "n": F.col("id") > 0})) == [("t", 2)]
    assert rows(validate.null_keys(df, "id", ["t"])) == [(2, ["t"])]
    nested = df.select("id", F.struct("lon", F.struct(F.lit(1).alias("lat"), F.lit(2).alias("x")).alias("in")).alias("s"))
    assert validate.coordinate_paths(nested.schema) == ["s.lon", "s.in.lat"]
    assert validate.coordinate_paths(validate.without_coordinates(nested).schema) == []
    files = spark.createDataFrame([(f"/x/p1{s}.tif",) for s in validate.LAYERS] + [("/x/p2_T0_rgb.tif",), ("/x/other.tif",)], "path string")
    got = {r.scene_id: (r.complete, r.usable, len(r.missing)) for r in validate.scenes_of(files).collect()}
    assert got == {"p1": (True, True, 0), "p2": (False, False, 14)}
    assert validate.verdict(spark.createDataFrame([("a", "pass"), ("b", "warn")], "name string, status string")).first().ready
    r = validate.id_sync(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int"), "k").first()
    assert (r.only_left, r.only_right, r.both, r.equal) == (1, 1, 1, False)


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles(spark, accuracy, monkeypatch):
    from pairlens.operators.quantiles import exact_quantiles

    rng = random.Random(9)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1), 5.0])) for _ in range(3000)] + [("c", None), ("c", float("nan")), ("d", 1.0), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    qs = [0.0, 0.1, 0.5, 0.85, 1.0]
    for limit in (200_000, 0):
        monkeypatch.setattr("pairlens.operators.quantiles.BROADCAST_ROWS", limit)
        got = {r.k: r for r in exact_quantiles(df, F.col("v"), qs, ["k"], accuracy).collect()}
        assert set(got) == {"a", "b", None, "d", "e"}
        for k, r in got.items():
            xs = [v for g, v in data if g == k]
            assert r.n == len(xs) and np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(xs, qs))
        whole = exact_quantiles(df, F.col("v"), qs, (), accuracy).first()
        assert np.allclose([whole[f"q{i}"] for i in range(5)], np.nanquantile([v for _, v in data if v is not None], qs))
        assert exact_quantiles(df.limit(0), F.col("v"), qs, (), accuracy).count() == 0


def test_threshold_fit_counts_ties(spark):
    rng = random.Random(12)
    for _ in range(4):
        data = [(round(rng.uniform(-0.04, 0.04), 2), rng.choice(["decline", "stable", "increase"])) for _ in range(rng.randint(2, 25))]
        vs = sorted({v for v, _ in data})
        hits = {(lo, hi): sum(g == ("decline" if v <= lo else "increase" if v >= hi else "stable") for v, g in data) for lo in vs if lo < 0.01 for hi in vs if hi > lo}
        r = fit.threshold_fit(spark.createDataFrame(data, "v double, gold string"), "v").first()
        if not hits:
            assert r is None
            continue
        top = max(hits.values())
        assert (r.hits, r.n, r.n_best, (r.lo, r.hi)) == (top, len(data), sum(h == top for h in hits.values()), min(k for k, h in hits.items() if h == top))


def test_composites(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 100.0), ("b", None, 7.0), (None, "x", 2.0)], "k string, o string, v double")
    got = {r.k: r.v for r in period.composite(df, ["k"], ["v"]).collect()}
    assert got == {"a": 3.0, "b": 7.0, None: 2.0}
    assert {r.k: r.v for r in period.radar_composite(df.filter("k = 'a'"), ["k"], ["v"], "o").collect()} == {"a": 2.0}
    assert {r.k: r.v for r in period.composite(df, ["k"], ["v"], F.col("v") < 50, "sum").collect()} == {"a": 4.0, "b": 7.0, None: 2.0}
