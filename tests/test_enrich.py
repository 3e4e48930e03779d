from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import enrich

ROLES = ("NDVI", "NBR", "VV", "rain", "slope", "down", "up", "mask_ndvi", "mask_nbr")


def test_signals_and_missing_numbers(spark):
    rows = [
        (1, -0.05, -0.03, 0.9, -30.0, 12.0, 0.1, 0.0, 0.01, 0.05, 0, "decline"),
        (2, 0.03, 0.0, 0.1, 25.0, 2.0, 0.0, 0.1, 0.03, 0.03, 2, "increase"),
        (3, 0.0, 0.0, -0.8, 0.0, None, 0.0, 0.0, 0.0, 0.0, 1, "stable"),
        (4, None, None, None, None, None, None, None, 0.0, 0.0, 0, None),
    ]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{r} double" for r in ROLES) + ", boxes int, label string")
    c = {k: F.col(k) for k in (*ROLES, "boxes", "label")}
    s = enrich.signals(c)
    got = [tuple(r) for r in df.orderBy("k").select(*[s[k] for k in ("trend", "burn", "consistency", "radar", "rain", "ground")]).collect()]
    assert got == [
        ("strong_decline", "elevated_burn_signal", "agrees", "notable_backscatter_shift", "drier_second_window", "steep_terrain"),
        ("greening", "deforestation_pattern", "agrees", "secondary", "wetter_second_window", "gentle_terrain"),
        ("stable", "low", "spatial_anomaly", "notable_backscatter_shift", "neutral", "gentle_terrain"),
        ("stable", "low", "partial_mismatch", "secondary", "neutral", "gentle_terrain"),
    ]
    texts = [r[0] for r in df.orderBy("k").select(enrich.summary(F.col("k").cast("string"), c, s)).collect()]
    assert texts[0].startswith("Spectral loss dominates 1: NDVI Δ=-0.0500") and "n/a" in texts[3] and "candidate_class=unknown" in texts[3]


def test_rounded_deltas(spark):
    df = spark.createDataFrame([(0.00004, 0.00016), (None, 0.1)], "a double, b double")
    d = enrich.rounded_deltas({"x": F.col("a")}, {"x": F.col("b")})["x"]
    assert [r[0] for r in df.select(d).collect()] == [0.0002, None]  # the rounded means differ by two steps, not by one
