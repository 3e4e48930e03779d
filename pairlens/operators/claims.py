"""Directional claims in texts, checked against measured changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.labels import direction
from pairlens.schemas import CLASS_DIRECTION

# Words for indicators and directions, the words that are both, and the windows that are searched.
INDICATOR_WORDS = {
    "NDVI": "ndvi", "EVI": "evi", "NDMI": "ndmi", "NBR": "nbr", "green_cover": "green cover|greenness|canopy", "VV": "vv", "VH": "vh|backscatter",
    "rainfall": "rainfall|precipitation|drier|wetter", "soil_moisture": "soil moisture", "temperature": "temperature|warmer|cooler",
}
DIRECTION_WORDS = {
    "increase": "increase|increased|increasing|rise|rising|risen|higher|gain|gained|wetter|warmer",
    "decrease": "decrease|decreased|decreasing|drop|dropped|decline|declined|declining|lower|loss|drier|cooler",
    "stable": "stable|unchanged|little change|no change|similar",
}
BOTH = {"drier": "decrease", "cooler": "decrease", "wetter": "increase", "warmer": "increase"}
AFTER, BEFORE = 40, 30
NEGATION = r"\b(not|no|never|without|neither|nor|n't)\b"
HEDGE = r"\b(may|might|could|possibly|probably|likely|slight|slightly|small|minor|suggest\w*)\b"
COPIED_RULE = r"NDVI\s*Δ\s*(≤|≥|between)[^→]{0,30}→\s*(decline|increase|stable)"

def _words(words: str) -> str:
    return rf"(?i)\b(?:{words})\b"


def _length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))


def _last_start(t: Column, pattern: str) -> Column:
    """Where the last match starts, from 0; null without one."""
    pieces, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    n = F.size(hits)
    return F.when(n > 0, _length(F.slice(pieces, 1, n)) + _length(F.slice(hits, 1, F.greatest(n - 1, F.lit(0)))))


def claims(df: DataFrame, key: str, text: Column) -> DataFrame:
    """One row for each mention of an indicator in each text, with the direction that stands near it: the first one after it, else the last one
    before it; ``direction`` is null where none stands near. Null and empty texts give none.

    The pieces between the matches of a pattern give their places, so everything is column expressions.
    """
    t = F.coalesce(text, F.lit(""))
    kinds = [F.struct(F.lit(name).alias("indicator"), F.regexp_extract_all("_t", F.lit(_words(w)), F.lit(0)).alias("hits"), F.split("_t", _words(w), -1).alias("pieces")) for name, w in INDICATOR_WORDS.items()]
    found = df.select(key, t.alias("_t")).select(key, "_t", F.explode(F.array(*kinds)).alias("g")).filter(F.size("g.hits") > 0)
    m = found.select(key, "_t", "g.indicator", F.col("g.hits").alias("_h"), F.col("g.pieces").alias("_p"), F.posexplode("g.hits").alias("_i", "_w"))
    m = m.select(key, "_t", "indicator", "_w", (_length(F.slice("_p", 1, F.col("_i") + 1)) + _length(F.slice("_h", 1, F.col("_i")))).alias("start"))
    stop, first = F.col("start") + F.length("_w"), F.greatest(F.col("start") - BEFORE, F.lit(0))
    m = m.withColumns({"_after": F.substring("_t", stop + 1, F.lit(AFTER)), "_before": F.substring("_t", first + 1, F.col("start") - first), "_near": F.substring("_t", first + 1, stop + AFTER - first), "_from": F.substring("_t", F.col("start") + 1, F.lit(70))})
    said = F.create_map(*[F.lit(x) for kv in BOTH.items() for x in kv])
    ahead = F.array_min(F.filter(F.array(*[F.struct(F.regexp_instr("_after", F.lit(_words(w))).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("way")) for i, (name, w) in enumerate(DIRECTION_WORDS.items())]), lambda x: x["at"] > 0))
    behind = F.array_max(F.filter(F.array(*[F.struct(_last_start(F.col("_before"), _words(w)).alias("at"), F.lit(name).alias("way")) for name, w in DIRECTION_WORDS.items()]), lambda x: x["at"].isNotNull()))
    way = F.coalesce(F.try_element_at(said, F.lower("_w")), ahead["way"], behind["way"])
    has = lambda c, p: F.regexp_like(c, F.lit(p))
    return m.select(key, "indicator", way.alias("direction"), "start", has("_near", "(?i)" + NEGATION).alias("negation"), has("_near", "(?i)" + HEDGE).alias("hedge"), has("_from", "^" + COPIED_RULE).alias("copied_rule"))


def checked(c: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """Claims with the measured direction (``measured``), ``consistent`` and the kind of an error.

    ``measured`` has ``key``, ``indicator``, ``delta``. Claims without a direction or a measurement have null ``consistent``.
    """
    j = c.join(measured.select(key, "indicator", "delta"), [key, "indicator"], "left").withColumn("measured", direction(F.col("delta"), F.col("indicator")))
    ok = F.col("direction") == F.col("measured")
    up_or_down = ((F.col("direction") == "increase") & (F.col("delta") > 0)) | ((F.col("direction") == "decrease") & (F.col("delta") < 0))
    kind = F.when(ok, "").when(F.col("measured") == "stable", F.when(up_or_down, "within_deadband_same_sign").otherwise("within_deadband_opposite_sign")).when(F.col("direction") == "stable", "said_stable_beyond_deadband").when(~ok, "beyond_deadband_opposite_sign")
    return j.withColumn("consistent", ok).withColumn("error_type", kind)


def scores(checked_claims: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """Per text: scored claims, consistent ones, their share (null without any), whether one is wrong, and whether the most frequent
    direction is that of the predicted class (null for a tie or no class).

    ``preds`` has ``key`` and ``pred`` and decides which texts come out.
    """
    c = checked_claims.filter(F.col("direction").isNotNull())
    g = c.groupBy(key).agg(F.count("consistent").alias("n_claims"), F.sum(F.col("consistent").cast("long")).alias("n_correct"))
    d = c.groupBy(key, "direction").agg(F.count(F.lit(1)).alias("n")).withColumn("_top", F.max("n").over(Window.partitionBy(key))).filter("n = _top")
    dominant = d.groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, F.first("direction")).alias("dominant"))
    expected = F.when(F.col("pred") == "decline", CLASS_DIRECTION["decline"]).when(F.col("pred") == "increase", CLASS_DIRECTION["increase"]).when(F.col("pred") == "stable", CLASS_DIRECTION["stable"])
    out = preds.select(key, "pred").join(g, key, "left").join(dominant, key, "left")
    n, k = F.coalesce("n_claims", F.lit(0)), F.coalesce("n_correct", F.lit(0))
    return out.select(key, n.alias("n_claims"), k.alias("n_correct"), (k / F.nullif(n, F.lit(0))).alias("faithfulness"), (n > k).alias("has_wrong_claim"), (F.col("dominant") == expected).alias("self_consistent"))
