"""Label rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens import schemas as S


# The rule in words for no change, a fall, a rise and neither; cut-offs of the trend words (change, share of pixels); synonyms.
HINTS = ("Use NDVI trend only; if unclear, answer stable.", "NDVI Δ ≤ −0.02 → decline.", "NDVI Δ ≥ +0.02 → increase.", "NDVI Δ between −0.02 and +0.02 → stable.")
STRONG_FALL, FALL, SLIGHT_RISE, RISE, TREND_SHARE = -0.04, -0.02, 0.01, 0.02, 0.08
DECLINE_WORDS = ("decrease", "decreasing", "decreased", "loss", "negative", "declining")
INCREASE_WORDS = ("increasing", "increased", "gain", "growth", "positive")
STABLE_WORDS = ("unchanged", "no_change", "no-change", "same", "neutral")


def two_threshold(v: Column, low: Column | float = S.RULE_LOW, high: Column | float = S.RULE_HIGH) -> Column:
    """decline at ``low`` or under, increase at ``high`` or over, else stable; decline is tested first. Null stays null."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(v.isNull(), F.lit(None)).when(v <= low, "decline").when(v >= high, "increase").otherwise("stable")


def screened_label(v: Column, low: Column, high: Column, masked_before: Column, masked_after: Column, most_masked: float = S.MAX_MASKED, band: float = S.STABLE_BAND) -> Column:
    """The two-threshold label, or uncertain where too much is masked or a value between the cut-offs isn't near zero."""
    over = F.coalesce(masked_before > most_masked, F.lit(False)) | F.coalesce(masked_after > most_masked, F.lit(False))
    return F.when(over, "uncertain").when(v <= low, "decline").when(v >= high, "increase").when(F.abs(v) < band, "stable").otherwise("uncertain")


def hint_text(v: Column) -> Column:
    """The rule in words for a change of NDVI."""
    return F.when(v.isNull(), HINTS[0]).when(v <= S.RULE_LOW, HINTS[1]).when(v >= S.RULE_HIGH, HINTS[2]).otherwise(HINTS[3])


def trend_word(delta: Column, share_down: Column, share_up: Column) -> Column:
    """Five levels from the change and the shares of pixels that fell or rose; a null share counts as 0."""
    down, up = F.coalesce(share_down, F.lit(0.0)), F.coalesce(share_up, F.lit(0.0))
    return (
        F.when((delta <= STRONG_FALL) & (down >= TREND_SHARE), "strong_decline").when(delta <= FALL, "moderate_decline")
        .when((delta >= RISE) & (up >= TREND_SHARE), "greening").when(delta >= SLIGHT_RISE, "slight_greening").otherwise("stable")
    )


def trend_class(word: Column) -> Column:
    """The class that a trend word stands for; null stays null."""
    return F.when(word.contains("decline"), "decline").when(word.contains("green"), "increase").when(word.isNotNull(), "stable")


def direction(delta: Column, indicator: Column) -> Column:
    """increase, decrease or stable by the indicator's dead band; a change of just the band is a direction. Null stays null."""
    band = reduce(lambda c, kv: c.when(indicator == kv[0], kv[1]), list(S.DEAD_BANDS.items())[1:], F.when(indicator == "NDVI", S.DEAD_BANDS["NDVI"]))
    return F.when(delta.isNull() | band.isNull(), F.lit(None)).when(F.abs(delta) < band, "stable").when(delta > 0, "increase").otherwise("decrease")


def severity(mean_drop: Column, high: float, moderate: float) -> Column:
    return F.when(mean_drop >= high, "High").when(mean_drop >= moderate, "Moderate").otherwise("Low")


def class_token(word: Column) -> Column:
    """A class from one word, with synonyms; null for any other word."""
    w = F.trim(F.lower(word))
    return (
        F.when(w.isin("stable", "decline", "increase"), w)
        .when(w.isin(*DECLINE_WORDS), "decline")
        .when(w.isin(*INCREASE_WORDS), "increase")
        .when(w.isin(*STABLE_WORDS), "stable")
    )
