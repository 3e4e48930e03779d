"""Signals of a scene derived from its measured changes, and the sentences that state them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions.labels import trend_word
from pairlens.functions.numeric import fixed

# Cut-offs of the signals, their words, and the leads of a summary.
BURN_MARGIN, BURN_FALL, MASK_SHARE = 0.02, -0.02, 0.02
RADAR_SHIFT, DRY, WET, STEEP = 0.8, -25.0, 25.0, 12.0
LEADS = {
    "strong_decline": "Spectral loss dominates", "moderate_decline": "Moderate canopy loss is measured for", "greening": "Greening signal dominates",
    "slight_greening": "Slight greening is measured for", "stable": "Spectral stability dominates",
}
DECLINES, RISES = ("strong_decline", "moderate_decline"), ("greening", "slight_greening")


def rounded_deltas(before: dict[str, Column], after: dict[str, Column], digits: int = 4) -> dict[str, Column]:
    """Differences of means that were rounded first, rounded again; null where one side is missing."""
    return {k: F.round(F.round(after[k], digits) - F.round(before[k], digits), digits) for k in before}


def burn_cue(mask_ndvi: Column, mask_nbr: Column, nbr: Column, boxes: Column) -> Column:
    """Whether burning or felling is likely, from the shares of both masks, the change of NBR (null: none) and the number of boxes."""
    burn = (mask_nbr > mask_ndvi + BURN_MARGIN) & (F.coalesce(nbr, F.lit(0.0)) < BURN_FALL)
    return F.when(burn, "elevated_burn_signal").when((mask_ndvi > MASK_SHARE) & (boxes > 0), "deforestation_pattern").otherwise("low")


def label_consistency(label: Column, trend: Column, boxes: Column) -> Column:
    """Whether a label agrees with the measured trend; a stable label with boxes is an anomaly in space."""
    agrees = ((label == "decline") & trend.isin(*DECLINES)) | ((label == "increase") & trend.isin(*RISES)) | ((label == "stable") & (trend == "stable") & (boxes == 0))
    return F.when(F.coalesce(agrees, F.lit(False)), "agrees").when((label == "stable") & (boxes > 0), "spatial_anomaly").otherwise("partial_mismatch")


def context_words(radar: Column, rain: Column, slope: Column) -> tuple[Column, Column, Column]:
    """How strong the radar's change is, whether the second window was drier or wetter, and how steep the ground; nulls are weak, neutral, flat."""
    return (
        F.when(F.abs(radar) >= RADAR_SHIFT, "notable_backscatter_shift").otherwise("secondary"),
        F.when(rain <= DRY, "drier_second_window").when(rain >= WET, "wetter_second_window").otherwise("neutral"),
        F.when(F.coalesce(slope, F.lit(0.0)) >= STEEP, "steep_terrain").otherwise("gentle_terrain"),
    )


def signals(c: dict[str, Column]) -> dict[str, Column]:
    """All signals of a scene; ``c`` gives its columns by their role: NDVI, NBR, VV, rain, slope, down, up, mask_ndvi, mask_nbr, boxes, label."""
    trend = trend_word(c["NDVI"], c["down"], c["up"])
    radar, rain, ground = context_words(c["VV"], c["rain"], c["slope"])
    return {"trend": trend, "burn": burn_cue(c["mask_ndvi"], c["mask_nbr"], c["NBR"], c["boxes"]), "consistency": label_consistency(c["label"], trend, c["boxes"]), "radar": radar, "rain": rain, "ground": ground}


def summary(name: Column, c: dict[str, Column], s: dict[str, Column]) -> Column:
    """The signals of a scene in sentences, its lead by the trend; numbers that are missing are ``n/a``. ``s`` is from :func:`signals`."""
    lead = reduce(lambda w, kv: w.when(s["trend"] == kv[0], kv[1]), list(LEADS.items())[1:], F.when(s["trend"] == "strong_decline", LEADS["strong_decline"]))
    signed = lambda k, d: fixed(c[k], d, sign=True)
    return F.concat(
        lead, F.lit(" "), name, F.lit(": NDVI Δ="), signed("NDVI", 4), F.lit(", NBR Δ="), signed("NBR", 4), F.lit(". "),
        F.lit("SAR VV Δ"), signed("VV", 2), F.lit(" dB ("), s["radar"], F.lit("). "),
        F.lit("Rain Δ"), signed("rain", 1), F.lit(" mm ("), s["rain"], F.lit("), "), s["ground"], F.lit(". "),
        F.when(c["boxes"] > 0, F.concat(F.lit("Segmentation produced "), c["boxes"].cast("string"), F.lit(" region(s)."))).otherwise(F.lit("No boxes.")),
        F.lit(" Inference: vegetation_trend="), s["trend"], F.lit(", cue="), s["burn"], F.lit(", candidate_class="), F.coalesce(c["label"], F.lit("unknown")), F.lit(" ("), s["consistency"], F.lit(")."),
    )
