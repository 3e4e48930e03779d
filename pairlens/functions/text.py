"""Texts: tokens, leaks, evidence in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that give the label away.
LEAK_TOKENS = ("candidate_class", "vegetation_trend", "reference_class", "partial_mismatch")


def tokens(t: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; [] for null. (Δ is lower-cased first and so never a token.)"""
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bigrams(toks: Column) -> Column:
    """Neighbouring tokens joined by a blank."""
    return F.when(F.size(toks) >= 2, F.zip_with(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def leak(t: Column, gold: Column | None = None) -> Column:
    """The first leaking name in a text, else ``=label`` where the gold label is spelled out after "="; else null."""
    low = F.lower(F.coalesce(t, F.lit("")))
    out = F.when(low.contains(LEAK_TOKENS[0]), LEAK_TOKENS[0])
    for name in LEAK_TOKENS[1:]:
        out = out.when(low.contains(name), name)
    if gold is None:
        return out
    # Only the letters of a class can stand in the pattern.
    g = F.regexp_replace(F.lower(gold), "[^a-z_]", "")
    return out.when((F.length(g) > 0) & F.coalesce(F.regexp_like(low, F.concat(F.lit("=\\s*"), g, F.lit("\\b"))), F.lit(False)), F.concat(F.lit("="), gold))


def scrubbed(t: Column) -> Column:
    """Evidence without lines that carry the label, and without leaking names and their values; blank lines go."""
    names = "|".join(LEAK_TOKENS)
    lines = F.split(F.coalesce(t, F.lit("")), "\n")
    kept = F.filter(lines, lambda x: ~F.trim(F.lower(x)).startswith("inference for") & ~F.trim(F.lower(x)).startswith("respond with class"))
    clean = F.transform(kept, lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, f"(?i)({names})\\s*=\\s*\\S+", ""), f"(?i)\\b({names})\\b", "")))
    return F.trim(F.array_join(F.filter(clean, lambda x: F.length(F.trim(x)) > 0), "\n"))


def justification(parsed: Column, raw: Column) -> Column:
    """The fields of a parsed answer in one text, or the raw text where all are empty."""
    some = lambda c: F.nullif(c, F.lit(""))
    parts = F.concat_ws(" ", some(parsed["justification"]), F.array_join(F.filter(parsed["supporting_evidence"], lambda x: x != ""), " "), F.array_join(F.filter(parsed["conflicting_evidence"], lambda x: x != ""), " "), some(parsed["visual_change"]), some(parsed["possible_driver"]))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(parts, " +", " ")), F.lit("")), raw, F.lit(""))


def reading(prompt: Column, name: str, nth: int = 1) -> Column:
    """A signed reading such as ``NDVI Δ -0.183`` from a card or prompt, as DOUBLE; null where it is missing."""
    return F.nullif(F.regexp_extract(prompt, name, nth), F.lit("")).try_cast("double")


#: Where readings stand in prompts.
READINGS = {
    "ndvi_t0": (r"NDVI (-?\d+\.\d+) then", 1),
    "ndvi_t1": (r"NDVI -?\d+\.\d+ then (-?\d+\.\d+)", 1),
    "NDVI": (r"NDVI -?\d+\.\d+ then -?\d+\.\d+ \(Δ ([+-]\d+\.\d+)\)", 1),
    "EVI": (r"EVI Δ ([+-]\d+\.\d+)", 1),
    "NDMI": (r"NDMI Δ ([+-]\d+\.\d+)", 1),
    "NBR": (r"NBR Δ ([+-]\d+\.\d+)", 1),
    "VV": (r"VV Δ ([+-]\d+\.\d+)", 1),
    "rain_t0": (r"Rain (\d+\.\d+) mm", 1),
    "rain_t1": (r"Rain \d+\.\d+ mm then (\d+\.\d+) mm", 1),
    "temperature": (r"Temperature anomaly ([+-]\d+\.\d+)", 1),
}


def shortened(t: Column, most: int = 417) -> Column:
    """A text of ``most`` characters at most, cut at a blank and marked with an ellipsis; null stays null."""
    head = F.regexp_replace(F.substring(t, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(head, F.lit(" …")))
