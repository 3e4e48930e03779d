"""Evidence cards as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions.labels import hint_text
from pairlens.functions.numeric import fixed


def compact_table(c: dict[str, Column]) -> Column:
    """The short numeric table of a card; missing numbers are ``n/a``. ``c`` gives the columns by their role."""
    f = lambda k, d: fixed(c[k], d)
    s = lambda k, d: fixed(c[k], d, sign=True)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("NDVI "), f("ndvi_t0", 3), F.lit(" -> "), f("ndvi_t1", 3), F.lit(" (Δ "), s("NDVI", 3), F.lit(")")),
        F.concat(F.lit("EVI Δ "), s("EVI", 3), F.lit(" | NDMI Δ "), s("NDMI", 3), F.lit(" | NBR Δ "), s("NBR", 3)),
        F.concat(F.lit("SAR VV Δ "), s("VV", 2), F.lit(" dB")),
        F.concat(F.lit("Rainfall "), f("rain_t0", 1), F.lit(" -> "), f("rain_t1", 1), F.lit(" mm")),
        F.concat(F.lit("Temperature anomaly "), s("temperature", 1), F.lit(" °C")),
    )


def facts(c: dict[str, Column]) -> Column:
    """The facts of a card as a list of sentences; those with a missing number are left out."""
    s = lambda k, d: fixed(c[k], d, sign=True)
    given = lambda cols, text: F.when(F.least(*[c[k].isNotNull() for k in cols]) if len(cols) > 1 else c[cols[0]].isNotNull(), text)
    all_ = F.array(
        given(["ndvi_t0", "ndvi_t1"], F.concat(F.lit("Mean NDVI was "), fixed(c["ndvi_t0"], 3), F.lit(" first and "), fixed(c["ndvi_t1"], 3), F.lit(" second (Δ "), s("NDVI", 3), F.lit(")."))),
        given(["EVI"], F.concat(F.lit("EVI change (Δ) was "), s("EVI", 3), F.lit("."))),
        given(["NDMI"], F.concat(F.lit("NDMI change (Δ) was "), s("NDMI", 3), F.lit("."))),
        given(["rain_t0", "rain_t1"], F.concat(F.lit("Rainfall was "), fixed(c["rain_t0"], 1), F.lit(" mm first and "), fixed(c["rain_t1"], 1), F.lit(" mm second."))),
        given(["VV"], F.concat(F.lit("SAR VV backscatter change was "), s("VV", 2), F.lit(" dB."))),
    )
    return F.filter(all_, lambda x: x.isNotNull())


def structured_block(c: dict[str, Column]) -> Column:
    """The table, its numbered facts and the rule in words."""
    numbered = F.transform(facts(c), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat_ws("\n", compact_table(c), F.lit(""), F.lit("ALLOWED_FACTS:"), F.array_join(numbered, "\n"), F.concat(F.lit("CLASS_RULE: "), hint_text(c["NDVI"])))


def triplet_lines(triplets: Column) -> Column:
    """Disturbance boxes as numbered lines."""
    line = lambda t, i: F.concat((i + 1).cast("string"), F.lit(". bounding_box=["), F.array_join(F.transform(t["bbox"], lambda v: v.cast("string")), ", "), F.lit("], disturbance_type="), t["disturbance_type"], F.lit(", severity="), t["severity"])
    return F.coalesce(F.nullif(F.array_join(F.transform(triplets, line), "\n"), F.lit("")), F.lit("(no disturbance regions detected)"))


def narrative(triplets: Column) -> Column:
    """A sentence for each box, or one for a scene without any."""
    one = lambda t: F.concat(F.lit("A "), F.lower(t["severity"]), F.when(F.lower(t["disturbance_type"]).startswith("fire"), F.lit("-severity burn scar lies at [")).otherwise(F.lit("-severity loss of vegetation lies at [")), F.array_join(F.transform(t["bbox"], lambda v: v.cast("string")), ", "), F.lit("]."))
    return F.coalesce(F.nullif(F.array_join(F.transform(triplets, one), " "), F.lit("")), F.lit("No coherent drop exceeded the threshold; the pair agrees with a stable canopy."))


def target_json(change_class: Column, trend: Column, has_boxes: Column, explanation: Column) -> Column:
    """The supervision object of a record as JSON text, keys in this order; null trends are kept as null."""
    q = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    inner = lambda c: F.regexp_replace(q(c), r"^\[|\]$", "")
    return F.concat(F.lit('{"change_class": '), inner(F.coalesce(change_class, F.lit("unknown"))), F.lit(', "vegetation_trend": '), F.when(trend.isNull(), F.lit("null")).otherwise(inner(trend)), F.lit(', "disturbance_present": '), F.coalesce(has_boxes, F.lit(False)).cast("string"), F.lit(', "explanation": '), inner(F.coalesce(explanation, F.lit(""))), F.lit("}"))
