"""Validation as data: rules give rows (rule, id, detail), checks give (name, status, message)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# The layers of a complete scene and names of coordinates.
LAYERS = ("_T0_rgb", "_T1_rgb", "_T0_s2_optical", "_T1_s2_optical", "_T0_indices", "_T1_indices", "_T0_s1", "_T1_s1", "_T0_rainfall", "_T1_rainfall", "_T0_era5", "_T1_era5", "_dem", "_delta_ndvi", "_delta_nbr")
REQUIRED_LAYERS = ("_T0_rgb", "_T1_rgb", "_delta_ndvi", "_delta_nbr")
COORDINATES = frozenset({"lon", "lat", "longitude", "latitude"})


def broken_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(``rule``, ``id``) for each rule that a row breaks, in one pass; a rule that is null for a row is broken."""
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("rule"), F.col(key).alias("id"))


def null_keys(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(``id``, ``null_keys``) of the rows in which one of the columns is null."""
    names = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda m: m.isNotNull())
    return df.select(F.col(key).alias("id"), names.alias("null_keys")).filter(F.size("null_keys") > 0)


def coordinate_paths(schema: DataType, at: str = "") -> list[str]:
    """Paths of the fields of a schema that hold coordinates; the values of maps are searched too."""
    if isinstance(schema, StructType):
        return [p for f in schema.fields for p in ([f"{at}{f.name}"] if f.name.lower() in COORDINATES else coordinate_paths(f.dataType, f"{at}{f.name}."))]
    if isinstance(schema, ArrayType):
        return coordinate_paths(schema.elementType, at)
    if isinstance(schema, MapType):
        return coordinate_paths(schema.valueType, at)
    return []


def without_coordinates(df: DataFrame) -> DataFrame:
    """``df`` without coordinate fields at the top and in structs, and with NaN and infinities as null in its top numbers."""
    out = df.drop(*[c for c in df.columns if c.lower() in COORDINATES])
    for f in out.schema.fields:
        if isinstance(f.dataType, StructType):
            for p in coordinate_paths(f.dataType):
                out = out.withColumn(f.name, F.col(f.name).dropFields(p))
        elif f.dataType.typeName() in ("double", "float"):
            out = out.withColumn(f.name, F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) != float("inf")), F.col(f.name)))
    return out


def scenes_of(files: DataFrame, path: str = "path") -> DataFrame:
    """(``scene_id``, ``layers``, ``missing``, ``complete``, ``usable``) of a listing of rasters; the longest fitting suffix names the layer."""
    name = F.regexp_extract(F.col(path), r"([^/]+)\.tif$", 1)
    suffix = reduce(lambda c, s: c.when(name.endswith(s), s), sorted(LAYERS, key=len, reverse=True)[1:], F.when(name.endswith(sorted(LAYERS, key=len, reverse=True)[0]), sorted(LAYERS, key=len, reverse=True)[0]))
    f = files.select(name.alias("_n"), suffix.alias("layer")).filter(F.col("layer").isNotNull())
    f = f.select(F.expr("substring(_n, 1, length(_n) - length(layer))").alias("scene_id"), "layer")
    g = f.groupBy("scene_id").agg(F.array_sort(F.collect_set("layer")).alias("layers"))  # at most 15 of them
    missing = F.array_except(F.array(*map(F.lit, LAYERS)), F.col("layers"))
    return g.withColumn("missing", missing).withColumn("complete", F.size("missing") == 0).withColumn("usable", F.size(F.array_except(F.array(*map(F.lit, REQUIRED_LAYERS)), F.col("layers"))) == 0)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: how many checks pass, warn and fail, and ``ready`` where none fails."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    return checks.agg(n("pass").alias("n_pass"), n("warn").alias("n_warn"), n("fail").alias("n_fail")).withColumn("ready", F.col("n_fail") == 0)


def id_sync(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys that stand only left, only right, on both sides, and whether the sets are equal."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, key, "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return j.agg(n(l & ~r).alias("only_left"), n(r & ~l).alias("only_right"), n(l & r).alias("both")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
