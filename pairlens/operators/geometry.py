"""Planar neighbours: touching footprints, nearest neighbours, greedy spacing; all by grid cells and equality joins."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens import schemas as S
from pairlens.operators.skew import salted_join
from pairlens.session import materialize


def _home(df: DataFrame, side: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col("x") / side)).withColumn("_cy", F.floor(F.col("y") / side))


def _around(df: DataFrame, side: float, forward: bool = False) -> DataFrame:
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)] if forward else [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    at = F.explode(F.array(*[F.struct((F.floor(F.col("x") / side) + i).alias("cx"), (F.floor(F.col("y") / side) + j).alias("cy")) for i, j in steps]))
    return df.withColumn("_at", at).select(*df.columns, F.col("_at.cx").alias("_cx"), F.col("_at.cy").alias("_cy"))


def touching_pairs(points: DataFrame, footprint: float = S.FOOTPRINT_M, slack: float = 5.0, edge: float = 50.0, hot_rows: int = 4000) -> DataFrame:
    """Pairs (``id_a`` < ``id_b``) of square footprints that touch, with distance and ``kind`` edge or corner.

    ``points`` needs ``id``, ``x``, ``y`` in metres, one row per id. Two touch when both offsets are under footprint + slack; the
    pair is an edge when the smaller offset is under ``edge``. Rows with a null coordinate touch nothing.
    """
    side = footprint + slack
    p = points.filter("x is not null and y is not null").select("id", "x", "y")
    home = _home(p.select(F.col("id").alias("id_r"), "x", "y"), side).withColumnsRenamed({"x": "x_r", "y": "y_r"})
    probe = _around(p.select(F.col("id").alias("id_l"), "x", "y"), side, forward=True).withColumnsRenamed({"x": "x_l", "y": "y_l"})
    dx, dy = F.abs(F.col("x_l") - F.col("x_r")), F.abs(F.col("y_l") - F.col("y_r"))
    same = (F.floor(F.col("x_l") / side) == F.col("_cx")) & (F.floor(F.col("y_l") / side) == F.col("_cy"))
    j = salted_join(home, probe, ["_cx", "_cy"], F.col("id_r"), hot_rows).filter((dx < side) & (dy < side) & (F.col("id_l") != F.col("id_r")) & (~same | (F.col("id_l") < F.col("id_r"))))
    return j.select(F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b"), F.hypot(dx, dy).alias("metres"), F.when(F.least(dx, dy) < edge, "edge").otherwise("corner").alias("kind"))


def nearest(left: DataFrame, right: DataFrame, side: float, exclude_same_id: bool = False, growth: int = 8) -> DataFrame:
    """For each left point its nearest right point (``id``, ``nn``, ``dist``), exactly; ties go to the smaller right id.

    Both sides need ``id``, ``x``, ``y``. Cells of ``side`` are searched with their neighbours; an answer no farther than ``side``
    is final, and the other points go on to cells ``growth`` times as wide. Each round is one equality join in which a
    point's candidates are reduced before the shuffle. Points with a null coordinate are left out; an empty right side
    gives no rows.
    """
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    todo = materialize(left.filter(ok).select("id", "x", "y"), "nn")
    r = materialize(right.filter(ok).select(F.col("id").alias("nn"), F.col("x").alias("x_r"), F.col("y").alias("y_r")), "nn")
    both = r.agg(F.min("x_r").alias("a"), F.max("x_r").alias("b"), F.min("y_r").alias("c"), F.max("y_r").alias("d")).crossJoin(todo.agg(F.min("x").alias("e"), F.max("x").alias("f"), F.min("y").alias("g"), F.max("y").alias("h"))).first()
    if any(v is None for v in both):
        return todo.limit(0).select("id", F.col("id").alias("nn"), F.lit(0.0).alias("dist"))
    widest = max(max(both.b, both.f) - min(both.a, both.e), max(both.d, both.h) - min(both.c, both.g), side)
    done = None
    while True:
        home = r.withColumn("_cx", F.floor(F.col("x_r") / side)).withColumn("_cy", F.floor(F.col("y_r") / side))
        j = salted_join(home, _around(todo, side), ["_cx", "_cy"], F.col("nn"), 4000)
        if exclude_same_id:
            j = j.filter(F.col("id") != F.col("nn"))
        found = j.groupBy("id").agg(F.min(F.struct(F.hypot(F.col("x") - F.col("x_r"), F.col("y") - F.col("y_r")).alias("dist"), F.col("nn").alias("nn"))).alias("m")).select("id", F.col("m.nn").alias("nn"), F.col("m.dist").alias("dist"))
        last = side > widest
        final = materialize(found if last else found.filter(F.col("dist") <= side), "nn")
        done = final if done is None else done.unionByName(final)
        if last:
            return done
        todo = materialize(todo.join(final, "id", "left_anti"), "nn")
        if todo.isEmpty():
            return done
        side *= growth


def greedy_spacing(points: DataFrame, near: DataFrame) -> DataFrame:
    """The points that a greedy pass in the order of ``rank`` keeps when each must be far from all that were kept before.

    ``points``: ``id``, ``rank`` (different for all points); ``near``: pairs (``id_a``, ``id_b``) that are too close. In rounds, every
    undecided point that precedes all its undecided neighbours is kept and these are dropped; the result is that of the
    sequential pass, and no task holds more than its share of the pairs.
    """
    rank = points.select("id", "rank")
    r = lambda c, n: rank.select(F.col("id").alias(c), F.col("rank").alias(n))
    e = near.join(r("id_a", "rank_a"), "id_a").join(r("id_b", "rank_b"), "id_b")
    first = F.col("rank_a") < F.col("rank_b")
    edges = materialize(e.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("early"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("late")).distinct(), "edges")
    dropped = None
    while not edges.isEmpty():
        # Ends of edges without an earlier undecided neighbour are kept.
        kept = edges.select(F.col("early").alias("id")).distinct().join(edges.select(F.col("late").alias("id")).distinct(), "id", "left_anti")
        out = materialize(edges.join(kept, edges["early"] == kept["id"], "left_semi").select(F.col("late").alias("id")).distinct(), "dropped")
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = out.withColumnRenamed("id", "early")
        left = edges.join(gone, "early", "left_anti").join(out.withColumnRenamed("id", "late"), "late", "left_anti")
        edges = materialize(left.select("early", "late"), "edges")
    return points if dropped is None else points.join(dropped, "id", "left_anti")


def grid(lon0: float, lat0: float, lon1: float, lat1: float, metres: float, spark) -> DataFrame:  # noqa: ANN001
    """A regular grid of points (``patch_id``, ``lon``, ``lat``) from the south-west corner; steps are metres at the middle latitude."""
    dy = metres / S.METRES_PER_DEGREE
    from math import cos, radians

    dx = metres / (S.METRES_PER_DEGREE * cos(radians((lat0 + lat1) / 2)))
    nx, ny = int(ceil((lon1 - lon0) / dx - 1e-9)), int(ceil((lat1 - lat0) / dy - 1e-9))
    g = spark.range(max(nx, 0) * max(ny, 0))
    row, col = F.floor(F.col("id") / max(nx, 1)), F.pmod(F.col("id"), F.lit(max(nx, 1)))
    return g.select(F.format_string("p%05d", "id").alias("patch_id"), (F.lit(lon0) + col * dx).alias("lon"), (F.lit(lat0) + row * dy).alias("lat"))


def planar(df: DataFrame, key: str, lon: Column, lat: Column) -> DataFrame:
    """(``id``, ``x``, ``y``) on the plane of the study's latitude."""
    return df.select(F.col(key).alias("id"), (lon * S.METRES_PER_DEGREE * F.cos(F.radians(F.lit(S.STUDY_LATITUDE)))).alias("x"), (lat * S.METRES_PER_DEGREE).alias("y"))
