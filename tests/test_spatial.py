from __future__ import annotations

import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairlens.operators.spatial import EARTH_RADIUS_M, locate_in_regions, near_join, near_pairs
from tests.conftest import rows


def dist(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def brute(points, r):
    return sorted({(min(a, b), max(a, b)) for i, (a, *p) in enumerate(points) for b, *q in points[:i] if a != b and dist(p, q) <= r})


SCHEMA = "id long, lon double, lat double"


def test_near_pairs_everywhere(spark):
    rng = random.Random(5)
    pts, n = [], 0
    for lon0, lat0, spread in [(0.1, 0.1, 0.05), (179.99, 10, 0.03), (-179.99, 10, 0.03), (50, 89.98, 60), (200 - 360, 89.99, 180), (10, -89.99, 180), (80, 75, 0.1), (0, 90, 0), (45, 90, 0)]:
        for _ in range(60):
            lon = (lon0 + rng.uniform(-spread, spread) + 180) % 360 - 180
            pts.append((n, lon, max(-90.0, min(90.0, lat0 + rng.uniform(-0.02, 0.02)))))
            n += 1
    df = spark.createDataFrame(pts, SCHEMA)
    for r, hot in [(640.0, 4000), (1500.0, 5)]:
        assert rows(near_pairs(df, r, "id", hot)) == brute(pts, r)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-180, 180), st.sampled_from([-90.0, -89.995, 0.001, 71.0, 89.995, 90.0])), max_size=30), st.sampled_from([300.0, 5000.0]))
def test_near_pairs_property(spark, places, r):
    pts = [(i, x, y) for i, (x, y) in enumerate(places) if (x, y) != (0, 0)]
    assert rows(near_pairs(spark.createDataFrame(pts, SCHEMA), r, "id", 3)) == brute(pts, r)


def test_dirty_rows_and_clashing_columns(spark):
    nan = float("nan")
    data = [(1, 5.0, 5.0, 9, "x"), (1, 5.0, 5.0, 9, "x"), (2, 5.001, 5.0, 9, None), (3, None, 5.0, 9, "x"), (4, nan, 5.0, 9, "x"), (5, 0.0, 0.0, 9, "x"), (6, 0.001, 0.0, 9, "x"), (7, 181.0, 5.0, 9, "x"), (None, 5.0, 5.0, 9, "x"), (8, -9999.0, -9999.0, 9, "x")]
    df = spark.createDataFrame(data, "id long, lon double, lat double, _salt int, id_l string")
    assert rows(near_pairs(df, 640.0, "id")) == [(1, 2)]
    assert rows(near_pairs(df.limit(0), 640.0, "id")) == []
    got = near_join(df, df, 640.0, "id", "id")
    assert got.filter("id_l = 1 and id_r = 2").count() == 2  # each delivered row counts
    assert near_join(df.limit(0), df, 640.0, "id", "id").count() == 0


def test_regions(spark):
    regions = spark.createDataFrame([(7, -180.0, 180.0, 71.0, 77.0), (9, 179.97, -179.97, -57.0, -55.76), (3, 10.0, 10.4, 0.0, 0.2), (4, 10.4, 10.8, 0.0, 0.2), (1, None, 1.0, 0.0, 1.0)], "block_id int, lon_min double, lon_max double, lat_min double, lat_max double")
    pts = spark.createDataFrame([(1, 0.5, 72.0), (2, 180.0, 71.0), (3, 179.98, -56.0), (4, -179.98, -56.0), (5, -179.96, -56.0), (6, 10.4, 0.1), (7, 10.399999, 0.0), (8, 10.1, 0.2), (9, None, 0.1), (10, 180.0, -56.5), (11, -180.0, -56.5)], "rec_id long, lon double, lat double")
    assert rows(locate_in_regions(pts, regions, "rec_id", "block_id")) == [(1, 7), (2, 7), (3, 9), (4, 9), (6, 4), (7, 3), (10, 9), (11, 9)]
    assert rows(locate_in_regions(pts, regions.limit(0), "rec_id", "block_id")) == []


def test_polygon(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    regions = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, ring), (2, 0.0, 1.0, 0.0, 1.0, None)], "block_id int, lon_min double, lon_max double, lat_min double, lat_max double, ring array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.8, 0.8)], "rec_id long, lon double, lat double")
    assert rows(locate_in_regions(pts, regions, "rec_id", "block_id")) == [(1, 1), (2, 2)]
