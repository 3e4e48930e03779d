"""Points near other points or inside regions, by grid cells sized to the radius and an exact check.

Bands of latitude are two radii high; each band is cut into equal cells of longitude that are at least two radii wide at
the band's poleward edge. A point is found from the few cells that its circle touches, so neither the poles nor the 180th
meridian need a special case, and every stage is an equi-join.
"""

from __future__ import annotations

from math import ceil, degrees, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.skew import salted_join

#: Mean Earth radius in metres (fixed value).
EARTH_RADIUS_M = 6_371_008.8
#: Side of a cell in radii: at 2 a circle touches two to three cells, at 1 it would touch four to nine.
CELL_RADII = 2.0
#: Points of one grid cell that one task may hold before the cell is split.
HOT_CELL_ROWS = 4_000


def located(lon: Column, lat: Column) -> Column:
    """True where a row has a location: both are numbers, in range, and not both zero. Never null."""
    ok = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))
    return F.coalesce(ok, F.lit(False))


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


class BandGrid:
    """Cells of at least ``CELL_RADII`` radii on each side, as column expressions."""

    def __init__(self, radius_m: float) -> None:
        # A little more than the radius, so that rounding never separates a pair at the very limit.
        self.angle = radius_m * 1.000001 / EARTH_RADIUS_M
        self.radius = degrees(self.angle)
        self.height = self.radius * CELL_RADII
        self.bands = int(ceil(180 / self.height))

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / self.height), F.lit(self.bands - 1)).cast("long")

    def cells_in(self, band: Column) -> Column:
        edge = F.least(F.greatest(F.abs(band * self.height - 90), F.abs((band + 1) * self.height - 90)), F.lit(90.0))
        return F.greatest(F.floor(360 * F.cos(F.radians(edge)) / self.height), F.lit(1)).cast("long")

    def cell(self, lon: Column, band: Column) -> Column:
        n = self.cells_in(band)
        return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)

    def home(self, df: DataFrame, lon: str, lat: str) -> DataFrame:
        """``df`` with the cell of each point in ``_band`` and ``_cell``."""
        return df.withColumn("_band", self.band(F.col(lat))).withColumn("_cell", self.cell(F.col(lon), F.col("_band")))

    def around(self, df: DataFrame, lon: str, lat: str, forward: bool = False) -> DataFrame:
        """``df`` with one row for each cell that the circle around a point touches.

        ``forward``: only the own band from the own cell eastward, and the next band; enough to find each pair of one
        set from one of its ends. A neighbouring band is searched only where the circle reaches it.
        """
        x, y = F.col(lon), F.col(lat)
        reach = F.when(F.abs(y) + self.radius >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(sin(self.angle)) / F.cos(F.radians(y))))))
        own = self.band(y)

        def run(band: Column, west: Column, touched: Column | None = None) -> Column:
            n = self.cells_in(band)
            first = F.floor((x - west + 180) / 360 * n).cast("long")
            last = F.least(F.floor((x + reach + 180) / 360 * n).cast("long"), first + n - 1)
            cells = F.transform(F.sequence(first, last), lambda c: F.struct(band.alias("_band"), F.pmod(c, n).alias("_cell")))
            inside = (band >= 0) & (band < self.bands)
            inside = inside if touched is None else inside & touched
            return F.when(inside, cells).otherwise(F.slice(cells, 1, 0))

        # A circle that reaches around a pole may lie on both sides of the own cell; it is searched in full.
        west = F.when(reach >= 180, reach).otherwise(F.lit(0.0)) if forward else reach
        above, below = self.band(y + self.radius) > own, self.band(y - self.radius) < own
        runs = [run(own, west), run(own + 1, reach, above)] + ([] if forward else [run(own - 1, reach, below)])
        return df.withColumn("_at", F.explode(F.array_distinct(F.concat(*runs)))).select(*df.columns, F.col("_at._band").alias("_band"), F.col("_at._cell").alias("_cell"))


def near_join(left: DataFrame, right: DataFrame, radius_m: float, left_id: str, right_id: str, hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Pairs (``id_l``, ``id_r``, ``metres``) of a left and a right point at most ``radius_m`` apart.

    Both sides need ``lon``, ``lat`` and their id; other columns may be there and are ignored. Rows without a location
    (see :func:`located`) match nothing. Repeated rows give repeated pairs. The right side should be the larger one: the
    left side is sent to each cell that its circle touches.
    """
    grid = BandGrid(radius_m)

    def side(df: DataFrame, key: str, s: str) -> DataFrame:
        return df.filter(located(F.col("lon"), F.col("lat"))).select(F.col(key).alias(f"id_{s}"), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"))

    home = grid.home(side(right, right_id, "r"), "lon_r", "lat_r")
    probe = grid.around(side(left, left_id, "l"), "lon_l", "lat_l")
    joined = salted_join(home, probe, ["_band", "_cell"], F.col("id_r"), hot_rows)
    return joined.withColumn("metres", great_circle_m(F.col("lon_l"), F.col("lat_l"), F.col("lon_r"), F.col("lat_r"))).filter(F.col("metres") <= radius_m).select("id_l", "id_r", "metres")


def near_pairs(points: DataFrame, radius_m: float, key: str, hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Pairs (``id_a``, ``id_b``), ``id_a`` < ``id_b``, of different keys of one set with locations at most ``radius_m`` apart.

    ``points`` needs ``lon``, ``lat`` and ``key``; a key may have several locations, and one near pair of them is enough.
    Rows without a location or with a null key are left out; repeated rows change nothing; each pair comes once.
    """
    grid = BandGrid(radius_m)
    p = points.filter(located(F.col("lon"), F.col("lat")) & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct()
    home = grid.home(p.select(F.col("_id").alias("id_r"), F.col("_lon").alias("lon_r"), F.col("_lat").alias("lat_r")), "lon_r", "lat_r")
    probe = grid.around(p.select(F.col("_id").alias("id_l"), F.col("_lon").alias("lon_l"), F.col("_lat").alias("lat_l")), "lon_l", "lat_l", forward=True)
    joined = salted_join(home, probe, ["_band", "_cell"], F.col("id_r"), hot_rows)
    near = joined.filter((F.col("id_l") != F.col("id_r")) & (great_circle_m(F.col("lon_l"), F.col("lat_l"), F.col("lon_r"), F.col("lat_r")) <= radius_m))
    return near.select(F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b")).distinct()


#: Side of the finest region cell in degrees; level k has cells of 2**k times this.
REGION_CELL_DEG = 0.05
REGION_LEVELS = 13


def locate_in_regions(points: DataFrame, regions: DataFrame, key: str, region_key: str) -> DataFrame:
    """For each located point the region that contains it, as (``key``, ``region_key``).

    ``regions`` needs ``lon_min``, ``lon_max``, ``lat_min``, ``lat_max`` in degrees; ``lon_min`` > ``lon_max`` crosses the 180th
    meridian. An optional column ``ring`` (array of struct<lon, lat>) narrows a region to a polygon. West and south edges
    belong to a region, east and north edges do not, save at 180 degrees and the pole. If regions overlap, the lowest
    ``region_key`` wins. Points in no region, or without a location, give no row. Regions with a null bound contain nothing.

    A region is entered in the cells of the level at which it covers at most a few cells, a point in one cell of each
    level, so a wide region costs as little as a small one and both sides are joined by equality.
    """
    size = F.greatest(F.pmod(F.col("lon_max") - F.col("lon_min"), F.lit(360.0)), F.when(F.col("lon_max") - F.col("lon_min") >= 360, 360.0).otherwise(0.0), F.col("lat_max") - F.col("lat_min"))
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1e-9)) / F.lit(REGION_CELL_DEG))), F.lit(0)), F.lit(REGION_LEVELS - 1)).cast("int")
    ring = [F.col("ring")] if "ring" in regions.columns else []
    r = regions.filter(F.col("lon_min").isNotNull() & F.col("lon_max").isNotNull() & F.col("lat_min").isNotNull() & F.col("lat_max").isNotNull())
    r = r.select(F.col(region_key).alias("_region"), "lon_min", "lon_max", "lat_min", "lat_max", *ring, level.alias("_level")).withColumn("_side", F.lit(REGION_CELL_DEG) * F.pow(F.lit(2.0), F.col("_level")))
    east = F.when(F.col("lon_max") < F.col("lon_min"), F.col("lon_max") + 360).otherwise(F.col("lon_max"))
    xs = F.transform(F.sequence(F.floor((F.col("lon_min") + 180) / F.col("_side")), F.floor((east + 180) / F.col("_side"))), lambda c: F.floor(F.pmod(c * F.col("_side"), F.lit(360.0)) / F.col("_side") + 1e-9))
    # A cell that the meridian cuts is entered at both ends.
    xs = F.array_distinct(F.concat(xs, F.when(east > 180, F.array(F.lit(0).cast("long"), F.floor(F.lit(360.0) / F.col("_side")))).otherwise(F.array().cast("array<bigint>"))))
    ys = F.sequence(F.floor((F.col("lat_min") + 90) / F.col("_side")), F.floor((F.col("lat_max") + 90) / F.col("_side")))
    cells = r.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys)).drop("_side")
    p = points.filter(located(F.col("lon"), F.col("lat")) & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct()
    p = p.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(REGION_LEVELS - 1)))).withColumn("_side", F.lit(REGION_CELL_DEG) * F.pow(F.lit(2.0), F.col("_level")))
    p = p.withColumn("_x", F.floor((F.col("_lon") + 180) / F.col("_side"))).withColumn("_y", F.floor((F.col("_lat") + 90) / F.col("_side"))).drop("_side")
    # Only levels that some region uses are kept: a dozen rows at most.
    p = p.join(F.broadcast(r.select("_level").distinct()), "_level", "left_semi")
    lon, lat = F.col("_lon"), F.col("_lat")
    below = lambda v, top, end: (v < top) | ((top == end) & (v == end))
    across = F.col("lon_min") > F.col("lon_max")
    in_lon = F.when(across, (lon >= F.col("lon_min")) | (lon < F.col("lon_max"))).otherwise((lon >= F.col("lon_min")) & below(lon, F.col("lon_max"), F.lit(180.0)))
    inside = in_lon & (lat >= F.col("lat_min")) & below(lat, F.col("lat_max"), F.lit(90.0))
    if ring:
        inside = inside & F.coalesce(in_ring(lon, lat, F.col("ring")), F.lit(True))
    hit = salted_join(p, cells, ["_level", "_x", "_y"], F.col("_id")).filter(inside)
    return hit.groupBy("_id", "_lon", "_lat").agg(F.min("_region").alias("_region")).groupBy("_id").agg(F.min("_region").alias(region_key)).withColumnRenamed("_id", key).select(key, region_key)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring of vertices (array of struct<lon, lat>); null for a null ring."""
    n = F.size(ring)

    def crosses(acc: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        over = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return acc != (over & F.coalesce(lon < at, F.lit(False)))

    return F.when(ring.isNotNull() & (n >= 3), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crosses)).when(ring.isNotNull(), F.lit(False))
