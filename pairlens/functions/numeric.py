"""Numbers: indices, distances, formats, exact tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens import schemas as S


def norm_diff(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def evi(nir: Column, red: Column, blue: Column) -> Column:
    """Enhanced vegetation index of reflectances scaled by 10,000; null where the denominator is 0."""
    n, r, b = nir / 10000, red / 10000, blue / 10000
    return 2.5 * (n - r) / F.nullif(n + 6 * r - 7.5 * b + 1, F.lit(0.0))


def linear_ratio(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def finite(v: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def fixed(v: Column, digits: int, sign: bool = False) -> Column:
    """A number with fixed digits, with its sign on request; ``n/a`` for null."""
    return F.coalesce(F.when(v.isNotNull(), F.format_string(f"%{'+' if sign else ''}.{digits}f", v)), F.lit("n/a"))


def percent(v: Column) -> Column:
    """A share in percent with one digit, a dash for null."""
    return F.coalesce(F.when(v.isNotNull(), F.format_string("%.1f%%", v * 100)), F.lit("—"))


def equirectangular_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a plane at the middle latitude of two points."""
    return F.hypot((lon2 - lon1) * S.METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * S.METRES_PER_DEGREE)


def planar_x(lon: Column) -> Column:
    """Easting in metres on the plane of the study's latitude (not the distance of :func:`equirectangular_m`)."""
    return lon * S.METRES_PER_DEGREE * F.cos(F.radians(F.lit(S.STUDY_LATITUDE)))


def planar_y(lat: Column) -> Column:
    return lat * S.METRES_PER_DEGREE


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes [x0, y0, x1, y1]; 0 where they don't meet."""
    inter = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.when(inter == 0, 0.0).otherwise(inter / F.nullif(box_area(a) + box_area(b) - inter, F.lit(0)))


def wilson(k: Column, n: Column, z: float = S.WILSON_Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series eight places above it."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    shift = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift  # half the logarithm of 2 pi


#: Standard deviations of the binomial tail that are summed; what lies beyond is less than a double can tell.
TAIL_DEVIATIONS = 20


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p of the discordant counts; 1 where there are none.

    The binomial tail is summed from its largest term down, C(n, j - 1) = C(n, j) j / (n - j + 1), over as many terms as matter: a number that
    grows with the root of the counts.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * F.log(F.lit(2.0))
    terms = F.least(k, F.ceil(F.sqrt(n) * TAIL_DEVIATIONS).cast("double")).cast("int")
    start = F.struct(F.lit(0.0).alias("s"), top.alias("l"))
    step = lambda a, j: F.struct((a["s"] + F.exp(a["l"])).alias("s"), F.coalesce(a["l"] + F.log(F.nullif(k - j, F.lit(0.0)) / (n - k + j + 1)), F.lit(-1e300)).alias("l"))
    tail = F.aggregate(F.sequence(F.lit(0), terms), start, step, lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
