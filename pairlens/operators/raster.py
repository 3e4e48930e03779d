"""Rasters held as arrays of a row: Otsu masks, components, boxes, padding, disturbance triplets.

A row is one scene, so every operator is a batch function without a shuffle; pixel statistics stay in JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.skew import spread

#: Least pixels of a drop for a threshold, and least area of a box.
OTSU_PIXELS = 16
BOX_AREA = 64
IOU_MERGE = 0.4
# Fixed values: (high, moderate) cut-offs of the mean drop.
SEVERITY = {"Fire": (0.27, 0.10), "Deforestation": (0.25, 0.08)}


def otsu_threshold(values: np.ndarray, bins: int = 256) -> float:
    """The centre of the histogram bin after which between-class variance is largest; the first one of equals."""
    n, edges = np.histogram(values, bins)
    centre = (edges[:-1] + edges[1:]) / 2
    below, mass = np.cumsum(n), np.cumsum(n * centre)
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = mass / below - (mass[-1] - mass) / above
        spread = np.where((below > 0) & (above > 0), below * above * gap**2, 0.0)
    return float(centre[int(spread[:-1].argmax())])


def otsu_mask(pixels: np.ndarray, min_drop: float = 0.0) -> tuple[np.ndarray, float | None]:
    """Mask of the strong drops and the threshold; nothing where fewer than 16 pixels fall. NaN never falls."""
    p = np.nan_to_num(np.asarray(pixels, float), nan=0.0, posinf=0.0, neginf=0.0)
    drop = np.where(p < -abs(min_drop), -p, 0.0).astype(np.float32)
    some = drop[drop > 0]
    if some.size < OTSU_PIXELS:
        return np.zeros(drop.shape, np.uint8), None
    cut = float(some.max()) if some.min() == some.max() else otsu_threshold(some)
    return (drop >= cut).astype(np.uint8), cut


def _cross(m: np.ndarray, grow: bool) -> np.ndarray:
    """One step of growing or shrinking with a cross; beyond the edge nothing counts."""
    p = np.pad(m, 1, constant_values=not grow)
    parts = (p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:])
    return np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)


def _labels(m: np.ndarray, eight: bool) -> np.ndarray:
    """Component numbers from 1, by spreading the least number over neighbours until nothing changes."""
    lab = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    big = m.size + 2
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    while True:
        p = np.pad(np.where(m, lab, big), 1, constant_values=big)
        least = np.minimum.reduce([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i, j in [(0, 0), *steps]])
        new = np.where(m, least, 0)
        # Pointer jumping: a number's own place holds a smaller one already.
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(m, flat[new], 0)
        if (new == lab).all():
            return lab
        lab = new


def boxes(mask: np.ndarray, min_area: int = BOX_AREA, close: bool = True) -> list[list[int]]:
    """Boxes [x0, y0, x1, y1] of the outermost components, the largest first (then from top left).

    Gaps of a pixel are closed first; components inside of a hole of another one don't come out.
    """
    m = np.asarray(mask) > 0
    if close:
        m = _cross(_cross(m, True), False)
    if not m.any():
        return []
    outside = _labels(np.pad(~m, 1, constant_values=True), False)
    outer = np.pad((outside == outside[0, 0]), 0)
    lab = _labels(m, True)
    touch = np.pad(lab, 1)
    seen = set()
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            moved = np.roll(np.roll(outer, i, 0), j, 1)
            seen.update(np.unique(touch[moved]).tolist())
    out = []
    for k in sorted(seen - {0}):
        ys, xs = np.nonzero(lab == k)
        b = [int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1]
        if (b[2] - b[0]) * (b[3] - b[1]) >= min_area:
            out.append(b)
    return sorted(out, key=lambda b: (-(b[2] - b[0]) * (b[3] - b[1]), b[1], b[0]))


def mean_drop(pixels: np.ndarray, box: Sequence[int]) -> float:
    """Mean depth of the falls in a box; rises count as 0, NaN not at all, an empty box 0."""
    h, w = pixels.shape
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(w, box[2]), min(h, box[3])
    part = pixels[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else np.empty(0)
    part = part[np.isfinite(part)]
    return float(-np.minimum(part, 0).mean()) if part.size else 0.0


def iou(a: Sequence[int], b: Sequence[int]) -> float:
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    return inter / (area(a) + area(b) - inter) if inter else 0.0


def match_boxes(fire: Sequence[Sequence[int]], loss: Sequence[Sequence[int]], least: float = IOU_MERGE) -> list[tuple[list[int], str]]:
    """Each fire box takes the first unused loss box that overlaps enough, and becomes their union; unused loss boxes follow."""
    free = dict(enumerate(loss))
    out: list[tuple[list[int], str]] = []
    for f in fire:
        k = next((i for i, b in free.items() if iou(f, b) >= least), None)
        b = free.pop(k) if k is not None else f
        out.append(([min(f[0], b[0]), min(f[1], b[1]), max(f[2], b[2]), max(f[3], b[3])], "Fire"))
    return out + [(list(b), "Deforestation") for b in free.values()]


def severity_of(drop: float, kind: str) -> str:
    high, moderate = SEVERITY[kind]
    return "High" if drop >= high else "Moderate" if drop >= moderate else "Low"


TRIPLETS = "array<struct<bbox:array<int>,disturbance_type:string,severity:string>>"


def disturbance_triplets(scenes: DataFrame, key: str, min_drop: float = 0.0) -> DataFrame:
    """(``key``, ``triplets``) of scenes with ``height``, ``width``, ``delta_ndvi`` and ``delta_nbr`` as row-major arrays.

    A scene whose arrays don't fit its size, or are null, has no triplets.
    """
    kind = dict(scenes.dtypes)[key]

    def one(h: int, w: int, ndvi: Sequence | None, nbr: Sequence | None) -> list[dict]:
        if ndvi is None or nbr is None or not h or not w or len(ndvi) != h * w or len(nbr) != h * w:
            return []
        a, b = (np.asarray(x, float).reshape(int(h), int(w)) for x in (ndvi, nbr))
        pairs = match_boxes(boxes(otsu_mask(b, min_drop)[0]), boxes(otsu_mask(a, min_drop)[0]))
        return [{"bbox": r, "disturbance_type": t, "severity": severity_of(mean_drop(b if t == "Fire" else a, r), t)} for r, t in pairs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({key: p[key], "triplets": [one(*x) for x in zip(p["height"], p["width"], p["delta_ndvi"], p["delta_nbr"])]})

    return spread(scenes.select(key, "height", "width", "delta_ndvi", "delta_nbr")).mapInPandas(run, f"{key} {kind}, triplets {TRIPLETS}")


def otsu_scenes(df: DataFrame, key: str, pixels: str, min_drop: float = 0.0) -> DataFrame:
    """(``key``, ``threshold``, ``n_mask``, ``share``) of each array of pixels; a null array gives nulls and 0 pixels."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [otsu_mask(np.asarray([] if v is None else v, float), min_drop) for v in p["_px"]]
            yield pd.DataFrame({key: p[key], "threshold": pd.array([t for _, t in got], dtype="Float64"), "n_mask": [int(m.sum()) for m, _ in got], "share": pd.array([float(m.mean()) if m.size else None for m, _ in got], dtype="Float64")})

    return spread(df.select(key, F.col(pixels).alias("_px"))).mapInPandas(run, f"{key} {kind}, threshold double, n_mask int, share double")


def class_policy(triplets: Column, reference: Column, most: int = 5) -> Column:
    """The boxes that a class may carry: none for stable, increase, uncertain or no class; for decline the strongest and largest
    losses, for fire its fires, at most ``most``; where a class has none of its kind, all are looked at."""
    ref = F.coalesce(F.lower(F.trim(reference)), F.lit(""))
    rank = lambda t: F.when(t["severity"] == "High", 0).when(t["severity"] == "Moderate", 1).otherwise(2)
    area = lambda t: (t["bbox"][2] - t["bbox"][0]) * (t["bbox"][3] - t["bbox"][1])
    of = lambda k: F.filter(triplets, lambda t: t["disturbance_type"] == k)
    loss = F.when(F.size(of("Deforestation")) > 0, of("Deforestation")).otherwise(triplets)
    fire = F.when(F.size(of("Fire")) > 0, of("Fire")).otherwise(triplets)
    numbered = F.transform(loss, lambda t, i: F.struct(rank(t).alias("r"), (-area(t)).alias("a"), i.alias("i"), t.alias("t")))
    ordered = F.transform(F.array_sort(numbered), lambda x: x["t"])
    return F.when(ref.isin("stable", "increase", "uncertain", "") | triplets.isNull(), F.slice(triplets, 1, 0)).when(ref == "decline", F.slice(ordered, 1, most)).when(ref == "fire", F.slice(fire, 1, most)).otherwise(F.slice(triplets, 1, most))


def padded_box(box: Column, height: Column, width: Column, target: int = 512) -> Column:
    """A box of a chip on the square canvas that the chip is padded and scaled to; rounded half to even and clipped."""
    side = F.greatest(height, width)
    scale = F.lit(float(target)) / side
    px, py = F.floor((side - width) / 2), F.floor((side - height) / 2)
    at = lambda v, pad, lo, hi: F.least(F.greatest(F.bround((v + pad) * scale, 0).cast("int"), F.lit(lo)), F.lit(hi))
    return F.array(at(box[0], px, 0, target - 1), at(box[1], py, 0, target - 1), at(box[2], px, 1, target), at(box[3], py, 1, target))


def area_share(box: Column, canvas: int = 512) -> Column:
    return F.round(F.greatest(F.lit(0), box[2] - box[0]) * F.greatest(F.lit(0), box[3] - box[1]) / float(canvas * canvas), 4)


def stretched(reflectance: Column, vmax: float = 0.22) -> Column:
    """Reflectance (or its 10,000-fold) of one band's pixels to 0..255 by a fixed window; NaN and negatives become 0."""
    top = F.array_max(F.filter(reflectance, lambda v: ~F.isnan(v)))
    scale = F.when(top > 1.5, 10000.0).otherwise(1.0)
    return F.transform(reflectance, lambda v: F.floor(F.least(F.greatest(F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)) / scale / vmax, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def mask_share(mask: Column) -> Column:
    """Share of a mask whose values are 0..1 or 0..255; 0 for null or empty."""
    top = F.array_max(mask)
    scale = F.when(top > 1.5, 255.0).otherwise(1.0)
    total = F.aggregate(mask, F.lit(0.0), lambda a, v: a + F.least(F.greatest(v.cast("double") / scale, F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(total / F.nullif(F.size(mask), F.lit(0)), F.lit(0.0))


def rgb_stats(r: Column, g: Column, b: Column) -> Column:
    """Means, brightness and the share of pixels where green leads, of three bands of pixels in 0..255."""
    n = F.nullif(F.size(r), F.lit(0)).cast("double")
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / n / 255, 4)
    px = F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"))
    light = F.transform(px, lambda p: (0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]) / 255)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    m = total(light) / n
    sd = F.sqrt(F.greatest(F.aggregate(light, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n, F.lit(0.0)))
    lead = F.size(F.filter(px, lambda p: (p["g"] > p["r"]) & (p["g"] > p["b"]))) / n
    return F.struct(mean(r).alias("mean_r"), mean(g).alias("mean_g"), mean(b).alias("mean_b"), F.round(m, 4).alias("brightness_mean"), F.round(sd, 4).alias("brightness_std"), F.round(lead, 4).alias("green_dominant_fraction"))


def tensor_ok(pixels: Column, height: Column, width: Column, channels: Column, want: tuple[int, int, int] = (512, 512, 2)) -> Column:
    """Whether a tensor has the wanted shape, as many values, and only finite ones; null is not ok."""
    shape = (height == want[0]) & (width == want[1]) & (channels == want[2]) & (F.size(pixels) == want[0] * want[1] * want[2])
    return F.coalesce(shape & F.forall(pixels, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
