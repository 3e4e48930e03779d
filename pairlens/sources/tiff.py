"""Reader of TIFF rasters as arrays: strips and tiles, plain, deflate or LZW, with predictors, nodata as NaN."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.skew import spread

# Fixed values of the format: bytes of a value of each field type, and the tags that are read.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, NODATA = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 42113


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table and 257 ends."""
    out, table, width, bits, n = bytearray(), [], 9, 0, 0
    last = b""
    for byte in data:
        bits, n = (bits << 8) | byte, n + 8
        while n >= width:
            n -= width
            code = (bits >> n) & ((1 << width) - 1)
            bits &= (1 << n) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last:
                table.append(last + word[:1])
            last = word
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _fields(b: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}[b[:2]]
    if struct.unpack_from(order + "H", b, 2)[0] != 42:
        raise ValueError("no TIFF of the classic kind")
    at = struct.unpack_from(order + "I", b, 4)[0]
    fields: dict[int, tuple] = {}
    for i in range(struct.unpack_from(order + "H", b, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", b, at + 2 + 12 * i)
        size = TYPE_BYTES.get(kind, 1) * count
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", b, at + 10 + 12 * i)[0]
        code = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
        if code == "s":
            fields[tag] = (b[place : place + count].split(b"\0")[0].decode("ascii", "replace"),)
        elif code:
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", b, place)
    return order, fields


def read_tiff(b: bytes) -> np.ndarray:
    """Height x width x bands as float32; the nodata value and infinities are NaN. Anything else than such a raster is a ValueError."""
    try:
        order, f = _fields(b)
        w, h, bands = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
        bits, fmt = f.get(BITS, (1,))[0], f.get(SAMPLE_FORMAT, (1,))[0]
        kind = np.dtype({1: "u", 2: "i", 3: "f"}[fmt] + str(bits // 8)).newbyteorder(order)
        planar, predictor, packing = f.get(PLANAR, (1,))[0], f.get(PREDICTOR, (1,))[0], f.get(COMPRESSION, (1,))[0]
        tiled = TILES in f
        bw, bh = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (w, min(h, f.get(ROWS_PER_STRIP, (h,))[0]))
        places, sizes = (f[TILES], f[TILE_BYTES]) if tiled else (f[STRIPS], f[STRIP_BYTES])
        deep = bands if planar == 1 else 1
        across, down = -(-w // bw), -(-h // bh)
        out = np.empty((h, w, bands), np.float32)
        for k, (place, size) in enumerate(zip(places, sizes)):
            raw = b[place : place + size]
            raw = raw if packing == 1 else _lzw(raw) if packing == 5 else zlib.decompress(raw) if packing in (8, 32946) else None
            if raw is None:
                raise ValueError(f"compression {packing}")
            plane, rest = divmod(k, across * down) if planar == 2 else (0, k)
            y, x = (rest // across) * bh, (rest % across) * bw
            rows = bh if tiled else min(bh, h - y)
            if predictor == 3:
                # Bytes are differenced along a row and stored by significance, the highest first.
                p = np.frombuffer(raw[: rows * bw * deep * kind.itemsize], np.uint8).reshape(rows, kind.itemsize * bw, deep) if deep == 1 else np.frombuffer(raw[: rows * bw * deep * kind.itemsize], np.uint8).reshape(rows, -1, deep)
                p = np.cumsum(p, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, bw * deep)
                block = np.ascontiguousarray(p.transpose(0, 2, 1)).view(f">f{kind.itemsize}").reshape(rows, bw, deep)
            else:
                block = np.frombuffer(raw[: rows * bw * deep * kind.itemsize], kind).reshape(rows, bw, deep)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            part = block[: h - y, : w - x]
            out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + deep] = part
        if NODATA in f and str(f[NODATA][0]).strip():
            out[out == np.float32(float(f[NODATA][0]))] = np.nan
        out[~np.isfinite(out)] = np.nan
        return out
    except (KeyError, IndexError, struct.error, zlib.error, TypeError) as e:
        raise ValueError(f"no readable raster: {e}") from e


def rasters(files: DataFrame) -> DataFrame:
    """(``path``, ``height``, ``width``, ``bands``, ``pixels``) of TIFF files (``path``, ``content``); unreadable files have null fields.

    Pixels are row-major with the bands innermost; nodata is NaN. A file is decoded in one task, as a raster is one array.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    a = read_tiff(bytes(content))
                    rows.append((path, *a.shape, a.ravel()))
                except ValueError:
                    rows.append((path, None, None, None, None))
            out = pd.DataFrame(rows, columns=["path", "height", "width", "bands", "pixels"])
            yield out.astype({k: "Int32" for k in ("height", "width", "bands")})

    return spread(files.select("path", "content")).mapInPandas(run, "path string, height int, width int, bands int, pixels array<float>")


def as_rgb(df: DataFrame) -> DataFrame:
    """Rasters of one band with the band three times, others with their first three bands; two bands become null."""
    n = F.col("height") * F.col("width")
    px = F.col("pixels")
    at = lambda i, b: F.get(px, (i * F.col("bands") + b).cast("int"))
    rgb = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.col("bands") == 1, F.array(at(i, 0), at(i, 0), at(i, 0))).otherwise(F.array(at(i, 0), at(i, 1), at(i, 2)))))
    return df.withColumn("pixels", F.when((F.col("bands") == 1) | (F.col("bands") >= 3), rgb)).withColumn("bands", F.lit(3))
