from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators.permutation import same_label_test
from pairlens.sources.config import Study, load_study
from pairlens.sources.tiff import as_rgb, rasters, read_tiff


def lzw(data: bytes) -> bytes:
    table, out, n, width, word = {bytes([i]): i for i in range(256)}, 0, 0, 9, b""

    def put(code):
        nonlocal out, n
        out, n = (out << width) | code, n + width

    put(256)
    size = 258
    for b in data:
        w = word + bytes([b])
        if w in table:
            word = w
            continue
        put(table[word])
        table[w] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        put(table[word])
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    pad = -n % 8
    return (out << pad).to_bytes((n + pad) // 8, "big")


def tiff(a: np.ndarray, order="<", packing=1, tile=None, planar=1, predictor=1, nodata=None) -> bytes:
    h, w, c = a.shape
    a = a.astype(a.dtype.newbyteorder(order))
    bw, bh = tile or (w, 3)
    planes = [a] if planar == 1 else [a[..., i : i + 1] for i in range(c)]
    blocks = []
    for p in planes:
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                part = p[y : y + bh, x : x + bw]
                if tile:
                    full = np.zeros((bh, bw, p.shape[2]), a.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1).astype(a.dtype)
                raw = part.tobytes()
                if predictor == 3:
                    b = np.ascontiguousarray(part.astype(">f4")).view(np.uint8).reshape(part.shape[0], -1, 4).transpose(0, 2, 1).reshape(part.shape[0], -1, part.shape[2])
                    raw = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1).astype(np.uint8).tobytes()
                blocks.append({1: bytes, 8: zlib.compress, 5: lzw}[packing](raw))
    data, places = b"", []
    for b in blocks:
        places.append(8 + len(data))
        data += b + b"\0" * (len(b) % 2)
    fmt = {"f": 3, "u": 1, "i": 2}[a.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8] * c), (259, 3, [packing]), (277, 3, [c]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [fmt] * c)]
    tags += [(322, 4, [bw]), (323, 4, [bh]), (324, 4, places), (325, 4, [len(b) for b in blocks])] if tile else [(273, 4, places), (278, 4, [bh]), (279, 4, [len(b) for b in blocks])]
    if nodata is not None:
        tags.append((42113, 2, nodata.encode() + b"\0"))
    tags.sort()
    ifd = 8 + len(data)
    extra, body, at = b"", b"", ifd + 2 + 12 * len(tags) + 4
    for tag, kind, v in tags:
        raw = v if kind == 2 else struct.pack(f"{order}{len(v)}{'H' if kind == 3 else 'I'}", *v)
        if len(raw) <= 4:
            value = raw.ljust(4, b"\0")
        else:
            value = struct.pack(order + "I", at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        body += struct.pack(order + "HHI", tag, kind, len(v)) + value
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", ifd) + data + struct.pack(order + "H", len(tags)) + body + struct.pack(order + "I", 0) + extra


RNG = np.random.default_rng(1)
FLOATS = RNG.normal(size=(21, 37, 2)).astype(np.float32)
INTS = RNG.integers(0, 200, (21, 37, 3)).astype(np.uint16)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("planar", [1, 2])
def test_tiff_round_trip(order, packing, tile, planar):
    for a in (FLOATS, INTS):
        assert (read_tiff(tiff(a, order, packing, tile, planar)) == a).all()
    assert (read_tiff(tiff(INTS, order, packing, tile, planar, predictor=2)) == INTS).all()
    assert (read_tiff(tiff(FLOATS[..., :1], order, packing, tile, planar, predictor=3)) == FLOATS[..., :1]).all()


def test_long_lzw():
    a = RNG.integers(0, 9, (300, 200, 1)).astype(np.uint8)
    assert (read_tiff(tiff(a, packing=5, tile=(208, 304))) == a).all()


def test_raster_table(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4, 1)
    (tmp_path / "a.tif").write_bytes(tiff(a, nodata="5"))
    (tmp_path / "b.tif").write_bytes(b"II*\0nonsense")
    (tmp_path / "c.tif").write_bytes(tiff(FLOATS[:2, :2]))
    df = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-5:]: r for r in rasters(df).collect()}
    assert (got["a.tif"].height, got["a.tif"].width, got["a.tif"].bands) == (3, 4, 1)
    assert [i for i, v in enumerate(got["a.tif"].pixels) if v != v] == [5]
    assert got["b.tif"].pixels is None and got["c.tif"].bands == 2
    rgb = {r.path[-5:]: r.pixels for r in as_rgb(rasters(df)).collect()}
    assert rgb["a.tif"][:6] == [0.0, 0.0, 0.0, 1.0, 1.0, 1.0] and rgb["c.tif"] is None


def test_study(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"patch_pixels": 32, "classes": ["a"]}))
    assert load_study(str(p)) == Study(patch_pixels=32, classes=("a",))
    with pytest.raises(ValueError, match="unknown"):
        Study().merged({"x": 1})


def test_permutation_keeps_the_margins(spark):
    n = 200
    nn = spark.createDataFrame([(i, i + 1 if i % 2 == 0 else i - 1) for i in range(n)], "id long, nn long")
    together = spark.createDataFrame([(i, "ab"[i // 2 % 2]) for i in range(n)], "id long, label string")
    r = same_label_test(nn, together, 50).first()
    assert r.observed == 1.0 and r.p == 1 / 51 and abs(r.null_mean - 0.5) < 0.1
    apart = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(n)], "id long, label string")
    assert same_label_test(nn, apart, 50).first().p == 1.0
    assert same_label_test(nn, together.withColumn("label", F.lit("a")), 20).first().null_mean == 1.0
