from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.operators import layout as lo
from histomesh.operators import plots as pl
from histomesh.sources import images as im


def lzw(raw: bytes) -> bytes:
    table, width, out, held = {bytes([k]): k for k in range(256)}, 9, [(256, 9)], b""
    size = 258
    for k in raw:
        w = held + bytes([k])
        if w in table:
            held = w
            continue
        out.append((table[held], width))
        table[w] = size
        size += 1
        width = 9 + sum(size > (1 << b) - 1 for b in (9, 10, 11))
        held = bytes([k])
        if size == 4094:
            out.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
    out += [(table[held], width)] if held else []
    size += 1
    out.append((257, 9 + sum(size > (1 << b) - 1 for b in (9, 10, 11))))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def tiff(levels, order="<", compression=1, tile=None, predictor=1, rows=16, size=(4, 1)) -> bytes:
    """A file of the pyramid levels (each pages x height x width): sub-images for the smaller ones."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    pack = {1: bytes, 8: zlib.compress, 5: lzw, 32773: lambda b: b"".join(bytes([len(b[k : k + 128]) - 1]) + b[k : k + 128] for k in range(0, len(b), 128))}[compression]

    def page(a, subs):
        h, w = a.shape
        blocks = []
        if tile:
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    b = np.zeros((tile, tile), a.dtype)
                    part = a[y : y + tile, x : x + tile]
                    b[: part.shape[0], : part.shape[1]] = part
                    blocks.append(b)
        else:
            blocks = [a[y : y + rows] for y in range(0, h, rows)]
        at, n = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=b.dtype.type(0))
            raw = pack(b.astype(b.dtype.newbyteorder(order)).tobytes())
            at.append(len(out)), n.append(len(raw))
            out.extend(raw)
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8]), (259, 3, [compression]), (277, 3, [1]), (282, 5, list(size)), (317, 3, [predictor])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, at), (325, 4, n)] if tile else [(273, 4, at), (278, 4, [rows]), (279, 4, n)]
        tags += [(330, 4, subs)] if subs else []
        entries = b""
        for tag, kind, values in sorted(tags):
            body = struct.pack(order + {3: "H", 4: "I", 5: "I"}[kind] * len(values), *values)
            if len(body) > 4:
                place = len(out)
                out.extend(body)
                body = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values) // (2 if kind == 5 else 1)) + body.ljust(4, b"\0")
        where = len(out)
        out.extend(struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0")
        return where

    link = 4
    for k in range(len(levels[0])):
        where = page(levels[0][k], [page(level[k], []) for level in levels[1:]])
        struct.pack_into(order + "I", out, link, where)
        link = len(out) - 4
    return bytes(out)


@pytest.mark.parametrize(("compression", "tile", "order", "predictor"), [(1, None, "<", 1), (8, 32, "<", 2), (5, None, ">", 1), (5, 32, "<", 2), (32773, None, ">", 1)])
def test_tiff(spark, tmp_path, compression, tile, order, predictor):
    rng = np.random.default_rng(3)
    full = (np.arange(3 * 70 * 90).reshape(3, 70, 90) // 7 + rng.integers(0, 3, (3, 70, 90))).astype(np.uint16)
    pyramid = [full, full[:, ::2, ::2], full[:, ::4, ::4]]
    (tmp_path / "a.tif").write_bytes(tiff(pyramid, order, compression, tile, predictor))
    im.image_tiles(spark, str(tmp_path / "a.tif")).write.parquet(str(tmp_path / "tiles"))
    tiles = spark.read.parquet(str(tmp_path / "tiles"))
    info = {r.level: r for r in im.levels(tiles).collect()}
    assert [(info[k].level_height, info[k].level_width, info[k].n_pages) for k in range(3)] == [(p.shape[1], p.shape[2], 3) for p in pyramid]
    assert info[2].pixel_size == 1.0 and info[0].dtype == "<u2"
    assert (im.read_region(tiles, 0, 0, 90, 70) == full).all()
    assert (im.read_region(tiles, 13, 9, 50, 41, channel=1) == full[1, 9:50, 13:63]).all()
    assert (im.read_region(tiles, 3, 2, 20, 10, level=1, channel=2) == pyramid[1][2, 2:12, 3:23]).all()
    for bad in ((80, 0, 20, 5), (0, 0, 0, 5), (-1, 0, 5, 5)):
        with pytest.raises(ValueError):
            im.read_region(tiles, *bad)
    with pytest.raises(ValueError):
        im.read_region(tiles, 0, 0, 5, 5, level=3)
    with pytest.raises(ValueError):
        im.read_region(tiles, 0, 0, 5, 5, channel=3)


def test_not_a_tiff():
    with pytest.raises(ValueError):
        im.Tiff(b"GIF89a..")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(0, 1, 8) + 30 * np.eye(8)[i % 3]).tolist(), i % 3) for i in range(240)]
    return spark.createDataFrame(rows, "cell_id long, v array<double>, label int").cache()


def apart(placed, blobs) -> float:
    """Share of rows whose nearest other row has their label."""
    rows = placed.join(blobs.select("cell_id", "label"), "cell_id").collect()
    y, lab = np.array([(r.x, r.y) for r in rows]), np.array([r.label for r in rows])
    assert len(rows) == 240 and np.isfinite(y).all()
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return float((lab[d.argmin(axis=1)] == lab).mean())


def test_umap(blobs):
    a, b = lo.curve(0.5)
    assert abs(a - 0.583) < 0.02 and abs(b - 1.334) < 0.02
    whole = lo.umap(blobs, n_epochs=100)
    assert apart(whole, blobs) == 1.0
    assert whole.orderBy("cell_id").collect() == lo.umap(blobs.repartition(3), n_epochs=100).orderBy("cell_id").collect()
    assert apart(lo.umap(blobs, n_epochs=100, n_fit=150), blobs) > 0.98
    w = lo.fuzzy_graph(blobs.select("cell_id", "v"), 10)
    assert w.where("cell_id_a >= cell_id_b or weight <= 0 or weight > 1.000001").isEmpty() and w.count() == w.select("cell_id_a", "cell_id_b").distinct().count()


def test_tsne(spark, blobs):
    assert apart(lo.tsne(blobs, 20, 250), blobs) == 1.0
    assert apart(lo.tsne(blobs, 20, 250, n_fit=150), blobs) > 0.98
    assert lo.tsne(blobs.limit(0)).count() == 0 and lo.umap(blobs.limit(2)).count() == 2
    with pytest.raises(ValueError):
        lo.tsne(blobs, n_fit=10**6)


def test_plots(spark):
    cells = spark.createDataFrame([(f"c{i}", float(i), float(i), i) for i in range(50)], "cell_id string, x double, y double, k int")
    assert pl.spatial_scatter(cells, cells, "k", xlim=(10, 20), max_cells=5).count() == 5
    assert pl.spatial_scatter(cells, cells, "k", ylim=(10, 20)).count() == 11
    expr = spark.createDataFrame([("c1", "g", 3.0)], "cell string, gene string, value double")
    assert pl.spatial_expression(cells, expr, "g").agg(F.sum("value")).first()[0] == 3.0
    for bad in ({"gene": "nope"}, {"gene": "g", "mode": "line"}):
        with pytest.raises(ValueError):
            pl.spatial_expression(cells, expr, **bad)
