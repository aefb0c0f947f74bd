"""TIFF images as a table of decoded tiles, and regions of them.

A file is read once by Spark's binaryFile source (2 GB a file at most) and becomes one row a strip or tile; written as Parquet, a
region then reads the tiles that it meets and no others. Baseline and Big TIFF; pyramids as sub-images or as further images of a
smaller size; no compression, deflate, LZW and PackBits; predictors 1 and 2; one sample a pixel, or several in planes or interleaved.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.operators.cells import scale_coordinates
from histomesh.operators.shapes import scale_polygons
from histomesh.sources.vendors import exists as vendors_exists

#: Pixels (over all pages) that read_region brings to the driver at most.
REGION_PIXELS = 1 << 28
TILES = "file string, level int, page int, x int, y int, width int, height int, level_width int, level_height int, dtype string, pixel_size double, axes string, data binary"

#: Fixed values of the TIFF format: bytes and struct codes of the field types that are read.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 13: (4, "I"), 16: (8, "Q"), 18: (8, "Q")}
_KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Page:
    tags: dict

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def size(self) -> tuple[int, int]:
        return self.one(256), self.one(257)

    @property
    def samples(self) -> int:
        return self.one(277, 1)


class Tiff:
    def __init__(self, data: bytes):
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        magic = struct.unpack(order + "H", data[2:4])[0] if order else 0
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        self.data, self.order, self.big = data, order, magic == 43
        first = struct.unpack_from(order + ("Q" if self.big else "I"), data, 8 if self.big else 4)[0]
        self.pages = self._chain(first)
        top = self.pages[0]
        same = [p for p in self.pages if p.size == top.size]
        subs = [[Page(self._directory(at)[0]) for at in p.tags.get(330, ())] for p in same]
        self.levels = [same, *[[s[k] for s in subs] for k in range(min(map(len, subs)))]]
        if len(self.levels) == 1:  # smaller images that follow, as many a level as the first has or one
            rest = [p for p in self.pages if p.size != top.size and p.size[0] < top.size[0]]
            for size in dict.fromkeys(p.size for p in rest):
                if len(group := [p for p in rest if p.size == size]) == len(same):
                    self.levels.append(group)

    def _chain(self, at: int) -> list[Page]:
        out, seen = [], set()
        while at and at not in seen:
            seen.add(at)
            tags, at = self._directory(at)
            out.append(Page(tags))
        return out

    def _directory(self, at: int) -> tuple[dict, int]:
        count, entry, word = ("Q", 20, "Q") if self.big else ("H", 12, "I")
        n = struct.unpack_from(self.order + count, self.data, at)[0]
        at += struct.calcsize(count)
        wide = struct.calcsize(word)
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(self.order + "HH", self.data, at + k * entry)
            if kind not in _TYPES:
                continue
            many = struct.unpack_from(self.order + word, self.data, at + k * entry + 4)[0]
            size, code = _TYPES[kind]
            place = at + k * entry + 4 + wide
            if size * many > wide:
                place = struct.unpack_from(self.order + word, self.data, place)[0]
            tags[tag] = struct.unpack_from(f"{self.order}{many}s" if code == "s" else self.order + code * many, self.data, place)
        return tags, struct.unpack_from(self.order + word, self.data, at + n * entry)[0]

    @property
    def dtype(self) -> np.dtype:
        p = self.pages[0]
        bits = p.one(258, 1)
        if bits % 8:
            raise ValueError(f"{bits} bits a sample are not supported")
        return np.dtype(f"{self.order}{_KINDS[p.one(339, 1)]}{bits // 8}")

    @property
    def axes(self) -> str:
        """Axes of the page dimension before YX, as the OME description names them (slowest first); else C."""
        text = self.pages[0].one(270, b"").decode("utf-8", "replace")
        found = re.search(r'DimensionOrder="XY([ZCT]{3})"', text)
        if not found:
            return "C"
        sizes = {a: int(n) for a, n in re.findall(r'Size([ZCT])="(\d+)"', text)}
        return "".join(a for a in reversed(found.group(1)) if sizes.get(a, 1) > 1) or "C"

    @property
    def pixel_size(self) -> float:
        """Pixel width by the resolution tag; 1 where it is absent or zero."""
        num, den = (self.pages[0].tags.get(282) or (0, 1))[:2]
        return den / num if num > 0 else 1.0

    def segments(self, page: Page) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(plane, x, y, stored width, stored height, offset, bytes) of each strip or tile."""
        w, h = page.size
        if 324 in page.tags:
            tw, th, offsets, counts = page.one(322), page.one(323), page.tags[324], page.tags[325]
        else:
            tw, th, offsets, counts = w, min(page.one(278, h), h), page.tags[273], page.tags[279]
        across, down = -(-w // tw), -(-h // th)
        for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
            plane, at = divmod(k, across * down)
            y, x = at // across * th, at % across * tw
            yield plane, x, y, tw, th if 324 in page.tags else min(th, h - y), offset, count

    def decode(self, page: Page, tw: int, th: int, offset: int, count: int) -> np.ndarray:
        """Stored pixels, height x width x interleaved samples."""
        raw, how = bytes(self.data[offset : offset + count]), page.one(259, 1)
        depth = page.samples if page.one(284, 1) == 1 else 1
        kind = self.dtype
        if how in (8, 32946):
            raw = zlib.decompress(raw)
        elif how == 5:
            raw = _lzw(raw)
        elif how == 32773:
            raw = _packbits(raw)
        elif how != 1:
            raise ValueError(f"compression {how} is not supported")
        out = np.frombuffer(raw, kind, tw * th * depth).reshape(th, tw, depth)
        if (predictor := page.one(317, 1)) == 2:
            out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        return out

    def tiles(self) -> Iterator[tuple]:
        """(level, page, x, y, level width, level height, pixels) of every plane's tiles, clipped to the image."""
        for level, pages in enumerate(self.levels):
            for number, page in enumerate(pages):
                w, h = page.size
                for plane, x, y, tw, th, offset, count in self.segments(page):
                    if not count:
                        continue
                    block = self.decode(page, tw, th, offset, count)[: h - y, : w - x]
                    for s in range(block.shape[2]):
                        yield level, number * page.samples + plane + s, x, y, w, h, block[:, :, s]


def _packbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + n + 2]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(raw: bytes) -> bytes:
    """Codes from the highest bit on, of 9 to 12 bits; 256 clears the table, 257 ends."""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, bits, last, out = list(start), 9, 0, 0, b"", bytearray()
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        width = 9 + sum(len(table) >= (1 << k) - 1 for k in (9, 10, 11))
    return bytes(out)


def image_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Every tile of the TIFF files at path (a file, folder or glob): file, level, page, place and size, level size, dtype, pixel_size (at
    level 0), axes, data (row-major, little-endian)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TILES.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                tif, rows, size = Tiff(content), [], 0
                for level, page, x, y, w, h, block in tif.tiles():
                    kind = block.dtype.newbyteorder("<")
                    rows.append((name, level, page, x, y, block.shape[1], block.shape[0], w, h, kind.str, tif.pixel_size, tif.axes, block.astype(kind).tobytes()))
                    size += block.nbytes
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TILES)


def levels(tiles: DataFrame) -> DataFrame:
    """file, level, level_width, level_height, n_pages, dtype, pixel_size (at that level)."""
    out = tiles.groupBy("file", "level").agg(*[F.first(c).alias(c) for c in ("level_width", "level_height", "dtype", "pixel_size")], (F.max("page") + 1).alias("n_pages"))
    return out.withColumn("pixel_size", F.col("pixel_size") * F.pow(F.lit(2.0), "level"))


def region_tiles(tiles: DataFrame, x: int, y: int, width: int, height: int, level: int = 0, channel: int | None = None) -> DataFrame:
    """The tiles that meet a box of pixels at a level; a plain filter, which reaches a Parquet scan."""
    meets = (F.col("level") == level) & (F.col("x") < x + width) & (F.col("x") + F.col("width") > x) & (F.col("y") < y + height) & (F.col("y") + F.col("height") > y)
    return tiles.where(meets if channel is None else meets & (F.col("page") == channel))


def read_region(tiles: DataFrame, x: int, y: int, width: int, height: int, level: int = 0, channel: int | None = None) -> np.ndarray:
    """Pixels of a box of one file's tiles: height x width, with all pages before that unless channel is given. A box outside the image, an
    unknown level or channel, and more than REGION_PIXELS pixels are refused; a tile that is absent from the file reads as zero."""
    if width <= 0 or height <= 0 or x < 0 or y < 0:
        raise ValueError("x and y must be at least 0, width and height positive")
    size = levels(tiles.where(F.col("level") == level)).collect()
    if len(size) != 1:
        raise ValueError(f"no such level: {level}" if not size else "tiles of more than one file")
    size = size[0]
    if x + width > size.level_width or y + height > size.level_height:
        raise ValueError("the box leaves the image")
    if channel is not None and not 0 <= channel < size.n_pages:
        raise ValueError(f"no such channel: {channel}")
    n = size.n_pages if channel is None else 1
    if n * width * height > REGION_PIXELS:
        raise ValueError(f"more than {REGION_PIXELS} pixels; use region_tiles")
    out = np.zeros((n, height, width), np.dtype(size.dtype))
    for t in region_tiles(tiles, x, y, width, height, level, channel).toLocalIterator():
        block = np.frombuffer(t.data, t.dtype).reshape(t.height, t.width)
        y0, y1, x0, x1 = max(y, t.y), min(y + height, t.y + t.height), max(x, t.x), min(x + width, t.x + t.width)
        out[0 if channel is not None else t.page, y0 - y : y1 - y, x0 - x : x1 - x] = block[y0 - t.y : y1 - t.y, x0 - t.x : x1 - t.x]
    return out[0] if channel is not None or n == 1 else out


class Image:
    """One image of a collection: its tiles, as a table, and regions of them. The tiles are decoded once and kept beside the file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def tiles(self) -> DataFrame:
        kept = f"{self.path}.tiles"
        if not vendors_exists(self.spark, f"{kept}/_SUCCESS"):
            image_tiles(self.spark, self.path).write.mode("overwrite").parquet(kept)
        return self.spark.read.parquet(kept)

    def levels(self) -> DataFrame:
        return levels(self.tiles)

    def region(self, x: int, y: int, width: int, height: int, level: int = 0, channel: int | None = None) -> np.ndarray:
        return read_region(self.tiles, x, y, width, height, level, channel)


class ImageCollection:
    """The named images of a dataset. meta: default, pixel_size, version, images (name: file). Without images there, a morphology.ome.tif at the root is
    the only one. A file is looked for in the images folder, then by its own path under the root."""

    def __init__(self, spark: SparkSession, root: str, meta: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        meta = meta or {}
        self.files: dict[str, str] = dict(meta.get("images") or {})
        self.pixel_size, self.default_image, self.version = float(meta.get("pixel_size", 1.0)), meta.get("default"), meta.get("version", "")
        if not self.files and vendors_exists(spark, f"{self.root}/morphology.ome.tif"):
            self.files, self.default_image, self.pixel_size = {"morphology": "morphology.ome.tif"}, "morphology", 1.0

    def pixel_size_at(self, level: int = 0) -> float:
        """Pixel width at a pyramid level."""
        if level < 0:
            raise ValueError("level must be at least 0")
        return self.pixel_size * 2**level

    def keys(self) -> list[str]:
        return sorted(self.files)

    def has(self, name: str) -> bool:
        return name in self.files

    def __getitem__(self, name: str) -> Image:
        if name not in self.files:
            raise KeyError(f"no image {name}; there are {self.keys()}")
        file = self.files[name]
        inside = f"{self.root}/images/{file.rsplit('/', 1)[-1]}"
        return Image(self.spark, inside if vendors_exists(self.spark, inside) else f"{self.root}/{file}")

    def scale_coordinates(self, cells: DataFrame, level: int = 0) -> DataFrame:
        """cells with x, y in pixels of a level."""
        return scale_coordinates(cells, self.pixel_size, level)

    def scale_polygons(self, shapes: DataFrame, level: int = 0) -> DataFrame:
        """Outlines in pixels of a level."""
        return scale_polygons(shapes, self.pixel_size, level)
