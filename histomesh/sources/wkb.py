"""Rings from well-known binary polygons."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
#: ring: the outer one of the largest part; rest: all others, holes as well as further parts' outer rings.
RINGS = f"ring {RING}, rest array<{RING}>"
Ring = list[tuple[float, float]]


def twice_area(ring: Ring) -> float:
    """Twice the signed area, positive counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def _polygons(data: bytes, at: int = 0) -> tuple[list[list[Ring]], int]:
    """(polygons as lists of rings, place behind them) of the geometry at that place; no polygon for other kinds. Z and M values are passed over."""
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
    at += 5
    if kind & 0x20000000:
        at += 4
    dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[kind % 0x10000000 // 1000 % 4]
    kind = kind % 0x10000000 % 1000
    if kind not in (3, 6):
        return [], at
    n = struct.unpack_from(f"{order}I", data, at)[0]
    at += 4
    out: list = []
    for _ in range(n):
        if kind == 6:
            part, at = _polygons(data, at)
            out += part
            continue
        m = struct.unpack_from(f"{order}I", data, at)[0]
        values = struct.unpack_from(f"{order}{m * dims}d", data, at + 4)
        out.append(list(zip(values[::dims], values[1::dims], strict=True)))
        at += 4 + 8 * m * dims
    return (out if kind == 6 else [out] if out else []), at


def rings(data: bytes | None) -> list[Ring] | None:
    """All rings of a polygon or multipolygon, outer ones counter-clockwise and holes clockwise, the outer ring of the largest part first; None for
    null, empty or other shapes."""
    parts = [p for p in _polygons(data)[0] if p and p[0]] if data else []
    if not parts:
        return None
    turned = [[r if (twice_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(p) if r] for p in parts]
    turned.sort(key=lambda p: -sum(map(twice_area, p)))
    return [r for p in turned for r in p]


def outer_ring(data: bytes | None) -> Ring | None:
    """The outer ring of the polygon or of the largest part, as in rings()."""
    found = rings(data)
    return found[0] if found else None


def to_wkb(*rings: Ring) -> bytes:
    """A polygon: its outer ring, then its holes."""
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[v for p in r for v in p]) for r in rings)


def to_multi_wkb(*polygons: list[Ring]) -> bytes:
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(to_wkb(*p) for p in polygons)


def decode(col: str):
    """A struct of ring and rest."""

    @F.pandas_udf(RINGS)
    def parsed(data: pd.Series) -> pd.DataFrame:
        point = lambda r: [{"x": a, "y": b} for a, b in r]
        found = [rings(x) for x in data]
        return pd.DataFrame({"ring": [point(r[0]) if r else None for r in found], "rest": [[point(x) for x in r[1:]] if r else None for r in found]}, dtype=object)

    return parsed(F.col(col))
