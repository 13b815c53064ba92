"""Geometry given as (E)WKB: points' coordinates by Spark expressions, text forms by a vectorised function."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.values import Val, real, text

#: Geometry kinds by their WKB numbers.
NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def parse(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """A geometry as a GeoJSON-like object, and where it ends."""
    order = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5 + (4 if code & 0x20000000 else 0)
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    dims, kind = max(dims, {0: 2, 1: 3, 2: 3, 3: 4}[code // 1000]), code % 1000

    def point(at: int) -> tuple[list[float], int]:
        return list(struct.unpack_from(f"{order}{dims}d", raw, at)), at + 8 * dims

    def many(at: int, one) -> tuple[list, int]:
        (n,) = struct.unpack_from(order + "I", raw, at)
        at, out = at + 4, []
        for _ in range(n):
            x, at = one(at)
            out.append(x)
        return out, at

    if kind == 1:
        c, at = point(at)
        c = [] if all(v != v for v in c) else c
    elif kind == 2:
        c, at = many(at, point)
    elif kind == 3:
        c, at = many(at, lambda a: many(a, point))
    else:
        parts, at = many(at, lambda a: parse(raw, a))
        if kind == 7:
            return {"type": NAMES[kind], "geometries": parts}, at
        c = [p["coordinates"] for p in parts]
    return {"type": NAMES[kind], "coordinates": c}, at


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def wkt(g: dict) -> str:
    def inner(c) -> str:
        return " ".join(map(_number, c)) if c and not isinstance(c[0], list) else ", ".join(f"({inner(x)})" if isinstance(x[0], list) else inner(x) for x in c)

    name = g["type"].upper()
    if "geometries" in g:
        return f"{name}({', '.join(map(wkt, g['geometries']))})"
    return f"{name}({inner(g['coordinates'])})" if g["coordinates"] else f"{name} EMPTY"


def _numbers(x):
    return [_numbers(v) for v in x] if isinstance(x, list) else int(x) if x == int(x) else x


def geojson(g: dict) -> str:
    out = {"type": g["type"]} | ({"geometries": [json.loads(geojson(x)) for x in g["geometries"]]} if "geometries" in g else {"coordinates": _numbers(g["coordinates"])})
    return json.dumps(out, separators=(",", ":"))


def _text_udf(write):
    def of(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else write(parse(bytes(b))[0]))

    return F.pandas_udf(of, T.StringType())


def as_geojson(raw: Column) -> Val:
    return text(_text_udf(geojson)(raw))


def as_wkt(raw: Column) -> Val:
    return text(_text_udf(wkt)(raw))


def _points(raw: pd.Series) -> pd.DataFrame:
    found = [parse(bytes(b))[0] if b is not None else None for b in raw]
    xy = [g["coordinates"][:2] if g and g["type"] == "Point" and g["coordinates"] else (None, None) for g in found]
    return pd.DataFrame(xy, columns=["x", "y"], dtype="float64")


def _point(raw: Column) -> Column:
    return F.pandas_udf(_points, T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))(raw)


def x_of(raw: Column) -> Val:
    return real(_point(raw)["x"])


def y_of(raw: Column) -> Val:
    return real(_point(raw)["y"])
