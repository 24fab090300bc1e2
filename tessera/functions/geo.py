"""Geographic scalars as column expressions (degrees in, codegen throughout)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_NM = 1.852
#: The radius in metres of the sphere with the earth's area.
AUTHALIC_M = 6371007.180918475
MERCATOR_LIMIT = 85.05


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * radius)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def mercator_y(lat: Column) -> Column:
    held = F.greatest(F.least(lat, F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT))
    return F.log(F.tan(math.pi / 4 + F.radians(held) / 2))


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional tile numbers at a zoom."""
    n = float(1 << zoom)
    return (lon + 180) / 360 * n, (1 - mercator_y(lat) / math.pi) / 2 * n


def tile_box(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a tile in mercator metres."""
    half = math.pi * 6378137.0
    size = 2 * half / (1 << zoom)
    return x * size - half, half - (y + 1) * size, (x + 1) * size - half, half - y * size


def zoom_for(west: Column, east: Column, pixels: int = 700, most: int = 14) -> Column:
    """The zoom at which a box is nearest to `pixels` wide."""
    z = F.rint(F.log2(pixels * 360 / (256 * F.greatest(east - west, F.lit(1e-6)))))
    return F.greatest(F.lit(6), F.least(F.lit(most), z)).cast("int")


def wind_u(speed: Column, direction: Column) -> Column:
    return -speed * F.sin(F.radians(direction))


def wind_v(speed: Column, direction: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


def knots(mps: Column) -> Column:
    return mps * 1.943844


def feet(m: Column) -> Column:
    return m * 3.28084


def elevation_decoded(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def elevation_encoded(metres: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of an elevation: 256ths of a metre above -32768."""
    v = F.greatest(F.lit(0.0), F.least(metres + 32768.0, F.lit(65535.9)))
    r = F.floor(v / 256)
    return r.cast("int"), F.floor(v - r * 256).cast("int"), F.floor((v - F.floor(v)) * 256).cast("int")


def unpacked(v: Column, scale: float, offset: float, fill: float) -> Column:
    return F.when(v == fill, None).otherwise(v * scale + offset)


def tenths(v: Column) -> Column:
    """Rounded tenths, clamped to 16 bits."""
    return F.greatest(F.least(F.round(v * 10), F.lit(32767)), F.lit(-32768)).cast("smallint")


def ring_area_m2(ring: Column) -> Column:
    """Shoelace area of a lon/lat ring (array of struct x, y) in a projection local to its first point."""
    lat0 = F.radians(ring[0]["y"])
    n = F.size(ring)
    kx, ky = math.pi / 180 * EARTH_KM * 1000 * F.cos(lat0), math.pi / 180 * EARTH_KM * 1000
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1)), lambda p, q: ((p["x"] - ring[0]["x"]) * (q["y"] - ring[0]["y"]) - (q["x"] - ring[0]["x"]) * (p["y"] - ring[0]["y"])) * kx * ky)
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)) / 2


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting; a point on an edge may fall either way."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1)), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"]) + p["x"]))
    return F.aggregate(edges, F.lit(False), lambda a, e: a != e)


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north))


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_within(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def corner_within(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0].between(b[0], b[2]) & a[1].between(b[1], b[3])


def equidistant(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y in metres of a point in the azimuthal equidistant projection around (lat0, lon0)."""
    a, b, d = F.radians(lat0), F.radians(lat), F.radians(lon - lon0)
    far = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))))
    turn = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    metres = F.when(far < 1e-12, 0.0).otherwise(far * AUTHALIC_M)
    return metres * F.sin(turn), metres * F.cos(turn)


def ring_orientation(ring: Column, n: int) -> Column:
    """The circular mean, modulo 360 / n degrees, of the directions from a ring's middle to its corners (x, y)."""
    size = F.size(ring)
    total = lambda f: F.aggregate(ring, F.lit(0.0), lambda a, p: a + f(p))
    cx, cy = total(lambda p: p["x"]) / size, total(lambda p: p["y"]) / size
    angle = lambda p: F.atan2(p["y"] - cy, p["x"] - cx) * n
    return F.degrees(F.atan2(total(lambda p: F.sin(angle(p))), total(lambda p: F.cos(angle(p))))) / n
