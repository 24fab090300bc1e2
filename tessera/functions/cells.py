"""Hex-cell ids as bit arithmetic (64-bit ids; resolution in bits 52-55, three bits a digit, unused 7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hexgrid

DIGITS = 15
#: Base cells that are pentagons (fixed values of the public cell layout).
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def _mask(resolution: int) -> int:
    """The digits finer than a resolution, all set."""
    return (1 << 3 * (DIGITS - resolution)) - 1


def span(res: int) -> int:
    """How far apart ids of neighbours in order are at a resolution."""
    return 1 << 3 * (DIGITS - res)


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(15).cast("int")


def parent(cell: Column, res: int) -> Column:
    cleared = cell.bitwiseOR(F.lit(_mask(res))).bitwiseAND(F.lit(~(15 << 52)))
    return cleared.bitwiseOR(F.lit(res << 52))


def child_range(cell: Column, cell_res: int, res: int) -> tuple[Column, Column]:
    """The lowest and highest id of all descendants at `res`; ids of one resolution are contiguous."""
    span = _mask(cell_res) ^ _mask(res)
    base = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(res << 52))
    return base.bitwiseAND(F.lit(~span)), base


def base_cell(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(127).cast("int")


def is_pentagon(cell: Column) -> Column:
    """A pentagon's base cell and only zero digits down to its resolution."""
    res = F.shiftright(cell, 52).bitwiseAND(15).cast("int")
    unused = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(3 * DIGITS) - res * 3)
    return base_cell(cell).isin(*PENTAGONS) & (cell.bitwiseAND(F.lit(1 << 3 * DIGITS) - unused) == 0)


def children(cell: Column, cell_res: int) -> Column:
    """The children one resolution finer, as an array: seven, or six under a pentagon (no digit 1)."""
    shift = 3 * (DIGITS - cell_res - 1)
    head = cell.bitwiseAND(F.lit(~(15 << 52) & ~(7 << shift))).bitwiseOR(F.lit((cell_res + 1) << 52))
    digits = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: ~(is_pentagon(cell) & (d == 1)))
    return F.transform(digits, lambda d: head.bitwiseOR(F.shiftleft(d.cast("long"), shift)))


def to_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def from_text(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def resolution_for_area(km2: Column) -> Column:
    return F.when(km2 <= 120, 9).when(km2 <= 900, 8).otherwise(7)


def _halves(cell: Column) -> tuple[Column, Column]:
    """A cell as two columns that pandas keeps exact beside nulls."""
    return F.shiftright(cell, 32), cell.bitwiseAND(F.lit(0xFFFFFFFF))


def _joined(high: pd.Series, low: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The places of the cells that are not null, and the cells."""
    known = np.flatnonzero(high.notna().to_numpy())
    return known, (high.to_numpy()[known].astype(np.int64) << 32) | low.to_numpy()[known].astype(np.int64)


def _per_column(kind: str, fn):
    """A column function of `fn` (numpy array of cells to a list or array of results); null cells give null."""

    def run(high: pd.Series, low: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(high), dtype=object)
        known, ids = _joined(high, low)
        if len(known):
            out[known] = pd.Series(list(fn(ids)), index=known, dtype=object)
        return out

    return lambda cell: F.pandas_udf(run, kind)(*_halves(cell))


def at(lat: Column, lon: Column, res: int) -> Column:
    """The cell of a resolution (0 to 15) that holds a point in degrees; null without a finite point."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype=object)
        known = np.flatnonzero(np.isfinite(a.to_numpy(float)) & np.isfinite(b.to_numpy(float)))
        if len(known):
            out[known] = pd.Series(hexgrid.cell_of(a.to_numpy(float)[known], b.to_numpy(float)[known], res).tolist(), index=known, dtype=object)
        return out

    return F.pandas_udf(run, "long")(lat, lon)


def center(cell: Column) -> Column:
    """The centre of a cell as a struct (lat, lon) in degrees."""
    flat = _per_column("array<double>", lambda c: np.stack(hexgrid.center_of(c), 1))(cell)
    return F.when(cell.isNotNull(), F.struct(F.get(flat, F.lit(0)).alias("lat"), F.get(flat, F.lit(1)).alias("lon")))


def boundary(cell: Column) -> Column:
    """The closed ring of a cell's corners, counter-clockwise: array of struct (x = lon, y = lat) in degrees."""

    def run(high: pd.Series, low: pd.Series) -> pd.DataFrame:
        x, y = [None] * len(high), [None] * len(high)
        known, ids = _joined(high, low)
        for i, ring in zip(known, hexgrid.boundary_of(ids) if len(known) else []):
            y[i], x[i] = hexgrid.degrees_of(np.concatenate([ring, ring[:1]]))
        return pd.DataFrame({"x": x, "y": y})

    corners = F.pandas_udf(run, "struct<x: array<double>, y: array<double>>")(*_halves(cell))
    return F.arrays_zip(corners["x"], corners["y"])


def area_m2(cell: Column) -> Column:
    """The area of a cell on the sphere."""
    return _per_column("double", hexgrid.area_of)(cell)


def neighbours(cell: Column) -> Column:
    """The cells that share an edge with a cell, in rising order: six, or five around a pentagon."""
    return _per_column("array<long>", hexgrid.neighbours_of)(cell)
