"""Grid cells: the only module that computes them.

A cell of resolution r is a square of EDGE[r] degrees, always found from the
coordinates and never from a parent cell. Its id packs resolution, row and column.
Cells are a join key; the exact predicate stays with the join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge in degrees by resolution; the ring of a cell covers at least an edge around any of its points.
EDGE = {4: 0.4, 5: 0.16, 6: 0.06, 7: 0.024, 8: 0.008, 9: 0.003}
#: Coarser ones, for things whose extent varies from row to row, and all levels.
WIDE = {0: 60.0, 1: 12.0, 2: 4.0, 3: 1.2}
LEVELS = WIDE | EDGE
#: A degree of latitude in metres on the sphere of `geo`, and the latitude from which longitudes no longer tell distance.
DEGREE_M, POLAR = 111_194.9, 85.0
_SHIFT, _ROW = 58, 29


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack(res: int | Column, row: Column, col: Column) -> Column:
    top = F.lit(res) if isinstance(res, int) else res
    return F.shiftleft(top.cast("long"), _SHIFT).bitwiseOR(F.shiftleft(row.cast("long"), _ROW)).bitwiseOR(col.cast("long"))


def packed(res: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """`pack` of arrays."""
    return (res.astype(np.int64) << _SHIFT) | (row.astype(np.int64) << _ROW) | col.astype(np.int64)


def cells(lat: np.ndarray, lon: np.ndarray, res: int) -> np.ndarray:
    """`cell` of arrays of known positions."""
    return packed(np.full(len(lat), res), np.floor((lat + 90) / LEVELS[res]), np.floor((lon + 180) / LEVELS[res]))


def cell(lat, lon, res: int) -> Column:
    """Cell id, or null without a position."""
    return pack(res, F.floor((_c(lat) + 90) / LEVELS[res]), F.floor((_c(lon) + 180) / LEVELS[res]))


def cell_sql(lat: str, lon: str, res: int) -> str:
    """`cell` as SQL text."""
    e = LEVELS[res]
    return f"shiftleft({res}L, {_SHIFT}) | shiftleft(bigint(floor(({lat} + 90) / {e}D)), {_ROW}) | bigint(floor(({lon} + 180) / {e}D))"


def corner(row: Column, col: Column, direction: Column) -> Column:
    """Id of one of four directions from a corner of cells, in order of row and column."""
    return F.shiftleft(row.cast("long"), 33).bitwiseOR(F.shiftleft(col.cast("long"), 2)).bitwiseOR(direction.cast("long"))


def row_of(c) -> Column:
    return F.shiftright(_c(c), _ROW).bitwiseAND(F.lit((1 << _ROW) - 1))


def col_of(c) -> Column:
    return _c(c).bitwiseAND(F.lit((1 << _ROW) - 1))


def centre(c, res: int) -> tuple[Column, Column]:
    return (row_of(c) + 0.5) * LEVELS[res] - 90, (col_of(c) + 0.5) * LEVELS[res] - 180


def touching(cells_: np.ndarray, south: np.ndarray, west: np.ndarray, north: np.ndarray, east: np.ndarray, res: int) -> np.ndarray:
    """Which of an array of cells touch their boxes; east may exceed 180 and west be below -180."""
    e, wide = LEVELS[res], round(360 / LEVELS[res])
    row, col = cells_ >> _ROW & (1 << _ROW) - 1, cells_ & (1 << _ROW) - 1
    first, last = np.floor((west + 180) / e), np.floor((east + 180) / e)
    return (row >= np.floor((south + 90) / e)) & (row <= np.floor((north + 90) / e)) & ((col - first) % wide <= last - first)


def bit(k: Column) -> Column:
    """A long in which only that bit is set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def disk(c, k: int, res: int) -> Column:
    """Array of the cells up to k rows and columns away, the cell itself included; columns wrap at the date line."""
    wide = round(360 / LEVELS[res])
    around = [pack(res, row_of(c) + i, F.pmod(col_of(c) + j, F.lit(wide))) for i in range(-k, k + 1) for j in range(-k, k + 1)]
    return F.array(*around)


def disks(cells_: np.ndarray, k: int, res: int) -> np.ndarray:
    """`disk` of an array of cells, one row each."""
    wide = round(360 / LEVELS[res])
    row, col = cells_ >> _ROW & (1 << _ROW) - 1, cells_ & (1 << _ROW) - 1
    i, j = (x.ravel() for x in np.mgrid[-k : k + 1, -k : k + 1])
    return packed(np.full((len(cells_), len(i)), res), row[:, None] + i, (col[:, None] + j) % wide)


def _cover(south, west, north, east, res: int | Column, edge, wide) -> Column:
    lat = lambda x: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), _c(x)))
    step = lambda x, off: F.floor((x + off) / edge).cast("long")
    rows = F.sequence(step(lat(south), 90), step(lat(north), 90))
    first = step(_c(west), 180)
    cols = F.sequence(first, F.greatest(first, F.least(step(_c(east), 180), first + wide - 1)))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: pack(res, r, F.pmod(c, wide)))))


def cover_box(south, west, north, east, res: int) -> Column:
    """Array of the cells that touch a box; east may exceed 180 and west be below -180, columns wrap at the date line."""
    return _cover(south, west, north, east, res, F.lit(LEVELS[res]), F.lit(round(360 / LEVELS[res])).cast("long"))


def extent(lat, radius_m) -> tuple[Column, Column]:
    """Degrees of latitude and of longitude that a circle reaches from its centre; all longitudes if it holds a pole."""
    high = (_c(radius_m) if isinstance(radius_m, (str, Column)) else F.lit(float(radius_m))) / DEGREE_M * 1.000001
    top = F.abs(_c(lat)) + high
    across = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(high)) / F.cos(F.radians(F.least(F.abs(_c(lat)), F.lit(89.999999)))))))
    return high, F.when(top >= 90, F.lit(180.0)).otherwise(across * 1.000001)


def reach(lat, lon, radius_m, res: int) -> Column:
    """Array of the cells that a circle touches, at any latitude."""
    high, across = extent(lat, radius_m)
    return cover_box(_c(lat) - high, _c(lon) - across, _c(lat) + high, _c(lon) + across, res)


def _columns(row: Column, size: float) -> Column:
    """How many columns of at least `size` degrees of the great circle fit around a row of that height, at its narrow edge."""
    top = F.greatest(F.abs(row * size - 90), F.abs((row + 1) * size - 90))
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(360 / size) * F.cos(F.radians(F.least(top, F.lit(90.0))))))


def fitted(lat, lon, size: float) -> Column:
    """Cell id in rows of `size` degrees whose columns are about as wide as they are high, at any latitude; null without a position."""
    row = F.floor((_c(lat) + 90) / size)
    n = _columns(row, size)
    return pack(7, row, F.pmod(F.floor((_c(lon) + 180) / 360 * n), n))


def fitted_reach(lat, lon, radius_m: float, size: float) -> Column:
    """Array of the `fitted` cells that a circle touches."""
    high, across = extent(lat, radius_m)
    at = lambda x: F.floor((F.greatest(F.lit(-90.0), F.least(F.lit(90.0), x)) + 90) / size)

    def columns(row: Column) -> Column:
        n = _columns(row, size)
        first = F.floor((_c(lon) - across + 180) / 360 * n)
        return F.transform(F.sequence(first, F.least(F.floor((_c(lon) + across + 180) / 360 * n), first + n - 1)), lambda c: pack(7, row, F.pmod(c, n)))

    return F.flatten(F.transform(F.sequence(at(_c(lat) - high), at(_c(lat) + high)), columns))


def level_of(size) -> Column:
    """The finest level at which a box of so many degrees touches at most three by three cells."""
    out = F.lit(min(LEVELS))
    for res in sorted(LEVELS)[1:]:
        out = F.when(_c(size) <= 2 * LEVELS[res], res).otherwise(out)
    return out


def edge_of(level) -> Column:
    """A level's edge in degrees."""
    return F.create_map(*(F.lit(x) for r in LEVELS for x in (r, LEVELS[r])))[_c(level)]


def cover_any(south, west, north, east, level, edge) -> Column:
    """Array of the cells of a level (a column of `level_of`, with its `edge_of`) that touch a box."""
    return _cover(south, west, north, east, _c(level), _c(edge), F.round(360 / _c(edge)).cast("long"))


def levels(lat, lon) -> Column:
    """Array of a point's cells of all levels: a point in a box shares exactly one with `cover_any` of the box."""
    return F.array(*(cell(lat, lon, r) for r in sorted(LEVELS)))
