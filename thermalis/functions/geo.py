"""Projection and grids as column expressions; everything stays in generated code.

The plane is EPSG:7755 (WGS 84 / India NSF LCC), a Lambert conformal conic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid (WGS 84) and the projection's origin, parallels and false origin.
A, FLATTENING = 6378137.0, 1 / 298.257223563
LAT0, LON0, LAT1, LAT2, X0, Y0 = 24.0, 80.0, 12.472955, 35.1728044, 4_000_000.0, 4_000_000.0
#: Cell of the registry grid in metres, and the factor that packs a cell's column and row.
CELL_M, PACK = 375.0, 100_000
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - E2 * math.sin(lat) ** 2)


def _t(lat: float) -> float:
    s = E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (E / 2)


_LAT0, _LAT1, _LAT2 = (math.radians(x) for x in (LAT0, LAT1, LAT2))
N = (math.log(_m(_LAT1)) - math.log(_m(_LAT2))) / (math.log(_t(_LAT1)) - math.log(_t(_LAT2)))
SCALE = A * _m(_LAT1) / (N * _t(_LAT1) ** N)
RHO0 = SCALE * _t(_LAT0) ** N


def to_metres(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) of a latitude and longitude in degrees."""
    phi = F.radians(lat)
    s = F.sin(phi) * E
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2))
    rho, theta = F.pow(t, F.lit(N)) * SCALE, F.radians(lon - LON0) * N
    return rho * F.sin(theta) + X0, F.lit(RHO0 + Y0) - rho * F.cos(theta)


def from_metres(x: Column, y: Column) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees; the latitude's fixed-point iteration is unrolled."""
    dx, dy = x - X0, F.lit(RHO0 + Y0) - y
    t = F.pow(F.sqrt(dx * dx + dy * dy) / SCALE, F.lit(1 / N))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(6):
        s = F.sin(phi) * E
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(E / 2)))
    return F.degrees(phi), F.degrees(F.atan2(dx, dy) / N) + LON0


def offset(lat: Column, lon: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """(latitude, longitude) after a move of dx, dy metres in the plane."""
    x, y = to_metres(lat, lon)
    return from_metres(x + dx, y + dy)


def cell(x: Column, y: Column) -> Column:
    """Key of the registry cell that holds a point in metres."""
    return F.floor(x / CELL_M).cast("long") * PACK + F.floor(y / CELL_M).cast("long")


def cell_bounds(key: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) of a cell in metres."""
    i, j = F.floor(key / PACK), key % PACK
    return i * CELL_M, j * CELL_M, (i + 1) * CELL_M, (j + 1) * CELL_M


def grid_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Key of a cell of a regular grid of latitude and longitude, counted from the north-west."""
    return F.floor((90 - lat) / degrees).cast("long") * round(360 / degrees) + F.floor((lon + 180) / degrees).cast("long")


def grid_centre(key: Column, degrees: float) -> tuple[Column, Column]:
    """(latitude, longitude) of the middle of a grid cell."""
    columns = round(360 / degrees)
    return 90 - (F.floor(key / columns) + 0.5) * degrees, (key % columns + 0.5) * degrees - 180


def utc_day(at: Column) -> Column:
    """Days since 1970-01-01 of a timestamp, in UTC."""
    return F.unix_date(F.to_date(at)).cast("int")


def season(month: Column) -> Column:
    """The four seasons of the India Meteorological Department."""
    return F.when(month <= 2, "winter").when(month <= 5, "pre_monsoon").when(month <= 9, "monsoon").otherwise("post_monsoon")


def tile_name(lat: Column, lon: Column) -> Column:
    """South-west corner of the 3-degree land-cover tile, as N27E078."""
    south, west = (F.floor(c / 3) * 3 for c in (lat, lon))
    return F.format_string("%s%02d%s%03d", F.when(south >= 0, "N").otherwise("S"), F.abs(south), F.when(west >= 0, "E").otherwise("W"), F.abs(west))


def block(lat: Column, lon: Column, degrees: float = 2.0) -> Column:
    """Key of the block for grouped cross-validation."""
    return F.floor(lat / degrees).cast("long") * 1000 + F.floor(lon / degrees).cast("long")
