"""Column functions on coordinates: projection, cells, blocks, affine grids."""

from __future__ import annotations

import math

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import col

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

# WGS 84 and the UTM grid.
_A, _INVERSE_F, _K0, _EASTING, _NORTHING = 6378137.0, 298.257223563, 0.9996, 500000.0, 10000000.0
# Half a plot cell in degrees, the margin around it, and metres a degree.
HALF_DEG, MARGIN_M, M_PER_DEG_LAT, M_PER_DEG_LON = 0.05, 1000.0, 110540.0, 111320.0

_F = 1 / _INVERSE_F
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_TO = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280,
]
_FROM = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280,
]


def utm_zone(lon) -> Column:
    return (F.floor((col(lon) + 180) / 6) + 1).cast("int")


def utm_epsg(lon, lat) -> Column:
    return F.when(col(lat) >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def utm_zone_path(lon, lat) -> Column:
    """Zone with its hemisphere letter, with the wider zones of Norway and Svalbard."""
    lon, lat = col(lon), col(lat)
    north = (lat >= 72) & (lat < 84)
    zone = (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
        .when(north & (lon >= 0) & (lon < 9), 31).when(north & (lon >= 9) & (lon < 21), 33)
        .when(north & (lon >= 21) & (lon < 33), 35).when(north & (lon >= 33) & (lon < 42), 37).otherwise(utm_zone(lon))
    )
    return F.concat(zone.cast("string"), F.when(lat >= 0, "N").otherwise("S"))


def tile_epsg(tile) -> Column:
    """EPSG code of a tile name such as 32TPT: zone digits, then a latitude band letter."""
    t = col(tile)
    band, zone = F.substring(t, 3, 1), F.substring(t, 1, 2).cast("int")
    return F.when(band.between("C", "M"), 32700 + zone).when(band.between("N", "X"), 32600 + zone).otherwise(F.raise_error(F.concat(F.lit("no hemisphere in tile "), t)).cast("int"))


def to_utm(lon, lat, epsg) -> list[Column]:
    """Easting and northing in the zone of ``epsg``: fourth-order transverse Mercator series."""
    lon, lat, epsg = col(lon), F.radians(col(lat)), col(epsg)
    away = F.radians(lon - (epsg % 100 * 6 - 183))
    t = F.sinh(F.atanh(F.sin(lat)) - _E * F.atanh(_E * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_TO, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return [(_EASTING + _K0 * _R * x).alias("x"), (_K0 * _R * y + F.when(epsg >= 32700, _NORTHING).otherwise(0.0)).alias("y")]


def from_utm(x, y, epsg) -> list[Column]:
    """Longitude and latitude of a place in the zone of ``epsg``."""
    epsg = col(epsg)
    xi = (col(y) - F.when(epsg >= 32700, _NORTHING).otherwise(0.0)) / (_K0 * _R)
    eta = (col(x) - _EASTING) / (_K0 * _R)
    p, q = xi, eta
    for j, b in enumerate(_FROM, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(p) / F.cosh(q))

    def geodetic(chi):  # from the conformal latitude by fixed-point rounds
        lat = chi
        for _ in range(4):
            lat = F.asin(F.tanh(F.atanh(F.sin(chi)) + _E * F.atanh(_E * F.sin(lat))))
        return F.degrees(lat)

    lat = F.transform(F.array(conformal), geodetic)[0]  # bound, as the rounds use it often
    return [(F.degrees(F.atan2(F.sinh(q), F.cos(p))) + (epsg % 100 * 6 - 183)).alias("lon"), lat.alias("lat")]


def to_utm_array(lon, lat, epsg) -> tuple[np.ndarray, np.ndarray]:
    """``to_utm`` of numpy arrays, for the pixels of grids within tasks."""
    away, sine = np.radians(lon - (epsg % 100 * 6 - 183)), np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(sine) - _E * np.arctanh(_E * sine))
    xi, eta = np.arctan2(t, np.cos(away)), np.arctanh(np.sin(away) / np.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_TO, 1):
        x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return _EASTING + _K0 * _R * x, _K0 * _R * y + np.where(epsg >= 32700, _NORTHING, 0.0)


def from_utm_array(x, y, epsg) -> tuple[np.ndarray, np.ndarray]:
    """``from_utm`` of numpy arrays."""
    xi, eta = (y - np.where(epsg >= 32700, _NORTHING, 0.0)) / (_K0 * _R), (x - _EASTING) / (_K0 * _R)
    p, q = xi, eta
    for j, b in enumerate(_FROM, 1):
        p = p - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        q = q - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    sine = np.sin(p) / np.cosh(q)
    lat, conformal = np.arcsin(sine), np.arctanh(np.sin(np.arcsin(sine)))
    for _ in range(4):
        lat = np.arcsin(np.tanh(conformal + _E * np.arctanh(_E * np.sin(lat))))
    return np.degrees(np.arctan2(np.sinh(q), np.cos(p))) + (epsg % 100 * 6 - 183), np.degrees(lat)


def projected(lon, lat, epsg) -> Column:
    """``to_utm`` of whole batches, a struct of x and y: each term is evaluated once, where the column's many uses of one
    another are not."""
    def of(lon: pd.Series, lat: pd.Series, epsg: pd.Series) -> pd.DataFrame:
        x, y = to_utm_array(*[k.to_numpy() for k in (lon, lat, epsg)])
        return pd.DataFrame({"x": x, "y": y})

    return F.pandas_udf(of, "x double, y double")(col(lon), col(lat), col(epsg))


def unprojected(x, y, epsg) -> Column:
    """``from_utm`` of whole batches, a struct of lon and lat."""
    def of(x: pd.Series, y: pd.Series, epsg: pd.Series) -> pd.DataFrame:
        lon, lat = from_utm_array(*[k.to_numpy() for k in (x, y, epsg)])
        return pd.DataFrame({"lon": lon, "lat": lat})

    return F.pandas_udf(of, "lon double, lat double")(col(x), col(y), col(epsg))


def box(x, y, half_x, half_y) -> list[Column]:
    x, y = col(x), col(y)
    return [(x - half_x).alias("xmin"), (y - half_y).alias("ymin"), (x + half_x).alias("xmax"), (y + half_y).alias("ymax")]


def cell(lon, lat, half: float = HALF_DEG) -> list[Column]:
    return box(lon, lat, F.lit(half), F.lit(half))


def cell_buffered(lon, lat, half: float = HALF_DEG, margin: float = MARGIN_M) -> list[Column]:
    """Cell with the same margin in true metres on every side."""
    return box(lon, lat, half + margin / (M_PER_DEG_LON * F.cos(F.radians(col(lat)))), F.lit(half + margin / M_PER_DEG_LAT))


def window_box(lon, lat, side_km) -> list[Column]:
    """Box of a side in kilometres on the ground around a point."""
    half = col(side_km) * 500
    return box(lon, lat, half / (M_PER_DEG_LON * F.cos(F.radians(col(lat)))), half / M_PER_DEG_LAT)


def cells_for_bbox(df: DataFrame, south, north, west, east, name: str = "cell") -> DataFrame:
    """A row for each 1-degree cell, named by its north-west corner, that a box meets. Boxes may pass the 180th meridian
    (west and east then differ by the true width); rows beyond the poles are left out."""
    top = F.explode(F.sequence(F.greatest(F.floor(col(south)) + 1, F.lit(-89)), F.least(F.floor(col(north)) + 1, F.lit(90))))
    left = F.explode(F.sequence(F.floor(col(west)), F.floor(col(east))))
    cells = df.withColumn("_t", top).withColumn("_l", left).withColumn("_l", F.pmod(F.col("_l") + 180, F.lit(360)) - 180)
    return cells.withColumn(name, cell_name("_t", "_l")).drop("_t", "_l")


def block_of(lat, lon) -> Column:
    """10-degree block named by its north-west corner."""
    top, left = (F.ceil(col(lat) / 10) * 10).cast("int"), (F.floor(col(lon) / 10) * 10).cast("int")
    return F.concat(
        F.when(top >= 0, "N").otherwise("S"), F.lpad(F.abs(top).cast("string"), 2, "0"), F.when(left >= 0, "E").otherwise("W"), F.lpad(F.abs(left).cast("string"), 3, "0")
    )


def round_cell(name) -> Column:
    """10-degree block of a 1-degree cell name; S00 to S09 belong to N00."""
    n = col(name)
    south, lat, west, lon = F.substring(n, 1, 1) == "S", F.substring(n, 2, 2).cast("int"), F.substring(n, 4, 1) == "W", F.substring(n, 5, 3).cast("int")
    up, down = lambda v: (F.ceil(v / 10) * 10).cast("int"), lambda v: (F.floor(v / 10) * 10).cast("int")
    first = F.when(south & (lat <= 9), "N00").otherwise(F.concat(F.when(south, "S").otherwise("N"), F.lpad(F.when(south, down(lat)).otherwise(up(lat)).cast("string"), 2, "0")))
    return F.concat(first, F.when(west, "W").otherwise("E"), F.lpad(F.when(west, up(lon)).otherwise(down(lon)).cast("string"), 3, "0"))


def block_bounds(name) -> list[Column]:
    n = col(name)
    top = F.substring(n, 2, 2).cast("int") * F.when(F.substring(n, 1, 1) == "N", 1).otherwise(-1)
    left = F.substring(n, 5, 3).cast("int") * F.when(F.substring(n, 4, 1) == "E", 1).otherwise(-1)
    return [left.alias("xmin"), (top - 10).alias("ymin"), (left + 10).alias("xmax"), top.alias("ymax")]


def cell_name(lat_top, lon_left) -> Column:
    """1-degree cell of a north-west corner."""
    t, l = col(lat_top), col(lon_left)
    return F.concat(F.when(t >= 0, "N").otherwise("S"), F.lpad(F.abs(t).cast("string"), 2, "0"), F.when(l >= 0, "E").otherwise("W"), F.lpad(F.abs(l).cast("string"), 3, "0"))


def rowcol(x, y, a, e, c, f, how: str = "floor") -> list[Column]:
    """Row and column of a place on a north-up grid; ``round`` is half-even."""
    step = F.floor if how == "floor" else F.rint
    return [step((col(y) - col(f)) / col(e)).cast("long").alias("row"), step((col(x) - col(c)) / col(a)).cast("long").alias("col")]


def xy(row, column, a, e, c, f, shift: float = 0.5) -> list[Column]:
    """Place of a pixel: its centre, or its corner with shift 0."""
    return [(col(c) + (col(column) + shift) * col(a)).alias("x"), (col(f) + (col(row) + shift) * col(e)).alias("y")]


def cylindrical(lon, lat) -> list[Column]:
    """Cylindrical equal-area metres, true along the equator."""
    r = 6371007.0
    return [(F.radians(col(lon)) * r).alias("mx"), (F.sin(F.radians(col(lat))) * r).alias("my")]
