"""Column functions: encodings, normalisation, dequantisation, storage types."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLASSES, EARTH_RADIUS, MISSION_START, NODATA, OFFSET_START
from ..semantics import col


def unit(c: Column) -> Column:
    """[-1, 1] to [0, 1]."""
    return (c + 1) / 2


def encode_latlon(lat, lon) -> list[Column]:
    """Cosine and sine of latitude (period 180) and longitude (period 360), scaled to [0, 1]."""
    lat, lon = F.lit(math.pi) * col(lat) / 90, F.lit(math.pi) * col(lon) / 180
    return [unit(F.cos(lat)).alias("lat_cos"), unit(F.sin(lat)).alias("lat_sin"), unit(F.cos(lon)).alias("lon_cos"), unit(F.sin(lon)).alias("lon_sin")]


def encode_grid(df: DataFrame, lat, lon, height: int, width: int, resolution: float = 10.0) -> DataFrame:
    """A row for each pixel (i, j) of a patch around a point, with its coordinates' encoding. Pixels lie ``resolution``
    metres apart; i and j count from the pixel that is half the patch before the point."""
    i, j = (F.explode(F.sequence(F.lit(-(n // 2)), F.lit(n - n // 2 - 1))) for n in (height, width))
    grid = df.withColumn("i", i).withColumn("j", j)
    per_metre = 180 / math.pi / EARTH_RADIUS
    to_lat = col(lat) + F.col("i") * resolution * per_metre
    to_lon = col(lon) + F.col("j") * resolution * per_metre / F.cos(col(lat) * math.pi / 180)
    return grid.select("*", *encode_latlon(to_lat, to_lon))


def encode_doy(days) -> list[Column]:
    """Cyclic day of the year from days since the mission start; day 366 lies past the full circle."""
    angle = 2 * math.pi * F.dayofyear(F.date_add(F.lit(MISSION_START).cast("date"), col(days).cast("int"))) / 365
    return [unit(F.cos(angle)).alias("doy_cos"), unit(F.sin(angle)).alias("doy_sin")]


def normalise(c, how: str, stats: dict[str, Column], nodata=None, clip: bool = True) -> Column:
    """mean_std, pct (clipped to [0, 1] unless told not to) or min_max; no-data becomes 0."""
    low, high = {"mean_std": ("mean", "std"), "pct": ("p1", "p99"), "min_max": ("min", "max")}[how]
    x = col(c)
    scale = stats[high] if how == "mean_std" else stats[high] - stats[low]
    y = F.try_divide(x - stats[low], scale)
    if nodata is not None:
        y = F.when(x == nodata, 0.0).otherwise(y)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)) if how == "pct" and clip else y


def normalise_bands(values, stats, how: str, nodata=None) -> Column:
    """Band array against an array of structs (mean, std, min, max, p1, p99) in the same order."""
    return F.zip_with(col(values), col(stats), lambda v, s: normalise(v, how, {k: s[k] for k in ("mean", "std", "min", "max", "p1", "p99")}, nodata))


def reflectance(dn, flag) -> Column:
    """Surface reflectance: (dn - 1000 * flag) / 10000, not below 0; zero stays the no-data mark."""
    dn = col(dn)
    return F.when(dn == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (dn - F.coalesce(col(flag), F.lit(0)) * 1000) / 10000.0))


def radar_db(dn) -> Column:
    """Backscatter in dB from digital numbers; zero is no data (NULL)."""
    dn = col(dn).cast("double")
    return F.when(dn != 0, 10 * F.log10(dn * dn) - 83.0)


def encode_class(cls, prob) -> list[Column]:
    """Land cover as cosine and sine (period 100) in [0, 1] and its probability; 255 is no data (0)."""
    gone, a = col(cls) == NODATA["cover"], 2 * math.pi * col(cls) / 100
    return [
        F.when(gone, 0.0).otherwise(unit(F.cos(a))).alias("lc_cos"), F.when(gone, 0.0).otherwise(unit(F.sin(a))).alias("lc_sin"),
        F.when(col(prob) == NODATA["cover"], 0.0).otherwise(col(prob) / 100.0).alias("lc_prob"),
    ]


def one_hot(c, kind: str = "class") -> Column:
    """Array with a 1 at the value's place; unknown values take place 0."""
    names = CLASSES if kind == "class" else list(range(8))
    at = F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, names)), col(c).cast("int")), F.lit(0)), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: (i == at).cast("int"))


def dequant_power(values) -> Column:
    """8-bit embedding to [0, 1]: signed square of v / 127.5; the mark becomes NULL."""
    def one(v):
        x = v / 127.5
        return F.when(v != NODATA["embedding"], unit(x * x * F.signum(v.cast("double"))))

    return F.transform(col(values), one)


def dequant_scale(values, scale) -> Column:
    """8-bit embedding times its scale; a missing scale gives 0."""
    s = col(scale)
    return F.transform(col(values), lambda v: F.when(s.isNull() | F.isnan(s), 0.0).otherwise(v * s))


def height_residual(height, rh98, mode: str = "pixel", before=None, after=None) -> Column:
    """Canopy height minus footprint height, negative footprint heights counted as 0.

    ``pixel``: of one height. Of a square patch (array, row by row): ``film``, the centre's residual; ``centre``, a patch that
    holds it everywhere; ``patch``, every height's. ``before``: functions that normalise heights and footprint heights
    first; ``after``: one that normalises the residuals instead.
    """
    h, low = col(height), F.greatest(col(rh98), F.lit(0.0))
    of_height, of_low = before or (lambda v: v, lambda v: v)
    then = after or (lambda v: v)
    residual = lambda v: then(of_height(v) - of_low(low))
    if mode == "pixel":
        return residual(h)
    if mode == "patch":
        return F.transform(h, residual)
    centre = residual(F.get(h, F.floor(F.size(h) / 2).cast("int")))
    if mode == "film":
        return centre
    if mode == "centre":
        return F.array_repeat(centre, F.size(h))
    raise ValueError(f"no such mode: {mode}")


def crop_center(values, size: int, k: int) -> Column:
    """k x k centre of a size x size nested array."""
    first = size // 2 - k // 2 + 1
    return F.transform(F.slice(col(values), first, k), lambda r: F.slice(r, first, k))


def reflect(i, n) -> Column:
    """Index mirrored at the borders of [0, n), clipped where it leaves the mirror image."""
    i, n = col(i), col(n)
    j = F.when(i < 0, -i - 1).when(i >= n, 2 * n - i - 1).otherwise(i)
    return F.greatest(F.lit(0), F.least(j, n - 1))


def window_weight(row, column, height: int, width: int, factor: float = 5.0) -> Column:
    """Gaussian weight of a window's pixel: deviations of a ``factor``-th of the window, centred."""
    x = math.floor(-height / 2) + col(column) * ((height // 2 - math.floor(-height / 2)) / max(width - 1, 1))
    y = math.floor(-width / 2) + col(row) * ((width // 2 - math.floor(-width / 2)) / max(height - 1, 1))
    sx, sy = (height // 2 - math.floor(-height / 2)) / factor, (width // 2 - math.floor(-width / 2)) / factor
    return F.exp(-(x * x / (2 * sx * sx) + y * y / (2 * sy * sy))) / (2 * math.pi * sx * sy)


def to_storage(c, kind: str = "uint16") -> Column:
    """Prediction to its stored type: negatives 0, above the range clamped (uint16), missing 65535 or -9999."""
    c = col(c).cast("double")
    fill, gone = (65535, -9999.0)[kind != "uint16"], c.isNull() | F.isnan(c)
    if kind == "uint16":
        return F.when(gone | (c > 65535), 65535).when(c < 0, 0).otherwise(F.floor(c)).cast("int")
    return F.when(gone | (F.abs(c) == float("inf")), fill).when(c < 0, 0.0).otherwise(c)


def bilinear(grid, y, x) -> Column:
    """Value of a nested array at a fractional place, clamped to its edge."""
    g, y, x = col(grid), col(y), col(x)
    h, w = F.size(g), F.size(g[0])
    y0 = F.greatest(F.lit(0), F.least(F.floor(y).cast("int"), h - 1))
    x0 = F.greatest(F.lit(0), F.least(F.floor(x).cast("int"), w - 1))
    y1, x1 = F.least(y0 + 1, h - 1), F.least(x0 + 1, w - 1)
    fy, fx = F.greatest(F.lit(0.0), F.least(F.lit(1.0), y - y0)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - x0))
    at = lambda r, c: F.get(F.get(g, r), c)
    return at(y0, x0) * (1 - fy) * (1 - fx) + at(y0, x1) * (1 - fy) * fx + at(y1, x0) * fy * (1 - fx) + at(y1, x1) * fy * fx


def boa_flag(date) -> Column:
    """1 for acquisitions from the date on which digital numbers gained an offset."""
    return (col(date).cast("date") >= F.lit(OFFSET_START).cast("date")).cast("int")


def days_since(date) -> Column:
    return F.datediff(col(date).cast("date"), F.lit(MISSION_START).cast("date"))


def config_name(flags: dict[str, Column], bands: Column, patch: Column) -> Column:
    """Name of a run: enabled sources in fixed order, the band set, the patch size."""
    parts = [F.when(flags[k], F.lit(f"{k}_")).otherwise("") for k in ("lc", "alos", "ch", "dem")]
    return F.concat(*parts, F.when(bands == 4, "RGBNIR").when(bands == 12, "ALLBANDS").otherwise(""), F.lit("_"), patch.cast("string"))
