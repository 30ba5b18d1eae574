"""A store of points in files along a space-filling curve, and a scan that opens only the files that a box meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..semantics import col


def curve_place(lon, lat) -> Column:
    """Place along the Z-curve: the bits of both coordinates, 16 each, in turn. Coordinates outside the globe are clamped."""
    def spread(value, low, span):
        k = F.floor((value - low) / span * 65536).cast("long")
        k = F.greatest(F.lit(0).cast("long"), F.least(F.lit(65535).cast("long"), k))
        for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            k = k.bitwiseOR(F.shiftleft(k, step)).bitwiseAND(mask)
        return k

    return spread(col(lon), -180.0, 360.0).bitwiseOR(F.shiftleft(spread(col(lat), -90.0, 180.0), 1))


def write_point_store(df: DataFrame, path: str, files: int = 256, lon: str = "lon", lat: str = "lat") -> None:
    """Write points to about ``files`` files, each a range of the curve, and the bounds of every file beside them.

    Ranges are cut at sampled quantiles, so files are of like size wherever points gather. Points without both coordinates
    are in no box and are left out.
    """
    whole = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_z", curve_place(lon, lat))
    whole.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.parquet(path)
    there = df.sparkSession.read.parquet(path).groupBy(F.input_file_name().alias("file"))
    bounds = [f(c).alias(f"{n}_{f.__name__}") for n, c in (("lon", lon), ("lat", lat)) for f in (F.min, F.max)]
    there.agg(*bounds, F.count(F.lit(1)).alias("points")).coalesce(1).write.parquet(f"{path.rstrip('/')}-bounds")  # one row a file


def scan_point_store(spark: SparkSession, path: str, w: float, s: float, e: float, n: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points of a store in a box, borders included: only files whose bounds meet the box are listed, then the exact clip,
    which is pushed to their row groups. The driver holds the names of these files."""
    bounds = spark.read.parquet(f"{path.rstrip('/')}-bounds")
    meet = (F.col("lon_min") <= e) & (F.col("lon_max") >= w) & (F.col("lat_min") <= n) & (F.col("lat_max") >= s)
    names = [r["file"] for r in bounds.where(meet).select("file").collect()]
    inside = F.col(lon).between(w, e) & F.col(lat).between(s, n)
    if not names:
        return spark.read.parquet(path).where(inside).limit(0)
    return spark.read.parquet(*names).where(inside)
