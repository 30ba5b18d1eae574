"""Rules that every operator shares: missing values, bins, ordering by hash, safe division."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c) -> Column:
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def mask_nodata_value(c, marks) -> Column:
    """NULL where the value is a no-data mark or NaN."""
    c = col(c)
    return F.when(~(c.isin(list(marks)) | F.isnan(c.cast("double"))), c)


def bin_of(c, width: float) -> Column:
    """Half-open bins [k * width, (k + 1) * width)."""
    return F.floor(col(c) / F.lit(float(width))).cast("long")


def md5_order(seed, *cols) -> Column:
    """Order that depends on the seed and the key alone, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string"), *[col(c).cast("string") for c in cols]))


def md5_uniform(seed, *cols) -> Column:
    """Uniform number in [0, 1) from the first eight hexadecimal digits of the hash."""
    return F.conv(F.substring(md5_order(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def first_by(df: DataFrame, keys, order) -> DataFrame:
    """One row of each key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def collected(df: DataFrame) -> DataFrame:
    """A table of bounded size as local rows: what it is made of runs once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def written(df: DataFrame) -> DataFrame:
    """df written once where all executors can read it, for several passes over what is dear to make.

    The folder is the session's ``spark.checkpoint.dir`` (the warehouse where it is unset); it is left to the caller.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Broadcast a dimension table if it holds at most ``rows`` rows; otherwise leave the join to the planner.

    The rows taken to find that out are the ones broadcast, so a small table's own plan runs once.
    """
    first = df.take(rows + 1)
    return F.broadcast(df.sparkSession.createDataFrame(first, df.schema)) if len(first) <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt out and merged, never broadcast.

    The planner takes a table's size from its compressed files, and rows that are exploded from it as no more than that:
    millions of rows would be gathered on the driver.
    """
    return df.hint("merge")
