"""Chunk statistics of a stream: partial moments per micro-batch, merged when read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import pool_stats


def write_partials(stream: DataFrame, by, value: str, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that appends each micro-batch's n, mean, deviation, min and max, one row a group. A batch that
    is run again replaces its own folder, so a retry does not count twice."""
    v = F.col(value).cast("double")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.where(v.isNotNull()).groupBy(*by).agg(
            F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
        ).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_merged(spark, path: str, by) -> DataFrame:
    """Exact moments over all batches so far."""
    return pool_stats(spark.read.parquet(path), by, exact=True)
