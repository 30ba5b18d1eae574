"""Window functions, orderings and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import unit
from ..semantics import first_by
from .nearest import filled_and_missing


def renumber(df: DataFrame, by, order, name: str = "new_idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def cumulative_share(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Ranked values with their cumulative share; one row a band, so one partition."""
    w = Window.orderBy(F.col(value).desc(), tie)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("cum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("cum", F.col("cum") / F.sum(value).over(Window.partitionBy()))


def first_rank_at(curve: DataFrame, thresholds=(0.5, 0.8, 0.9)) -> DataFrame:
    return curve.agg(*[F.min(F.when(F.col("cum") >= t, F.col("rank"))).alias(f"at_{round(t * 100)}") for t in thresholds])


def terrain(pixels: DataFrame, key="raster_id", value: str = "value", step: float = 10.0, remask: bool = False) -> DataFrame:
    """Slope and encoded aspect by central differences, one-sided at the edges.

    Missing cells take the nearest valid height first, so their neighbours' gradients are defined; with ``remask``
    they have no slope and aspect of their own.
    """
    def gradient(by, along):
        w = Window.partitionBy(key, by).orderBy(along)
        ahead, back, here = F.lead(value).over(w), F.lag(value).over(w), F.col(value)
        return F.when(ahead.isNotNull() & back.isNotNull(), (ahead - back) / (2 * step)).when(ahead.isNotNull(), (ahead - here) / step).when(back.isNotNull(), (here - back) / step)

    filled, gone = filled_and_missing(pixels, (key,), value)
    out = filled.withColumn("px", gradient("col", "row")).withColumn("py", gradient("row", "col"))
    if remask:
        out = out.withColumn("px", F.when(~gone, F.col("px"))).withColumn("py", F.when(~gone, F.col("py")))
    out = out.withColumn(value, F.when(~gone, F.col(value))).drop("_gone")
    aspect = F.lit(math.pi / 2) - F.atan2("py", "px")
    aspect = F.when(aspect < 0, aspect + 2 * math.pi).otherwise(aspect)
    return out.withColumn("slope", F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py"))).withColumn("aspect_cos", unit(F.cos(aspect))).withColumn("aspect_sin", unit(F.sin(aspect)))


def region_numbers(names: DataFrame, name: str = "region") -> DataFrame:
    """Alphabetical number of each name, from 0, on the table of names."""
    return names.select(name).distinct().withColumn("number", F.dense_rank().over(Window.orderBy(name)) - 1)


def best_trial(scores: DataFrame, by) -> DataFrame:
    return first_by(scores, by, [F.col("label_distance"), F.col("class_distance"), F.col("trial")])


def merge_latest(df: DataFrame, key, seq: str) -> DataFrame:
    return first_by(df, key, [F.col(seq).desc()])


def worst_k(df: DataFrame, k: int, value: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(value).asc_nulls_last(), tie).limit(k)


def top_k(df: DataFrame, k: int, value: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(value).desc(), tie).limit(k)


def pareto(df: DataFrame, cost: str, gain: str, bins: int = 64) -> DataFrame:
    """Rows that no other row matches in cost and gain and beats in one. Rows are dealt to ranges of the cost between
    its quantiles, so that each holds about as many rows however far outliers lie; the best gain of the cheaper
    ranges comes from one row a range, the rest from a running maximum inside."""
    cuts = df.agg(F.percentile_approx(cost, [k / bins for k in range(1, bins)], 10 * bins).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    ranged = df.withColumn("_bin", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q <= F.col(cost))) if cuts else F.lit(0))
    best = ranged.groupBy("_bin").agg(F.max(gain).alias("_m"))
    best = best.select("_bin", F.max("_m").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    tops = ranged.groupBy("_bin", cost).agg(F.max(gain).alias("_top"))
    cheaper = Window.partitionBy("_bin").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_inside", F.max("_top").over(cheaper))
    out = ranged.join(tops, ["_bin", cost]).join(F.broadcast(best), "_bin")
    beaten = F.coalesce(F.greatest("_before", "_inside") >= F.col(gain), F.lit(False)) | (F.col("_top") > F.col(gain))
    return out.where(~beaten).drop("_bin", "_before", "_inside", "_top")


def kept_rows(sizes: DataFrame, skip: DataFrame, key) -> DataFrame:
    """Row numbers below each group's size that are not in the list."""
    rows = sizes.where("n > 0").select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    return rows.join(skip.select(*key, "idx"), [*key, "idx"], "left_anti")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedupe(df: DataFrame, key, order) -> DataFrame:
    return first_by(df, key, order)


def expand_regions(names: DataFrame, dim: DataFrame) -> DataFrame:
    """Regions for a list of names that may be regions or continents, each once, in the list's order."""
    known = names.join(F.broadcast(dim.select(F.col("continent").alias("name"), F.col("region").alias("_r"))), "name", "left")
    out = known.select(F.coalesce("_r", "name").alias("region"), "position")
    return out.groupBy("region").agg(F.min("position").alias("position"))
