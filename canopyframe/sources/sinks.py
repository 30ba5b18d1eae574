"""Sinks: datasets, statistics, results, CSV reports; resume, versioned cache and retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..semantics import finite, md5_order


def write_dataset(df: DataFrame, path: str, mode: str, seed=42, key=("tile", "year", "idx")) -> None:
    """Training layout: shuffled by hash order; test layout: in tile order. Rows keep that order inside files.
    df runs twice, as its ranges are sampled first: what is dear to make is written before."""
    order = [md5_order(seed, *key)] if mode != "test" else [F.col(k) for k in key]
    laid = df.withColumn("_o", order[0]).repartitionByRange("_o").sortWithinPartitions("_o").drop("_o") if mode != "test" else df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.withColumn("split", F.lit(mode)).write.mode("append").partitionBy("split").parquet(path)


def stats_name(years, regions, lite: bool) -> str:
    return "_".join(["statistics", "-".join(map(str, sorted(years))), "-".join(sorted(regions)) if regions else "all", "lite" if lite else "full"])


def write_stats(df: DataFrame, root: str, years, regions, lite: bool) -> str:
    path = f"{root}/{stats_name(years, regions, lite)}"
    df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").parquet(path)
    return path


def write_results(ensemble: DataFrame, per_model: DataFrame, path: str) -> None:
    ensemble.write.mode("overwrite").parquet(f"{path}/samples")
    per_model.write.mode("overwrite").parquet(f"{path}/models")


def four_decimals(v: Column) -> Column:
    """Text of a finite double with four decimals, rounded from its exact binary value, ties to even.

    v * 10000 is split into the rounded product and its exact error (v's upper 26 bits times 10000 is exact), so a
    product that rounds to a half is told apart from one that is a half. From 9e11 on doubles have no finer digits.
    """
    v = v.cast("double")
    a = F.abs(v)
    product = a * 1e4
    upper = a * 134217729.0 - (a * 134217729.0 - a)
    error = (upper * 1e4 - product) + (a - upper) * 1e4
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    units = whole + F.when(up, 1).otherwise(0)
    sign = F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise("")
    text = F.concat(sign, F.floor(units / 10000).cast("string"), F.lit("."), F.lpad((units % 10000).cast("string"), 4, "0"))
    return F.when(a < 9e11, text).otherwise(F.format_string("%.4f", v))


def csv_columns(df: DataFrame, int_cols=()) -> DataFrame:
    """Text of every column: four decimals, blank for missing and non-finite values, whole numbers where asked."""
    def one(c, t):
        if c in int_cols:
            return F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
        if t in ("double", "float"):
            return F.when(finite(c), four_decimals(F.col(c))).otherwise("")
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(*[one(c, t).alias(c) for c, t in df.dtypes])


def write_metrics_csv(df: DataFrame, path: str, int_cols=()) -> None:
    csv_columns(df, int_cols).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def pending(tasks: DataFrame, done: DataFrame, key) -> DataFrame:
    """Units without an output. Refuses an output table that lacks a key column."""
    if lacking := [k for k in key if k not in done.columns]:
        raise ValueError(f"output lacks {lacking}")
    return tasks.join(done.select(*key), list(key), "left_anti")


def cached(spark: SparkSession, path: str, version: int, required, build) -> DataFrame:
    """The table at path if its version and columns fit, else built and written anew."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
        if set(required) | {"_version"} <= set(df.columns) and df.where(F.col("_version") != version).isEmpty():
            return df.drop("_version")
    except AnalysisException:
        pass
    build().withColumn("_version", F.lit(version)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("_version")


def merge_retry(old: DataFrame, new: DataFrame, key) -> DataFrame:
    """Old output with reruns over it: the latest attempt of a key wins."""
    both = old.withColumn("_attempt", F.lit(0)).unionByName(new.withColumn("_attempt", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("_attempt").desc())
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_attempt")


def retry_errors(all_rows: DataFrame, errors: DataFrame, run, old: DataFrame, key) -> DataFrame:
    """Rerun only the rows listed as failed and lay the results over the old output."""
    return merge_retry(old, run(all_rows.join(errors.select(*key).distinct(), list(key), "left_semi")), key)
