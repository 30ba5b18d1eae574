"""Sampling and rebalancing by hash order, stable under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CLASSES, EARTH_RADIUS, OVERSAMPLING
from ..semantics import collected, md5_order, md5_uniform, small
from .aggregates import LABEL_BINS, freq_distance, label_bin, zero_filled


def mark_per_tile(df: DataFrame, fraction: float, seed, by=("tile",), key=("tile", "year", "idx"), name: str = "_hit") -> DataFrame:
    """Rows with a mark at exactly int(n * fraction) of each group, the first by hash."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy("_o", *key))
    out = df.withColumn("_o", md5_order(seed, *key)).withColumn("_k", rank).withColumn("_n", F.count(F.lit(1)).over(w))
    return out.withColumn(name, F.col("_k") <= F.floor(F.col("_n") * fraction)).drop("_o", "_k", "_n")


def sample_per_tile(df: DataFrame, fraction: float, seed, by=("tile",), key=("tile", "year", "idx")) -> DataFrame:
    """Exactly int(n * fraction) rows of each group, the first by hash."""
    return mark_per_tile(df, fraction, seed, by, key).where("_hit").drop("_hit")


def matched_subsample(df: DataFrame, fraction: float, trials: int, region: str = "region_cla", by=("tile",), key=("tile", "year", "idx")) -> DataFrame:
    """Distances of ``trials`` subsamples from their region's label and class distributions; see best_trial.

    All trials are drawn and counted in one pass, by label bin and class together; both distances need sums of these
    counts only, a table of trials, regions, bins and classes.
    """
    columns = dict.fromkeys([*by, *key, region, "agbd", "cls"])
    seeded = df.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    marked = mark_per_tile(seeded, fraction, F.col("trial"), ("trial", *by), key)
    keys = ["trial", region]
    counts = marked.groupBy(*keys, label_bin("agbd").alias("bin"), "cls").agg(F.count(F.lit(1)).alias("every"), F.count_if("_hit").alias("chosen"))
    counts = collected(counts)

    def distance(group, values, name):
        sums = counts.where(F.col(group).isin(values)).groupBy(*keys, group)
        every, chosen = (zero_filled(sums.agg(F.sum(c).alias("n")), keys, group, values) for c in ("every", "chosen"))
        return freq_distance(every, chosen, keys, group).withColumnRenamed("distance", name)

    return distance("bin", LABEL_BINS, "label_distance").join(distance("cls", CLASSES, "class_distance"), keys)


def laid_out(rows: DataFrame, key=("tile", "year", "idx"), seed=42, shuffled: bool = True) -> DataFrame:
    """Rows with the value that orders their layout: by hash, or in place."""
    return rows.withColumn("layout", md5_order(seed, *key) if shuffled else F.concat_ws("|", *[F.lpad(F.col(k).cast("string"), 12, "0") for k in key]))


def materialise(df: DataFrame, indices: DataFrame, key=("tile", "year", "idx"), seed=42, shuffled: bool = True) -> DataFrame:
    """Listed rows with the value that orders their layout."""
    return laid_out(df.join(indices.select(*key), list(key), "left_semi"), key, seed, shuffled)


def cap_per_tile(df: DataFrame, caps: DataFrame, by: str = "tile", order=("idx",)) -> DataFrame:
    out = df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).join(small(caps), by)
    return out.where(F.col("_k") <= F.col("cap")).drop("_k", "cap")


def oversample(df: DataFrame, factors=OVERSAMPLING, value: str = "agbd", width: float = 50.0) -> DataFrame:
    """Each row as often as its label bin's factor; labels past the last bin take its factor."""
    place = F.greatest(F.lit(0), F.least(F.floor(F.col(value) / width), F.lit(len(factors) - 1))).cast("int")
    times = F.get(F.array(*[F.lit(int(f)) for f in factors]), place)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def jitter_coords(df: DataFrame, low_km: float, high_km: float, seed, key, lat="lat", lon="lon") -> DataFrame:
    """Coordinates moved by a distance in [low, high] km along both axes, either way, wrapped to the globe."""
    def away(name):
        sign = F.when(md5_uniform(f"{seed}-{name}-sign", *key) < 0.5, 1).otherwise(-1)
        return sign * (low_km + (high_km - low_km) * md5_uniform(f"{seed}-{name}", *key)) * 1000

    dlat = away("lat") / EARTH_RADIUS * 180 / math.pi
    dlon = away("lon") / (EARTH_RADIUS * F.cos(F.lit(math.pi) * F.col(lat) / 180)) * 180 / math.pi
    wrap = lambda c, half: F.pmod(c + half, F.lit(2.0 * half)) - half
    return df.withColumn("_lat", wrap(F.col(lat) + dlat, 90)).withColumn(lon, wrap(F.col(lon) + dlon, 180)).withColumn(lat, F.col("_lat")).drop("_lat")


def crop_origin(seed, key, size: int, full: int) -> tuple[Column, Column]:
    at = lambda n: F.floor(md5_uniform(f"{seed}-{n}", *key) * (full - size + 1)).cast("int")
    return at("row"), at("col")


def random_crop(df: DataFrame, size: int, full: int, seed, key) -> DataFrame:
    """Origin of a random crop and where the central label pixel lies in it."""
    r, c = crop_origin(seed, key, size, full)
    return df.withColumn("crop_row", r).withColumn("crop_col", c).withColumn("label_row", full // 2 - F.col("crop_row")).withColumn("label_col", full // 2 - F.col("crop_col"))


def random_mask(df: DataFrame, values: str, seed, key) -> DataFrame:
    """Band array set to zero for half of the rows, by hash."""
    return df.withColumn(values, F.when(md5_uniform(seed, *key) < 0.5, F.transform(values, lambda v: v * 0)).otherwise(F.col(values)))


def member_onehot(df: DataFrame, members: int, seed=None, key=(), member: int | None = None) -> DataFrame:
    pick = F.lit(member) if member is not None else F.floor(md5_uniform(seed, *key) * members)
    return df.withColumn("onehot", F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda i: (i == pick).cast("int")))


def take_quota(df: DataFrame, n: int, seed, key) -> DataFrame:
    """The first n rows by hash. Counts by the hash's first digits show where n is reached; rows below that pass
    in parallel and only those with the digits at the cut are ranked."""
    hashed = df.withColumn("_o", md5_order(seed, *key)).withColumn("_d", F.substring("_o", 1, 4))
    upto = hashed.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(Window.orderBy("_d")))  # 65,536 rows at most
    cut = upto.where(F.col("_upto") >= n).orderBy("_d").first()
    if cut is None:
        return df
    edge = hashed.where(F.col("_d") == cut["_d"]).withColumn("_k", F.row_number().over(Window.partitionBy("_d").orderBy("_o", *key)))
    edge = edge.where(F.col("_k") <= n - (cut["_upto"] - cut["_n"])).drop("_k")
    return hashed.where(F.col("_d") < cut["_d"]).unionByName(edge).drop("_o", "_d")


def balance_year(df: DataFrame, year: int, n: int, seed, key) -> DataFrame:
    """A fixed number of one year's rows with all of the others."""
    one = take_quota(df.where(F.col("year") == year), n, seed, key)
    return df.where(F.col("year") != year).unionByName(one)


def peek_sample(df: DataFrame, n: int, order, seed=None) -> DataFrame:
    """n rows for inspection: evenly strided in order, or the first by hash put back in order."""
    if seed is not None:
        return take_quota(df, n, seed, order).orderBy(*order)
    total = df.count()
    stride = max(1, total // n)
    first = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(first, *order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    at = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).join(F.broadcast(starts), "_p")
    return at.where((F.col("_s") + F.col("_i")) % stride == 0).orderBy(*order).limit(n).drop("_p", "_i", "_s")
