"""Mergeable statistics, accuracy metrics, losses, histograms and audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CLASSES
from ..semantics import bin_of, col, small
from .ranks import percentiles, with_percentiles


def tile_sizes(df: DataFrame, chunk: int, by=("tile",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("chunks_floor", F.floor(F.col("n") / chunk)).withColumn("chunks_ceil", F.ceil(F.col("n") / chunk))


def chunk_stats(df: DataFrame, by, value: str, pos: str, chunk: int) -> DataFrame:
    """n, mean, population deviation, min and max of each chunk; the chunk comes from the position, not the partition."""
    v = F.col(value).cast("double")
    out = df.where(v.isNotNull()).groupBy(*by, F.floor(F.col(pos) / chunk).alias("chunk")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    return out.where(F.when(F.isnan("mean") | (F.abs("mean") == float("inf")), F.raise_error(F.lit("statistics of NaN or infinite values")).cast("boolean")).otherwise(True))


def pool_stats(chunks: DataFrame, by, exact: bool = False) -> DataFrame:
    """Merged mean and deviation. Pooled: chunk variances weighted by n - 1 over N - k, which depends on the chunks."""
    n, m, s = F.col("n"), F.col("mean"), F.col("std")
    total = F.sum(n)
    if exact:
        std = F.sqrt(F.greatest(F.lit(0.0), F.sum(n * (s * s + m * m)) / total - F.pow(F.sum(n * m) / total, 2)))
    else:
        std = F.sqrt(F.try_divide(F.sum((n - 1) * s * s), total - F.count(F.lit(1))))
    return chunks.groupBy(*by).agg(total.alias("n"), (F.sum(n * m) / total).alias("mean"), std.alias("std"), F.min("min").alias("min"), F.max("max").alias("max"))


def hist_percentiles(df: DataFrame, by, value: str, p=(0.01, 0.99)) -> DataFrame:
    """First value whose cumulative share reaches p, by exact ranks."""
    q = percentiles(df, by, value, p, discrete=True)
    kind = df.schema[value].dataType
    return q.select(*by, *[F.col("q")[i].cast(kind).alias(f"p{round(x * 100)}") for i, x in enumerate(p)])


def array_moments(df: DataFrame, by, values: str) -> DataFrame:
    """Per dimension of an array column: n, mean, population deviation, min and max of its non-null values."""
    long = df.select(*by, F.posexplode(values).alias("dim", "v")).where("v is not null and not isnan(v)")
    return long.groupBy(*by, "dim").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def embedding_statistics(df: DataFrame, values: str, by=(), regions=("global",), continents: dict[str, list[str]] | None = None, years=None, tiles: DataFrame | None = None, lite: bool = False, order=("idx",)) -> DataFrame:
    """Per dimension moments of the embeddings of chosen regions, years and tiles.

    regions: names of regions or continents, or ``global``; tiles: (tile, cap), of which all rows are used, or with
    ``lite`` each tile's first ``cap`` rows in order, counted before other columns are read.
    """
    if "global" not in regions:
        names = [r for name in regions for r in (continents or {}).get(name, [name])]
        df = df.where(F.col("region").isin(list(dict.fromkeys(names))))
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    if tiles is not None:
        df = df.join(tiles, "tile")
        if lite:
            df = df.withColumn("_k", F.row_number().over(Window.partitionBy("tile").orderBy(*order))).where(F.col("_k") <= F.col("cap"))
    return array_moments(df, by, values)


def band_statistics(df: DataFrame, by, values: str, pos: str, chunk: int) -> DataFrame:
    """Pooled moments with the 1st and 99th percentile of every band of an array column."""
    long = df.select(*by, pos, F.posexplode(values).alias("band", "v")).where("v is not null")
    keys = [*by, "band"]
    return pool_stats(chunk_stats(long, keys, "v", pos, chunk), keys).join(hist_percentiles(long, keys, "v"), keys)


def zero_filled(counts: DataFrame, by, bin_col: str, bins: list[int]) -> DataFrame:
    """A row for each group and bin, 0 where there is none."""
    every = counts.select(*by).distinct().withColumn(bin_col, F.explode(F.array(*map(F.lit, bins))))
    return every.join(counts, [*by, bin_col], "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Bins of ten up to 500 that labels are counted in.
LABEL_BINS = list(range(50))


def label_bin(value: str, width: int = 10, top: int = 500) -> Column:
    """Bin of a label, NULL outside [0, top)."""
    return F.when((F.col(value) >= 0) & (F.col(value) < top), bin_of(value, width)).cast("int")


def regional_distribution(df: DataFrame, by, value: str = "agbd", width: int = 10, top: int = 500) -> DataFrame:
    bins = list(range(0, top // width))
    counts = df.withColumn("bin", label_bin(value, width, top)).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, by, "bin", bins)


def class_counts(df: DataFrame, by, cls: str = "cls") -> DataFrame:
    return zero_filled(df.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n")), by, cls, CLASSES)


def freq_distance(ref: DataFrame, sub: DataFrame, by, bin_col: str = "bin") -> DataFrame:
    """Mean absolute difference of the sorted normalised frequencies; where the bins lie does not count."""
    def ranked(df, name):
        share = F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy(*by))), F.lit(0.0))
        df = df.withColumn(name, share)
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(name, bin_col))).select(*by, "rank", name)

    return ranked(ref, "p").join(ranked(sub, "q"), [*by, "rank"]).groupBy(*by).agg(F.avg(F.abs(F.col("p") - F.col("q"))).alias("distance"))


def binned_distance(ref: DataFrame, sub: DataFrame, by, bin_col: str = "bin") -> DataFrame:
    """True distance of the binned distributions, in bins: sum of absolute differences of the cumulative shares."""
    both = ref.withColumnRenamed("n", "_p").join(sub.withColumnRenamed("n", "_q"), [*by, bin_col])
    whole, run = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(bin_col)
    share = lambda c: F.coalesce(F.try_divide(F.sum(c).over(run), F.sum(c).over(whole)), F.lit(0.0))
    both = both.withColumn("d", share("_p") - share("_q"))
    return both.groupBy(*by).agg(F.sum(F.abs("d")).alias("distance"))


def correlation(x, y) -> Column:
    """Correlation from moments: NULL, not an error, where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def metric_columns(pred, truth) -> list[Column]:
    """n, bias, RMSE, MAE, r and R2 about the label mean; r and R2 are NULL below two rows or for constant labels."""
    both = col(pred).isNotNull() & col(truth).isNotNull()
    p, t = F.when(both, col(pred).cast("double")), F.when(both, col(truth).cast("double"))
    d, n = p - t, F.count(p)
    spread = F.var_pop(t) * n
    sound = (n >= 2) & (F.min(t) < F.max(t))
    return [
        n.alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        F.when(sound & (F.min(p) < F.max(p)), correlation(p, t)).alias("r"), F.when(sound, 1 - F.sum(d * d) / spread).alias("r2"),
    ]


def metrics(df: DataFrame, pred: str, truth: str, by=()) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(pred, truth))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for display and comparison; a negative zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def weighted_losses(df: DataFrame, pred: str, truth: str, weight: str, by=(), delta: float = 1.0) -> DataFrame:
    d, w = F.col(pred) - F.col(truth), F.col(weight)
    a = F.abs(d)
    huber = F.when(a <= delta, 0.5 * d * d).otherwise(delta * (a - 0.5 * delta))
    return df.groupBy(*by).agg(
        F.avg(w * d).alias("me"), F.sqrt(F.avg(w * d * d)).alias("rmse"), F.avg(w * d * d).alias("mse"), F.avg(w * a).alias("mae"), F.avg(w * huber).alias("huber")
    )


def gaussian_nll(df: DataFrame, mean: str, log_var: str, truth: str, by=(), eps: float = 1e-6) -> DataFrame:
    v = F.greatest(F.exp(F.col(log_var)), F.lit(eps))
    return df.groupBy(*by).agg(F.avg(0.5 * (F.log(v) + F.pow(F.col(mean) - F.col(truth), 2) / v)).alias("nll"))


def agreement_weight(sparse, dense, mode: str, cutoff: float) -> Column:
    """Weight of the dense label by its relative distance from the sparse one, cut at ``cutoff``: 1 down to 0."""
    x = F.least(F.abs(col(sparse) - col(dense)) / (col(sparse) + 1e-6), F.lit(cutoff)) / cutoff
    e, l2, ie = math.exp(1), math.log(2), math.exp(-1)
    return {"linear": lambda: 1 - x, "log": lambda: F.log(x * (1 - e) + e), "exp": lambda: 2 - F.exp(x * l2), "inv_log": lambda: -F.log(x * (1 - ie) + ie)}[mode]()


def error_of(pred, truth, loss: str = "MSE", delta: float = 1.0) -> Column:
    """Squared error, or Huber's: half the square up to ``delta``, linear beyond."""
    d = F.abs(col(pred) - col(truth))
    return {"MSE": lambda: d * d, "Huber": lambda: F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))}[loss]()


def agreement_loss(patches: DataFrame, centres: DataFrame, key: str, mode: str = "linear", cutoff: float = 0.5, loss: str = "MSE", version: int = 2) -> DataFrame:
    """Mean over patches of weight * dense error + (1 - weight) * sparse error.

    Version 2 weighs each patch's own errors; version 1 weighs the squared errors of all patches together. Modes
    ``random`` and ``false`` have a fixed weight (a half, one) on the errors of all together, in any version.
    """
    fixed = {"random": 0.5, "false": 1.0}.get(mode)
    kind = "MSE" if fixed is None and version == 1 else loss
    dense = patches.groupBy(key).agg(F.sum(error_of("pred", "dense", kind)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = F.lit(fixed) if fixed is not None else agreement_weight("sparse", "centre_dense", mode, cutoff)
    both = dense.join(centres, key).withColumn("_w", w).withColumn("_c", error_of("centre_pred", "sparse", kind))
    if fixed is None and version == 2:
        total = F.avg(F.col("_w") * F.col("_s") / F.col("_n") + (1 - F.col("_w")) * F.col("_c"))
    else:
        total = F.avg("_w") * F.sum("_s") / F.sum("_n") + (1 - F.avg("_w")) * F.avg("_c")
    return both.agg(F.count(F.lit(1)).alias("n"), total.alias("loss"))


def balanced_loss(patches: DataFrame, centres: DataFrame, key: str, lam="dense_gaussian", how: str = "pct", bins: DataFrame | None = None, epoch: int = 0, max_epochs: int = 15, loss: str = "MSE") -> DataFrame:
    """Sparse loss plus filtered dense loss, with a constant weight or a Gaussian warm-up over the epochs; ``loss`` is MSE or
    Huber, of both."""
    dense = patches.groupBy(key).agg(F.avg(error_of("pred", "dense", loss)).alias("_d"))
    both = dense.join(centres, key)
    s, c = F.col("sparse"), F.col("centre_dense")
    if how == "pct":
        factor = 1 - F.abs(s - c) / (s + 1e-6)
    elif how == "R2_bin":
        both = both.withColumn("bin", bin_of("sparse", 50)).join(F.broadcast(bins), "bin", "left")
        factor = 1 - F.pow(s - c, 2) / (F.pow(s - F.col("bin_mean"), 2) + 1e-6)
    else:
        factor = F.lit(1.0)
    both = both.withColumn("_f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), factor)))
    out = both.agg(F.avg(error_of("centre_pred", "sparse", loss)).alias("sparse_loss"), F.avg(F.col("_f") * F.col("_d")).alias("dense_loss"))
    if isinstance(lam, float):
        return out.withColumn("loss", F.col("sparse_loss") + lam * F.col("dense_loss"))
    g = math.exp(-5 * (1 - (epoch / (max_epochs - 1)) ** 2))
    a, b = ("dense_loss", "sparse_loss") if lam == "dense_gaussian" else ("sparse_loss", "dense_loss")
    return out.withColumn("loss", (1 - g) * F.col(a) + g * F.col(b))


def patch_jsd(df: DataFrame, key: str, a: str, b: str, eps: float = 1e-8) -> DataFrame:
    """Jensen-Shannon divergence of the softmaxed patches, averaged over patches."""
    w = Window.partitionBy(key)
    soft = lambda c: F.exp(F.col(c) - F.max(c).over(w))
    df = df.withColumn("_a", soft(a)).withColumn("_b", soft(b))
    df = df.withColumn("_p", F.col("_a") / F.sum("_a").over(w) + eps).withColumn("_q", F.col("_b") / F.sum("_b").over(w) + eps)
    m = F.log((F.col("_p") + F.col("_q")) / 2)
    term = 0.5 * (F.col("_p") * (F.log("_p") - m) + F.col("_q") * (F.log("_q") - m))
    return df.groupBy(key).agg(F.sum(term).alias("jsd")).agg(F.count(F.lit(1)).alias("n"), F.avg("jsd").alias("jsd"))


def sliced_normality(df: DataFrame, values: str, directions: DataFrame, points: int = 17, reach: float = 5.0) -> DataFrame:
    """Mean over directions of N times the weighted distance of the projections' characteristic function from the
    normal one. directions: (slice, direction), a few dozen unit vectors, joined as a broadcast dimension."""
    step = 2 * reach / (points - 1)
    dot = F.aggregate(F.zip_with(F.col(values), F.col("direction"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(-reach + i * step).alias("t")) for i in range(points)])).alias("p")
    seen = df.select(values).join(F.broadcast(directions)).select("slice", dot.alias("z")).select("slice", "z", t)
    z = F.col("z") * F.col("p.t")
    ecf = seen.groupBy("slice", "p.i", "p.t").agg(F.avg(F.cos(z)).alias("re"), F.avg(F.sin(z)).alias("im"), F.count(F.lit(1)).alias("n"))
    g = F.exp(-0.5 * F.col("t") * F.col("t"))
    edge = F.when(F.col("i").isin(0, points - 1), 0.5).otherwise(1.0)
    return ecf.groupBy("slice").agg((F.sum((F.pow(F.col("re") - g, 2) + F.pow(F.col("im"), 2)) * g * edge) * step * F.max("n")).alias("statistic"))


def metrics_by_bin(df: DataFrame, pred: str, truth: str, width: int = 50, top: int = 500, by=()) -> DataFrame:
    """Metrics by label bin; labels at or above the top are in none."""
    return metrics(df.where((F.col(truth) >= 0) & (F.col(truth) < top)).withColumn("bin", bin_of(truth, width)), pred, truth, [*by, "bin"]).withColumn("lower", F.col("bin") * width)


def merged_region(c, merge: dict[int, int] = {2: 5}) -> Column:  # noqa: B006
    out = col(c)
    for old, new in merge.items():
        out = F.when(col(c) == old, new).otherwise(out)
    return out


def metrics_cube(df: DataFrame, pred: str, truth: str, a: str, b: str, by=()) -> DataFrame:
    """Overall, by each of two columns and by both, in one pass; ``level`` says which columns are summed over."""
    sets = [[*map(F.col, (*by, *s))] for s in ((a, b), (a,), (b,), ())]
    return df.groupingSets(sets, *by, a, b).agg(F.grouping_id().alias("level"), *metric_columns(pred, truth))


def residual_boxes(df: DataFrame, pred: str, truth: str, by, width: int = 50, top: int = 500) -> DataFrame:
    """Quartiles of the residuals by bin, and whiskers at the furthest values within 1.5 interquartile ranges."""
    r = df.where(F.col(pred).isNotNull() & (F.col(truth) >= 0) & (F.col(truth) < top)).withColumn("bin", bin_of(truth, width)).withColumn("_r", F.col(pred) - F.col(truth))
    keys = [*by, "bin"]
    q = percentiles(r, keys, "_r", (0.25, 0.5, 0.75))
    q = small(q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = r.join(q, keys).where((F.col("_r") >= F.col("q1") - reach) & (F.col("_r") <= F.col("q3") + reach))
    return inside.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("q1", "median", "q3")], F.min("_r").alias("low"), F.max("_r").alias("high"))


def binned_calibration(df: DataFrame, pred: str, truth: str, width: float = 25.0) -> DataFrame:
    out = df.where(F.col(pred).isNotNull() & F.col(truth).isNotNull()).groupBy(bin_of(truth, width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("std")
    )
    return out.withColumn("size_class", F.when(F.col("n") < 5, "few").when(F.col("n") < 20, "some").otherwise("many"))


def compare_models(a: DataFrame, b: DataFrame, by: str, metric: str) -> DataFrame:
    """How much better a is than b, by group: the metric's fall, of the absolute value for the mean error."""
    size = F.abs if metric in ("bias", "me") else (lambda c: c)
    both = a.select(by, F.col(metric).alias("_a")).join(b.select(by, F.col(metric).alias("_b")), by)
    return both.select(by, (size(F.col("_b")) - size(F.col("_a"))).alias("gain"))


def density2d(df: DataFrame, x: str, y: str, bins: int = 150, top: float = 500.0) -> DataFrame:
    """2-D histogram on [0, top] squared; the top edge belongs to the last bin."""
    inside = df.where(F.col(x).between(0, top) & F.col(y).between(0, top))
    at = lambda c: F.least(F.floor(F.col(c) * bins / top), F.lit(bins - 1))
    return inside.groupBy(at(x).alias("xbin"), at(y).alias("ybin")).agg(F.count(F.lit(1)).alias("n"))


def density1d(df: DataFrame, by, value: str, bins: int, top: float) -> DataFrame:
    inside = df.where(F.col(value).between(0, top))
    counts = inside.groupBy(*by, F.least(F.floor(F.col(value) * bins / top), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*by)) * (top / bins)))


def point_density(df: DataFrame, lon: str, lat: str, width: int, height: int) -> DataFrame:
    """Points of each cell of a world grid, and the share of filled cells with as many or fewer."""
    cells = df.groupBy(
        F.greatest(F.lit(0), F.least(F.floor((F.col(lon) + 180) / 360 * width), F.lit(width - 1))).alias("cx"),
        F.greatest(F.lit(0), F.least(F.floor((90 - F.col(lat)) / 180 * height), F.lit(height - 1))).alias("cy"),
    ).agg(F.count(F.lit(1)).alias("n"))
    levels = cells.groupBy("n").agg(F.count(F.lit(1)).alias("_m"))  # ranks over distinct counts only
    run = Window.orderBy("n")
    levels = levels.select("n", (F.sum("_m").over(run) / F.sum("_m").over(Window.partitionBy())).alias("rank"))
    return cells.join(levels, "n")


def ensemble(df: DataFrame, key, pred: str = "pred") -> DataFrame:
    return df.groupBy(*key).agg(F.count(pred).alias("members"), F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("std"))


def ensemble_rmse(df: DataFrame, pred: str, truth: str, model: str) -> DataFrame:
    per = metrics(df, pred, truth, [model]).select(model, "rmse")
    return per.agg(F.count(F.lit(1)).alias("models"), F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"))


def cell_median(df: DataFrame, x: str, y: str, size: float, value: str) -> DataFrame:
    """Median of each grid cell, placed at the cell's centre."""
    cells = df.select(F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy"), value)
    out = with_percentiles(cells.groupBy("cx", "cy").agg(F.count(value).alias("n")), cells, ["cx", "cy"], value, {"median": 0.5})
    return out.withColumn("x", (F.col("cx") + 0.5) * size).withColumn("y", (F.col("cy") + 0.5) * size)


def coverage_report(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    out = df.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.count_if(c >= 0.99).alias("full"), F.count_if(c < 0.5).alias("poor"), F.count_if(c.isNull()).alias("missing"))
    return with_percentiles(out, df, [], column, {"median": 0.5})


def extent_summary(df: DataFrame, column: str, thresholds=(0.5, 0.9, 1.0)) -> DataFrame:
    out = df.agg(*[F.count_if(F.col(column) < t).alias(f"below_{round(t * 100)}") for t in thresholds])
    return with_percentiles(out, df, [], column, {f"p{p}": p / 100 for p in (0, 5, 25, 50, 75, 100)})


def label_summary(df: DataFrame, by, value: str) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_percentiles(out, df, by, value, {"median": 0.5, "p90": 0.9})


def class_distribution(df: DataFrame, key, cls: str) -> DataFrame:
    return df.groupBy(*key).agg(F.array(*[F.count_if(F.col(cls) == c) / F.count(F.lit(1)) for c in CLASSES]).alias("shares"))


def class_mode(df: DataFrame, key, cls: str) -> DataFrame:
    """Most frequent class, the smallest on a tie."""
    counts = df.where(F.col(cls).isNotNull()).groupBy(*key, cls).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*key).agg(F.min_by(cls, F.struct(F.negative("_n"), F.col(cls))).alias("mode"))


def blend_windows(df: DataFrame, key, pred: str, weight: str) -> DataFrame:
    """Weighted mean of overlapping window predictions at each pixel."""
    p, w = F.col(pred), F.col(weight)
    return df.where(p.isNotNull()).groupBy(*key).agg(F.try_divide(F.sum(w * p), F.sum(w)).alias("value"))


def merge_windows(df: DataFrame, key, policy: str, seq: str = "seq", pred: str = "pred", slots: int = 3, size: int | None = None, crop: int | None = None, axes=None) -> DataFrame:
    """One prediction a pixel from overlapping windows.

    ``last``: the last window written. ``slots``: the mean of the last writer of each of a few rotating slots.
    ``cropped``: each window writes only what is left without ``crop`` pixels on every side, so that windows ``size -
    2 * crop`` apart tile the raster; a pixel belongs to one window, which its place decides, and nothing is grouped.
    ``axes`` names, for rows and for columns, (place, window start, length of the axis): as in ``windows_padded``, the last
    inner part of an axis is shifted to end at its edge and written last.
    """
    if policy == "last":
        return df.groupBy(*key).agg(F.max_by(pred, seq).alias("value"))
    if policy == "slots":
        per_slot = df.groupBy(*key, (F.col(seq) % slots).alias("_slot")).agg(F.max_by(pred, seq).alias("_v"))
        return per_slot.groupBy(*key).agg(F.avg("_v").alias("value"))
    if policy != "cropped":
        raise ValueError(f"no such policy: {policy}")
    if not size or crop is None or not axes or size <= 2 * crop:
        raise ValueError("cropped windows need size, crop and axes")
    inner = size - 2 * crop

    def owner(place, length):
        """Start of the inner part that has a place: those of full steps, then the one that ends at the edge."""
        last = F.greatest(F.lit(0), F.col(length) - inner)
        return F.when(F.col(place) >= last, last).otherwise(F.floor(F.col(place) / inner) * inner)

    own = [F.col(start) == owner(place, length) for place, start, length in axes]
    return df.where(own[0] & own[1]).select(*key, F.col(pred).alias("value"))


def composite_patches(df: DataFrame, key, value: str, top: float = 65535.0) -> DataFrame:
    mean = F.avg(value)
    return df.groupBy(*key).agg(F.when(mean.isNull(), top).otherwise(F.least(F.greatest(mean, F.lit(0.0)), F.lit(top))).alias("value"))


def rank_attributions(df: DataFrame, band: str, value: str, centre: Column) -> DataFrame:
    a = F.abs(F.col(value))
    out = df.groupBy(band).agg(F.avg(a).alias("full"), F.avg(F.when(centre, a)).alias("centre"))
    out = out.withColumn("share", 100 * F.col("full") / F.sum("full").over(Window.partitionBy()))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("full").desc(), band)))


def offset_diagnostic(df: DataFrame, by, value: str, warn: float = 0.02) -> DataFrame:
    """Mean and deviation of the values at each offset, and how far the means spread around the overall one."""
    v = F.col(value)
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v))).alias("std"))
    every = Window.partitionBy()
    spread = F.try_divide(F.max("mean").over(every) - F.min("mean").over(every), F.abs(F.avg("mean").over(every)))
    return out.withColumn("spread", spread).withColumn("warn", F.col("spread") > warn)


def cloud_score(df: DataFrame, by, r: str, g: str, b: str, fill: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when((F.least(r, g, b) > 180) | fill, 1.0).otherwise(0.0)).alias("score"))


def audit_rasters(meta: DataFrame, pixels: DataFrame, smallest: int, largest: int, bands: int, most_nodata: float, nodata: float = -9999.0) -> DataFrame:
    """Failed rules of each raster: size in pixels, number of bands, orientation, projection; the pixels of those that
    pass are then read for the share without data. A raster without any pixel has all of them missing."""
    side = (F.least("width", "height"), F.greatest("width", "height"))
    rules = F.array(
        F.when(side[1] > largest, "large"), F.when(side[0] < smallest, "small"), F.when(F.col("bands") != bands, "bands"),
        F.when(F.col("e") > 0, "south_up"), F.when(F.coalesce(~F.col("epsg").between(32601, 32760), F.lit(True)), "no_projection"),
    )
    m = meta.select("raster_id", F.filter(rules, lambda x: x.isNotNull()).alias("_f"))
    sane = m.where(F.size("_f") == 0).select("raster_id")
    seen = pixels.join(sane, "raster_id", "left_semi").groupBy("raster_id").agg(F.avg(F.when(F.col("value") == nodata, 1.0).otherwise(0.0)).alias("nodata_share"))
    empty = (F.size("_f") == 0) & (F.coalesce("nodata_share", F.lit(1.0)) > most_nodata)
    found = F.concat("_f", F.filter(F.array(F.when(empty, "nodata")), lambda x: x.isNotNull()))
    return m.join(seen, "raster_id", "left").select("raster_id", "nodata_share", F.array_join(found, ",").alias("failures"))


def patch_validity(df: DataFrame, key, valid: Column) -> DataFrame:
    """Patches with all, some and no valid pixels."""
    per = df.groupBy(*key).agg(F.count_if(valid).alias("_v"), F.count(F.lit(1)).alias("_n"))
    v, n = F.col("_v"), F.col("_n")
    return per.agg(F.count_if(v == n).alias("whole"), F.count_if((v > 0) & (v < n)).alias("part"), F.count_if(v == 0).alias("never"))
