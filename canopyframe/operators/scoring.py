"""Scoring with given weights: linear probes, small dense heads, map and footprint pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_storage, window_weight
from ..sources.sinks import write_results
from .aggregates import blend_windows, ensemble, metrics
from .filters import assemble_features


def dot(values, weights) -> Column:
    v = F.col(values) if isinstance(values, str) else values
    w = F.array(*[F.lit(float(x)) for x in weights]) if not isinstance(weights, Column) else weights
    return F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def fit_linear_probe(df: DataFrame, values: str, label: str, reg: float = 0.0):
    """Least-squares weights and intercept; normal equations are summed over partitions."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    x = df.select(array_to_vector(F.col(values).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    model = LinearRegression(regParam=reg, solver="normal").fit(x)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def score_linear(df: DataFrame, values: str, weights, intercept: float, name: str = "pred") -> DataFrame:
    return df.withColumn(name, dot(values, weights) + intercept)


def score_mlp(df: DataFrame, values: str, layers: list[dict], name: str = "pred") -> DataFrame:
    """Dense layers, each with a ReLU behind it, the last one too. A layer: weights (rows), bias, and, where it is
    normalised, scale and shift of that."""
    out = df.withColumn("_h", F.col(values).cast("array<double>"))
    for layer in layers:
        n = len(layer["bias"])
        units = zip(layer["weights"], layer["bias"], layer.get("scale", [1.0] * n), layer.get("shift", [0.0] * n))
        rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w]).alias("w"), F.lit(float(b)).alias("b"), F.lit(float(s)).alias("s"), F.lit(float(t)).alias("t")) for w, b, s, t in units])
        out = out.withColumn("_h", F.transform(rows, lambda r: F.greatest((dot(F.col("_h"), r["w"]) + r["b"]) * r["s"] + r["t"], F.lit(0.0))))
    return out.withColumn(name, F.get("_h", F.lit(0))).drop("_h")


def predict_map(windows: DataFrame, heads: dict[str, list[dict]], size: int, kind: str = "uint16") -> DataFrame:
    """Windows scored by every head on each pixel's bands, blended per head, averaged over heads, stored.

    windows: raster_id, row0 and col0 of the whole window, i, j, value (array of bands); heads: name to dense layers, see
    ``score_mlp``.
    """
    place = windows.select("raster_id", (F.col("row0") + F.col("i")).alias("row"), (F.col("col0") + F.col("j")).alias("col"), "value", window_weight("i", "j", size, size).alias("weight"))
    scored = None
    for name, layers in heads.items():
        one = score_mlp(place, "value", layers).select("raster_id", "row", "col", "weight", F.lit(name).alias("model"), "pred")
        scored = one if scored is None else scored.unionByName(one)
    blended = blend_windows(scored, ["model", "raster_id", "row", "col"], "pred", "weight")
    return ensemble(blended, ["raster_id", "row", "col"], "value").withColumn("stored", to_storage(F.round("mean", 6), kind))


def predict_footprints(df: DataFrame, features: dict[str, list[Column]], enabled, models: dict[str, tuple], label: str, key, carried=(), path: str | None = None) -> DataFrame:
    """Footprints from features to results: assembled features, each linear model's score, and the models' mean.

    models: name to (weights, intercept). Returns key, label, carried columns, members, mean and std of the models'
    predictions; with a path the results sink holds these and each model's RMSE.
    """
    x = assemble_features(df, features, enabled, "_x")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.array(*[F.lit(float(v)) for v in w]).alias("w"), F.lit(float(b)).alias("b")) for m, (w, b) in models.items()]))
    scored = x.select(*key, label, *carried, "_x", each.alias("m")).select(*key, label, *carried, "m.model", (dot("_x", F.col("m.w")) + F.col("m.b")).alias("pred"))
    samples = ensemble(scored, [*key, label, *carried], "pred")
    if path is not None:
        write_results(samples, metrics(scored, "pred", label, ["model"]).select("model", "n", "rmse"), path)
    return samples
