"""End-to-end compositions: a compact dataset, and maps against plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import metrics
from ..operators.filters import apply_filters, select_plots
from ..operators.sampling import laid_out, matched_subsample, sample_per_tile
from ..operators.windows import best_trial
from ..semantics import small


def compact_dataset(df: DataFrame, fraction: float, trials: int, region: str = "region_cla", by=("tile",), key=("tile", "year", "idx")) -> DataFrame:
    """Of each region the subsample whose label and class distributions are nearest to the whole, in layout order."""
    best = best_trial(matched_subsample(df, fraction, trials, region, by, key), [region]).select(region, "trial")
    chosen = sample_per_tile(df.join(small(best), region), fraction, F.col("trial"), ("trial", *by), key)
    return laid_out(chosen, key).drop("trial")


def compare_maps(plots: DataFrame, estimates: list[str], truth: str, rules: dict, min_year: int = 2017, min_n: int = 5) -> DataFrame:
    """Metrics of several maps against the same plots: those that pass the filters and at which all maps have a value."""
    kept, _ = apply_filters(select_plots(plots, min_year, min_n), {**rules, "paired": F.forall(F.array(*estimates), lambda v: v.isNotNull())})
    long = kept.select(truth, F.explode(F.array(*[F.struct(F.lit(e).alias("map"), F.col(e).alias("estimate")) for e in estimates])).alias("e")).select(truth, "e.*")
    return metrics(long, "estimate", truth, ["map"])
