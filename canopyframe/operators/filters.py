"""Filters and projections of footprint, plot and raster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BAD_SCENE_CLASSES, WATER
from ..semantics import col, finite, mask_nodata_value


def decode_latlon(df: DataFrame, lat=("lat_dec", "lat_off"), lon=("lon_dec", "lon_off")) -> DataFrame:
    """Degrees from a signed fraction and an unsigned whole: the sign of the fraction holds for both."""
    whole = lambda d, o: F.signum(F.col(d)) * (F.abs(F.col(d)) + F.col(o))
    return df.withColumn("lat", whole(*lat)).withColumn("lon", whole(*lon))


def filter_years(df: DataFrame, years=None, min_year=None) -> DataFrame:
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    return df if min_year is None else df.where(F.col("year") >= min_year)


def select_plots(df: DataFrame, min_year: int = 2017, min_n: int = 5) -> DataFrame:
    return df.where((F.col("year") >= min_year) & (F.col("n") >= min_n))


def quality_filter(df: DataFrame, quality="quality", degrade="degrade", sensitivity="sensitivity", least: float = 0.95) -> DataFrame:
    return df.where((F.col(quality) == 1) & (F.col(degrade) == 0) & (F.col(sensitivity) > least))


def assert_quality(df: DataFrame, sensitivity="sensitivity", least: float = 0.95) -> DataFrame:
    """One row that says if the whole population passes the quality filter."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(sensitivity).alias("least"), F.coalesce(F.min(sensitivity) > least, F.lit(True)).alias("sound"))


def mask_nodata(df: DataFrame, column: str, marks) -> DataFrame:
    return df.withColumn(column, mask_nodata_value(column, marks))


def finite_pairs(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.where(finite(pred) & finite(label))


def dropped_pairs(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~(finite(pred) & finite(label))).alias("dropped"))


def in_window(df: DataFrame, left, bottom, right, top, x="x", y="y", inclusive: bool = False) -> DataFrame:
    """Points in a window: left <= x < right and bottom < y <= top, or all edges included."""
    x, y, left, bottom, right, top = map(lambda v: col(v) if isinstance(v, (str, Column)) else F.lit(v), (x, y, left, bottom, right, top))
    if inclusive:
        return df.where(x.between(left, right) & y.between(bottom, top))
    return df.where((left <= x) & (x < right) & (bottom < y) & (y <= top))


def scene_mask(df: DataFrame, cls: str) -> DataFrame:
    return df.withColumn("masked", F.col(cls).isin(BAD_SCENE_CLASSES))


def drop_water(df: DataFrame, cls: str, classes=(WATER,)) -> DataFrame:
    """Rows whose class at the point is not water; rows without a class stay."""
    return df.where(F.coalesce(~F.col(cls).isin(list(classes)), F.lit(True)))


def apply_filters(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all rules in order, and how many each step drops of what the steps before left."""
    alive, flagged = F.lit(True), df
    for name, rule in rules.items():
        flagged = flagged.withColumn(f"_{name}", alive & ~F.coalesce(rule, F.lit(False)))
        alive = alive & F.coalesce(rule, F.lit(False))
    drops = flagged.agg(*[F.count_if(F.col(f"_{n}")).alias(n) for n in rules])
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.col(n).alias("dropped")) for i, n in enumerate(rules)])).alias("s")
    return df.where(alive), drops.select(steps).select("s.*")


def spatial_rules(train: str | None = None, regions: str | None = None, skip: str | None = None, only: str | None = None) -> dict[str, Column]:
    """Rules over the flags of ``spatial_marks``, in the order of the report: outside training tiles, outside skipped
    regions, inside chosen ones (buffered, if the flag is), inside the only one."""
    rules = {}
    if train:
        rules["training tiles"] = ~F.col(train)
    if skip:
        rules["skipped regions"] = ~F.col(skip)
    if regions:
        rules["regions"] = F.col(regions)
    if only:
        rules["only"] = F.col(only)
    return rules


def report_configs(df: DataFrame, configs: dict[str, Column]) -> DataFrame:
    """Rows of each named configuration of the filters; a row is in every configuration that it passes."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in configs.items()]), lambda x: x.isNotNull())
    return df.withColumn("config", F.explode(names))


def config_drops(df: DataFrame, configs: dict[str, dict[str, Column]]) -> DataFrame:
    """How many rows each rule of each configuration drops of what its rules before left, and how many stay (rule ``kept``),
    all in one pass: config, step, rule, rows."""
    counts, names = [], []
    for config, rules in configs.items():
        alive = F.lit(True)
        for step, (name, rule) in enumerate(rules.items()):
            held = F.coalesce(rule, F.lit(False))
            counts.append(F.count_if(alive & ~held))
            names.append((config, step, name))
            alive = alive & held
        counts.append(F.count_if(alive))
        names.append((config, len(rules), "kept"))
    one = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts)])
    rows = [F.struct(F.lit(c).alias("config"), F.lit(s).alias("step"), F.lit(n).alias("rule"), F.col(f"_{i}").alias("rows")) for i, (c, s, n) in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def parse_tokens(c, kind: str) -> Column:
    """A part of a file or product name, by the kind of name."""
    c = col(c)
    return {
        "shard_year": F.regexp_extract(c, r"data_subset-(\d{4})-v", 1).cast("int"),
        "shard": F.regexp_extract(c, r"_(\d+)-20", 1).cast("int"),
        "granule_year": F.substring(c, 1, 4).cast("int"),
        "product_date": F.to_date(F.substring(F.split(c, "_")[2], 1, 8), "yyyyMMdd"),
        "product_tile": F.substring(F.split(c, "_")[5], 2, 5),
        "region": F.split(c, "_")[0],
        "region_year": F.split(c, "_")[1].cast("int"),
    }[kind]


def clamp_year(c, low: int = 2018) -> Column:
    return F.greatest(col(c), F.lit(low))


def assemble_features(df: DataFrame, features: dict[str, list[Column]], enabled, name: str = "features") -> DataFrame:
    """Array of the enabled features' columns, in the order of ``features``."""
    chosen = [c.cast("double") for k, cs in features.items() if k in enabled for c in cs]
    return df.withColumn(name, F.array(*chosen))


def target(c, how: str = "identity", mean=None, std=None) -> Column:
    c = col(c).cast("double")
    return {"identity": lambda: c, "log": lambda: F.log1p(c), "unlog": lambda: F.expm1(c), "normal": lambda: (c - mean) / std}[how]()


def select_bands(values, names: list[str], wanted: list[str]) -> Column:
    """Bands of an array by name, in the wanted order."""
    return F.array(*[F.get(col(values), F.lit(names.index(w))) for w in wanted])
