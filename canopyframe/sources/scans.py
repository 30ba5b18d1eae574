"""Scans: footprint shards, plots, lists, class vectors, bounded point reads, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CLASS_EMBEDDINGS, FOOTPRINTS


def scan_footprints(spark: SparkSession, root: str, years, shards: int = 20, debug: bool = False, schema=FOOTPRINTS) -> DataFrame:
    """Shards of the years; partitions are pruned before files are opened. Debug reads the first two shards."""
    df = spark.read.schema(schema).parquet(root).where(F.col("year").isin(list(years)))
    return df.where(F.col("shard") < (2 if debug else shards))


def tile_catalog(df: DataFrame) -> DataFrame:
    return df.groupBy("tile").agg(F.sort_array(F.collect_set("file")).alias("files"))


def tile_year_map(df: DataFrame) -> DataFrame:
    """Year to file map of each tile; the first file by name where a year has several."""
    one = df.groupBy("tile", "year").agg(F.min("file").alias("file"))
    return one.groupBy("tile").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "file")))).alias("files"))


def scan_class_embeddings(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(CLASS_EMBEDDINGS).option("header", True).csv(path)
    return df.select("mapping", F.array(*[f"dim{i}" for i in range(5)]).alias("vector"))


_GEOJSON = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
])))])


def scan_plots(spark: SparkSession, path: str) -> DataFrame:
    """Polygon features as rows: properties, ``parts`` (each an outer ring and its holes, rings without their closing
    points), ``ring`` (the first part's outer one) and the bounds of all parts. A MultiPolygon has several parts; features
    of other kinds or without coordinates are left out."""
    f = spark.read.schema(_GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    several = F.from_json(text, "array<array<array<array<double>>>>")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", several)

    def opened(ring):
        points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        return F.when((F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1)), F.slice(points, 1, F.size(points) - 1)).otherwise(points)

    out = f.select(F.col("f.properties").alias("properties"), F.transform(parts, lambda p: F.transform(p, opened)).alias("parts"))
    points = F.flatten(F.flatten("parts"))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    out = out.select("*", F.col("parts")[0][0].alias("ring"), F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))
    return out.where("xmin is not null")


def scan_uri_list(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    df = spark.read.text(path).select(F.trim("value").alias("uri")).where("uri <> ''")
    return df if year is None else df.where(F.col("uri").contains(f"/{year}/"))


def with_cell(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """1-degree cell id, the partition column of point tables."""
    return df.withColumn("cell", (F.floor(F.col(lat)) + 90) * 360 + F.floor(F.col(lon)) + 180)


def scan_points_bbox(df: DataFrame, w: float, s: float, e: float, n: float, lon: str = "lon", lat: str = "lat", most_cells: int = 5000) -> DataFrame:
    """Points in a box, borders included: cells first (partition pruning), then the exact clip."""
    import math

    cells = [(y + 90) * 360 + x + 180 for y in range(math.floor(s), math.floor(n) + 1) for x in range(math.floor(w), math.floor(e) + 1)]
    if len(cells) <= most_cells:  # a longer list costs more than it prunes; the clip alone is exact
        df = df.where(F.col("cell").isin(cells))
    return df.where(F.col(lon).between(w, e) & F.col(lat).between(s, n))


def project_features(df: DataFrame, spec: list[tuple[str, str]], region=None, defaults: dict | None = None) -> DataFrame:
    """Declared columns with their types, optional ones with a default, and the region."""
    defaults = defaults or {}
    cols = [(F.col(k) if k in df.columns else F.lit(defaults[k])).cast(t).alias(k) for k, t in spec]
    return df.select(*cols, *([region] if region is not None else []))


def pick_stats(catalog: DataFrame, lite: bool, hold_out: str | None = None, keep: bool = False, years=None, trained_years=None) -> DataFrame:
    """Rows of the statistics to normalise with: those of the trained years if given, of the region alone, of all
    regions but the held-out one, or of everything."""
    wanted = ",".join(map(str, sorted(trained_years or years or [])))
    regions = "all" if hold_out is None else (hold_out if keep else f"not-{hold_out}")
    return catalog.where((F.col("lite") == lite) & (F.col("regions") == regions) & (F.col("years") == wanted))
