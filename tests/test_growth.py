"""Queries whose cost once grew with more than their input: plans and results on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import joins as J
from canopyframe.operators import raster as R


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tall(spark):
    """A raster of one column of blocks, 400 rows of 8 columns, and a point at each of its pixels."""
    return spark.range(3200).selectExpr("id", "0L AS raster_id", "id div 8 AS row", "id % 8 AS col", "CAST(id AS DOUBLE) AS value")


def test_patches_are_not_broadcast(tall):
    out = R.extract_patches(tall.select("id", "raster_id", "row", "col"), tall, 3, 4)
    assert "Broadcast" not in plan(out)
    got = {r.id: r.patch for r in out.where("id in (0, 9)").collect()}
    assert got == {0: [None, None, None, None, 0.0, 1.0, None, 8.0, 9.0], 9: [0.0, 1.0, 2.0, 8.0, 9.0, 10.0, 16.0, 17.0, 18.0]}


def test_scenes_are_brought_down_to_one_a_tile(spark):
    plots = spark.createDataFrame([(1, [1, 2]), (2, [2]), (3, [3]), (4, [9])], "plot long, tiles array<long>")
    scenes = spark.createDataFrame([(5, 1, 3.0), (4, 1, 3.0), (7, 2, None), (8, 2, 4.0), (9, 3, None), (6, 3, None)], "scene long, tile long, score double")
    out = J.pick_scene(plots, scenes)
    text = plan(out)
    assert "Window" not in text and text.index("Join") < text.rindex("Aggregate")  # scenes are aggregated below the join
    assert {tuple(r) for r in out.collect()} == {(1, 4, 3.0), (2, 8, 4.0), (3, 6, None)}


def test_crops_of_equal_means_tie(spark):
    """Two crops of the same values in another order, whose sums as doubles differ in the last digit."""
    sum_of = lambda v: ((v[0] + v[1]) + v[2]) + v[3]
    one, two = [0.1, 0.2, 0.3, 0.4], [0.2, 0.4, 0.3, 0.1]
    assert sum_of(one) < sum_of(two)
    rows = [(k % 2, 4 * (k // 2) + i // 2, i % 2, v) for k, vs in enumerate((one, two, two, one)) for i, v in enumerate(vs)]
    rows += [(r, 2 + i // 2, i % 2, 0.0) for r in range(2) for i in range(4)]
    pixels = spark.createDataFrame(rows, "raster_id long, row long, col long, value double").coalesce(1)
    assert {tuple(r)[:3] for r in R.best_crop(pixels, 2, 2, 1.0).collect()} == {(0, 0, 0), (1, 0, 0)}


def test_feature_files_are_bounded(spark):
    from canopyframe.plans.queries_io import _collections

    plots = spark.range(50_000).withColumnRenamed("id", "plot")
    sizes = [r.n for r in _collections(plots, F.struct("plot")).select(F.size("features").alias("n")).collect()]
    assert sum(sizes) == 50_000 and max(sizes) < 2500


def _grid(spark, n, ident, epsg=32632, width=32, height=3200, c=500000.0):
    return spark.createDataFrame([(ident, epsg, 10.0, -10.0, c, 5000000.0, width, height)], f"{n} long, epsg int, a double, e double, c double, f double, width long, height long")


def test_mosaic_lays_no_empty_parts(spark):
    """The window of a long raster of another zone is mostly empty; its parts' windows are not."""
    from canopyframe.operators import grids as D

    rasters = _grid(spark, "raster_id", 1).unionByName(_grid(spark, "raster_id", 2, 32633))
    area = lambda df: df.agg(F.sum(F.col("width") * F.col("height"))).first()[0]
    assert area(D.mosaic_windows(rasters, 10.0)) > 4 * 2 * 32 * 3200
    assert area(D.mosaic_parts(rasters, 10.0)) < 1.5 * 2 * 32 * 3200


def test_grids_meet_tiles_and_not_pixels(spark):
    """Grids of the same and of another zone: values as from a projection of each pixel, in one row a tile."""
    from canopyframe.functions import geo as G

    src = _grid(spark, "raster_id", 7, 32633, 60, 70, 28300.0)
    values = spark.range(4200).selectExpr("7L AS raster_id", "id div 60 AS row", "id % 60 AS col", "CAST(id AS DOUBLE) AS value").where("value % 11 <> 3")
    x, y = (float(v[0]) for v in G.to_utm_array(*G.from_utm_array(*[__import__("numpy").array([k]) for k in (28500.0, 4999700.0, 32633)]), 32632))
    dst = _grid(spark, "grid", 1, 32632, 40, 33, x).withColumn("f", F.lit(y)).unionByName(_grid(spark, "grid", 2, 32633, 5, 5, 28320.0)).unionByName(_grid(spark, "grid", 3, 32632, 9, 9))
    laid = R.laid_values(values, src, R.overlapping(dst, src))
    assert laid.count() <= 4 * 3 + 1  # blocks of grids by tiles
    cells = dst.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)))
    cells = cells.withColumn("x", F.expr("c + (col + 0.5D) * a")).withColumn("y", F.expr("f + (row + 0.5D) * e"))
    cells = cells.select("grid", "row", "col", "epsg", "x", "y", *G.from_utm("x", "y", "epsg")).select("grid", "row", "col", "epsg", F.col("x").alias("px"), F.col("y").alias("py"), *G.to_utm("lon", "lat", F.lit(32633)))
    px, py = F.when(F.col("epsg") == 32633, F.col("px")).otherwise(F.col("x")), F.when(F.col("epsg") == 32633, F.col("py")).otherwise(F.col("y"))
    at = cells.select("grid", F.col("row").alias("r"), F.col("col").alias("k"), F.floor((py - 5000000) / -10).alias("row"), F.floor((px - 28300) / 10).alias("col"))
    want = {tuple(r) for r in at.join(values, ["row", "col"]).select("grid", "r", "k", "value").collect()}
    assert len(want) > 500 and {tuple(r) for r in R.regrid(values, src, dst).select("grid", "row", "col", "value").collect()} == want


def test_places_without_a_pixel_are_null(spark, tmp_path):
    """Rasters with single pixels, a whole tile, values and the end of the last row missing, as in SQL."""
    from compare import check

    from canopyframe.plans.catalog import ORACLES, QUERIES

    keys = spark.range(4 * 32 * 100 + 50).where("id div 128 not between 32 and 63 and id % 41 <> 7")  # 32 rows of 32 columns of 4 rasters
    keys.selectExpr("id AS p_partkey", "IF(id % 43 = 1, NULL, 900D + id % 1000 / 10D) AS p_retailprice", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES["g09_regrid"](spark, str(tmp_path))
    assert got.where("value is null and row between 22 and 42").count() > 4 * 20 * 20  # the tile
    check(got, con, ORACLES["g09_regrid"])


def test_patches_within_their_tile_ask_no_other(spark, monkeypatch):
    from canopyframe.operators import grids as D

    tiles = _grid(spark, "raster_id", 0, height=32).unionByName(_grid(spark, "raster_id", 1, height=32, c=500320.0))
    values = spark.range(2048).selectExpr("id div 1024 AS raster_id", "id % 1024 div 32 AS row", "id % 32 AS col", "CAST(id AS DOUBLE) AS value")
    points = spark.createDataFrame([(1, 0, 16, 16), (2, 0, 16, 31), (3, 1, 0, 0)], "id long, raster_id long, row long, col long")
    asked = []
    monkeypatch.setattr(D, "laid_values", lambda p, s, pairs: asked.extend((r[0], r[1]) for r in pairs.select("grid.id", "raster_id").collect()) or R.laid_values(p, s, pairs))
    got = {r.id: r.patch for r in D.patches_across(points, tiles, values, 3).collect()}
    assert sorted(asked) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert got[2] == [510.0, 511.0, 1504.0, 542.0, 543.0, 1536.0, 574.0, 575.0, 1568.0] and got[3] == [None, None, None, 31.0, 1024.0, 1025.0, 63.0, 1056.0, 1057.0]


def test_zones_of_equal_outlines_are_measured_once(spark, monkeypatch):
    """400 zones of two boxes, one zone of both; a zone of more values than are held is ranked by digits."""
    pixels = spark.range(60).selectExpr("id + 0.5D AS x", "0.5D AS y", "CAST(id AS DOUBLE) AS value")
    zones = spark.range(400).selectExpr("id AS zone", "10D * (id % 2) AS xmin", "0D AS ymin", "10D * (id % 2) + 10 AS xmax", "1D AS ymax")
    zones = zones.unionByName(spark.createDataFrame([(900, 0.0, 0.0, 60.0, 1.0), (901, 0.0, 0.0, 10.0, 1.0), (901, 10.0, 0.0, 20.0, 1.0)], zones.schema))
    seen = []
    monkeypatch.setattr(J, "written", lambda df: seen.append(df.count()) or df)
    monkeypatch.setattr(J, "_HELD", 30)
    got = {r.zone: (r.n, r["mean"], r.median, round(r.p90, 6)) for r in J.zonal_stats(zones, pixels, 7.0).collect()}
    assert seen == [10 + 10 + 60 + 20] and len(got) == 402
    assert got[0] == (10, 4.5, 4.5, 8.1) and got[399] == (10, 14.5, 14.5, 18.1) and got[901] == (20, 9.5, 9.5, 17.1) and got[900] == (60, 29.5, 29.5, 53.1)


def test_windows_are_dealt_out(spark):
    """Padded windows are cut into pixels on all partitions, and no pixel is joined by its raster alone."""
    meta = _grid(spark, "raster_id", 0, height=64).coalesce(1)
    pixels = spark.range(2048).selectExpr("0L AS raster_id", "id div 32 AS row", "id % 32 AS col", "CAST(id AS DOUBLE) AS value")
    out = R.read_window(R.windows_padded(meta, 20, 3), meta, pixels, 20)
    assert "REPARTITION_BY_NUM" in plan(out) and {"height", "width"} <= set(out.columns)
    assert out.where("row0 = 0 and col0 = 0 and i = 3 and j = 3").first().value == 0.0 and out.where("row0 = 0 and col0 = 0 and i = 1 and j = 3").first().value == 32.0


def test_places_are_found_once_for_both_layouts(spark, sf, monkeypatch):
    from canopyframe.plans import queries_io as Q
    from canopyframe.plans.catalog import QUERIES

    seen = []
    monkeypatch.setattr(Q.K, "write_dataset", lambda df, path, mode: seen.append(plan(df)) or df.withColumn("split", F.lit(mode)).write.mode("append").parquet(path))
    assert QUERIES["s09_write_dataset"](spark, sf).count() > 0 and len(seen) == 2
    assert all("Window" not in p for p in seen)
