"""Edge rows of single operators: missing values, borders, ties, hemispheres, empty groups."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.functions import geo as G
from canopyframe.functions import scalar as X
from canopyframe.operators import aggregates as A
from canopyframe.operators import filters as P
from canopyframe.operators import joins as J
from canopyframe.operators import nearest as N
from canopyframe.operators import raster as R
from canopyframe.operators import sampling as M
from canopyframe.operators import scoring as H
from canopyframe.operators import windows as W
from canopyframe.semantics import bin_of, mask_nodata_value, nan_to_null
from canopyframe.sources import scans as S
from canopyframe.sources import sinks as K

NAN, INF = float("nan"), float("inf")


def one(df):
    return df.collect()[0]


def test_metrics_of_few_and_constant_labels(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 5.0), ("b", 3.0, 5.0), ("c", None, 1.0), ("d", 1.0, 0.0), ("d", 2.0, 4.0), ("d", 4.0, 3.0)], "g string, p double, t double")
    got = {r.g: r for r in A.metrics(df, "p", "t", ["g"]).collect()}
    assert (got["a"].n, got["a"].rmse, got["a"].r, got["a"].r2) == (1, 1.0, None, None)
    assert got["b"].r2 is None and got["b"].bias == -3 and got["c"].n == 0 and got["c"].rmse is None
    p, t = np.array([1, 2, 4.0]), np.array([0, 4, 3.0])
    assert got["d"].r2 == pytest.approx(1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert got["d"].r == pytest.approx(np.corrcoef(p, t)[0, 1])


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (-9999.0,), (INF,)], "v double")
    assert [r[0] for r in df.select(nan_to_null("v")).collect()] == [1.0, None, None, -9999.0, INF]
    assert [r[0] for r in df.select(mask_nodata_value("v", [-9999.0])).collect()] == [1.0, None, None, None, INF]
    pairs = spark.createDataFrame([(1.0, 1.0), (NAN, 1.0), (INF, 1.0), (1.0, None)], "p double, t double")
    assert P.finite_pairs(pairs, "p", "t").count() == 1 and one(P.dropped_pairs(pairs, "p", "t")).dropped == 3
    bad = spark.createDataFrame([("a", 0, NAN), ("a", 1, 1.0)], "g string, i int, v double")
    with pytest.raises(Exception, match="NaN"):
        A.chunk_stats(bad, ["g"], "v", "i", 10).collect()


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(v, v) for v in (0.0, 49.9, 50.0, 499.9, 500.0, 550.0, -1.0)], "t double, p double")
    assert [r[0] for r in df.select(bin_of("t", 50)).collect()] == [0, 0, 1, 9, 10, 11, -1]
    assert sum(r.n for r in A.metrics_by_bin(df, "p", "t").collect()) == 4
    assert sum(r.n for r in A.density2d(df, "t", "p", 10).collect()) == 5  # the top edge belongs to the last bin
    assert {int(r.t): r.n for r in M.oversample(df, value="t").groupBy("t").agg(F.count("*").alias("n")).collect()}[550] == 10


def test_pooled_equals_whole_for_one_chunk_and_any_partitioning(spark):
    v = np.random.default_rng(0).normal(50, 9, 500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").withColumn("g", F.lit(1))
    for parts in (1, 7):
        chunks = A.chunk_stats(df.repartition(parts), ["g"], "v", "i", 37)
        exact, pooled = one(A.pool_stats(chunks, ["g"], True)), one(A.pool_stats(chunks, ["g"]))
        n, s = np.array([len(v[k : k + 37]) for k in range(0, 500, 37)]), np.array([v[k : k + 37].std() for k in range(0, 500, 37)])
        assert exact["std"] == pytest.approx(v.std()) and exact["mean"] == pytest.approx(v.mean())
        assert pooled["std"] == pytest.approx(math.sqrt(((n - 1) * s * s).sum() / (500 - len(n))))


def test_coordinates_in_all_quadrants(spark):
    df = spark.createDataFrame([(0.5, 10, -0.25, 3), (-0.5, 10, 0.25, 3), (0.0, 7, 0.0, 9), (-0.1, 0, -0.1, 0)], "lat_dec double, lat_off int, lon_dec double, lon_off int")
    assert [(r.lat, r.lon) for r in P.decode_latlon(df).collect()] == [(10.5, -3.25), (-10.5, 3.25), (0.0, 0.0), (-0.1, -0.1)]
    p = spark.createDataFrame([(lat, lon) for lat in (-80.0, -33.3, -0.001, 0.0, 45.0, 83.0) for lon in (-179.9, -6.0, 0.0, 5.999, 6.0, 179.9)], "lat double, lon double")
    back = p.withColumn("epsg", G.utm_epsg("lon", "lat")).select("lat", "lon", "epsg", *G.to_utm("lon", "lat", "epsg"))
    back = back.select(F.col("lat").alias("a"), F.col("lon").alias("b"), "x", *G.from_utm("x", "y", "epsg"))
    for r in back.collect():
        assert r.lat == pytest.approx(r.a, abs=1e-8) and r.lon == pytest.approx(r.b, abs=1e-8) and 100000 < r.x < 900000
    on_axis = spark.createDataFrame([(9.0, 0.0, 32632), (9.0, 48.0, 32632)], "lon double, lat double, epsg int")
    xs = on_axis.select(*G.to_utm("lon", "lat", "epsg")).collect()
    assert xs[0].x == pytest.approx(500000) and xs[0].y == pytest.approx(0, abs=1e-6)
    assert xs[1].y == pytest.approx(5316300.0, abs=100)  # 0.9996 of the meridian arc to 48 degrees


def test_blocks_and_cells(spark):
    p = spark.createDataFrame([(45.2, 100.3), (-39.9, 170.0), (-45.0, -75.1), (0.0, 0.0), (50.0, -180.0)], "lat double, lon double")
    assert [r[0] for r in p.select(G.block_of("lat", "lon")).collect()] == ["N50E100", "S30E170", "S40W080", "N00E000", "N50W180"]
    b = spark.createDataFrame([("N50E100",), ("S30W080",)], "b string").select(*G.block_bounds("b")).collect()
    assert tuple(b[0]) == (100, 40, 110, 50) and tuple(b[1]) == (-80, -40, -70, -30)
    names = spark.createDataFrame([("N44E103",), ("S05W072",), ("S11W080",), ("N00E009",)], "n string")
    assert [r[0] for r in names.select(G.round_cell("n")).collect()] == ["N50E100", "N00W080", "S10W080", "N00E000"]
    with pytest.raises(Exception, match="hemisphere"):
        spark.createDataFrame([("32APT",)], "t string").select(G.tile_epsg("t")).collect()


def test_points_on_borders(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    poly = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring], 0.0, 0.0, 10.0, 10.0)], "ring array<struct<x:double,y:double>>, xmin double, ymin double, xmax double, ymax double")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.0, 5.0), (3, 10.0, 10.0), (4, 10.001, 5.0), (5, -3.0, -3.0)], "id int, x double, y double")
    ids = lambda how, keep=True: sorted(r.id for r in J.points_in(pts, poly, how, keep, 4.0).collect())
    assert ids("within") == [1] and ids("intersects") == [1, 2, 3] and ids("within", False) == [2, 3, 4, 5]
    w = spark.createDataFrame([(0.0, 10.0), (10.0, 5.0), (5.0, 0.0), (5.0, 10.0)], "x double, y double")
    assert P.in_window(w, 0.0, 0.0, 10.0, 10.0).count() == 2 and P.in_window(w, 0.0, 0.0, 10.0, 10.0, inclusive=True).count() == 4
    centre = spark.createDataFrame([(1, 1000.0, 1000.0)], "epsg int, x double, y double")
    near = spark.createDataFrame([(1, 1, 1639.9, 1000.0), (2, 1, 1640.0, 1000.0), (3, 2, 1000.0, 1000.0), (4, 1, 360.1, 1639.0)], "id int, epsg int, x double, y double")
    assert sorted(r.id for r in J.overlap_join(near, centre).collect()) == [1, 4]


def raster(spark, values, e=-10.0):
    h, w = len(values), len(values[0])
    meta = spark.createDataFrame([(0, 32632, 10.0, e, 500000.0, 5000000.0, w, h)], "raster_id int, epsg int, a double, e double, c double, f double, width int, height int")
    pix = spark.createDataFrame([(0, i, j, None if v is None else float(v)) for i, r in enumerate(values) for j, v in enumerate(r)], "raster_id int, row int, col int, value double")
    return meta, pix


def test_sampling_at_raster_edges(spark):
    meta, pix = raster(spark, [[1, 2], [3, -9999]])
    pts = spark.createDataFrame([(1, 0, 500000.0, 5000000.0), (2, 0, 500020.0, 5000000.0), (3, 0, 500019.9, 4999990.0), (4, 0, 500005.0, 4999980.0), (5, 0, 500005.0, 4999980.1), (6, 0, 500011.0, 4999985.0)], "id int, raster_id int, x double, y double")
    got = {r.id: r.value for r in J.sample_raster(pts, meta, pix).collect()}
    assert got == {1: 1.0, 3: None, 5: 3.0, 6: None}
    with pytest.raises(Exception, match="north-up"):
        J.sample_raster(pts, raster(spark, [[1]], 10.0)[0], pix).collect()


def test_fill_and_terrain(spark):
    meta, pix = raster(spark, [[1, None, 3], [None, None, None], [7, None, 9]])
    filled = {(r.row, r.col): r.value for r in N.fill_nearest(pix).collect()}
    assert filled[0, 1] == 1 and filled[1, 1] == 1 and filled[1, 2] == 3 and filled[2, 1] == 7
    z = np.random.default_rng(1).normal(size=(5, 6))
    t = {(r.row, r.col): r for r in W.terrain(raster(spark, z.tolist())[1]).collect()}
    px, py = np.gradient(z, 10)
    aspect = np.pi / 2 - np.arctan2(py, px)
    for (i, j), r in t.items():
        assert r.slope == pytest.approx(math.hypot(px[i, j], py[i, j])) and r.aspect_cos == pytest.approx((math.cos(aspect[i, j]) + 1) / 2)


def test_fill_nearest_by_brute_force(spark):
    """Rasters of any shape and share of holes, in one table, beside columns of other kinds; ties by row, then column."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k, (h, w, share) in enumerate([(1, 1, 0.0), (1, 1, 1.0), (1, 40, 0.9), (40, 1, 0.9), (13, 17, 0.5), (30, 30, 0.97), (25, 60, 0.995), (9, 9, 1.0), (12, 12, 0.0)]):
        gone = rng.random((h, w)) < share
        have = np.argwhere(~gone)
        for i in range(h):
            for j in range(w):
                v = None if gone[i, j] else float(rng.integers(0, 10**6))
                rows.append((f"r{k}", k % 2, i + 100, j - 7, v, "kept", [i]))
                want[f"r{k}", k % 2, i + 100, j - 7] = v
        for i, j in np.argwhere(gone).tolist() if len(have) else []:
            a, b = min(have.tolist(), key=lambda p: ((p[0] - i) ** 2 + (p[1] - j) ** 2, p[0], p[1]))
            want[f"r{k}", k % 2, i + 100, j - 7] = want[f"r{k}", k % 2, a + 100, b - 7]
    df = spark.createDataFrame(rows, "raster string, band int, row long, col long, height double, note string, more array<int>").repartition(7)
    for size in ("10000", "37"):  # batches that end inside rows of a raster
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = N.fill_nearest(df, ("raster", "band"), "height").collect()
        assert len(got) == len(rows) and {(r.raster, r.band, r.row, r.col): r.height for r in got} == want
        assert all(r.note == "kept" and r.more == [r.row - 100] for r in got)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = {(r.row, r.col): r.value for r in N.fill_nearest(raster(spark, [[5, None, None, None, None]])[1], radius=2).collect()}
    assert [near[0, j] for j in range(5)] == [5, 5, 5, None, None]
    sparse = [(0, 0, 0, 1.0), (0, 0, 9, None), (0, 7, 8, 2.0), (0, 3, 3, None), (0, 2, 5, 7.0)]  # cells of the box are missing
    near = {(r.row, r.col): r.value for r in N.fill_nearest(spark.createDataFrame(sparse, "raster_id int, row long, col long, value double")).collect()}
    assert near == {(0, 0): 1, (0, 9): 7, (7, 8): 2, (3, 3): 7, (2, 5): 7}
    plan = N.fill_nearest(df, ("raster", "band"), "height")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ENSURE_REQUIREMENTS") == 3
    assert N.fill_nearest(df.limit(0), ("raster", "band"), "height").count() == 0


def test_filled_before_terrain_and_resampling(spark):
    pix = raster(spark, [[10, None, 30]])[1]
    fine = {(r.row, r.col): r.value for r in R.upsample(pix, 2, 1).collect()}
    # the middle is filled with 10: its neighbours lean on it, itself it is missing again
    assert [fine[0, j] for j in range(6)] == [10, 10, None, None, 25, 30]
    pix = raster(spark, [[10, None, 30]] * 2)[1]
    steep = {r.col: r.slope for r in W.terrain(pix).collect()}
    assert [steep[j] for j in range(3)] == pytest.approx([0.0, 1.0, 2.0])
    assert [r.slope is None for r in sorted(W.terrain(pix, remask=True).collect(), key=lambda r: r.col)] == [False, False, True, True, False, False]


def test_overlap_policies(spark):
    df = spark.createDataFrame([(0, j, s, float(s), 20) for j in range(20) for s in (0, 6, 12, 14) if s - 1 <= j < s + 7], "row int, col int, start int, pred double, width int").withColumn("seq", F.col("start"))
    own = A.merge_windows(df.withColumn("r0", F.lit(0)).withColumn("h", F.lit(1)), ["col"], "cropped", size=8, crop=1, axes=(("row", "r0", "h"), ("col", "start", "width")))
    got = {r.col: r.value for r in own.collect()}
    assert got == {j: float(14 if j >= 14 else j // 6 * 6) for j in range(20)}
    for bad in ({"policy": "first"}, {"policy": "cropped"}, {"policy": "cropped", "size": 4, "crop": 2, "axes": ()}):
        with pytest.raises(ValueError):
            A.merge_windows(df, ["col"], **bad)


def test_products_of_the_same_tile(spark):
    products = spark.createDataFrame([("A1", "31AAA", 5), ("B1", "32TPT", 5), ("B0", "32TPT", 5), ("C", "32TPT", 6)], "product string, tile string, stamp int")
    asks = spark.createDataFrame([(1, "A9", "31AAA", 5), (2, "B9", "32TPT", 5), (3, "C", "32TPT", 6), (4, "D", "33XXX", 5)], "request int, name string, tile string, stamp int")
    assert {r.request: r.product for r in J.resolve_product(asks, products).collect()} == {1: "A1", 2: "B0", 3: "C", 4: None}


def test_patches_touch_borders_and_windows_cover(spark):
    meta, pix = raster(spark, np.arange(30).reshape(5, 6).tolist())
    pts = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 2, 3), (3, 0, 4, 5)], "id int, raster_id int, row int, col int")
    got = {r.id: r.patch for r in R.extract_patches(pts, pix, 3, 2).collect()}
    assert got[2] == [8, 9, 10, 14, 15, 16, 20, 21, 22] and got[1] == [None, None, None, None, 0, 1, None, 6, 7] and got[3][4] == 29
    for h, w in ((20, 20), (21, 40), (55, 33)):
        m = spark.createDataFrame([(0, h, w)], "raster_id int, height int, width int")
        seen = np.zeros((h, w), bool)
        rows = R.windows_overlap(m, 20, 8).collect()
        for r in rows:
            assert 0 <= r.row0 and r.row1 <= h and 0 <= r.col0 and r.col1 <= w
            seen[r.row0 : r.row1, r.col0 : r.col1] = True
        assert seen.all() and one(R.window_count(m, 20, 8)).windows == len(rows)
        seen[:] = False
        for r in R.windows_padded(m, 20, 3).collect():
            seen[r.row0 : r.row0 + 14, r.col0 : r.col0 + 14] = True
        assert seen.all()


def test_class_mode_ties_and_empty_patches(spark):
    df = spark.createDataFrame([(1, 40), (1, 30), (1, 30), (1, 40), (2, None), (3, 126)], "id int, c int")
    assert {r.id: r["mode"] for r in A.class_mode(df, ["id"], "c").collect()} == {1: 30, 3: 126}
    v = one(A.patch_validity(df, ["id"], F.col("c").isNotNull()))
    assert (v.whole, v.part, v.never) == (2, 0, 1)


def test_sampling_of_small_tiles_and_repartitioning(spark):
    df = spark.createDataFrame([(t, 2020, i) for t, n in ((1, 3), (2, 10), (3, 101)) for i in range(n)], "tile int, year int, idx int")
    picks = [sorted(map(tuple, M.sample_per_tile(df.repartition(p), 0.1, 1).collect())) for p in (1, 7)]
    assert picks[0] == picks[1] and [sum(x[0] == t for x in picks[0]) for t in (1, 2, 3)] == [0, 1, 10]
    scores = spark.createDataFrame([("r", 2, 0.1, 0.5), ("r", 1, 0.1, 0.4), ("r", 0, 0.1, 0.4)], "region string, trial int, label_distance double, class_distance double")
    assert one(W.best_trial(scores, ["region"])).trial == 0
    moved = M.jitter_coords(spark.createDataFrame([(i, 89.999, 179.999) for i in range(40)], "id int, lat double, lon double"), 0, 5, 1, ["id"]).collect()
    assert all(-90 <= r.lat <= 90 and -180 <= r.lon <= 180 for r in moved) and len({r.lat for r in moved}) > 30


def test_leap_day_and_storage(spark):
    days = (datetime.date(2020, 12, 31) - datetime.date(2019, 4, 17)).days
    r = one(spark.range(1).select(*X.encode_doy(F.lit(days))))
    assert r.doy_cos == pytest.approx((math.cos(2 * math.pi * 366 / 365) + 1) / 2)
    df = spark.createDataFrame([(NAN,), (INF,), (None,), (-3.0,), (70000.0,), (12.9,)], "v double")
    assert [x[0] for x in df.select(X.to_storage("v")).collect()] == [65535, 65535, 65535, 0, 65535, 12]
    assert [x[0] for x in df.select(X.to_storage("v", "float")).collect()] == [-9999, -9999, -9999, 0, 70000, 12.9]
    assert [x[0] for x in spark.range(-3, 8).select(X.reflect("id", F.lit(5))).collect()] == [2, 1, 0, 0, 1, 2, 3, 4, 4, 3, 2]


def test_catalogues_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("t1", 2019, "b"), ("t1", 2020, "a"), ("t1", 2019, "a"), ("t2", 2020, "c")], "tile string, year int, file string")
    assert {r.tile: r.files for r in S.tile_catalog(df).collect()} == {"t1": ["a", "b"], "t2": ["c"]}
    assert {r.tile: r.files for r in S.tile_year_map(df).collect()} == {"t1": {2019: "a", 2020: "a"}, "t2": {2020: "c"}}
    assert K.pending(df, df.where("year = 2020"), ["tile", "year"]).count() == 2
    with pytest.raises(ValueError):
        K.pending(df, df.drop("year"), ["tile", "year"])
    calls = []

    def build():
        calls.append(1)
        return df

    for version in (1, 1, 2):
        assert K.cached(spark, f"{tmp_path}/c", version, ["tile"], build).count() == 4
    assert len(calls) == 2
    K.write_metrics_csv(spark.createDataFrame([("a", 2020.0, 1.23456), ("b", None, NAN)], "k string, year double, v double"), f"{tmp_path}/m", ["year"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part*")))
    assert "a,2020,1.2346" in text and "b,," in text
    old, new = spark.createDataFrame([(1, "x"), (2, "bad")], "k int, v string"), spark.createDataFrame([(2, "y")], "k int, v string")
    assert {r.k: r.v for r in K.merge_retry(old, new, ["k"]).collect()} == {1: "x", 2: "y"}


def test_shard_scan_prunes_partitions(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id as string) tile", "id idx", "cast(id % 3 + 2019 as int) year", "cast(id % 20 as int) shard")
    df.write.partitionBy("year", "shard").parquet(f"{tmp_path}/f")
    scan = S.scan_footprints(spark, f"{tmp_path}/f", [2020], debug=True)
    assert scan.count() == df.where("year = 2020 and shard < 2").count()
    assert "PartitionFilters: [isnotnull" in scan._jdf.queryExecution().toString() or "PartitionFilters: [year" in scan._jdf.queryExecution().toString()


def test_linear_probe_recovers_weights(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = x @ [1, -2, 0.5, 3] + 7
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    w, b = H.fit_linear_probe(df, "x", "y")
    assert np.allclose(w, [1, -2, 0.5, 3], atol=1e-6) and b == pytest.approx(7)


def test_pareto_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(c), float(g)) for i, (c, g) in enumerate(rng.integers(0, 25, size=(150, 2)))]
    got = {r.id for r in W.pareto(spark.createDataFrame(rows, "id int, cost double, gain double"), "cost", "gain", 7).collect()}
    assert got == {i for i, c, g in rows if not any(d <= c and h >= g and (d < c or h > g) for _, d, h in rows)}


def test_pareto_with_an_outlier(spark):
    """One cost far from all others leaves the ranges even; equal costs, an empty table."""
    rng = np.random.default_rng(5)
    rows = [(i, float(c), float(g)) for i, (c, g) in enumerate(zip(rng.integers(0, 400, 900), rng.integers(0, 50, 900)))] + [(9000, 1e12, 60.0), (9001, -1e12, -1.0)]
    want = {i for i, c, g in rows if not any(b <= c and h >= g and (b < c or h > g) for _, b, h in rows)}
    df = spark.createDataFrame(rows, "i int, c double, g double")
    assert {r.i for r in W.pareto(df, "c", "g").collect()} == want
    assert {r.i for r in W.pareto(df.where("i < 4"), "c", "g", 2).collect()} and W.pareto(df.limit(0), "c", "g").count() == 0


def test_point_store_opens_few_files(spark, tmp_path):
    from canopyframe.sources.points import scan_point_store, write_point_store

    rng = np.random.default_rng(7)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 4000), rng.uniform(-90, 90, 4000)))]
    rows += [(9000, 180.0, 90.0), (9001, -180.0, -90.0), (9002, None, 1.0), (9003, 10.0, 20.0), (9004, 10.0, 20.0)]
    df = spark.createDataFrame(rows, "i int, lon double, lat double")
    write_point_store(df, f"{tmp_path}/p", 64)
    for box in ((10.0, 20.0, 25.0, 30.0), (10.0, 20.0, 10.0, 20.0), (-180.0, -90.0, 180.0, 90.0), (179.99, 89.99, 180.0, 90.0), (500.0, 0.0, 501.0, 1.0)):
        w, s, e, n = box
        got = scan_point_store(spark, f"{tmp_path}/p", *box)
        assert sorted(r.i for r in got.collect()) == [i for i, x, y in rows if x is not None and w <= x <= e and s <= y <= n]
    few = scan_point_store(spark, f"{tmp_path}/p", 10.0, 20.0, 25.0, 30.0)
    assert len(few.inputFiles()) <= 8 and len(spark.read.parquet(f"{tmp_path}/p").inputFiles()) == 64
