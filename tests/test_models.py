"""Fitted models against numpy, and formats against Python's own."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from canopyframe.operators import joins as J
from canopyframe.operators import raster as R
from canopyframe.operators import sampling as M
from canopyframe.plans.bind import Tables
from canopyframe.plans.catalog import QUERIES
from canopyframe.sources import sinks as K


def test_principal_components(spark, sf):
    rows = [(r.vec_id, r.q) for r in Tables(spark, sf).emb.collect() if -128.0 not in r.q]
    x = np.array([q for _, q in rows])
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    _, loads = np.linalg.eigh(np.cov(x.T))
    loads = loads[:, ::-1][:, :3]
    loads = loads * np.sign(loads[np.abs(loads).argmax(0), range(3)])
    score = x @ loads
    low, high = np.percentile(score, [2, 98], axis=0)
    want = np.clip((score - low) / (high - low), 0, 1)
    got = {(r.vec_id, r.component): r.level for r in QUERIES["g15_pca_rgb"](spark, sf).collect()}
    assert len(got) == 3 * len(rows)
    assert max(abs(got[v, k] - want[i, k]) for i, (v, _) in enumerate(rows) for k in range(3)) < 2e-3


def test_linear_probe_scores_vary_with_the_label(spark, sf):
    rows = QUERIES["h01_fit_linear_probe"](spark, sf).collect()
    label, pred = np.array([r.label for r in rows], float), np.array([r.pred for r in rows])
    assert len(rows) > 100 and abs(pred.mean() - label.mean()) < 1e-2  # the intercept is not penalised
    assert np.corrcoef(label, pred)[0, 1] > 0.1


def test_four_decimals(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1e3, 1e3) for _ in range(2000)] + [round(rng.uniform(-500, 500), 5) for _ in range(4000)] + [rng.randrange(10**7) / 2**k for k in range(20) for _ in range(20)]
    values += [0.0, -0.0, 0.00005, -0.00005, 0.00015, 2.5e-5, 1e-300, 123456789.00005, 0.03125, 0.09375, 899999999999.9999, 1e12, -1e15, 1e18]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").coalesce(1).select(K.four_decimals(F.col("v"))).collect()]
    assert got == [f"{v:.4f}" for v in values]


def test_quota_of_any_size(spark):
    df = spark.range(5000).withColumn("key", F.col("id") % 700)
    order = [(r.id, r.o) for r in df.select("id", M.md5_order(3, "id").alias("o")).collect()]
    order.sort(key=lambda r: (r[1], r[0]))
    for n in (0, 1, 7, 4999, 5000, 9000):
        assert sorted(r.id for r in M.take_quota(df, n, 3, ["id"]).collect()) == sorted(i for i, _ in order[:n])


def test_ring_meets_box(spark):
    """A polygon and a box, by sampling both finely."""
    rng = random.Random(4)
    rows = []
    for k in range(400):
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 7)))
        ring = [(round(rng.uniform(0.5, 3) * math.cos(a), 3), round(rng.uniform(0.5, 3) * math.sin(a), 3)) for a in angles]
        x, y = rng.uniform(-4, 3), rng.uniform(-4, 3)
        rows.append((k, ring, x, y, x + rng.choice([0.01, 0.5, 2, 7]), y + rng.choice([0.01, 0.5, 2, 7])))
    df = spark.createDataFrame(rows, "k int, ring array<struct<x:double,y:double>>, x0 double, y0 double, x1 double, y1 double")
    got = {r.k: r.hit for r in df.select("k", J.meets_box(F.array("ring"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("hit")).collect()}

    def inside(px, py, ring):
        n, c = len(ring), False
        for i in range(n):
            (ax, ay), (bx, by) = ring[i], ring[(i + 1) % n]
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                c = not c
        return c

    def meets(ring, x0, y0, x1, y1):
        n = len(ring)
        for i in range(n):
            (ax, ay), (bx, by) = ring[i], ring[(i + 1) % n]
            for t in np.linspace(0, 1, 2001):
                px, py = ax + t * (bx - ax), ay + t * (by - ay)
                if x0 <= px <= x1 and y0 <= py <= y1:
                    return True
        return any(inside(px, py, ring) for px in (x0, x1) for py in (y0, y1))

    differ = [k for k, ring, *box in rows if got[k] != meets(ring, *box)]
    assert len(differ) <= 2 and sum(got.values()) > 50  # an edge may slip between the sampled points


def test_rows_of_pixels_under_random_shapes(spark):
    """Runs of pixels against the tests of single points and boxes: stars with holes, two parts, grids turned either way."""
    from canopyframe.operators import shapes as S

    rng = random.Random(8)

    def star(cx, cy, low, high, n):
        return [(cx + rng.uniform(low, high) * math.cos(2 * math.pi * k / n), cy + rng.uniform(low, high) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    polys = []
    for k in range(24):
        cx, cy = rng.uniform(-30, 150), rng.uniform(-130, 30)
        parts = [[star(cx, cy, 25, 45, rng.randrange(3, 12)), star(cx, cy, 5, 11, rng.randrange(3, 6))], [star(cx + 80, cy - 10, 3, 25, rng.randrange(3, 7))]]
        polys.append((k, 1 + k % 2, [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]))
    polys += [(90, 1, [[[{"x": x, "y": y} for x, y in ((0.0, 0.0), (40.0, 0.0), (40.0, -30.0), (0.0, -30.0))]]]), (91, 1, [[[{"x": x, "y": y} for x, y in ((500.0, 0.0), (540.0, 0.0), (540.0, -30.0))]]])]
    polys = spark.createDataFrame(polys, "zone int, epsg int, parts array<array<array<struct<x:double,y:double>>>>")
    metas = spark.createDataFrame([(7, 1, 10.0, -10.0, 0.0, 0.0, 12, 10), (8, 2, 10.0, 10.0, -20.0, -100.0, 15, 13)], "raster_id int, epsg int, a double, e double, c double, f double, width int, height int")
    pixels = spark.createDataFrame([(m, i, j, float(i * j)) for m, w, h in ((7, 12, 10), (8, 15, 13)) for i in range(h) for j in range(w)], "raster_id int, row int, col int, value double")
    laid = pixels.join(metas, "raster_id").selectExpr("*", "c + (col + 0.5D) * a AS x", "f + (row + 0.5D) * e AS y")
    each = S.shaped(polys).join(laid, "epsg")
    corners = [F.col("x") - 5, F.col("y") - 5, F.col("x") + 5, F.col("y") + 5]
    for touched, test in ((False, S.inside(F.col("x"), F.col("y"), F.col("rings"))), (True, S.meets_box(F.col("rings"), *corners))):
        want = {tuple(r) for r in each.where(test).select("zone", "raster_id", "row", "col").collect()}
        got = [(r.zone, r.raster_id, r.row, r.col) for r in R.clip_polygon(polys, metas, pixels, touched=touched, cell=60.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    square = {(r.row, r.col) for r in R.clip_polygon(polys.where("zone = 90"), metas, pixels, touched=True).collect()}
    assert square == {(i, j) for i in range(4) for j in range(5)}  # borders that only touch are in
