"""Exact ranks and percentiles against numpy: any magnitude, ties, hot groups, null groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import ranks as K


def test_digits_keep_the_order(spark):
    rng = np.random.default_rng(2)
    values = [0.0, 1.0, 5e-324, 2.0**-1022, 1.7976931348623157e308, math.inf, 3.0, 0.1] + [2.0**k for k in range(-1074, 1024, 7)]
    values += [float(np.nextafter(2.0**k, 0)) for k in range(-1073, 1024, 7)] + rng.lognormal(0, 100, 500).tolist() + (1000 + rng.normal(size=500) * 1e-9).tolist()
    values = sorted(values + [-v for v in values])
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select("i", *[d(F.col("v")).alias(f"d{k}") for k, d in enumerate(K.DOUBLES)]).orderBy("i").collect()
    for a, b in zip(got, got[1:]):
        assert a.d0 <= b.d0 and a.d1 <= b.d1 and a.d2 <= b.d2
    for r in got:
        assert r.d2 == values[r.i] and (r.d0 == r.d2 or abs(r.d0 - r.d2) <= abs(r.d2) * 2.0**-11 or math.isinf(r.d0))


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.normal(50, 20, 4000), 1), "wide": rng.lognormal(0, 60, 700) * rng.choice([-1, 1], 700), "same": np.full(300, 7.25), "one": np.array([-3.5]), "two": np.array([1.0, 2.0]), None: rng.uniform(-1, 1, 50)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("one", math.nan), ("none", None), ("none", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = {r.g: r.q for r in K.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, shares), rel=1e-12)
    first = {r.g: r.q for r in K.percentiles(df, ["g"], "v", shares, discrete=True).collect()}
    for g, vs in groups.items():
        assert first[g] == [float(np.sort(vs)[max(math.ceil(p * len(vs)), 1) - 1]) for p in shares]
    whole = K.percentiles(df, [], "v", (0.5,)).collect()
    assert len(whole) == 1 and whole[0].q[0] == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    assert K.percentiles(df.limit(0), ["g"], "v", shares).count() == 0 and K.percentiles(df.limit(0), [], "v", shares).count() == 0
    named = {r.g: (r.n, r.m) for r in K.with_percentiles(df.groupBy("g").agg(F.count("v").alias("n")), df, ["g"], "v", {"m": 0.5}).collect()}
    assert named["none"] == (1, None) and named["two"] == (2, 1.5) and named[None][0] == 50


def test_no_task_holds_a_group(spark):
    """Rows of one group are counted where they are; what is shuffled are digits with their counts."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") % 50).cast("double").alias("v")).repartition(8)
    rows = df.select("g", F.col("v").alias("_k"))
    wanted = spark.createDataFrame([(1, 0), (1, 100_000)], "g int, rank long")
    found = K.select_ranks(rows, ["g"], wanted)
    assert {(r.rank, r._k) for r in found.collect()} == {(0, 0), (100_000, 25.0)}
    whole = rows.select("g", (F.col("_k") * 10**12).cast("long").alias("_k"))
    assert {(r.rank, r._k) for r in K.select_ranks(whole, ["g"], wanted, digits=K.LONGS).collect()} == {(0, 0), (100_000, 25 * 10**12)}
    plan = K.percentiles(df, ["g"], "v", (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan or "percentile" not in plan


def test_many_groups_without_broadcast(spark):
    """More groups than are broadcast."""
    df = spark.range(60_000).select((F.col("id") % 25_000).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    got = K.percentiles(df, ["g"], "v", (0.5,))
    want = df.groupBy("g").agg(F.median("v").alias("m"))
    assert got.join(want, "g").where(F.abs(F.col("q")[0] - F.col("m")) > 1e-9).count() == 0 and got.count() == 25_000
