"""Queries that write what they derive from the tables and read it back through the scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators.aggregates import rounded
from ..operators.windows import best_trial
from ..operators.sampling import matched_subsample
from ..operators.scoring import predict_footprints
from ..sources import scans as S
from ..sources.points import scan_point_store, write_point_store
from ..sources import sinks as K
from ..streaming.incremental import read_merged, write_partials
from ..semantics import written
from .bind import Tables, query
from .pipelines import compact_dataset, compare_maps
from .queries_space import _M02, md5_sql
from .queries_stats import METRICS, r


def _folder(spark) -> str:
    """A new folder where all executors can read and write."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


@query("s01_scan_footprints", "SELECT tile, year, shard, ok, ln, pk, agbd, price FROM fp WHERE year IN (1996, 1998)")
def _(spark, d):
    path = _folder(spark)
    columns = ["tile", "ok", "ln", "pk", "agbd", "price", "year", "shard"]
    table = Tables(spark, d).fp.select(*columns)
    table.repartition("year", "shard").write.partitionBy("year", "shard").parquet(path)
    return S.scan_footprints(spark, path, [1996, 1998], schema=table.schema).select("tile", "year", "shard", "ok", "ln", "pk", "agbd", "price")


_SAMPLES = "(SELECT tile, year, idx, agbd, region_cla, rh98 * 9.5e0 + tax * 100 - 2 AS p1, rh98 * 10.5e0 + tax * 20 - 9 AS p2 FROM fpx)"


def _results(spark, d) -> str:
    path = _folder(spark)
    features = {"height": [F.col("rh98")], "price": [F.col("price")], "tax": [F.col("tax")]}
    models = {"one": ([9.5, 100.0], -2.0), "two": ([10.5, 20.0], -9.0)}
    predict_footprints(Tables(spark, d).fpx, features, ["height", "tax"], models, "agbd", ["tile", "year", "idx"], ["region_cla"], path)
    return path


@query("s12_results", f"SELECT model, count(*) AS n, {r('sqrt(avg((p - agbd) ** 2))', 'rmse')} FROM (SELECT 'one' AS model, agbd, p1 AS p FROM {_SAMPLES} UNION ALL SELECT 'two', agbd, p2 FROM {_SAMPLES}) GROUP BY model")
def _(spark, d):
    return rounded(spark.read.parquet(f"{_results(spark, d)}/models"))


@query("s12_result_samples", f"SELECT tile, year, idx, agbd, region_cla, CAST(2 AS BIGINT) AS members, {r('(p1 + p2) / 2', 'mean')} FROM {_SAMPLES}")
def _(spark, d):
    return rounded(spark.read.parquet(f"{_results(spark, d)}/samples").select("tile", "year", "idx", "agbd", "region_cla", "members", "mean"))


@query("s04_scan_class_embeddings", f"SELECT cls AS mapping, {r('avg(agbd)', 'v0')}, {r('avg(rh98)', 'v1')}, {r('max(disc)', 'v2')} FROM fp GROUP BY cls")
def _(spark, d):
    path = _folder(spark)
    g = Tables(spark, d).fp.groupBy("cls").agg(F.avg("agbd").alias("dim0"), F.avg("rh98").alias("dim1"), F.max("disc").alias("dim2"), F.min("disc").alias("dim3"), F.max("tax").alias("dim4"))
    g.select(*[f"dim{i}" for i in range(5)], F.col("cls").alias("mapping")).write.option("header", True).csv(path)
    return rounded(S.scan_class_embeddings(spark, path).select("mapping", *[F.col("vector")[i].alias(f"v{i}") for i in range(3)]))


def _collections(features, feature):
    """Arrays of at most some thousand features, each to be written as one file, however many there are: GeoJSON is read whole
    files at a time."""
    dealt = features.select(F.pmod(F.xxhash64("plot"), F.lit(max(16, -(-features.count() // 2000)))).alias("part"), feature.alias("feature"))
    return dealt.groupBy("part").agg(F.collect_list("feature").alias("features"))


@query("s05_scan_plots", "SELECT CAST(plot AS VARCHAR) AS plot, round(lon - 0.05e0, 4) AS xmin, round(lat - 0.05e0, 4) AS ymin, round(lon + 0.05e0, 4) AS xmax, round(lat + 0.05e0, 4) AS ymax, CAST(4 AS INT) AS points FROM plots")
def _(spark, d):
    path = _folder(spark)
    c = [F.round(v, 4) for v in G.cell("lon", "lat")]
    ring = F.array(*[F.array(c[i], c[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3), (0, 1))])
    feature = F.struct(F.struct(F.col("plot")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    p = _collections(Tables(spark, d).plots, feature)
    p.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return S.scan_plots(spark, path).select(F.col("properties")["plot"].alias("plot"), "xmin", "ymin", "xmax", "ymax", F.size("ring").alias("points"))


@query("s07_point_store", "SELECT plot, lon, lat FROM plots WHERE lon BETWEEN -60 AND 40 AND lat BETWEEN -20 AND 45")
def _(spark, d):
    path = f"{_folder(spark)}/points"
    write_point_store(Tables(spark, d).plots.select("plot", "lon", "lat"), path, 32)
    return scan_point_store(spark, path, -60, -20, 40, 45)


@query("s05_scan_parts", """SELECT CAST(plot AS VARCHAR) AS plot, 1 + plot % 2 AS parts, 2 AS rings, round(lon - 1, 4) AS xmin, round(lat - 1, 4) AS ymin, round(CASE WHEN plot % 2 = 1 THEN lon + 4 ELSE lon + 1 END, 4) AS xmax, round(lat + 1, 4) AS ymax FROM plots""")
def _(spark, d):
    """Squares with a hole, every other one with a second part beside it, written as GeoJSON and read again."""
    path = _folder(spark)
    ring = lambda half, dx=0.0: F.array(*[F.array(F.round(F.col("lon") + dx + i * half, 4), F.round(F.col("lat") + j * half, 4)) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    one, two = F.array(ring(1.0), ring(0.5)), F.array(ring(0.5, 3.5))
    text = lambda kind, c: F.to_json(F.struct(F.struct("plot").alias("properties"), F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geometry")))
    feature = F.when(F.col("plot") % 2 == 1, text("MultiPolygon", F.array(one, two))).otherwise(text("Polygon", one))
    p = _collections(Tables(spark, d).plots, feature)
    p.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("features", ","), F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    out = S.scan_plots(spark, path)
    return out.select(F.col("properties")["plot"].alias("plot"), F.size("parts").alias("parts"), F.size(F.col("parts")[0]).alias("rings"), "xmin", "ymin", "xmax", "ymax")


@query("s06_scan_uri_list", "SELECT concat('store://area/', year(o_orderdate), '/', o_custkey % 60, 'N/', o_orderkey, '.tiff') AS uri FROM orders WHERE year(o_orderdate) = 1997")
def _(spark, d):
    path = _folder(spark)
    Tables(spark, d).raw("orders").select(F.expr("concat('store://area/', year(o_orderdate), '/', o_custkey % 60, 'N/', o_orderkey, '.tiff')").alias("value")).write.text(path)
    return S.scan_uri_list(spark, path, 1997)


@query("s09_write_dataset", "SELECT split, tile, year, idx FROM fpx WHERE split <> 'val'")
def _(spark, d):
    path = _folder(spark)
    x = written(Tables(spark, d).fpx.where("split <> 'val'").select("split", "tile", "year", "idx"))  # places are found once for both layouts
    for mode in ("train", "test"):
        K.write_dataset(x.where(F.col("split") == mode).select("tile", "year", "idx"), path, mode)
    return spark.read.parquet(path).select("split", "tile", "year", "idx")


@query("s10_write_stats", "SELECT region_cla, CAST(avg(rh98) AS FLOAT) AS mean FROM fp GROUP BY region_cla")
def _(spark, d):
    stats = Tables(spark, d).fp.groupBy("region_cla").agg(F.avg("rh98").alias("mean"))
    return spark.read.parquet(K.write_stats(stats, _folder(spark), [2020], [], True))


@query("s13_write_metrics_csv", "SELECT CAST(plot AS VARCHAR) AS plot, CAST(year AS VARCHAR) AS year, printf('%.4f', est_b) AS est_b FROM plots")
def _(spark, d):
    path = _folder(spark)
    K.write_metrics_csv(Tables(spark, d).plots.select("plot", "year", "est_b"), path, ["year"])
    return spark.read.option("header", True).csv(path)


@query("s15_cached", f"SELECT plot, {r('agb', 'agb')} FROM plots")
def _(spark, d):
    path, plots = _folder(spark), Tables(spark, d).plots
    K.cached(spark, path, 2, ["plot", "agb"], lambda: plots.select("plot", (F.col("agb") * 0).alias("agb")))
    K.cached(spark, path, 3, ["plot", "agb"], lambda: plots.select("plot", "agb"))
    return rounded(K.cached(spark, path, 3, ["plot", "agb"], lambda: plots.select("plot", (F.col("agb") * 0).alias("agb"))))


@query("f17_round_cell", """SELECT plot, CASE WHEN south AND t <= 9 THEN 'N00' ELSE concat(CASE WHEN south THEN 'S' ELSE 'N' END, lpad(CAST(CAST(CASE WHEN south THEN floor(t / 10e0) * 10 ELSE ceil(t / 10e0) * 10 END AS INT) AS VARCHAR), 2, '0')) END
    || CASE WHEN west THEN 'W' ELSE 'E' END || lpad(CAST(CAST(CASE WHEN west THEN ceil(l / 10e0) * 10 ELSE floor(l / 10e0) * 10 END AS INT) AS VARCHAR), 3, '0') AS block
    FROM (SELECT plot, floor(lat) + 1 < 0 AS south, abs(floor(lat) + 1) AS t, floor(lon) < 0 AS west, abs(floor(lon)) AS l FROM plots)""")
def _(spark, d):
    return Tables(spark, d).plots.select("plot", G.round_cell(G.cell_name(F.floor("lat") + 1, F.floor("lon"))).alias("block"))


@query("compact_dataset", f"""{_M02}, best AS (SELECT region_cla, trial FROM ld JOIN kd USING (region_cla, trial) QUALIFY row_number() OVER (PARTITION BY region_cla ORDER BY ld.v, kd.v, trial) = 1)
    SELECT tile, year, idx, {md5_sql('42', 'tile', 'year', 'idx')} AS layout FROM x JOIN best USING (region_cla, trial) WHERE hit""")
def _(spark, d):
    return compact_dataset(Tables(spark, d).fpx, 0.3, 3).select("tile", "year", "idx", "layout")


@query("best_trials", f"{_M02} SELECT region_cla, CAST(trial AS INT) AS trial FROM ld JOIN kd USING (region_cla, trial) QUALIFY row_number() OVER (PARTITION BY region_cla ORDER BY ld.v, kd.v, trial) = 1")
def _(spark, d):
    return best_trial(matched_subsample(Tables(spark, d).fpx, 0.3, 3), ["region_cla"]).select("region_cla", "trial")


_CM = METRICS.replace("pred", "e").replace("agbd", "agb")


@query("compare_maps", f"""WITH k AS (SELECT * FROM plots WHERE year >= 2017 AND n >= 5 AND cov_a >= 0.5e0 AND agb <= 400 AND est_a IS NOT NULL AND est_b IS NOT NULL),
    l AS (SELECT 'est_a' AS map, agb, est_a AS e FROM k UNION ALL SELECT 'est_b', agb, est_b FROM k) SELECT map, {_CM} FROM l GROUP BY map""")
def _(spark, d):
    return rounded(compare_maps(Tables(spark, d).plots, ["est_a", "est_b"], "agb", {"coverage": F.col("cov_a") >= 0.5, "value": F.col("agb") <= 400}))


@query("streaming_chunk_stats", f"SELECT event_type, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std', 4)}, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def _(spark, d):
    root, schema = _folder(spark), spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    write_partials(stream, ["event_type"], "value", f"{root}/partials", f"{root}/checkpoint").awaitTermination()
    return rounded(read_merged(spark, f"{root}/partials", ["event_type"])).withColumn("std", F.round("std", 4))
