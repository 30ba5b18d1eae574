"""Queries of scans, filters, aggregates, windows, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import windows as W
from ..operators.aggregates import rounded
from ..schemas import CLASSES
from ..sources import scans as S
from ..sources import sinks as K
from .bind import Tables, query


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"


FILE = "concat('data_subset-', year, '-v4_', shard, '-20.h5')"
BOTH = "CASE WHEN pred IS NOT NULL AND agbd IS NOT NULL THEN"
P_, T_ = f"{BOTH} pred END", f"{BOTH} agbd END"
METRICS = ", ".join([
    "count(pred) AS n", r(f"avg({P_} - {T_})", "bias"), r(f"sqrt(avg(({P_} - {T_}) ** 2))", "rmse"), r(f"avg(abs({P_} - {T_}))", "mae"),
    r(f"CASE WHEN count(pred) >= 2 AND min({T_}) < max({T_}) AND min(pred) < max(pred) THEN corr({P_}, {T_}) END", "r"),
    r(f"CASE WHEN count(pred) >= 2 AND min({T_}) < max({T_}) THEN 1 - sum(({P_} - {T_}) ** 2) / (var_pop({T_}) * count(pred)) END", "r2"),
])


# scans and sinks ----------------------------------------------------------------------------------------------------


@query("s02_tile_catalog", f"SELECT tile, array_to_string(list_sort(list(DISTINCT {FILE})), ',') AS files FROM fp GROUP BY tile")
def _(spark, d):
    return S.tile_catalog(Tables(spark, d).fp.withColumn("file", F.expr(FILE))).select("tile", F.array_join("files", ",").alias("files"))


@query("s03_tile_year_map", f"SELECT tile, year, min({FILE}) AS file FROM fp GROUP BY tile, year")
def _(spark, d):
    return S.tile_year_map(Tables(spark, d).fp.withColumn("file", F.expr(FILE))).select("tile", F.explode("files").alias("year", "file"))


@query("s07_points_in_box", "SELECT plot, lon, lat FROM plots WHERE lon BETWEEN -60 AND 40 AND lat BETWEEN -20 AND 45")
def _(spark, d):
    return S.scan_points_bbox(S.with_cell(Tables(spark, d).plots), -60, -20, 40, 45).select("plot", "lon", "lat")


@query("s08_project_features", "SELECT CAST(agbd AS FLOAT) AS agbd, CAST(rh98 AS FLOAT) AS rh98, CAST(cls AS SMALLINT) AS cls, CAST(0 AS SMALLINT) AS offset_flag, ok, region_cla AS region FROM fp")
def _(spark, d):
    spec = [("agbd", "float"), ("rh98", "float"), ("cls", "smallint"), ("offset_flag", "smallint"), ("ok", "long")]
    return S.project_features(Tables(spark, d).fp, spec, F.col("region_cla").alias("region"), {"offset_flag": 0})


@query("s10_statistics_names", "SELECT split, concat('statistics_', array_to_string(list_sort(list(DISTINCT year)), '-'), '_all_full') AS name FROM fp GROUP BY split")
def _(spark, d):
    years = F.array_join(F.transform(F.sort_array(F.collect_set("year")), lambda y: y.cast("string")), "-")
    return Tables(spark, d).fp.groupBy("split").agg(F.concat(F.lit("statistics_"), years, F.lit("_all_full")).alias("name"))


_CATALOG = """SELECT 'all' AS regions, '2020' AS years, true AS lite, avg(agbd) AS mean FROM fp UNION ALL SELECT 'all', '2020', false, avg(rh98) FROM fp
    UNION ALL SELECT concat('R', region_cla), '2020', true, avg(agbd) FROM fp GROUP BY region_cla UNION ALL SELECT concat('not-R', region_cla), '2020', true, avg(-agbd) FROM fp GROUP BY region_cla"""


@query("s11_pick_stats", f"SELECT regions, years, {r('mean', 'mean')} FROM ({_CATALOG}) WHERE lite AND regions = 'not-R2' AND years = '2020'")
def _(spark, d):
    fp = Tables(spark, d).fp
    row = lambda df, regions, lite, v: df.agg(F.avg(v).alias("mean")).select(regions.alias("regions"), F.lit("2020").alias("years"), F.lit(lite).alias("lite"), "mean")
    by = fp.groupBy("region_cla")
    cat = row(fp, F.lit("all"), True, "agbd").union(row(fp, F.lit("all"), False, "rh98"))
    cat = cat.union(row(by, F.concat(F.lit("R"), "region_cla"), True, "agbd")).union(row(by, F.concat(F.lit("not-R"), "region_cla"), True, F.negative("agbd")))
    return rounded(S.pick_stats(cat, True, "R2", years=[2020]).select("regions", "years", "mean"))


@query("s13_csv_columns", "SELECT CAST(plot AS VARCHAR) AS plot, CAST(year AS VARCHAR) AS year, coalesce(printf('%.4f', est_a), '') AS est_a, printf('%.4f', agb) AS agb FROM plots")
def _(spark, d):
    return K.csv_columns(Tables(spark, d).plots.select("plot", "year", "est_a", "agb"), ["year"])


@query("s14_pending", "SELECT DISTINCT tile, year FROM fp WHERE (tile, year) NOT IN (SELECT (tile, year) FROM fp WHERE shard = 3)")
def _(spark, d):
    fp = Tables(spark, d).fp
    return K.pending(fp.select("tile", "year").distinct(), fp.where("shard = 3").select("tile", "year").distinct(), ["tile", "year"])


@query("s16_retry_errors", f"SELECT plot, {r('CASE WHEN est_a IS NULL THEN agb * 2 ELSE est_a END', 'value')} FROM plots")
def _(spark, d):
    plots = Tables(spark, d).plots
    bad = plots.where("est_a is null").select("plot")
    return rounded(K.retry_errors(plots, bad, lambda x: x.select("plot", (F.col("agb") * 2).alias("value")), plots.select("plot", F.col("est_a").alias("value")), ["plot"]))


# filters ------------------------------------------------------------------------------------------------------------


@query("p01_decode_latlon", f"SELECT ok, ln, pk, {r('sign(lat_dec) * (abs(lat_dec) + lat_off)', 'lat')}, {r('sign(lon_dec) * (abs(lon_dec) + lon_off)', 'lon')} FROM fp")
def _(spark, d):
    return rounded(P.decode_latlon(Tables(spark, d).fp).select("ok", "ln", "pk", "lat", "lon"))


@query("p02_filter_years", "SELECT year, count(*) AS n FROM fp WHERE year >= 1997 AND year IN (1996, 1997, 1999) GROUP BY year")
def _(spark, d):
    return P.filter_years(Tables(spark, d).fp, [1996, 1997, 1999], 1997).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("p03_select_plots", f"SELECT plot, n, year, {r('agb', 'agb')} FROM plots WHERE year >= 2017 AND n >= 5")
def _(spark, d):
    return rounded(P.select_plots(Tables(spark, d).plots).select("plot", "n", "year", "agb"))


_Q = "SELECT *, CASE WHEN pk % 5 = 0 THEN 0 ELSE 1 END AS quality, CASE WHEN ok % 7 = 0 THEN 1 ELSE 0 END AS degrade, 0.9e0 + disc AS sensitivity FROM fp"


def _quality(t):
    return t.fp.selectExpr("*", "CASE WHEN pk % 5 = 0 THEN 0 ELSE 1 END AS quality", "CASE WHEN ok % 7 = 0 THEN 1 ELSE 0 END AS degrade", "0.9D + disc AS sensitivity")


@query("p04_quality_filter", f"SELECT tile, count(*) AS n, {r('min(sensitivity)', 'least')} FROM ({_Q}) WHERE quality = 1 AND degrade = 0 AND sensitivity > 0.95e0 GROUP BY tile")
def _(spark, d):
    return rounded(P.quality_filter(_quality(Tables(spark, d))).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("sensitivity").alias("least")))


@query("p04_assert_quality", f"SELECT count(*) AS n, {r('min(sensitivity)', 'least')}, min(sensitivity) > 0.95e0 AS sound FROM ({_Q}) WHERE quality = 1 AND degrade = 0 AND sensitivity > 0.95e0")
def _(spark, d):
    return rounded(P.assert_quality(P.quality_filter(_quality(Tables(spark, d)))))


@query("p05_mask_nodata", f"SELECT raster_id, count(*) AS n, count(nullif(value, -9999)) AS valid, {r('avg(nullif(value, -9999))', 'mean')} FROM pix GROUP BY raster_id")
def _(spark, d):
    p = P.mask_nodata(Tables(spark, d).pix, "value", [-9999.0])
    return rounded(p.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("valid"), F.avg("value").alias("mean")))


@query("p06_finite_pairs", "SELECT member, count(*) AS n FROM preds WHERE pred IS NOT NULL GROUP BY member")
def _(spark, d):
    return P.finite_pairs(Tables(spark, d).preds, "pred", "agbd").groupBy("member").agg(F.count(F.lit(1)).alias("n"))


@query("p06_dropped_pairs", "SELECT count(*) AS n, count(*) FILTER (pred IS NULL) AS dropped FROM preds")
def _(spark, d):
    return P.dropped_pairs(Tables(spark, d).preds, "pred", "agbd")


@query("p07_in_window", "SELECT plot, lon, lat FROM plots WHERE -50.05e0 <= lon AND lon < 60.05e0 AND -30.05e0 < lat AND lat <= 30.05e0")
def _(spark, d):
    return P.in_window(Tables(spark, d).plots, -50.05, -30.05, 60.05, 30.05, "lon", "lat").select("plot", "lon", "lat")


@query("p08_scene_mask", "SELECT pk, aux % 12 AS scl, aux % 12 IN (0, 1, 6, 11) AS masked FROM pix")
def _(spark, d):
    return P.scene_mask(Tables(spark, d).pix.selectExpr("pk", "aux % 12 AS scl"), "scl")


@query("p09_drop_water", "SELECT pk, aux FROM (SELECT pk, aux, CASE WHEN aux % 3 = 0 THEN 80 WHEN aux % 7 = 0 THEN NULL ELSE 10 END AS cover FROM pix) WHERE coalesce(cover <> 80, true)")
def _(spark, d):
    p = Tables(spark, d).pix.selectExpr("pk", "aux", "CASE WHEN aux % 3 = 0 THEN 80 WHEN aux % 7 = 0 THEN NULL ELSE 10 END AS cover")
    return P.drop_water(p, "cover").select("pk", "aux")


_RULES = {"year": "year >= 2016", "value": "est_a <= 400", "coverage": "cov_a >= 0.5", "count": "n >= 3"}


@query("p10_apply_filters", """WITH a AS (SELECT coalesce(year >= 2016, false) AS r1, coalesce(est_a <= 400, false) AS r2, cov_a >= 0.5e0 AS r3, n >= 3 AS r4 FROM plots)
    SELECT 0 AS step, 'year' AS rule, count(*) FILTER (NOT r1) AS dropped FROM a UNION ALL SELECT 1, 'value', count(*) FILTER (r1 AND NOT r2) FROM a
    UNION ALL SELECT 2, 'coverage', count(*) FILTER (r1 AND r2 AND NOT r3) FROM a UNION ALL SELECT 3, 'count', count(*) FILTER (r1 AND r2 AND r3 AND NOT r4) FROM a""")
def _(spark, d):
    return P.apply_filters(Tables(spark, d).plots, {k: F.expr(v) for k, v in _RULES.items()})[1]


_PM = METRICS.replace("pred", "est_a").replace("agbd", "agb")


@query("p11_report_configs", f"""WITH c AS (SELECT 'all' AS config, * FROM plots UNION ALL SELECT 'recent', * FROM plots WHERE year >= 2017
    UNION ALL SELECT 'covered', * FROM plots WHERE cov_a >= 0.5e0 AND cov_b >= 0.5e0) SELECT config, {_PM} FROM c GROUP BY config""")
def _(spark, d):
    configs = {"all": F.lit(True), "recent": F.expr("year >= 2017"), "covered": F.expr("cov_a >= 0.5 and cov_b >= 0.5")}
    return rounded(A.metrics(P.report_configs(Tables(spark, d).plots, configs), "est_a", "agb", ["config"]))


_PRODUCT = "concat('S2A_MSIL2A_', {0}, 'T101031_N0500_R022_T', lpad(CAST(o_orderkey % 60 + 1 AS {1}), 2, '0'), 'TPT_x')"


@query("p12_parse_tokens", f"""SELECT o_orderkey, CAST(strptime(substr(split_part(name, '_', 3), 1, 8), '%Y%m%d') AS DATE) AS day, substr(split_part(name, '_', 6), 2, 5) AS tile
    FROM (SELECT o_orderkey, {_PRODUCT.format("strftime(o_orderdate, '%Y%m%d')", 'VARCHAR')} AS name FROM orders)""")
def _(spark, d):
    name = F.expr(_PRODUCT.format("date_format(o_orderdate, 'yyyyMMdd')", "STRING"))
    o = Tables(spark, d).raw("orders").select("o_orderkey", name.alias("name"))
    return o.select("o_orderkey", P.parse_tokens("name", "product_date").alias("day"), P.parse_tokens("name", "product_tile").alias("tile"))


@query("p13_clamp_year", "SELECT plot, greatest(year, 2018) AS year FROM plots")
def _(spark, d):
    return Tables(spark, d).plots.select("plot", P.clamp_year("year").alias("year"))


@query("p14_assemble_features", f"SELECT ok, ln, pk, {r('agbd', 'f0')}, {r('(cos(pi() * lat_dec / 90) + 1) / 2', 'f1')}, {r('region_cla', 'f2')} FROM fp")
def _(spark, d):
    features = {"label": [F.col("agbd")], "height": [F.col("rh98")], "lat": [(F.cos(F.pi() * F.col("lat_dec") / 90) + 1) / 2], "region": [F.col("region_cla")]}
    out = P.assemble_features(Tables(spark, d).fp, features, {"label", "lat", "region"})
    return rounded(out.select("ok", "ln", "pk", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]))


@query("p15_target", f"SELECT ok, ln, pk, {r('ln(1 + agbd)', 'log_agbd')}, {r('(agbd - 100) / 50', 'norm_agbd')} FROM fp")
def _(spark, d):
    return rounded(Tables(spark, d).fp.select("ok", "ln", "pk", P.target("agbd", "log").alias("log_agbd"), P.target("agbd", "normal", 100, 50).alias("norm_agbd")))


@query("p16_select_bands", "SELECT pk, aux AS b0, value AS b1 FROM pix")
def _(spark, d):
    bands = F.array("value", "pk", "aux")
    out = Tables(spark, d).pix.select("pk", P.select_bands(bands, ["B02", "B03", "B04"], ["B04", "B02"]).alias("b"))
    return out.select("pk", F.col("b")[0].cast("int").alias("b0"), F.col("b")[1].alias("b1"))


# aggregates ---------------------------------------------------------------------------------------------------------


@query("a01_tile_sizes", "SELECT tile, count(*) AS n, count(*) // 7 AS chunks_floor, CAST(ceil(count(*) / 7e0) AS BIGINT) AS chunks_ceil FROM fp GROUP BY tile")
def _(spark, d):
    return A.tile_sizes(Tables(spark, d).fp, 7)


_CHUNKS = "SELECT tile, year, idx // 50 AS chunk, count(agbd) AS n, avg(agbd) AS mean, stddev_pop(agbd) AS std, min(agbd) AS min, max(agbd) AS max FROM fpx GROUP BY tile, year, idx // 50"


@query("a02_chunk_stats", f"SELECT tile, year, chunk, n, {r('mean', 'mean')}, {r('std', 'std')}, min, max FROM ({_CHUNKS})")
def _(spark, d):
    return rounded(A.chunk_stats(Tables(spark, d).fpx, ["tile", "year"], "agbd", "idx", 50))


@query("a03_pool_stats", f"""SELECT tile, CAST(sum(n) AS BIGINT) AS n, {r('sum(n * mean) / sum(n)', 'mean')}, {r('sqrt(sum((n - 1) * std * std) / nullif(sum(n) - count(*), 0))', 'std')}, min(min) AS min, max(max) AS max
    FROM ({_CHUNKS}) GROUP BY tile""")
def _(spark, d):
    return rounded(A.pool_stats(A.chunk_stats(Tables(spark, d).fpx, ["tile", "year"], "agbd", "idx", 50), ["tile"]))


@query("a03_pool_stats_exact", f"SELECT event_type, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std', 4)}, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def _(spark, d):
    return rounded(A.pool_stats(A.chunk_stats(Tables(spark, d).chunked, ["event_type"], "value", "pos", 100), ["event_type"], exact=True)).withColumn("std", F.round("std", 4))


@query("a04_hist_percentiles", "SELECT region_cla, quantile_disc(agbd, 0.01) AS p1, quantile_disc(agbd, 0.99) AS p99 FROM fp GROUP BY region_cla")
def _(spark, d):
    return A.hist_percentiles(Tables(spark, d).fp, ["region_cla"], "agbd")


@query("a05_band_statistics", f"""WITH l AS (SELECT raster_id, pk, unnest([0, 1]) AS band, unnest([value, CAST(aux AS DOUBLE)]) AS v FROM valid),
    c AS (SELECT raster_id, band, pk // 100 AS k, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi FROM l GROUP BY ALL),
    s AS (SELECT raster_id, band, CAST(sum(n) AS BIGINT) AS n, {r('sum(n * m) / sum(n)', 'mean')}, {r('sqrt(sum((n - 1) * s * s) / nullif(sum(n) - count(*), 0))', 'std')}, min(lo) AS min, max(hi) AS max FROM c GROUP BY raster_id, band)
    SELECT s.*, p1, p99 FROM s JOIN (SELECT raster_id, band, quantile_disc(v, 0.01) AS p1, quantile_disc(v, 0.99) AS p99 FROM l GROUP BY raster_id, band) USING (raster_id, band)""")
def _(spark, d):
    v = Tables(spark, d).valid.select("raster_id", "pk", F.array(F.col("value"), F.col("aux").cast("double")).alias("bands"))
    return rounded(A.band_statistics(v, ["raster_id"], "bands", "pk", 100))


@query("a06_embedding_statistics", f"SELECT label, dim, count(v) AS n, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, min(v) AS min, max(v) AS max FROM (SELECT label, dim, nullif(v, -128) AS v FROM dims) WHERE v IS NOT NULL GROUP BY label, dim")
def _(spark, d):
    e = Tables(spark, d).emb.select("label", F.transform("q", lambda v: F.when(v != -128, v)).alias("q"))
    return rounded(A.array_moments(e, ["label"], "q").withColumn("dim", F.col("dim").cast("long")))


@query("a06_selected_embeddings", f"""WITH e AS (SELECT *, vec_id % 20 AS tile, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS k FROM dims WHERE label % 5 IN (1, 3, 4) AND vec_id % 3 <> 2 AND vec_id % 20 < 12 AND dim = 0)
    SELECT dim, count(nullif(v, -128)) AS n, {r('avg(nullif(v, -128))', 'mean')}, {r('stddev_pop(nullif(v, -128))', 'std')}, min(nullif(v, -128)) AS min, max(nullif(v, -128)) AS max
    FROM dims JOIN (SELECT vec_id FROM e WHERE k <= 5 + tile) USING (vec_id) GROUP BY dim""")
def _(spark, d):
    e = Tables(spark, d).emb.selectExpr("vec_id AS idx", "concat('R', label % 5) AS region", "2018 + vec_id % 3 AS year", "vec_id % 20 AS tile", "transform(q, v -> CASE WHEN v <> -128 THEN v END) AS q")
    tiles = e.select("tile").distinct().where("tile < 12").withColumn("cap", F.col("tile") + 5)
    out = A.embedding_statistics(e, "q", regions=["north", "R4"], continents={"north": ["R1", "R3"]}, years=[2018, 2019], tiles=tiles, lite=True)
    return rounded(out.withColumn("dim", F.col("dim").cast("long")))


@query("a07_regional_distribution", """SELECT g.region_cla, CAST(b AS INT) AS bin, count(agbd) AS n FROM (SELECT DISTINCT region_cla FROM fp) g CROSS JOIN range(50) t(b)
    LEFT JOIN fp ON fp.region_cla = g.region_cla AND floor(agbd / 10) = b AND agbd < 500 GROUP BY g.region_cla, b""")
def _(spark, d):
    return A.regional_distribution(Tables(spark, d).fp, ["region_cla"])


@query("a07_class_counts", f"""SELECT g.region_cla, CAST(c AS INT) AS cls, count(agbd) AS n FROM (SELECT DISTINCT region_cla FROM fp) g CROSS JOIN (SELECT unnest({CLASSES}) AS c)
    LEFT JOIN fp ON fp.region_cla = g.region_cla AND cls = c GROUP BY g.region_cla, c""")
def _(spark, d):
    return A.class_counts(Tables(spark, d).fp, ["region_cla"])


_DIST = """WITH c AS (SELECT g.region_cla, b AS bin, count(agbd) AS p, count(agbd) FILTER (split = 'test') AS q FROM (SELECT DISTINCT region_cla FROM fp) g CROSS JOIN range(50) t(b)
    LEFT JOIN fp ON fp.region_cla = g.region_cla AND floor(agbd / 10) = b AND agbd < 500 GROUP BY g.region_cla, b)"""


@query("a08_freq_distance", f"""{_DIST}, s AS (SELECT region_cla, bin, coalesce(p / nullif(sum(p) OVER w, 0), 0) AS p, coalesce(q / nullif(sum(q) OVER w, 0), 0) AS q FROM c WINDOW w AS (PARTITION BY region_cla)),
    x AS (SELECT region_cla, p, row_number() OVER (PARTITION BY region_cla ORDER BY p, bin) AS k FROM s), y AS (SELECT region_cla, q, row_number() OVER (PARTITION BY region_cla ORDER BY q, bin) AS k FROM s)
    SELECT region_cla, {r('avg(abs(p - q))', 'distance')} FROM x JOIN y USING (region_cla, k) GROUP BY region_cla""")
def _(spark, d):
    fp = Tables(spark, d).fp
    every = A.regional_distribution(fp, ["region_cla"])
    part = every.select("region_cla", "bin").join(A.regional_distribution(fp.where("split = 'test'"), ["region_cla"]), ["region_cla", "bin"], "left").fillna(0, ["n"])
    return rounded(A.freq_distance(every, part, ["region_cla"]))


@query("a08_binned_distance", f"""{_DIST}, s AS (SELECT region_cla, coalesce(sum(p) OVER r / nullif(sum(p) OVER w, 0), 0) - coalesce(sum(q) OVER r / nullif(sum(q) OVER w, 0), 0) AS d FROM c
    WINDOW w AS (PARTITION BY region_cla), r AS (PARTITION BY region_cla ORDER BY bin)) SELECT region_cla, {r('sum(abs(d))', 'distance')} FROM s GROUP BY region_cla""")
def _(spark, d):
    fp = Tables(spark, d).fp
    every = A.regional_distribution(fp, ["region_cla"])
    part = every.select("region_cla", "bin").join(A.regional_distribution(fp.where("split = 'test'"), ["region_cla"]), ["region_cla", "bin"], "left").fillna(0, ["n"])
    return rounded(A.binned_distance(every, part, ["region_cla"]))


@query("a09_metrics", f"SELECT member, split, {METRICS} FROM preds GROUP BY member, split")
def _(spark, d):
    return rounded(A.metrics(Tables(spark, d).preds, "pred", "agbd", ["member", "split"]))


_D = "(pred - agbd)"


@query("a10_weighted_losses", f"""SELECT split, {r(f'avg((1 + tax) * {_D})', 'me')}, {r(f'sqrt(avg((1 + tax) * {_D} ** 2))', 'rmse')}, {r(f'avg((1 + tax) * {_D} ** 2)', 'mse')}, {r(f'avg((1 + tax) * abs({_D}))', 'mae')},
    {r(f'avg((1 + tax) * CASE WHEN abs({_D}) <= 1 THEN 0.5e0 * {_D} ** 2 ELSE abs({_D}) - 0.5e0 END)', 'huber')} FROM preds GROUP BY split""")
def _(spark, d):
    return rounded(A.weighted_losses(Tables(spark, d).preds.withColumn("w", F.col("tax") + 1), "pred", "agbd", "w", ["split"]))


@query("a11_gaussian_nll", f"SELECT member, {r('avg(0.5e0 * (ln(greatest(exp(disc * 50), 1e-6)) + (pred - agbd) ** 2 / greatest(exp(disc * 50), 1e-6)))', 'nll')} FROM preds GROUP BY member")
def _(spark, d):
    return rounded(A.gaussian_nll(Tables(spark, d).preds.withColumn("lv", F.col("disc") * 50), "pred", "lv", "agbd", ["member"]))


# patches of the losses: pixels are a tile-year's footprints, the centre is its first row
_PATCH = """patch AS (SELECT concat(tile, '-', year) AS key, idx, agbd + (disc - 0.05e0) * 500 AS pred, agbd AS dense, rh98 * 9.5e0 + 3 AS sp FROM fpx),
    centre AS (SELECT key, pred AS centre_pred, dense AS centre_dense, sp AS sparse FROM patch WHERE idx = 0),
    dl AS (SELECT key, avg((pred - dense) ** 2) AS d FROM patch GROUP BY key)"""


def _patches(t):
    p = t.fpx.select(F.concat_ws("-", "tile", "year").alias("key"), "idx", (F.col("agbd") + (F.col("disc") - 0.05) * 500).alias("pred"), F.col("agbd").alias("dense"), (F.col("rh98") * 9.5 + 3).alias("sp"))
    return p, p.where("idx = 0").select("key", F.col("pred").alias("centre_pred"), F.col("dense").alias("centre_dense"), F.col("sp").alias("sparse"))


_X = "least(abs(sparse - centre_dense) / (sparse + 1e-6), 0.25e0) / 0.25e0"
for _mode, _sql in {"linear": f"1 - {_X}", "log": f"ln({_X} * (1 - exp(1)) + exp(1))", "exp": f"2 - exp({_X} * ln(2))", "inv_log": f"-ln({_X} * (1 - exp(-1)) + exp(-1))"}.items():
    @query(f"a12_agreement_loss_{_mode}", f"WITH {_PATCH} SELECT count(*) AS n, {r(f'avg(({_sql}) * d + (1 - ({_sql})) * (centre_pred - sparse) ** 2)', 'loss')} FROM centre JOIN dl USING (key)")
    def _(spark, d, mode=_mode):
        p, c = _patches(Tables(spark, d))
        return rounded(A.agreement_loss(p, c, "key", mode, 0.25))


_ALL_DENSE, _HUBER = "(SELECT avg((pred - dense) ** 2) FROM patch)", "CASE WHEN abs({0}) <= 1 THEN 0.5e0 * ({0}) ** 2 ELSE abs({0}) - 0.5e0 END"
_OWN = f"SELECT key, avg({_HUBER.format('pred - dense')}) AS d FROM patch GROUP BY key"
_W, _SPARSE = f"(1 - {_X})", _HUBER.format("centre_pred - sparse")
for _name, _args, _from, _sql in (
    ("version1", ("linear", 0.25, "MSE", 1), "centre", f"avg({_W}) * {_ALL_DENSE} + (1 - avg({_W})) * avg((centre_pred - sparse) ** 2)"),
    ("huber", ("linear", 0.25, "Huber", 2), f"centre JOIN ({_OWN}) USING (key)", f"avg({_W} * d + (1 - {_W}) * ({_SPARSE}))"),
    ("random", ("random", 0.25, "Huber", 2), "centre", f"0.5e0 * (SELECT avg({_HUBER.format('pred - dense')}) FROM patch) + 0.5e0 * avg({_SPARSE})"),
    ("false", ("false", 0.25, "MSE", 2), "centre", _ALL_DENSE),
):
    @query(f"a12_agreement_loss_{_name}", f"WITH {_PATCH} SELECT count(*) AS n, {r(_sql, 'loss')} FROM {_from}")
    def _(spark, d, args=_args):
        p, c = _patches(Tables(spark, d))
        return rounded(A.agreement_loss(p, c, "key", *args))


@query("a13_balanced_loss", f"""WITH {_PATCH}, x AS (SELECT *, greatest(0, least(1, 1 - abs(sparse - centre_dense) / (sparse + 1e-6))) AS f FROM centre JOIN dl USING (key)),
    y AS (SELECT avg((centre_pred - sparse) ** 2) AS sparse_loss, avg(f * d) AS dense_loss, exp(-5 * (1 - (7 / 14e0) ** 2)) AS g FROM x)
    SELECT {r('sparse_loss', 'sparse_loss')}, {r('dense_loss', 'dense_loss')}, {r('(1 - g) * dense_loss + g * sparse_loss', 'loss')} FROM y""")
def _(spark, d):
    p, c = _patches(Tables(spark, d))
    return rounded(A.balanced_loss(p, c, "key", epoch=7))


@query("a13_balanced_loss_bins", f"""WITH {_PATCH}, m AS (SELECT floor(sp / 50) AS bin, avg(sp) AS bm FROM patch GROUP BY 1),
    x AS (SELECT *, greatest(0, least(1, 1 - (sparse - centre_dense) ** 2 / ((sparse - bm) ** 2 + 1e-6))) AS f FROM centre JOIN dl USING (key) LEFT JOIN m ON floor(sparse / 50) = bin),
    y AS (SELECT avg((centre_pred - sparse) ** 2) AS sparse_loss, avg(f * d) AS dense_loss FROM x)
    SELECT {r('sparse_loss', 'sparse_loss')}, {r('dense_loss', 'dense_loss')}, {r('sparse_loss + 0.5e0 * dense_loss', 'loss')} FROM y""")
def _(spark, d):
    p, c = _patches(Tables(spark, d))
    bins = p.groupBy(F.floor(F.col("sp") / 50).alias("bin")).agg(F.avg("sp").alias("bin_mean"))
    return rounded(A.balanced_loss(p, c, "key", 0.5, "R2_bin", bins))


_HUBER = "CASE WHEN abs({0}) <= 1 THEN 0.5e0 * ({0}) ** 2 ELSE abs({0}) - 0.5e0 END"


@query("a13_balanced_loss_huber", f"""WITH {_PATCH}, h AS (SELECT key, avg({_HUBER.format('pred - dense')}) AS hd FROM patch GROUP BY key), x AS (SELECT *, greatest(0, least(1, 1 - abs(sparse - centre_dense) / (sparse + 1e-6))) AS f FROM centre JOIN h USING (key)),
    y AS (SELECT avg({_HUBER.format('centre_pred - sparse')}) AS sparse_loss, avg(f * hd) AS dense_loss, exp(-5 * (1 - (7 / 14e0) ** 2)) AS g FROM x)
    SELECT {r('sparse_loss', 'sparse_loss')}, {r('dense_loss', 'dense_loss')}, {r('(1 - g) * dense_loss + g * sparse_loss', 'loss')} FROM y""")
def _(spark, d):
    p, c = _patches(Tables(spark, d))
    return rounded(A.balanced_loss(p, c, "key", epoch=7, loss="Huber"))


@query("a14_patch_jsd", f"""WITH {_PATCH}, s AS (SELECT key, exp((pred - max(pred) OVER w) / 50) AS a, exp((dense - max(dense) OVER w) / 50) AS b FROM patch WINDOW w AS (PARTITION BY key)),
    t AS (SELECT key, a / sum(a) OVER w + 1e-8 AS p, b / sum(b) OVER w + 1e-8 AS q FROM s WINDOW w AS (PARTITION BY key)),
    u AS (SELECT key, sum(0.5e0 * (p * (ln(p) - ln((p + q) / 2)) + q * (ln(q) - ln((p + q) / 2)))) AS j FROM t GROUP BY key) SELECT count(*) AS n, {r('avg(j)', 'jsd')} FROM u""")
def _(spark, d):
    p, _ = _patches(Tables(spark, d))
    return rounded(A.patch_jsd(p.withColumn("a", F.col("pred") / 50).withColumn("b", F.col("dense") / 50), "key", "a", "b"))


@query("a15_sliced_normality", f"""WITH dirs AS (SELECT s, k, cos(s * 0.7e0 + k * 1.3e0) / sqrt(sum(cos(s * 0.7e0 + k * 1.3e0) ** 2) OVER (PARTITION BY s)) AS w FROM range(4) a(s) CROSS JOIN range(64) b(k)),
    z AS (SELECT vec_id, s, sum(v / 16 * w) AS z FROM dims JOIN dirs ON dim = k GROUP BY vec_id, s), g AS (SELECT i, -5 + i * 0.625e0 AS t FROM range(17) a(i)),
    e AS (SELECT s, i, t, avg(cos(z * t)) AS re, avg(sin(z * t)) AS im, count(*) AS n FROM z CROSS JOIN g GROUP BY s, i, t)
    SELECT s AS slice, {r('sum(((re - exp(-0.5e0 * t * t)) ** 2 + im ** 2) * exp(-0.5e0 * t * t) * CASE WHEN i IN (0, 16) THEN 0.5e0 ELSE 1 END) * 0.625e0 * max(n)', 'statistic')} FROM e GROUP BY s""")
def _(spark, d):
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.cos(F.col("slice") * 0.7 + k * 1.3))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, v: s + v * v))
    dirs = spark.range(4).withColumnRenamed("id", "slice").withColumn("w", w).select("slice", F.transform("w", lambda v: v / norm).alias("direction"))
    e = Tables(spark, d).emb.select(F.transform("q", lambda v: v / 16).alias("x"))
    return rounded(A.sliced_normality(e, "x", dirs))


@query("a16_metrics_by_bin", f"SELECT member, CAST(floor(agbd / 50) AS BIGINT) AS bin, {METRICS}, CAST(floor(agbd / 50) AS BIGINT) * 50 AS lower FROM preds WHERE agbd >= 0 AND agbd < 500 GROUP BY member, floor(agbd / 50)")
def _(spark, d):
    return rounded(A.metrics_by_bin(Tables(spark, d).preds, "pred", "agbd", by=["member"]))


@query("accuracy_by_label_bin", f"SELECT CAST(floor(agbd / 50) AS BIGINT) AS bin, {METRICS}, CAST(floor(agbd / 50) AS BIGINT) * 50 AS lower FROM preds WHERE split = 'test' AND agbd >= 0 AND agbd < 500 GROUP BY floor(agbd / 50)")
def _(spark, d):
    t = Tables(spark, d)
    splits = t.raw("supplier").select(F.col("s_suppkey").alias("tile"), F.expr("CASE WHEN s_suppkey % 10 < 6 THEN 'train' WHEN s_suppkey % 10 < 8 THEN 'val' ELSE 'test' END AS split"))
    return rounded(A.metrics_by_bin(J.in_split(P.decode_latlon(t.preds).drop("split"), splits, "test"), "pred", "agbd"))


@query("a17_metrics_by_class", f"SELECT member, cls, {METRICS} FROM preds GROUP BY member, cls")
def _(spark, d):
    return rounded(A.metrics(Tables(spark, d).preds, "pred", "agbd", ["member", "cls"]))


_REGION = "CASE WHEN region_cla = 2 THEN 5 ELSE region_cla END"


@query("a18_metrics_by_region", f"SELECT member, {_REGION} AS region, {METRICS} FROM preds GROUP BY 1, 2")
def _(spark, d):
    return rounded(A.metrics(Tables(spark, d).preds.withColumn("region", A.merged_region("region_cla")), "pred", "agbd", ["member", "region"]))


@query("a19_metrics_cube", f"SELECT member, region_cla, cls, CAST(grouping_id(region_cla, cls) AS BIGINT) AS level, {METRICS} FROM preds GROUP BY member, CUBE (region_cla, cls)")
def _(spark, d):
    return rounded(A.metrics_cube(Tables(spark, d).preds, "pred", "agbd", "region_cla", "cls", ["member"]))


@query("a20_residual_boxes", f"""WITH r AS (SELECT member, CAST(floor(agbd / 50) AS BIGINT) AS bin, pred - agbd AS e FROM preds WHERE pred IS NOT NULL AND agbd < 500),
    q AS (SELECT member, bin, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS q2, quantile_cont(e, 0.75) AS q3 FROM r GROUP BY member, bin)
    SELECT member, bin, {r('min(q1)', 'q1')}, {r('min(q2)', 'median')}, {r('min(q3)', 'q3')}, {r('min(e)', 'low')}, {r('max(e)', 'high')} FROM r JOIN q USING (member, bin)
    WHERE e >= q1 - 1.5e0 * (q3 - q1) AND e <= q3 + 1.5e0 * (q3 - q1) GROUP BY member, bin""")
def _(spark, d):
    return rounded(A.residual_boxes(Tables(spark, d).preds, "pred", "agbd", ["member"]))


@query("a21_binned_calibration", f"""SELECT CAST(floor(agb / 25) AS BIGINT) AS bin, count(*) AS n, {r('avg(est_a)', 'mean')}, {r('stddev_pop(est_a)', 'std')}, CASE WHEN count(*) < 5 THEN 'few' WHEN count(*) < 20 THEN 'some' ELSE 'many' END AS size_class
    FROM plots WHERE est_a IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return rounded(A.binned_calibration(Tables(spark, d).plots, "est_a", "agb"))


@query("a22_compare_models", f"""WITH m AS (SELECT region_cla, member, avg(pred - agbd) AS bias FROM preds WHERE pred IS NOT NULL GROUP BY region_cla, member)
    SELECT a.region_cla, {r('abs(b.bias) - abs(a.bias)', 'gain')} FROM m a JOIN m b USING (region_cla) WHERE a.member = 1 AND b.member = 3""")
def _(spark, d):
    t = Tables(spark, d).preds
    per = lambda k: A.metrics(t.where(F.col("member") == k), "pred", "agbd", ["region_cla"])
    return rounded(A.compare_models(per(1), per(3), "region_cla", "bias"))


@query("a23_density2d", "SELECT CAST(least(floor(agbd * 50 / 500e0), 49) AS BIGINT) AS xbin, CAST(least(floor(pred * 50 / 500e0), 49) AS BIGINT) AS ybin, count(*) AS n FROM preds WHERE agbd BETWEEN 0 AND 500 AND pred BETWEEN 0 AND 500 GROUP BY ALL")
def _(spark, d):
    return A.density2d(Tables(spark, d).preds, "agbd", "pred", 50)


@query("a24_density1d", f"WITH c AS (SELECT region_cla, CAST(least(floor(agbd * 40 / 500e0), 39) AS BIGINT) AS bin, count(*) AS n FROM fp WHERE agbd BETWEEN 0 AND 500 GROUP BY ALL) SELECT *, {r('n / (sum(n) OVER (PARTITION BY region_cla) * 12.5e0)', 'density')} FROM c")
def _(spark, d):
    return rounded(A.density1d(Tables(spark, d).fp, ["region_cla"], "agbd", 40, 500.0))


@query("a25_point_density", f"""WITH c AS (SELECT CAST(greatest(0, least(floor((lon + 180) / 360 * 36), 35)) AS BIGINT) AS cx, CAST(greatest(0, least(floor((90 - lat) / 180 * 18), 17)) AS BIGINT) AS cy, count(*) AS n FROM plots GROUP BY ALL)
    SELECT *, {r('cume_dist() OVER (ORDER BY n)', 'rank')} FROM c""")
def _(spark, d):
    return rounded(A.point_density(Tables(spark, d).plots, "lon", "lat", 36, 18)).select("cx", "cy", "n", "rank")


@query("a26_ensemble", f"SELECT ok, ln, pk, price, count(pred) AS members, {r('avg(pred)', 'mean')}, {r('stddev_pop(pred)', 'std')} FROM preds GROUP BY ok, ln, pk, price")
def _(spark, d):
    return rounded(A.ensemble(Tables(spark, d).preds, ["ok", "ln", "pk", "price"]))


@query("a27_ensemble_rmse", f"SELECT count(*) AS models, {r('avg(e)', 'mean_rmse')}, {r('stddev_pop(e)', 'std_rmse')} FROM (SELECT member, sqrt(avg((pred - agbd) ** 2)) AS e FROM preds GROUP BY member)")
def _(spark, d):
    return rounded(A.ensemble_rmse(Tables(spark, d).preds, "pred", "agbd", "member"))


@query("a28_cell_median", f"SELECT CAST(floor(lon / 7) AS BIGINT) AS cx, CAST(floor(lat / 7) AS BIGINT) AS cy, count(agb) AS n, {r('median(agb)', 'median')}, {r('(floor(lon / 7) + 0.5e0) * 7', 'x')}, {r('(floor(lat / 7) + 0.5e0) * 7', 'y')} FROM plots GROUP BY floor(lon / 7), floor(lat / 7)")
def _(spark, d):
    return rounded(A.cell_median(Tables(spark, d).plots, "lon", "lat", 7.0, "agb"))


@query("a31_coverage_report", f"SELECT {r('median(c)', 'median')}, {r('avg(c)', 'mean')}, min(c) AS min, count(*) FILTER (c >= 0.99e0) AS full, count(*) FILTER (c < 0.5e0) AS poor, count(*) FILTER (c IS NULL) AS missing FROM (SELECT CASE WHEN est_a IS NOT NULL THEN cov_a END AS c FROM plots)")
def _(spark, d):
    return rounded(A.coverage_report(Tables(spark, d).plots.selectExpr("CASE WHEN est_a IS NOT NULL THEN cov_a END AS c"), "c"))


@query("a32_extent_summary", "SELECT " + ", ".join(r(f"quantile_cont(cov_b, {p / 100})", f"p{p}") for p in (0, 5, 25, 50, 75, 100)) + ", " + ", ".join(f"count(*) FILTER (cov_b < {t / 100}) AS below_{t}" for t in (50, 90, 100)) + " FROM plots")
def _(spark, d):
    return rounded(A.extent_summary(Tables(spark, d).plots, "cov_b"))


@query("a33_label_summary", f"SELECT year, count(agbd) AS n, {r('avg(agbd)', 'mean')}, {r('median(agbd)', 'median')}, {r('quantile_cont(agbd, 0.9)', 'p90')}, max(agbd) AS max FROM fp GROUP BY year")
def _(spark, d):
    return rounded(A.label_summary(Tables(spark, d).fp, ["year"], "agbd"))


@query("a34_class_distribution", "SELECT tile, year, " + ", ".join(r(f"count(*) FILTER (cls = {c}) / count(*)", f"c{c}") for c in CLASSES) + " FROM fp GROUP BY tile, year")
def _(spark, d):
    out = A.class_distribution(Tables(spark, d).fp, ["tile", "year"], "cls")
    return rounded(out.select("tile", "year", *[F.col("shares")[i].alias(f"c{c}") for i, c in enumerate(CLASSES)]))


@query("a35_class_mode", "WITH c AS (SELECT tile, year, cls, count(*) AS n FROM fp GROUP BY ALL) SELECT tile, year, cls AS mode FROM c QUALIFY row_number() OVER (PARTITION BY tile, year ORDER BY n DESC, cls) = 1")
def _(spark, d):
    return A.class_mode(Tables(spark, d).fp, ["tile", "year"], "cls")


@query("a39_rank_attributions", f"""WITH c AS (SELECT dim AS band, avg(abs(v)) AS f, avg(CASE WHEN label = 3 THEN abs(v) END) AS c FROM dims GROUP BY dim)
    SELECT band, {r('f', 'full')}, {r('c', 'centre')}, {r('100 * f / sum(f) OVER ()', 'share')}, CAST(row_number() OVER (ORDER BY f DESC, band) AS INT) AS rank FROM c""")
def _(spark, d):
    long = Tables(spark, d).emb.select("label", F.posexplode("q").alias("band", "v")).withColumn("band", F.col("band").cast("long"))
    return rounded(A.rank_attributions(long, "band", "v", F.col("label") == 3))


@query("a40_offset_diagnostic", f"""WITH c AS (SELECT row % 4 AS dy, col % 4 AS dx, count(value) AS n, avg(value) AS m, sqrt(avg(value * value) - avg(value) ** 2) AS s FROM valid GROUP BY ALL)
    SELECT dy, dx, n, {r('m', 'mean')}, {r('s', 'std')}, {r('(max(m) OVER () - min(m) OVER ()) / abs(avg(m) OVER ())', 'spread')}, (max(m) OVER () - min(m) OVER ()) / abs(avg(m) OVER ()) > 0.02e0 AS warn FROM c""")
def _(spark, d):
    return rounded(A.offset_diagnostic(Tables(spark, d).valid.selectExpr("row % 4 AS dy", "col % 4 AS dx", "value"), ["dy", "dx"], "value"))


@query("a41_cloud_score", f"SELECT raster_id, {r('avg(CASE WHEN least(aux * 5, value * 3, 250 - aux) > 180 OR value = -9999 THEN 1e0 ELSE 0 END)', 'score')} FROM pix GROUP BY raster_id")
def _(spark, d):
    p = Tables(spark, d).pix.selectExpr("raster_id", "value", "CAST(aux * 5 AS DOUBLE) AS r", "value * 3 AS g", "CAST(250 - aux AS DOUBLE) AS b")
    return rounded(A.cloud_score(p, ["raster_id"], "r", "g", "b", F.col("value") == -9999))


@query("a42_audit_rasters", f"""WITH m AS (SELECT raster_id, array_to_string(list_filter([CASE WHEN greatest(width, height) > 100 THEN 'large' END, CASE WHEN least(width, height) < 12 THEN 'small' END, CASE WHEN raster_id = 1 THEN 'bands' END,
    CASE WHEN e > 0 THEN 'south_up' END, CASE WHEN NOT (epsg BETWEEN 32601 AND 32760) THEN 'no_projection' END], lambda x: x IS NOT NULL), ',') AS g FROM rasters),
    s AS (SELECT raster_id, avg(CASE WHEN value = -9999 THEN 1e0 ELSE 0 END) AS share FROM pix JOIN m USING (raster_id) WHERE g = '' GROUP BY raster_id)
    SELECT raster_id, {r('share', 'nodata_share')}, CASE WHEN g = '' AND share > 0.027e0 THEN 'nodata' ELSE g END AS failures FROM m LEFT JOIN s USING (raster_id)""")
def _(spark, d):
    t = Tables(spark, d)
    meta = t.rasters.withColumn("bands", F.when(F.col("raster_id") == 1, 3).otherwise(2))
    return rounded(A.audit_rasters(meta, t.pix, 12, 100, 2, 0.027))


@query("a44_patch_validity", """WITH c AS (SELECT raster_id, row, count(*) FILTER (value <> -9999) AS v, count(*) AS n FROM pix GROUP BY ALL)
    SELECT count(*) FILTER (v = n) AS whole, count(*) FILTER (v > 0 AND v < n) AS part, count(*) FILTER (v = 0) AS never FROM c""")
def _(spark, d):
    return A.patch_validity(Tables(spark, d).pix, ["raster_id", "row"], F.col("value") != -9999)


# windows, orderings, sets -------------------------------------------------------------------------------------------

_SIZES = "SELECT tile, year, count(*) AS n FROM fp GROUP BY tile, year"
_RANGES = f"SELECT tile, year, n, CAST(sum(n) OVER (ORDER BY tile, year) AS BIGINT) AS \"end\" FROM ({_SIZES})"


def _ranges(t):
    return J.index_ranges(t.fp.groupBy("tile", "year").agg(F.count(F.lit(1)).alias("n")), ["tile", "year"])


@query("w01_index_ranges", f"SELECT tile, year, n, \"end\", \"end\" - n AS start FROM ({_RANGES})")
def _(spark, d):
    return _ranges(Tables(spark, d))


@query("w02_locate", f"SELECT o_orderkey * 3 AS position, tile, year, o_orderkey * 3 - (\"end\" - n) AS row FROM orders JOIN ({_RANGES}) ON o_orderkey * 3 >= \"end\" - n AND o_orderkey * 3 < \"end\"")
def _(spark, d):
    t = Tables(spark, d)
    return J.locate(t.raw("orders").select((F.col("o_orderkey") * 3).alias("position")), _ranges(t)).select("position", "tile", "year", "row")


@query("w03_renumber", "SELECT tile, year, idx, CAST(row_number() OVER (PARTITION BY tile, year ORDER BY idx) - 1 AS INT) AS new_idx FROM fpx WHERE ok % 3 <> 0")
def _(spark, d):
    return W.renumber(Tables(spark, d).fpx.where("ok % 3 <> 0").select("tile", "year", "idx"), ["tile", "year"], ["idx"])


@query("w04_cumulative_share", """WITH c AS (SELECT dim, avg(abs(v)) AS f FROM dims GROUP BY dim), s AS (SELECT row_number() OVER (ORDER BY f DESC, dim) AS k, sum(f) OVER (ORDER BY f DESC, dim) / sum(f) OVER () AS cum FROM c)
    SELECT CAST(min(k) FILTER (cum >= 0.5e0) AS INT) AS at_50, CAST(min(k) FILTER (cum >= 0.8e0) AS INT) AS at_80, CAST(min(k) FILTER (cum >= 0.9e0) AS INT) AS at_90 FROM s""")
def _(spark, d):
    share = Tables(spark, d).emb.select(F.posexplode("q").alias("dim", "v")).groupBy("dim").agg(F.avg(F.abs("v")).alias("f"))
    return W.first_rank_at(W.cumulative_share(share, "f", "dim"))


@query("w06_region_numbers", "SELECT n_name AS region, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INT) AS number FROM nation")
def _(spark, d):
    return W.region_numbers(Tables(spark, d).raw("nation").select(F.col("n_name").alias("region")))


@query("w07_best_trial", """SELECT region, trial FROM (SELECT o_custkey % 20 AS region, o_orderkey AS trial, floor(o_totalprice / 20000) AS a, o_orderkey % 5 AS b FROM orders)
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY a, b, trial) = 1""")
def _(spark, d):
    s = Tables(spark, d).raw("orders").selectExpr("o_custkey % 20 AS region", "o_orderkey AS trial", "floor(o_totalprice / 20000) AS label_distance", "o_orderkey % 5 AS class_distance")
    return W.best_trial(s, ["region"]).select("region", "trial")


@query("w08_merge_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def _(spark, d):
    return W.merge_latest(Tables(spark, d).raw("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("t01_worst_k", "SELECT plot, cov FROM (SELECT plot, CASE WHEN est_b IS NOT NULL THEN cov_b END AS cov FROM plots) ORDER BY cov NULLS LAST, plot LIMIT 20")
def _(spark, d):
    return W.worst_k(Tables(spark, d).plots.selectExpr("plot", "CASE WHEN est_b IS NOT NULL THEN cov_b END AS cov"), 20, "cov", "plot")


@query("t02_top_k", f"SELECT dim, {r('avg(abs(v))', 'f')} FROM dims GROUP BY dim ORDER BY round(avg(abs(v)), 6) DESC, dim LIMIT 10")
def _(spark, d):
    share = Tables(spark, d).emb.select(F.posexplode("q").alias("dim", "v")).groupBy(F.col("dim").cast("long").alias("dim")).agg(F.avg(F.abs("v")).alias("f"))
    return W.top_k(rounded(share), 10, "f", "dim")


@query("t03_pareto", """SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size
    AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))""")
def _(spark, d):
    return W.pareto(Tables(spark, d).raw("part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size")


@query("u01_common_tiles", "SELECT tile FROM fp WHERE year = 1996 INTERSECT SELECT tile FROM fp WHERE year = 2001")
def _(spark, d):
    fp = Tables(spark, d).fp
    return fp.where("year = 1996").select("tile").intersect(fp.where("year = 2001").select("tile"))


@query("u02_kept_rows", "SELECT tile, year, idx FROM fpx WHERE ok % 3 <> 0")
def _(spark, d):
    t = Tables(spark, d)
    return W.kept_rows(t.fp.groupBy("tile", "year").agg(F.count(F.lit(1)).alias("n")), t.fpx.where("ok % 3 = 0"), ["tile", "year"]).select("tile", "year", "idx")


@query("u03_union_sources", "SELECT 1996 AS load, tile, count(*) AS n FROM fp WHERE year = 1996 GROUP BY tile UNION ALL SELECT 1997, tile, count(*) FROM fp WHERE year = 1997 GROUP BY tile")
def _(spark, d):
    fp = Tables(spark, d).fp
    one = lambda y: fp.where(F.col("year") == y).groupBy("tile").agg(F.count(F.lit(1)).alias("n")).select(F.lit(y).alias("load"), "tile", "n")
    return W.union_sources([one(1996), one(1997)])


@query("u04_dedupe", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def _(spark, d):
    return W.dedupe(Tables(spark, d).raw("part").select("p_name", "p_partkey"), ["p_name"], ["p_partkey"])


@query("u05_expand_regions", """WITH args AS (SELECT r_name AS name, r_regionkey AS position FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT n_name, n_nationkey + 10 FROM nation WHERE n_nationkey % 4 = 1),
    dim AS (SELECT r_name AS continent, n_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT coalesce(region, name) AS region, min(position) AS position FROM args LEFT JOIN dim ON continent = name GROUP BY 1""")
def _(spark, d):
    t = Tables(spark, d)
    reg, nat = t.raw("region"), t.raw("nation")
    args = reg.where("r_regionkey % 2 = 0").selectExpr("r_name AS name", "r_regionkey AS position").union(nat.where("n_nationkey % 4 = 1").selectExpr("n_name", "n_nationkey + 10"))
    dim = nat.join(reg, F.expr("n_regionkey = r_regionkey")).selectExpr("r_name AS continent", "n_name AS region")
    return W.expand_regions(args, dim)
