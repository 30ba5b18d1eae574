"""Membership, lookup and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cylindrical
from ..semantics import first_by, small, written
from .ranks import with_percentiles
from .shapes import alike, alike_shapes, border_distance, covered_runs, inside, meets_box, on_border, shaped


def in_split(df: DataFrame, splits: DataFrame, mode: str, tile: str = "tile") -> DataFrame:
    return df.join(small(splits.where(F.col("split") == mode).select(tile)), tile, "left_semi")


def hold_out(df: DataFrame, tile_regions: DataFrame, region_continents: DataFrame, continent: str, keep: bool = False, tile: str = "tile") -> DataFrame:
    """Rows outside a continent's tiles, or only those inside."""
    regions = region_continents.where(F.col("continent") == continent).select("region")
    tiles = tile_regions.join(small(regions), "region", "left_semi").select(tile).distinct()
    return df.join(small(tiles), tile, "left_semi" if keep else "left_anti")


def drop_overlaps(df: DataFrame, overlaps: DataFrame, keys=("tile", "year", "idx")) -> DataFrame:
    return df.join(overlaps.select(*keys), list(keys), "left_anti")


# geometry -------------------------------------------------------------------------------------------------------


def touched_cells(size: float, xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> Column:
    """Grid cells that a box touches: the equi-key of a range join."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    return F.explode(F.flatten(F.transform(F.sequence(at(xmin), at(xmax)), lambda i: F.transform(F.sequence(at(ymin), at(ymax)), lambda j: F.struct(i.alias("cx"), j.alias("cy"))))))


def tiles_per_region(tiles: DataFrame, regions: DataFrame, cell: float = 10.0) -> DataFrame:
    """Tiles and regions that intersect, borders included. Tiles are boxes; regions boxes or shapes (``ring``, ``rings``
    or ``parts``), with holes and of several parts. They meet by grid cell of each part's bounds; a pair is tested in the
    cell of the lower left corner of what the bounds share."""
    polygons = not {"xmin", "ymin", "xmax", "ymax"} <= set(regions.columns)
    right = shaped(regions) if polygons else regions
    cells = lambda df: df.select("*", touched_cells(cell).alias("_c")).select("*", "_c.cx", "_c.cy").drop("_c")
    t, r = cells(tiles).alias("t"), cells(right).alias("r")
    meets = (F.col("t.xmin") <= F.col("r.xmax")) & (F.col("t.xmax") >= F.col("r.xmin")) & (F.col("t.ymin") <= F.col("r.ymax")) & (F.col("t.ymax") >= F.col("r.ymin"))
    own = (F.floor(F.greatest("t.xmin", "r.xmin") / cell) == F.col("t.cx")) & (F.floor(F.greatest("t.ymin", "r.ymin") / cell) == F.col("t.cy"))
    both = t.join(r, (F.col("t.cx") == F.col("r.cx")) & (F.col("t.cy") == F.col("r.cy"))).where(meets & own)
    if not polygons:
        return both.select("r.region", "t.tile")
    both = both.where(meets_box(F.col("r.rings"), *[F.col(f"t.{k}") for k in ("xmin", "ymin", "xmax", "ymax")]))
    return both.select("r.region", "t.tile").distinct()  # a tile may meet several parts


def _hits_in(points: DataFrame, polys: DataFrame, how: str, cell: float) -> DataFrame:
    polys = shaped(polys.select(*[c for c in ("ring", "rings", "parts") if c in polys.columns]))
    cells = polys.select("rings", "xmin", "ymin", "xmax", "ymax", touched_cells(cell).alias("cell")).select("*", "cell.cx", "cell.cy")
    at = points.select("id", "x", "y", F.floor(F.col("x") / cell).cast("long").alias("cx"), F.floor(F.col("y") / cell).cast("long").alias("cy"))
    x, y, rings = F.col("x"), F.col("y"), F.col("rings")
    boundary = on_border(x, y, rings)
    hit = (inside(x, y, rings) & ~boundary) if how == "within" else (inside(x, y, rings) | boundary)
    return at.join(cells, ["cx", "cy"]).where(x.between(F.col("xmin"), F.col("xmax")) & y.between(F.col("ymin"), F.col("ymax"))).where(hit).select("id")


def points_in(points: DataFrame, polys: DataFrame, how: str = "within", keep: bool = True, cell: float = 10.0) -> DataFrame:
    """Points inside any polygon (or outside all): a grid cell equi-join, then ray casting. ``within`` leaves
    out the boundary, that of holes too, ``intersects`` takes it in. points: id, x, y; polys: ``ring``, ``rings`` or ``parts``."""
    return points.join(_hits_in(points, polys, how, cell).distinct(), "id", "left_semi" if keep else "left_anti")


def spatial_marks(points: DataFrame, within: dict[str, DataFrame], near: dict[str, tuple[DataFrame, float]] | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with a flag for each named set of shapes: that it lies in one of ``within`` (borders included), or no further
    than so many metres from one of ``near``. All points stay, once each; one join brings all flags back.

    points: id, lon, lat and others; shapes as for ``points_in``. A point without coordinates or an id has no flag set.
    """
    at = points.select("id", F.col(lon).alias("x"), F.col(lat).alias("y"))
    hits = [_hits_in(at, polys, "intersects", 10.0).withColumn("_mark", F.lit(name)) for name, polys in within.items()]
    hits += [_hits_near(at.withColumnsRenamed({"x": "lon", "y": "lat"}), polys, metres, 500_000.0).withColumn("_mark", F.lit(name)) for name, (polys, metres) in (near or {}).items()]
    if not hits:
        return points
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    names = [*within, *(near or {})]
    flags = found.groupBy("id").agg(*[F.max(F.col("_mark") == n).alias(n) for n in names])
    return points.join(flags, "id", "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})


def overlap_join(points: DataFrame, centers: DataFrame, half: float = 640.0) -> DataFrame:
    """Points inside any square of ``half`` around a centre of the same zone, each once; borders are outside."""
    boxes = centers.select("epsg", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("x") - half).alias("xmin"), (F.col("y") - half).alias("ymin"), (F.col("x") + half).alias("xmax"), (F.col("y") + half).alias("ymax"))
    size = 2 * half
    boxes = boxes.select("*", touched_cells(size).alias("cell")).select("*", "cell.cx", "cell.cy")
    at = points.withColumn("cx", F.floor(F.col("x") / size).cast("long")).withColumn("cy", F.floor(F.col("y") / size).cast("long"))
    near = (F.abs(F.col("x") - F.col("ox")) < half) & (F.abs(F.col("y") - F.col("oy")) < half)
    return points.join(at.join(boxes, ["epsg", "cx", "cy"]).where(near).select("id").distinct(), "id", "left_semi")


def _hits_near(points: DataFrame, regions: DataFrame, buffer_m: float, cell_m: float) -> DataFrame:
    at = points.select("id", *cylindrical("lon", "lat"))
    r = 6371007.0
    flat = lambda p: F.struct((F.radians(p["x"]) * r).alias("x"), (F.sin(F.radians(p["y"])) * r).alias("y"))
    parts = shaped(regions).select(F.transform("rings", lambda ring: F.transform(ring, flat)).alias("rings"))
    parts = shaped(parts).selectExpr("rings", *[f"{k} {s} {float(buffer_m)!r}D AS {k}" for k, s in (("xmin", "-"), ("ymin", "-"), ("xmax", "+"), ("ymax", "+"))])
    parts = parts.select("*", touched_cells(cell_m).alias("_c")).select("*", "_c.cx", "_c.cy")
    x, y = F.col("mx"), F.col("my")
    at = at.withColumn("cx", F.floor(x / cell_m).cast("long")).withColumn("cy", F.floor(y / cell_m).cast("long"))
    boxed = x.between(F.col("xmin"), F.col("xmax")) & y.between(F.col("ymin"), F.col("ymax"))
    return at.join(parts, ["cx", "cy"]).where(boxed).where(inside(x, y, F.col("rings")) | (border_distance(x, y, F.col("rings")) <= buffer_m)).select("id")


def near_regions(points: DataFrame, regions: DataFrame, buffer_m: float, cell_m: float = 500_000.0) -> DataFrame:
    """Points within ``buffer_m`` of a region's outline or inside it, in equal-area metres; a point in a hole counts by its
    distance from the hole's edge. They meet by the grid cells that the bounds of a part and the buffer touch."""
    return points.join(_hits_near(points, regions, buffer_m, cell_m).distinct(), "id", "left_semi")


# lookups --------------------------------------------------------------------------------------------------------


def lite_to_original(lite: DataFrame, mapping: DataFrame) -> DataFrame:
    return lite.join(mapping, "lite_idx")


def paired_samples(points: DataFrame, sources: dict[str, DataFrame], keys) -> DataFrame:
    """Points at which every source has a value."""
    for name, source in sources.items():
        points = points.join(source.select(*keys, F.col("value").alias(name)), list(keys), "left")
    return points.dropna(subset=list(sources))


def embed_class(df: DataFrame, table: DataFrame, cls: str = "cls", default: int = 0) -> DataFrame:
    """Class vector by lookup; classes that the table lacks take the default's."""
    fallback = table.where(F.col("mapping") == default).select(F.col("vector").alias("_default"))
    out = df.join(small(table.select(F.col("mapping").alias(cls), F.col("vector").alias("_own"))), cls, "left")
    return out.join(F.broadcast(fallback.limit(1)), F.lit(True), "left").withColumn("vector", F.coalesce("_own", "_default")).drop("_own", "_default")


def residual_features(df: DataFrame, stats: DataFrame, keys, columns, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """Normalised statistics of the row's group; groups without statistics take zeros."""
    out = df.join(small(stats), list(keys), "left")
    for c in columns:
        mean, std = scale[c]
        out = out.withColumn(c, F.coalesce((F.col(c) - mean) / std, F.lit(0.0)))
    return out


def assert_aligned(a: DataFrame, b: DataFrame, keys, value: str, tol: float = 1e-6) -> DataFrame:
    """Rows of either side that the other lacks or whose values differ."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), list(keys), "full")
    return both.agg(
        F.count_if(F.col("_in_b").isNull()).alias("only_a"), F.count_if(F.col("_in_a").isNull()).alias("only_b"),
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & ~F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tol, F.col("_a").isNull() & F.col("_b").isNull())).alias("different"),
    )


def files_for_area(areas: DataFrame, files: DataFrame, known: DataFrame | None = None, cell: float = 5000.0) -> DataFrame:
    """Files of an area's zone whose bounds overlap it; areas with a known mapping use that alone."""
    rest = areas if known is None else areas.join(known.select("area").distinct(), "area", "left_anti")
    a = rest.select("area", "epsg", "xmin", "ymin", "xmax", "ymax", touched_cells(cell).alias("c"))
    f = files.select("file", "epsg", *[F.col(k).alias(f"f{k}") for k in ("xmin", "ymin", "xmax", "ymax")], touched_cells(cell).alias("c"))
    meets = (F.col("xmin") < F.col("fxmax")) & (F.col("xmax") > F.col("fxmin")) & (F.col("ymin") < F.col("fymax")) & (F.col("ymax") > F.col("fymin"))
    out = a.join(f, ["epsg", "c"]).where(meets).select("area", "file").distinct()
    return out if known is None else known.select("area", "file").unionByName(out)


def file_bounds(files: DataFrame, anchors: DataFrame, size: int, pixel: float) -> DataFrame:
    """Bounds of files named <prefix>-<row>-<col> from their offsets and one anchored corner of the prefix."""
    f = files.select("file", F.regexp_extract("file", r"^(.*)-\d+-\d+$", 1).alias("prefix"), F.regexp_extract("file", r"-(\d+)-\d+$", 1).cast("long").alias("row"), F.regexp_extract("file", r"-(\d+)$", 1).cast("long").alias("col"))
    out = f.join(small(anchors), "prefix")
    x, y = F.col("x0") + F.col("col") * pixel, F.col("y0") - F.col("row") * pixel
    return out.select("file", "epsg", x.alias("xmin"), (y - size * pixel).alias("ymin"), (x + size * pixel).alias("xmax"), y.alias("ymax"))


def missing_outputs(expected: DataFrame, present: DataFrame, keys) -> DataFrame:
    return expected.join(present.select(*keys), list(keys), "left_anti")


def compare_extents(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_b") < 0.99 * F.col("_a")).alias("shrunk"), F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop(F.when(F.col("_b").isNotNull(), F.col("_a"))) * F.stddev_pop(F.when(F.col("_a").isNotNull(), F.col("_b")))).alias("corr")
    )


def pick_scene(plots: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene with the lowest score among those of a plot's tiles, the first name on a tie; one without a score comes last.

    A tile's best scene is the best for all of its plots, so scenes are brought down to one a tile before plots meet them.
    """
    rank = F.struct(F.col("score").isNull().alias("none"), "score", F.col("scene").isNull().alias("unnamed"), "scene")
    best = scenes.groupBy("tile").agg(F.min(rank).alias("_s"))
    wanted = plots.select("plot", F.explode("tiles").alias("tile"))
    return wanted.join(best, "tile").groupBy("plot").agg(F.min("_s").alias("_s")).select("plot", "_s.scene", "_s.score")


def resolve_product(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Product with the requested name, else the first one of the same tile and acquisition time.

    requests: request, name, tile, stamp; products: product, tile, stamp. Requests without either have no product.
    """
    exact = products.select(F.col("product").alias("name"), F.col("product").alias("exact")).distinct()
    by_time = products.groupBy("tile", "stamp").agg(F.min("product").alias("similar"))
    out = requests.join(exact, "name", "left").join(by_time, ["tile", "stamp"], "left")
    return out.select("request", F.coalesce("exact", "similar").alias("product"))


def best_run(configs: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Run with the lowest error for each configuration, joined by its name."""
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in key])
    runs = first_by(results.withColumn("_name", name), ["_name"], [F.col("rmse"), F.col("run")]).select("_name", "run", "rmse")
    return configs.withColumn("_name", name).join(runs, "_name").drop("_name")


def required_tiles(samples: DataFrame, reach: float, lon="lon", lat="lat") -> DataFrame:
    """1-degree cells that the four corners of a sample's patch fall in."""
    corners = F.array(*[F.struct(F.floor(F.col(lon) + sx * reach).alias("cx"), F.floor(F.col(lat) + sy * reach).alias("cy")) for sx in (-1, 1) for sy in (-1, 1)])
    return samples.select("id", F.explode(corners).alias("c")).select("id", "c.cx", "c.cy").distinct()


def sample_raster(points: DataFrame, rasters: DataFrame, pixels: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Value of the pixel that holds a point (left <= x < right, bottom < y <= top); no data is NULL.

    points: id, raster_id, x, y. Rotated or south-up rasters are refused. Points of a raster meet its pixels by
    (raster, row, column).
    """
    grid = rasters.where(F.when(F.col("e") < 0, True).otherwise(F.raise_error(F.lit("raster is not north-up")).cast("boolean")))
    at = points.join(small(grid.select("raster_id", "a", "e", "c", "f", "width", "height")), "raster_id")
    at = at.withColumn("row", F.floor((F.col("f") - F.col("y")) / -F.col("e"))).withColumn("col", F.floor((F.col("x") - F.col("c")) / F.col("a")))
    at = at.where((F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width")))
    out = at.select("id", "raster_id", "row", "col").join(pixels.select("raster_id", "row", "col", "value"), ["raster_id", "row", "col"], "left")
    return out.select("id", "raster_id", "row", "col", F.when(F.col("value") != nodata, F.col("value")).alias("value"))


#: Values of a zone that are sorted together; larger zones' percentiles are found by counting digits.
_HELD = 10_000


def _zone_values(hits: DataFrame, value: str) -> DataFrame:
    """Count, mean, median and 90th percentile of each zone of hits (zone, value)."""
    names = {"median": 0.5, "p90": 0.9}
    hits = written(hits.select("zone", value))
    sums = hits.groupBy("zone").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    large = small(sums.where(F.col("n") > _HELD).select("zone"))
    same = F.col("h.zone").eqNullSafe(F.col("l.zone"))
    few = hits.alias("h").join(large.alias("l"), same, "left_anti").groupBy("zone").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sort_array(F.filter(F.collect_list(value), lambda v: ~F.isnan(v.cast("double")))).alias("_v"))  # _HELD values at most
    h = lambda p: F.lit(p) * (F.size("_v") - 1)
    at = lambda k: F.get("_v", k.cast("int"))
    between = lambda p: F.when(F.floor(h(p)) == F.ceil(h(p)), at(F.floor(h(p)))).otherwise((F.ceil(h(p)) - h(p)) * at(F.floor(h(p))) + (h(p) - F.floor(h(p))) * at(F.ceil(h(p))))
    few = few.select("zone", "n", "mean", *[F.when(F.size("_v") > 0, between(p)).alias(name) for name, p in names.items()])
    if large.isEmpty():
        return few
    rest = hits.alias("h").join(large.alias("l"), same, "left_semi")
    return few.unionByName(with_percentiles(rest.groupBy("zone").agg(F.count(value).alias("n"), F.avg(value).alias("mean")), rest, ["zone"], value, names))


def _for_all(members: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of each representative (zone) for all of its members."""
    return members.join(stats.withColumnRenamed("zone", "rep"), "rep").drop("rep")


def polygon_stats(polys: DataFrame, rasters: DataFrame, pixels: DataFrame, value: str = "value", cell: float = 10_000.0) -> DataFrame:
    """Mean, median and 90th percentile of all pixels that a polygon touches, in the polygon's own zone.

    polys: zone, epsg and a shape; rasters and pixels as for ``covered_runs``. Missing values count for nothing. Polygons of
    equal outlines are measured once.
    """
    kinds, members = alike_shapes(polys, "zone")
    runs = covered_runs(kinds, rasters, pixels.where(F.col(value).isNotNull()), "rep", touched=True, cell=cell)
    return _for_all(members, _zone_values(runs.select(F.col("rep").alias("zone"), F.explode(f"cells.{value}").alias(value)), value))


def zonal_stats(polys: DataFrame, pixels: DataFrame, cell: float, value: str = "value") -> DataFrame:
    """Mean, median and 90th percentile of the pixels whose centre lies in a box. pixels: x, y, value.

    Zones of equal boxes are measured once.
    """
    kinds, members = alike(polys, "zone", F.struct("xmin", "ymin", "xmax", "ymax"))
    boxes = kinds.select(F.col("rep").alias("zone"), F.explode("value").alias("b")).select("zone", "b.*")
    boxes = boxes.select("*", touched_cells(cell).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    at = pixels.where(F.col(value).isNotNull()).withColumn("cx", F.floor(F.col("x") / cell).cast("long")).withColumn("cy", F.floor(F.col("y") / cell).cast("long"))
    held = at.join(boxes, ["cx", "cy"]).where((F.col("xmin") <= F.col("x")) & (F.col("x") < F.col("xmax")) & (F.col("ymin") < F.col("y")) & (F.col("y") <= F.col("ymax")))
    return _for_all(members, _zone_values(held, value))


def common_coverage(grid: DataFrame, a: DataFrame, b: DataFrame, keys, by) -> DataFrame:
    """Shares of a grid that two sources cover, each and both, and their means where both do."""
    both = grid.join(a.select(*keys, F.col("value").alias("_a")), list(keys), "left").join(b.select(*keys, F.col("value").alias("_b")), list(keys), "left")
    p, q = F.col("_a"), F.col("_b")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    common = p.isNotNull() & q.isNotNull()
    return both.groupBy(*by).agg(
        share(p.isNotNull()).alias("cov_a"), share(q.isNotNull()).alias("cov_b"), share(common).alias("cov_both"), F.avg(F.when(common, p)).alias("mean_a"), F.avg(F.when(common, q)).alias("mean_b")
    )


def tile_refcounts(samples: DataFrame, reach: float) -> DataFrame:
    return required_tiles(samples, reach).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def locate(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range and row inside it of global positions; ranges (start, end exclusive) are one row a tile.

    They meet by blocks of positions as long as a range is on average."""
    size = ranges.agg(F.ceil(F.avg(F.col("end") - F.col("start")))).first()[0]
    block = max(1, int(size or 1))
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)))
    cut = ranges.where(F.col("end") > F.col("start")).withColumn("_b", blocks)
    both = positions.withColumn("_b", F.floor(F.col("position") / block)).join(cut, "_b").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("end")))
    return both.drop("_b").withColumn("row", F.col("position") - F.col("start"))


def index_ranges(sizes: DataFrame, order) -> DataFrame:
    """Start and end of each group in the global order, on the table of sizes."""
    run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("end", F.sum("n").over(run)).withColumn("start", F.col("end") - F.col("n"))
