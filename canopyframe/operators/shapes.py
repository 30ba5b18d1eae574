"""Polygons as lists of rings: tests of points and boxes, distances, and the pixels of each row that they cover.

A shape is an array of rings (outer ring and holes, in any order), a ring an array of (x, y) structs without its closing
point. A polygon of several parts is several rows, one a part, so that each part has bounds and cells of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import shuffled


#: Columns of a row of pixels that are joined together, as one strip.
_BLOCK = 64


def ring_edges(ring: Column) -> Column:
    """Edges (a, b) of a ring, the closing one included."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so points in holes are outside."""
    crosses = F.filter(edges(rings), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(crosses) % 2 == 1


def on_border(x: Column, y: Column, rings: Column) -> Column:
    return F.exists(edges(rings), lambda e: (
        ((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) == (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"]))
        & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
    ))


def border_distance(x: Column, y: Column, rings: Column) -> Column:
    """Distance of a point from the nearest edge, in the units of both."""
    def away(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.sqrt(F.pow(e["a"]["x"] + t * dx - x, 2) + F.pow(e["a"]["y"] + t * dy - y, 2))

    return F.array_min(F.transform(edges(rings), away))


def meets_box(rings: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a shape and a box have a point in common, borders included: an edge passes the box, or the box lies inside.

    An edge is cut to the part of it between the box's sides, first in x, then in y; nothing may be left of it. A box
    within a hole meets nothing.
    """
    never = F.struct(F.lit(2.0).alias("from"), F.lit(-1.0).alias("to"))

    def between(p, q, low, high):
        a, b = F.try_divide(low - p, q - p), F.try_divide(high - p, q - p)
        part = F.struct(F.least(a, b).alias("from"), F.greatest(a, b).alias("to"))
        whole = F.struct(F.lit(0.0).alias("from"), F.lit(1.0).alias("to"))
        return F.when(p != q, part).when(p.between(low, high), whole).otherwise(never)

    def passes(e):
        x, y = between(e["a"]["x"], e["b"]["x"], xmin, xmax), between(e["a"]["y"], e["b"]["y"], ymin, ymax)
        return F.greatest(F.lit(0.0), x["from"], y["from"]) <= F.least(F.lit(1.0), x["to"], y["to"])

    return F.exists(edges(rings), passes) | inside(xmin, ymin, rings)


def shaped(df: DataFrame) -> DataFrame:
    """df with a column ``rings`` and its bounds, one row a part: from ``parts`` (shapes), ``rings`` or a single ``ring``."""
    if "parts" in df.columns:
        df = df.drop("rings", "ring").withColumn("rings", F.explode("parts")).drop("parts")
    elif "rings" not in df.columns:
        df = df.withColumn("rings", F.array("ring")).drop("ring")
    points = F.flatten("rings")
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return df.drop("xmin", "ymin", "xmax", "ymax").select("*", F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def row_spans(shapes: DataFrame, keys, touched: bool = False) -> DataFrame:
    """Runs of pixels of each row that shapes cover: keys, row, first, last (inclusive); runs of one row do not overlap.

    shapes: keys, rings in coordinates, and the grid a, e, c, f, width, height that they are laid on, one row a part; rows
    with equal keys are parts of one polygon. A pixel is covered if its centre is inside, or with ``touched`` if the shape
    and the closed pixel have a point in common. Every edge is cut into the rows that it passes, which are
    brought together by row: a row's crossings in order give its runs, and with ``touched`` the columns that each edge
    passes are added. A row holds at most the edges of one polygon.
    """
    keys = list(keys)
    grid = [F.col(k) for k in ("c", "a", "f", "e")]
    u, t = (lambda p: (p["x"] - grid[0]) / grid[1]), (lambda p: (p["y"] - grid[2]) / grid[3])
    cut = F.transform(edges(F.col("rings")), lambda e: F.struct(u(e["a"]).alias("u0"), t(e["a"]).alias("t0"), u(e["b"]).alias("u1"), t(e["b"]).alias("t1")))
    parts = shapes.select(*keys, "width", "height", F.explode(cut).alias("g")).select(*keys, "width", "height", "g.*")
    low, high = F.least("t0", "t1"), F.greatest("t0", "t1")
    # closed rows that an edge passes; a border between two rows belongs to both
    rows = F.sequence(F.greatest(F.ceil(low) - 1, F.lit(0)), F.least(F.floor(high), F.col("height") - 1))
    passing = (F.floor(high) >= 0) & (F.ceil(low) - 1 <= F.col("height") - 1)
    parts = parts.where(passing).withColumn("row", F.explode(rows))
    mid = F.col("row") + 0.5
    at = lambda y: F.col("u0") + (y - F.col("t0")) / (F.col("t1") - F.col("t0")) * (F.col("u1") - F.col("u0"))
    crossing = F.when((F.col("t0") > mid) != (F.col("t1") > mid), at(mid))
    level = F.col("t0") == F.col("t1")
    ends = [F.when(level, F.col(k)).otherwise(at(F.greatest(low, F.least(high, y)))) for k, y in (("u0", F.col("row")), ("u1", F.col("row") + 1))]
    passed = F.struct((F.ceil(F.least(*ends)) - 1).alias("first"), F.floor(F.greatest(*ends)).alias("last"))
    lines = parts.groupBy(*keys, "row").agg(F.first("width").alias("width"), F.sort_array(F.collect_list(crossing)).alias("xs"), F.collect_list(passed).alias("passed"))
    pairs = F.when(F.size("xs") > 1, F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(pairs, lambda i: F.struct(F.ceil(F.get("xs", 2 * i) - 0.5).alias("first"), (F.ceil(F.get("xs", 2 * i + 1) - 0.5) - 1).alias("last")))
    if touched:
        runs = F.concat(runs, "passed")
    kept = F.filter(F.transform(runs, lambda r: F.struct(F.greatest(r["first"], F.lit(0)).alias("first"), F.least(r["last"], F.col("width") - 1).alias("last"))), lambda r: r["first"] <= r["last"])
    if not touched:  # crossings in order: their runs are apart
        return lines.select(*keys, "row", F.explode(kept).alias("_r")).select(*keys, "row", "_r.first", "_r.last")
    # runs in order, each cut to what lies behind all before it
    lines = lines.select(*keys, "row", F.sort_array(kept).alias("_runs"))
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice("_runs", 1, i), lambda r: r["last"])), F.lit(-1).cast("long"))
    apart = F.transform("_runs", lambda r, i: F.struct(F.greatest(r["first"], reach(i) + 1).alias("first"), r["last"].alias("last")))
    return lines.select(*keys, "row", F.explode(F.filter(apart, lambda r: r["first"] <= r["last"])).alias("_r")).select(*keys, "row", "_r.first", "_r.last")


def alike(df: DataFrame, key: str, value: Column, by=()) -> tuple[DataFrame, DataFrame]:
    """Rows of equal values brought down to one: (rep, by, value), and (key, rep) of all keys.

    A key's rows are taken together, as an array in order; rep is a struct of the least key with such an array.
    """
    own = df.groupBy(key, *by).agg(F.sort_array(F.collect_list(value)).alias("_v"))  # the rows of one key
    kinds = own.groupBy(*by, "_v").agg(F.min(F.struct(F.col(key).alias("id"))).alias("rep"))
    members = own.join(kinds, [*by, "_v"]).select(key, "rep")
    return kinds.select("rep", *by, F.col("_v").alias("value")), members


def alike_shapes(polys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Polygons of one zone and outline brought down to one: (rep, epsg, parts) and (key, rep)."""
    parts = F.col("parts") if "parts" in polys.columns else F.array("rings") if "rings" in polys.columns else F.array(F.array("ring"))
    kinds, members = alike(polys.select(key, "epsg", F.explode(parts).alias("_part")), key, F.col("_part"), ("epsg",))
    return kinds.withColumnRenamed("value", "parts"), members


def covered_runs(polys: DataFrame, rasters: DataFrame, pixels: DataFrame, key: str, touched: bool = False, cell: float = 10_000.0) -> DataFrame:
    """Runs of pixels of the rasters of its zone that each polygon covers: key and cells, an array of the columns of pixels.

    polys: key, epsg and a shape (``ring``, ``rings`` or ``parts``); rasters: raster_id, epsg, a, e, c, f, width, height;
    pixels: raster_id, row, col and others. Polygons meet rasters by the cells of ``cell`` metres that their bounds touch,
    and pixels by row and strip: no pixel is tested against an outline. Parts of one polygon do not overlap.
    """
    from .joins import touched_cells

    shapes = shaped(polys.select(key, "epsg", *[k for k in ("parts", "rings", "ring") if k in polys.columns]))
    shapes = shapes.withColumn("_c", touched_cells(cell)).select("*", "_c.cx", "_c.cy").drop("_c")
    x1, y1 = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    grids = rasters.select("raster_id", "epsg", "a", "e", "c", "f", "width", "height", F.least("c", x1).alias("rx0"), F.least("f", y1).alias("ry0"), F.greatest("c", x1).alias("rx1"), F.greatest("f", y1).alias("ry1"))
    grids = grids.withColumn("_c", touched_cells(cell, "rx0", "ry0", "rx1", "ry1")).select("*", "_c.cx", "_c.cy").drop("_c")
    meet = (F.col("xmin") <= F.col("rx1")) & (F.col("xmax") >= F.col("rx0")) & (F.col("ymin") <= F.col("ry1")) & (F.col("ymax") >= F.col("ry0"))
    own = (F.floor(F.greatest("xmin", "rx0") / cell) == F.col("cx")) & (F.floor(F.greatest("ymin", "ry0") / cell) == F.col("cy"))
    laid = shapes.join(grids, ["epsg", "cx", "cy"]).where(meet & own)
    # parts of one polygon share its runs, so that a pixel of two of them is there once
    parts = max(1, int(polys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = laid.select(F.col(key).alias("_key"), "raster_id", "rings", "a", "e", "c", "f", "width", "height").repartition(parts, "_key", "raster_id", "rings")
    spans = row_spans(laid, ["_key", "raster_id"], touched)
    block = lambda k: F.floor(F.col(k) / _BLOCK)
    strips = pixels.groupBy("raster_id", "row", block("col").alias("_b")).agg(F.collect_list(F.struct(*pixels.columns)).alias("_p"))  # _BLOCK columns
    spans = spans.withColumn("_b", F.explode(F.sequence(block("first"), block("last"))))
    hit = shuffled(spans).join(shuffled(strips), ["raster_id", "row", "_b"])
    cells = F.filter("_p", lambda p: p["col"].between(F.col("first"), F.col("last")))
    return hit.select(F.col("_key").alias(key), cells.alias("cells")).where("size(cells) > 0")


def covered_pixels(polys: DataFrame, rasters: DataFrame, pixels: DataFrame, key: str, touched: bool = False, cell: float = 10_000.0) -> DataFrame:
    """Pixels that each polygon covers, as for ``covered_runs``: key and the columns of pixels, each pixel once a polygon.

    Polygons of equal outlines are laid once.
    """
    kinds, members = alike_shapes(polys, key)
    runs = covered_runs(kinds, rasters, pixels, "rep", touched, cell)
    return shuffled(members).join(shuffled(runs), "rep").select(key, F.explode("cells").alias("_p")).select(key, "_p.*")
