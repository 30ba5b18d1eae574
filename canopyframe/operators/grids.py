"""Grids of a place's own zone that rasters of any zone are brought onto: coverage of plots, mosaics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import HALF_DEG, projected, unprojected, utm_epsg
from ..semantics import shuffled, small, written
from .raster import ROW, laid_values, overlapping


def plot_grids(plots: DataFrame, key: str = "plot", half_deg: float = HALF_DEG, res: float = 10.0) -> DataFrame:
    """Grid of ``res`` metres over each plot's cell (lon and lat, ``half_deg`` either way) in the plot's own zone.

    It follows from the cell alone, never from a raster: the bounds of the cell's projected corners, north up.
    Returns grid (the key), epsg, a, e, c, f, width, height.
    """
    at = plots.select(F.col(key).alias("grid"), "lon", "lat", utm_epsg("lon", "lat").alias("epsg"))
    at = at.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    names = [f"_{i}{j}" for i in "01" for j in "01"]
    for name in names:
        i, j = (half_deg if k == "1" else -half_deg for k in name[1:])
        at = at.withColumn(name, projected(F.col("lon") + i, F.col("lat") + j, "epsg"))
    x, y = ([F.col(f"{n}.{k}") for n in names] for k in ("x", "y"))
    at = at.select("grid", "epsg", F.least(*x).alias("c"), F.greatest(*y).alias("f"), F.greatest(*x).alias("_x1"), F.least(*y).alias("_y0"))
    size = lambda d: F.round(d / res).cast("long")
    return at.select("grid", "epsg", F.lit(float(res)).alias("a"), F.lit(-float(res)).alias("e"), "c", "f", size(F.col("_x1") - F.col("c")).alias("width"), size(F.col("f") - F.col("_y0")).alias("height"))


def plot_coverage(plots: DataFrame, first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], key: str = "plot", half_deg: float = HALF_DEG, res: float = 10.0) -> DataFrame:
    """What share of each plot's grid two sources cover, each and both, and their means where both do.

    A source is (rasters, pixels), of any zones and pixel sizes; its pixels come onto the grid by nearest value, the first
    raster by id where several have one. Missing values and places that a source does not reach are not covered, and a
    plot that no raster reaches has shares of 0 and no means. Plots meet rasters by cells of one degree and tiles of
    pixels; the values of a plot are shuffled as arrays, once.
    Returns key, pixels, cov_a, cov_b, cov_both, mean_a, mean_b.
    """
    parts = max(1, int(plots.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grids = written(plot_grids(plots, key, half_deg, res).repartition(parts))

    def laid(source, name):
        rasters, pixels = source
        return laid_values(pixels, rasters, overlapping(grids, rasters)).withColumn("_s", F.lit(name))

    dealt = laid(first, "a").unionByName(laid(second, "b")).repartition(parts, "grid")
    cells = dealt.select("grid", "_s", "raster_id", F.explode(F.arrays_zip("k", "value")).alias("_v")).where("_v.value is not null")
    of = lambda name: F.min_by("_v.value", F.when(F.col("_s") == name, F.col("raster_id"))).alias(f"_{name}")
    both = cells.groupBy("grid", F.col("_v.k").alias("k")).agg(of("a"), of("b"))
    a, b = F.col("_a"), F.col("_b")
    common = a.isNotNull() & b.isNotNull()
    sums = both.groupBy("grid").agg(
        F.count(a).alias("_na"), F.count(b).alias("_nb"), F.count_if(common).alias("_both"), F.avg(F.when(common, a)).alias("mean_a"), F.avg(F.when(common, b)).alias("mean_b")
    )
    out = grids.select("grid", (F.col("width") * F.col("height")).alias("pixels")).join(sums, "grid", "left")
    share = lambda c: F.try_divide(F.coalesce(c, F.lit(0)), "pixels")
    return out.select(F.col("grid").alias(key), "pixels", share("_na").alias("cov_a"), share("_nb").alias("cov_b"), share("_both").alias("cov_both"), "mean_a", "mean_b")


def patches_across(points: DataFrame, rasters: DataFrame, pixels: DataFrame, size: int = 25) -> DataFrame:
    """Square of ``size`` pixels around each point, from its own tile and its neighbours, those of other zones too.

    points: id, raster_id (the primary tile), row, col. A patch is a grid of the primary tile's zone and pixels; what
    lies outside that tile goes through longitude and latitude to the grid of every tile that reaches it, and takes the
    value of the first of them by id that has one. Missing pixels of the primary tile stay missing.
    Returns id and patch, an array row by row.
    """
    half = size // 2
    own = small(rasters.select("raster_id", "epsg", "a", "e", "c", "f", "width", "height"))
    held = F.col("row").between(half, F.col("height") - 1 - half) & F.col("col").between(half, F.col("width") - 1 - half)
    grids = points.select("id", F.col("raster_id"), "row", "col").join(own, "raster_id").select(
        F.struct("id", F.col("raster_id").alias("primary")).alias("grid"), "epsg", "a", "e", (F.col("c") + (F.col("col") - half) * F.col("a")).alias("c"),
        (F.col("f") + (F.col("row") - half) * F.col("e")).alias("f"), F.lit(size).cast("long").alias("width"), F.lit(size).cast("long").alias("height"), held.alias("_held"),
    )
    mine = F.col("raster_id") == F.col("grid.primary")
    # a patch within its primary tile asks no other
    laid = laid_values(pixels, rasters, overlapping(grids, rasters).where(mine | ~F.col("_held")))
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = laid.repartition(parts, "grid").select("grid", "raster_id", F.explode(F.arrays_zip("k", "value")).alias("_v")).where(F.col("_v.value").isNotNull() | mine)
    cells = cells.groupBy("grid", F.col("_v.k").alias("_k")).agg(F.max(mine).alias("_own"), F.max(F.when(mine, F.col("_v.value"))).alias("_first"), F.min_by("_v.value", F.when(~mine, F.col("raster_id"))).alias("_next"))
    place = F.expr(f"_k div {ROW}") * size + F.col("_k") % ROW
    cells = cells.select("grid", place.cast("int").alias("k"), F.when(F.col("_own"), F.col("_first")).otherwise(F.col("_next")).alias("value"))
    found = cells.groupBy("grid").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("_m")).select(F.col("grid.id").alias("grid"), "_m")  # size * size entries at most
    out = shuffled(points.select("id")).join(shuffled(found), F.col("id") == F.col("grid"), "left")
    return out.select("id", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at("_m", k)).alias("patch"))


def _border(rasters: DataFrame) -> DataFrame:
    """Longitude and latitude of nine points along each side of a raster."""
    part = [k / 8 for k in range(9)]
    at = [(u, v) for u in part for v in part if u in (0, 1) or v in (0, 1)]
    points = F.array(*[F.struct((F.col("c") + u * F.col("width") * F.col("a")).alias("x"), (F.col("f") + v * F.col("height") * F.col("e")).alias("y")) for u, v in at])
    return rasters.select("raster_id", "epsg", F.explode(points).alias("p")).select("raster_id", unprojected("p.x", "p.y", "epsg").alias("p")).select("raster_id", "p.lon", "p.lat")


def mosaic_windows(rasters: DataFrame, res: float) -> DataFrame:
    """Window of each raster on the grid of all: grid (raster_id), epsg, a, e, c, f, width, height, row0, col0.

    The zone is that of the centre of the union's bounds. The grid's lines are multiples of ``res``, north up; row0 and col0
    are a window's place on the whole grid. Windows are a pixel wider than their raster's border on all sides.
    """
    box = _boxes(rasters, _union_zone(rasters), res)
    corner = box.agg(F.min("_x0").alias("_left"), F.max("_y1").alias("_top"))
    return _windows(box.join(F.broadcast(corner)), res)


def _union_zone(rasters: DataFrame) -> DataFrame:
    """One row: the zone of the centre of the rasters' union."""
    return _border(rasters).agg(((F.min("lon") + F.max("lon")) / 2).alias("_lon"), ((F.min("lat") + F.max("lat")) / 2).alias("_lat")).select(utm_epsg("_lon", "_lat").alias("epsg"))


def _boxes(rasters: DataFrame, union: DataFrame, res: float) -> DataFrame:
    """Lines of the grid of all around each raster's border, a pixel away from it."""
    laid = _border(rasters).join(F.broadcast(union)).select("raster_id", "epsg", projected("lon", "lat", "epsg").alias("p")).select("raster_id", "epsg", "p.x", "p.y")
    low, high = (lambda k: (F.floor(F.min(k) / res) - 1).alias(f"_{k}0")), (lambda k: (F.ceil(F.max(k) / res) + 1).alias(f"_{k}1"))
    return laid.groupBy("raster_id", "epsg").agg(low("x"), high("x"), low("y"), high("y"))


def _windows(box: DataFrame, res: float) -> DataFrame:
    return box.select(
        F.col("raster_id").alias("grid"), "epsg", F.lit(float(res)).alias("a"), F.lit(-float(res)).alias("e"), (F.col("_x0") * float(res)).alias("c"), (F.col("_y1") * float(res)).alias("f"),
        (F.col("_x1") - F.col("_x0")).alias("width"), (F.col("_y1") - F.col("_y0")).alias("height"), (F.col("_top") - F.col("_y1")).alias("row0"), (F.col("_x0") - F.col("_left")).alias("col0"),
    )


def mosaic_parts(rasters: DataFrame, res: float, side: int = 64) -> DataFrame:
    """Windows of the parts of ``side`` rows and columns of each raster, cut to the raster's own window; grid is a struct
    that begins with raster_id. A long raster of another zone lies askew, and its own window would be mostly empty."""
    starts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(side).cast("long")))
    cut = rasters.where("width > 0 and height > 0").withColumn("_r", starts("height")).withColumn("_c", starts("width"))
    cut = cut.select(
        F.struct("raster_id", "_r", "_c").alias("raster_id"), "epsg", "a", "e", (F.col("c") + F.col("_c") * F.col("a")).alias("c"), (F.col("f") + F.col("_r") * F.col("e")).alias("f"),
        F.least(F.lit(side), F.col("width") - F.col("_c")).alias("width"), F.least(F.lit(side), F.col("height") - F.col("_r")).alias("height"),
    )
    union = _union_zone(rasters)
    whole = _boxes(rasters, union, res)
    corner = whole.agg(F.min("_x0").alias("_left"), F.max("_y1").alias("_top"))
    whole = whole.join(F.broadcast(corner)).select(F.col("raster_id").alias("_id"), "_left", "_top", *[F.col(f"_{k}").alias(f"_w{k}") for k in ("x0", "x1", "y0", "y1")])
    box = _boxes(cut, union, res).join(small(whole), F.col("raster_id.raster_id") == F.col("_id"))
    box = box.withColumns({f"_{k}": F.greatest(f"_{k}", f"_w{k}") for k in ("x0", "y0")}).withColumns({f"_{k}": F.least(f"_{k}", f"_w{k}") for k in ("x1", "y1")})
    return _windows(box, res)


def mosaic_projected(rasters: DataFrame, pixels: DataFrame, res: float = 10.0, priority: str = "raster_id") -> DataFrame:
    """One grid of rasters of any zones: epsg, row, col, value, source; the first valid raster by ``priority`` wins.

    Every part of a raster is brought by nearest value onto its own window of the grid of all, which south-up ones and
    those of another zone fit as well; windows are joined by pixel, so the empty parts of the union are never laid out.
    priority: a column of rasters, each raster's own.
    """
    rasters = written(rasters)
    rank = rasters.select(F.col("raster_id").alias("_id"), F.col(priority).alias("_p"))
    windows = mosaic_parts(rasters, res).join(small(rank), F.col("grid.raster_id") == F.col("_id")).withColumn("raster_id", F.col("_id"))
    windows = windows.withColumn("grid", F.struct("epsg", "row0", "col0", "_p"))
    cells = laid_values(pixels, rasters, windows).select("grid", "raster_id", F.explode(F.arrays_zip("k", "value")).alias("_v")).where("_v.value is not null")
    row, column = F.col("grid.row0") + F.expr(f"_v.k div {ROW}"), F.col("grid.col0") + F.col("_v.k") % ROW
    laid = cells.select("grid.epsg", row.alias("row"), column.alias("col"), F.struct("grid._p", "raster_id", "_v.value").alias("_v"))
    return laid.groupBy("epsg", "row", "col").agg(F.min("_v").alias("_v")).select("epsg", "row", "col", F.col("_v.value").alias("value"), F.col("_v.raster_id").alias("source"))
