"""Rasters as tables of pixels: windows, patches, mosaics, regridding."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import from_utm_array, to_utm_array, utm_epsg
from ..functions.scalar import reflect
from ..semantics import first_by, shuffled, small
from .joins import touched_cells
from .nearest import filled_and_missing
from .ranks import percentiles
from .shapes import covered_pixels

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def _axis(n: Column, size: int, step: int) -> Column:
    """Starts of windows along an axis, the last one anchored to the edge."""
    inner = F.when(n >= size, F.sequence(F.lit(0).cast("long"), n.cast("long") - size, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    edge = F.when((n - size) % step != 0, F.array((n - size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(inner, F.when(n >= size, edge).otherwise(F.array().cast("array<bigint>")))


def windows_overlap(meta: DataFrame, size: int, overlap: int) -> DataFrame:
    """Sliding windows with an overlap; the last row and column are anchored to the edge."""
    step = size - overlap
    out = meta.select("raster_id", "height", "width", F.explode(_axis(F.col("height"), size, step)).alias("row0")).select("raster_id", "row0", F.explode(_axis(F.col("width"), size, step)).alias("col0"))
    return out.withColumn("row1", F.col("row0") + size).withColumn("col1", F.col("col0") + size)


def window_count(meta: DataFrame, size: int, overlap: int) -> DataFrame:
    """Closed form of the number of windows."""
    step = size - overlap
    n = lambda c: F.floor((F.col(c) - size) / step) + 1 + F.when((F.col(c) - size) % step != 0, 1).otherwise(0)
    return meta.select("raster_id", (n("height") * n("width")).alias("windows"))


def windows_padded(meta: DataFrame, size: int, crop: int) -> DataFrame:
    """Windows whose inner parts tile the raster: reads reach ``crop`` over the border and are mirrored there;
    the last inner part is shifted to end at the edge."""
    inner = size - 2 * crop

    def axis(n):
        starts = F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long")), F.lit(inner).cast("long"))
        return F.transform(starts, lambda s: F.greatest(F.lit(0).cast("long"), F.least(s, n.cast("long") - inner)))

    out = meta.select("raster_id", "height", "width", F.explode(axis(F.col("height"))).alias("row0")).select("raster_id", "row0", F.explode(axis(F.col("width"))).alias("col0"))
    return out.withColumn("read_row0", F.col("row0") - crop).withColumn("read_col0", F.col("col0") - crop)


def read_window(windows: DataFrame, meta: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Pixels of padded windows, borders mirrored; height and width of the raster stay with them. Windows are dealt out
    before they are cut into pixels."""
    parts = max(1, int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = windows.drop("height", "width").join(small(meta.select("raster_id", "height", "width")), "raster_id").repartition(parts, "raster_id", "row0", "col0")
    cells = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    cells = cells.withColumn("row", reflect(F.col("read_row0") + F.col("i"), "height")).withColumn("col", reflect(F.col("read_col0") + F.col("j"), "width"))
    return shuffled(cells).join(shuffled(pixels), ["raster_id", "row", "col"], "left").select("raster_id", "row0", "col0", "i", "j", "value", "height", "width")


def centres(meta: DataFrame, step: int, half: int) -> DataFrame:
    """Lattice of window centres, clamped so that windows stay inside."""
    def axis(n):
        starts = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(step).cast("long"))
        return F.array_distinct(F.transform(starts, lambda s: F.greatest(F.lit(half).cast("long"), F.least(s + step // 2, n.cast("long") - 1 - half))))

    return meta.select("raster_id", "height", "width", F.posexplode(axis(F.col("height"))).alias("i", "row")).select("raster_id", "i", "row", F.posexplode(axis(F.col("width"))).alias("j", "col"))


def extract_patches(points: DataFrame, pixels: DataFrame, size: int = 25, width: int = 64) -> DataFrame:
    """Square of pixels around each point, row by row, NULL outside. points: id, raster_id, row, col.

    Pixels are laid as strips of ``width`` columns of one row, shuffled once; a point meets the strips of its patch's
    rows (one or two a row where strips are wider than patches) and takes its part of each.
    """
    half = size // 2
    offsets = F.sequence(F.lit(-half), F.lit(half))
    strips = pixels.groupBy("raster_id", "row", F.floor(F.col("col") / width).alias("strip")).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"))  # width entries at most
    at = lambda d: F.floor((F.col("_c") + d) / width)
    p = points.select("id", "raster_id", F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(offsets).alias("_i"))
    p = p.withColumn("row", F.col("_r") + F.col("_i")).withColumn("strip", F.explode(F.sequence(at(-half), at(half))))
    cells = F.transform(offsets, lambda d: F.struct(((F.col("_i") + half) * size + d + half).alias("k"), F.try_element_at("_m", F.col("_c") + d).alias("value")))
    hit = shuffled(p).join(shuffled(strips), ["raster_id", "row", "strip"]).select("id", F.filter(cells, lambda c: c["value"].isNotNull()).alias("cells"))
    found = hit.groupBy("id").agg(F.map_from_entries(F.flatten(F.collect_list("cells"))).alias("_m"))  # size * size entries at most
    return shuffled(points).join(shuffled(found), "id", "left").select("id", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at("_m", k)).alias("patch"))


def extract_patches_multi(points: DataFrame, tiles: DataFrame, pixels: DataFrame, size: int, step: float) -> DataFrame:
    """Patch around points (id, x, y) across neighbouring tiles: every pixel of the patch finds its own tile, by a
    grid cell that both touch."""
    half, cell = size // 2, 256 * step
    offsets = F.sequence(F.lit(-half), F.lit(half))
    cells = points.withColumn("i", F.explode(offsets)).withColumn("j", F.explode(offsets)).withColumn("px", F.col("x") + F.col("j") * step).withColumn("py", F.col("y") - F.col("i") * step)
    cells = cells.withColumn("cx", F.floor(F.col("px") / cell).cast("long")).withColumn("cy", F.floor(F.col("py") / cell).cast("long"))
    t = tiles.select("raster_id", "c", "f", (F.col("c") + F.col("width") * step).alias("xmax"), (F.col("f") - F.col("height") * step).alias("ymin"))
    t = t.select("*", touched_cells(cell, "c", "ymin", "xmax", "f").alias("_t")).select("*", "_t.cx", "_t.cy").drop("_t")
    inside = (F.col("c") <= F.col("px")) & (F.col("px") < F.col("xmax")) & (F.col("ymin") < F.col("py")) & (F.col("py") <= F.col("f"))
    found = cells.join(t, ["cx", "cy"]).where(inside).withColumn("row", F.floor((F.col("f") - F.col("py")) / step)).withColumn("col", F.floor((F.col("px") - F.col("c")) / step))
    out = found.join(pixels.select("raster_id", "row", "col", "value"), ["raster_id", "row", "col"])
    return out.groupBy("id", "i", "j").agg(F.min_by("value", "raster_id").alias("value"))


def mosaic(pixels: DataFrame, priority: str, key=("gx", "gy"), value: str = "value") -> DataFrame:
    """First valid source wins at each place of the common grid."""
    return pixels.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(F.struct(F.col(value).alias("value"), F.col(priority).alias("source")), priority).alias("_w")).select(*key, "_w.value", "_w.source")


def mosaic_zone(bounds: DataFrame) -> DataFrame:
    """Zone of the centre of all bounds (degrees)."""
    out = bounds.agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
    lon, lat = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return out.select(lon.alias("lon"), lat.alias("lat"), utm_epsg(lon, lat).alias("epsg"))


def north_up(meta: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rasters with rows from north to south: rows mirrored, origin moved to the other end."""
    south = F.col("e") > 0
    flipped = meta.withColumn("f", F.when(south, F.col("f") + F.col("e") * F.col("height")).otherwise(F.col("f"))).withColumn("e", F.when(south, -F.col("e")).otherwise(F.col("e")))
    turn = small(meta.select("raster_id", south.alias("_s"), F.col("height").alias("_h")))
    out = pixels.join(turn, "raster_id").withColumn("row", F.when(F.col("_s"), F.col("_h") - 1 - F.col("row")).otherwise(F.col("row"))).drop("_s", "_h")
    return flipped, out


#: Side of the blocks of a grid's pixels that are laid at once, and of the tiles of a raster's pixels that they meet.
_SIDE = 32
#: Pixels of grids that a task lays in one step.
_STEP = 400_000
#: A row and a column of a grid in one number.
ROW = 2**31


def _degree_cells(meta: DataFrame, name: str) -> DataFrame:
    """Cells of one degree that a grid may touch, from points along its border and a margin; _lon0 and _lat0 are the
    least of them."""
    part = [k / 4 for k in range(5)]
    border = [(u, v) for u in part for v in part if u in (0, 1) or v in (0, 1)]

    @F.pandas_udf("lon0 int, lon1 int, lat0 int, lat1 int")
    def bounds(epsg: pd.Series, a: pd.Series, e: pd.Series, c: pd.Series, f: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        at = lambda start, step, n, w: start.to_numpy()[:, None] + w * (n * step).to_numpy()[:, None]
        u, v = (np.array(k) for k in zip(*border))
        lon, lat = from_utm_array(at(c, a, width, u), at(f, e, height, v), epsg.to_numpy()[:, None])
        ends = {"lon0": lon.min(1) - 0.05, "lon1": lon.max(1) + 0.05, "lat0": lat.min(1) - 0.05, "lat1": lat.max(1) + 0.05}
        return pd.DataFrame({k: np.floor(x).astype("int32") for k, x in ends.items()})

    box = meta.withColumn("_b", bounds("epsg", *[F.col(k).cast("double") for k in ("a", "e", "c", "f", "width", "height")]))
    box = box.withColumn("_lat", F.explode(F.sequence("_b.lat0", "_b.lat1"))).withColumn("_lon", F.explode(F.sequence("_b.lon0", "_b.lon1")))
    return box.withColumn(f"_lat0_{name}", F.col("_b.lat0")).withColumn(f"_lon0_{name}", F.col("_b.lon0")).drop("_b")


def overlapping(dst: DataFrame, src: DataFrame) -> DataFrame:
    """Rows of dst (grids) with the raster_id of each raster that they may overlap, met by cells of one degree; a pair
    is kept in the first cell that both touch."""
    rasters = _degree_cells(src, "r").select("raster_id", "_lat", "_lon", "_lat0_r", "_lon0_r")
    both = _degree_cells(dst, "g").join(small(rasters), ["_lat", "_lon"])
    first = (F.col("_lat") == F.greatest("_lat0_g", "_lat0_r")) & (F.col("_lon") == F.greatest("_lon0_g", "_lon0_r"))
    return both.where(first).select(*dst.columns, "raster_id")


def _laid(batches):
    """Pixels of blocks of grids that lie on a raster: one row for each tile of the raster that a block meets."""
    for batch in batches:
        col = {k: batch[k].to_numpy(zero_copy_only=False) for k in batch.schema.names if k not in ("grid", "raster_id")}
        other = col["epsg"] != col["s_epsg"]

        def place(rows, r, c):
            x, y = col["c"][rows] + (c + 0.5) * col["a"][rows], col["f"][rows] + (r + 0.5) * col["e"][rows]
            far = np.flatnonzero(other[rows])
            if len(far):
                k = rows[far]
                x[far], y[far] = to_utm_array(*from_utm_array(x[far], y[far], col["epsg"][k]), col["s_epsg"][k])
            return np.floor((y - col["s_f"][rows]) / col["s_e"][rows]), np.floor((x - col["s_c"][rows]) / col["s_a"][rows])

        # a block whose corners leave it beside the raster, by more than their distance could bend, has no pixel on it
        rows = np.repeat(np.arange(len(other)), 4)
        u, v = np.tile([0, 0, 1, 1], len(other)), np.tile([0, 1, 0, 1], len(other))
        r, c = (k.reshape(-1, 4) for k in place(rows, col["row0"][rows] + u * (col["rows"][rows] - 1), col["col0"][rows] + v * (col["cols"][rows] - 1)))
        reach = 2 + 0.01 * ((r.max(1) - r.min(1)) + (c.max(1) - c.min(1)))
        near = (r.max(1) + reach >= 0) & (r.min(1) - reach < col["s_height"]) & (c.max(1) + reach >= 0) & (c.min(1) - reach < col["s_width"])
        kept = np.flatnonzero(near)
        sizes = (col["rows"] * col["cols"])[kept]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _STEP)) + 1
        for part in np.split(kept, cuts):
            if not len(part):
                continue
            n = (col["rows"] * col["cols"])[part]
            rows = np.repeat(part, n)
            k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            row, column = col["row0"][rows] + k // col["cols"][rows], col["col0"][rows] + k % col["cols"][rows]
            r, c = place(rows, row, column)
            on = np.flatnonzero((r >= 0) & (r < col["s_height"][rows]) & (c >= 0) & (c < col["s_width"][rows]))
            if not len(on):
                continue
            r, c, rows = r[on].astype("int64"), c[on].astype("int64"), rows[on]
            order = np.lexsort((c // _SIDE, r // _SIDE, rows)) if max(len(col["row0"]), r.max(), c.max()) >= 2**20 else np.argsort((rows << 40) + (r // _SIDE << 20) + c // _SIDE, kind="stable")
            on, r, c, rows = on[order], r[order], c[order], rows[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(r // _SIDE) != 0) | (np.diff(c // _SIDE) != 0)]))
            ends = pa.array(np.append(new, len(rows)).astype("int32"))
            lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x))
            taken = pa.array(rows[new])
            yield pa.RecordBatch.from_arrays(
                [batch["grid"].take(taken), batch["raster_id"].take(taken), pa.array(r[new] // _SIDE), pa.array(c[new] // _SIDE), lists(row[on] * ROW + column[on]), lists((r % _SIDE * _SIDE + c % _SIDE).astype("int32"))],
                ["grid", "raster_id", "_tr", "_tc", "k", "_at"],
            )


def _tiles(pixels: DataFrame) -> DataFrame:
    """Values of a raster's pixels as arrays, one a tile, row by row; NULL where there is none."""
    strip = [F.min(F.when(F.col("col") % _SIDE == j, F.col("value"))) for j in range(_SIDE)]
    strips = pixels.groupBy("raster_id", "row", F.floor(F.col("col") / _SIDE).alias("_tc")).agg(*[v.alias(f"_{j}") for j, v in enumerate(strip)])
    one = F.struct((F.col("row") % _SIDE).cast("int").alias("i"), F.array(*[f"_{j}" for j in range(_SIDE)]).alias("v"))
    tiles = strips.groupBy("raster_id", F.floor(F.col("row") / _SIDE).alias("_tr"), "_tc").agg(F.map_from_entries(F.collect_list(one)).alias("_m"))  # one entry a row
    none = F.array_repeat(F.lit(None).cast("double"), _SIDE)
    rows = F.transform(F.sequence(F.lit(0), F.lit(_SIDE - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), none))
    return tiles.select("raster_id", "_tr", "_tc", F.flatten(rows).alias("_t"))


def laid_values(pixels: DataFrame, src: DataFrame, pairs: DataFrame, missing: bool = False) -> DataFrame:
    """Nearest values of rasters on grids as arrays: grid, raster_id, k (row * 2^31 + column of the grid) and value.

    pairs: grid, epsg, a, e, c, f, width, height and the raster_id that the grid is laid on. Grids are cut into blocks,
    which are dealt out; every pixel's centre is projected into the raster. Blocks meet a raster's values by tiles, a
    row for each that a block meets, so neither pixels nor values are shuffled one by one. Places of a raster without a
    pixel are NULL; tiles without any are left out, but with ``missing``.
    """
    starts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(_SIDE).cast("long")))
    d = pairs.where("width > 0 and height > 0").select("grid", "raster_id", "epsg", "a", "e", "c", "f", F.col("width").cast("long"), F.col("height").cast("long"))
    d = d.withColumn("row0", starts("height")).withColumn("col0", starts("width"))
    d = d.withColumn("rows", F.least(F.lit(_SIDE), F.col("height") - F.col("row0"))).withColumn("cols", F.least(F.lit(_SIDE), F.col("width") - F.col("col0")))
    s = small(src.select("raster_id", *[F.col(k).alias(f"s_{k}") for k in ("epsg", "a", "e", "c", "f", "width", "height")]))
    parts = max(1, int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = d.drop("width", "height").join(s, "raster_id").repartition(parts, "grid", "row0", "col0")
    types = dict(d.dtypes)
    schema = f"grid {types['grid']}, raster_id {types['raster_id']}, _tr long, _tc long, k array<long>, _at array<int>"
    laid = shuffled(d.mapInArrow(_laid, schema)).join(shuffled(_tiles(pixels)), ["raster_id", "_tr", "_tc"], "left" if missing else "inner")
    return laid.select("grid", "raster_id", "k", F.transform("_at", lambda i: F.get("_t", i)).alias("value"))


def regrid(pixels: DataFrame, src: DataFrame, dst: DataFrame, pairs: DataFrame | None = None, missing: bool = False) -> DataFrame:
    """Nearest value on another grid: every destination pixel's centre is projected back into the source; pixels without a
    value are left out, or with ``missing`` NULL if they lie on the source. Grids meet the rasters that they may overlap, or
    those of ``pairs`` (grid, raster_id)."""
    met = overlapping(dst, src) if pairs is None else dst.join(pairs, "grid")
    cells = laid_values(pixels, src, met, missing).select("grid", "raster_id", F.explode(F.arrays_zip("k", "value")).alias("_v"))
    cells = cells if missing else cells.where("_v.value is not null")
    return cells.select("grid", "raster_id", F.expr(f"_v.k div {ROW}").alias("row"), (F.col("_v.k") % ROW).alias("col"), "_v.value")


def clip(pixels: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    return pixels.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))


def clip_polygon(polys: DataFrame, rasters: DataFrame, pixels: DataFrame, key: str = "zone", touched: bool = False, cell: float = 10_000.0) -> DataFrame:
    """Pixels of the rasters of its zone whose centres lie in each polygon, or with ``touched`` that it touches.

    Polygons have holes and several parts; see ``covered_pixels``. Returns key and the columns of pixels.
    """
    return covered_pixels(polys, rasters, pixels, key, touched, cell)


def crop_pad(pixels: DataFrame, ids: DataFrame, row0: int, row1: int, col0: int, col1: int, nodata: float = -9999.0) -> DataFrame:
    """Every place of a box, no data where the raster has none."""
    grid = ids.select("raster_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(row0).cast("long"), F.lit(row1 - 1).cast("long")))).withColumn("col", F.explode(F.sequence(F.lit(col0).cast("long"), F.lit(col1 - 1).cast("long"))))
    return grid.join(pixels.select("raster_id", "row", "col", "value"), ["raster_id", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(nodata)))


def contained(df: DataFrame) -> DataFrame:
    """Says for each window if it lies in its block (columns w_* and b_*)."""
    ok = (F.col("w_xmin") >= F.col("b_xmin")) & (F.col("w_xmax") <= F.col("b_xmax")) & (F.col("w_ymin") >= F.col("b_ymin")) & (F.col("w_ymax") <= F.col("b_ymax"))
    return df.withColumn("contained", ok)


def assert_contained(df: DataFrame) -> DataFrame:
    return contained(df).where(F.when(F.col("contained"), True).otherwise(F.raise_error(F.lit("window outside its block")).cast("boolean"))).drop("contained")


def upsample(pixels: DataFrame, factor: int, order: int = 0, value: str = "value") -> DataFrame:
    """Finer grid by nearest (order 0) or bilinear (order 1) values of whole rasters.

    Missing pixels take the nearest valid value before they are resampled, and what lies in them is missing again
    afterwards. Edges repeat; places that have no row weigh nothing. Each fine pixel asks for at most four coarse ones by
    equi-join.
    """
    sub = F.sequence(F.lit(0), F.lit(factor - 1))
    if order == 0:
        fine = pixels.select("raster_id", "row", "col", value).withColumn("i", F.explode(sub)).withColumn("j", F.explode(sub))
        return fine.select("raster_id", (F.col("row") * factor + F.col("i")).alias("row"), (F.col("col") * factor + F.col("j")).alias("col"), value)
    filled, gone = filled_and_missing(pixels.select("raster_id", "row", "col", value), ("raster_id",), value)
    fine = pixels.select("raster_id", "row", "col", F.col(value).isNull().alias("_gone")).withColumn("i", F.explode(sub)).withColumn("j", F.explode(sub))
    fine = fine.withColumn("frow", F.col("row") * factor + F.col("i")).withColumn("fcol", F.col("col") * factor + F.col("j"))
    edge = pixels.groupBy("raster_id").agg(F.max("row").alias("_hr"), F.max("col").alias("_hc"))
    fine = fine.join(small(edge), "raster_id")

    def axis(p, top):
        y = F.greatest(F.lit(0.0), F.least((F.col(p) + 0.5) / factor - 0.5, F.col(top).cast("double")))
        low = F.floor(y)
        return F.array(F.struct(low.alias("at"), (1 - (y - low)).alias("w")), F.struct(F.least(low + 1, F.col(top)).alias("at"), (y - low).alias("w")))

    asks = fine.withColumn("_y", F.explode(axis("frow", "_hr"))).withColumn("_x", F.explode(axis("fcol", "_hc"))).where((F.col("_y.w") > 0) & (F.col("_x.w") > 0))
    asks = asks.select("raster_id", "frow", "fcol", "_gone", F.col("_y.at").alias("row"), F.col("_x.at").alias("col"), (F.col("_y.w") * F.col("_x.w")).alias("_w"))
    got = asks.join(filled.select("raster_id", "row", "col", F.col(value).alias("_v")), ["raster_id", "row", "col"], "left")
    out = got.groupBy("raster_id", "frow", "fcol").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))).alias("_b"), F.first("_gone").alias("_gone"))
    return out.select("raster_id", F.col("frow").alias("row"), F.col("fcol").alias("col"), F.when(~gone, F.col("_b")).alias(value))


def window_from_bounds(df: DataFrame, margin: int) -> DataFrame:
    """Rows and columns of bounds on a grid, rounded outward, widened by a margin and kept inside."""
    r0, r1 = F.floor((F.col("f") - F.col("ymax")) / -F.col("e")) - margin, F.ceil((F.col("f") - F.col("ymin")) / -F.col("e")) + margin
    c0, c1 = F.floor((F.col("xmin") - F.col("c")) / F.col("a")) - margin, F.ceil((F.col("xmax") - F.col("c")) / F.col("a")) + margin
    keep = lambda v, top: F.greatest(F.lit(0).cast("long"), F.least(v, F.col(top).cast("long")))
    return df.withColumn("row0", keep(r0, "height")).withColumn("row1", keep(r1, "height")).withColumn("col0", keep(c0, "width")).withColumn("col1", keep(c1, "width"))


def best_crop(pixels: DataFrame, size: int = 320, stride: int = 64, least_valid: float = 0.98, value: str = "value") -> DataFrame:
    """Crop of each raster with the highest mean among those valid enough; the first row, then column, on a tie. A raster
    without any takes the crop around its centre, whose mean is NULL.

    Pixels are summed once a stride cell; a cell adds to the few crops that cover it. size is a multiple of stride. Sums are
    exact to 15 decimals, so crops of equal means tie whatever the order of their pixels; values beyond 1e22 and infinities
    are summed as doubles.
    """
    d = F.col(value).try_cast("decimal(38,15)")
    k = size // stride
    cells = pixels.groupBy("raster_id", F.floor(F.col("row") / stride).alias("i"), F.floor(F.col("col") / stride).alias("j")).agg(F.sum(value).alias("s"), F.try_sum(d).alias("d"), F.count(d).alias("dv"), F.count(value).alias("v"), F.count(F.lit(1)).alias("n"))
    back = F.sequence(F.lit(0), F.lit(k - 1))
    crops = cells.withColumn("di", F.explode(back)).withColumn("dj", F.explode(back)).withColumn("row0", (F.col("i") - F.col("di")) * stride).withColumn("col0", (F.col("j") - F.col("dj")) * stride).where("row0 >= 0 and col0 >= 0")
    sums = crops.groupBy("raster_id", "row0", "col0").agg(F.sum("s").alias("s"), F.try_sum("d").alias("d"), F.sum("dv").alias("dv"), F.sum("v").alias("v"), F.sum("n").alias("n")).where((F.col("n") == size * size) & (F.col("v") >= least_valid * size * size))
    total = F.coalesce(F.when(F.col("dv") == F.col("v"), F.col("d").cast("double")), F.col("s"))
    best = first_by(sums.withColumn("mean", total / F.col("v")), ["raster_id"], [F.col("mean").desc(), F.col("row0"), F.col("col0")])
    centre = lambda k: F.floor((F.max(k) + 1 - size) / 2).alias(f"_{k}")
    out = pixels.groupBy("raster_id").agg(centre("row"), centre("col")).join(best, "raster_id", "left")
    return out.select("raster_id", F.coalesce("row0", "_row").alias("row0"), F.coalesce("col0", "_col").alias("col0"), "mean")


def stretch(df: DataFrame, by, value: str, low: float = 0.01, high: float = 0.99, gamma: float = 0.65, name: str = "out") -> DataFrame:
    """Percentile stretch (positive finite values only) and gamma; by: the columns that share one stretch."""
    good = df.where((F.col(value) > 0) & (F.abs(F.col(value)) < float("inf")))
    q = small(percentiles(good, by, value, (low, high), name="_q"))
    out = df.join(q, list(by), "left") if by else df.join(q, F.lit(True), "left")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    x = F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.col(value))
    return out.withColumn(name, F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(gamma))).drop("_q")


def pca_rgb(df: DataFrame, values: str, key: str) -> DataFrame:
    """Three principal components of standardised vectors, each stretched to [0, 1]. Signs: the largest loading of
    a component is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.where(F.forall(values, lambda v: v.isNotNull())).select(key, array_to_vector(values).alias("_x"))
    scaled = StandardScaler(inputCol="_x", outputCol="_s", withMean=True, withStd=True).fit(x).transform(x)
    model = PCA(k=3, inputCol="_s", outputCol="_p").fit(scaled)
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, k]).argmax(), k] >= 0 else -1.0 for k in range(3)]
    out = model.transform(scaled).select(key, vector_to_array("_p").alias("_p"))
    out = out.select(key, F.posexplode(F.zip_with("_p", F.array(*map(F.lit, signs)), lambda v, s: v * s)).alias("component", "score"))
    q = percentiles(out, ["component"], "score", (0.02, 0.98), name="_q")  # three rows
    x = (F.col("score") - F.col("_q")[0]) / (F.col("_q")[1] - F.col("_q")[0])
    return out.join(F.broadcast(q), "component").select(key, "component", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("level"))


def stack_bands(metas: DataFrame, pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Bands side by side, if all have one grid."""
    same = metas.agg(*[F.count_distinct(k).alias(k) for k in ("epsg", "a", "e", "c", "f", "width", "height")])
    sound = same.where(" or ".join(f"{k} <> 1" for k in ("epsg", "a", "e", "c", "f", "width", "height"))).count() == 0
    if not sound:
        raise ValueError("bands are not on one grid")
    return pixels.groupBy("row", "col").pivot("band", bands).agg(F.first("value"))


def pad_canvas(meta: DataFrame, pixels: DataFrame) -> DataFrame:
    """Rasters centred on a canvas as large as the largest of them."""
    top = meta.agg(F.max("height").alias("_h"), F.max("width").alias("_w"))
    shift = meta.join(F.broadcast(top)).select("raster_id", F.floor((F.col("_h") - F.col("height")) / 2).alias("_dr"), F.floor((F.col("_w") - F.col("width")) / 2).alias("_dc"))
    return pixels.join(small(shift), "raster_id").withColumn("row", F.col("row") + F.col("_dr")).withColumn("col", F.col("col") + F.col("_dc")).drop("_dr", "_dc")


def coarse_map(lattice: DataFrame, meta: DataFrame, values: DataFrame, mask: DataFrame, step: int) -> DataFrame:
    """One pixel a lattice centre, placed around the predicted point, without value where the centre is masked."""
    at = lattice.join(values, ["raster_id", "row", "col"], "left").join(mask.select("raster_id", "row", "col", F.lit(True).alias("_m")), ["raster_id", "row", "col"], "left")
    at = at.join(small(meta.select("raster_id", "a", "e", "c", "f")), "raster_id")
    x = F.col("c") + (F.col("col") + 0.5) * F.col("a") - F.col("a") * step / 2
    y = F.col("f") + (F.col("row") + 0.5) * F.col("e") - F.col("e") * step / 2
    return at.select("raster_id", "i", "j", x.alias("left"), y.alias("top"), F.when(F.col("_m").isNull(), F.col("value")).alias("value"))
