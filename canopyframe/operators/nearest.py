"""Nearest valid cell of whole rasters by a separable exact distance transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row_pass(columns: list[str], value: str, radius: int | None):
    """Fills the missing cells of each row of a raster from the nearest valid cell of every column.

    Batches hold whole rows in order (a row of a raster begins where _at is 1) with _sr and _sv, the row and value of
    the valid cell that is nearest in the cell's own column. What a cell c pays for column k is (c - k)^2 +
    (row - _sr)^2: the lower envelope of these parabolas gives each c its column. Costs are scaled by more than what
    the source's row and column add, so equal distances are decided by them and no two columns cost the same.
    """

    def run(batches):
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa

        def solve(row, cols, source, gone):
            """Place of the source of each missing cell, or -1. cols ascend; source: row of each column's source or None."""
            have = [k for k, s in enumerate(source) if s is not None]
            if not have:
                return [-1] * len(gone)
            low, left = min(source[k] for k in have), cols[have[0]]
            wide = cols[have[-1]] - left + 1
            scale = (max(source[k] for k in have) - low + 1) * wide
            heap, start = [], []
            for k in have:
                h = (row - source[k]) ** 2 * scale + (source[k] - low) * wide + (cols[k] - left)
                first = None
                while heap:
                    q, hq = heap[-1]
                    # first place at which k costs less than q
                    first = (h - hq + scale * (cols[k] ** 2 - cols[q] ** 2)) // (2 * scale * (cols[k] - cols[q])) + 1
                    if start[-1] is None or first > start[-1]:
                        break
                    heap.pop()
                    start.pop()
                    first = None
                heap.append((k, h))
                start.append(first)
            found = [heap[bisect_right(start, cols[g], lo=1) - 1][0] for g in gone]
            if radius is None:
                return found
            return [k if (row - source[k]) ** 2 + (cols[g] - cols[k]) ** 2 <= radius * radius else -1 for g, k in zip(gone, found)]

        def done(table):
            own = table.column(value).combine_chunks()
            real = np.asarray(table.column("_real"))
            missing = np.asarray(own.is_null()) & real
            if missing.any():
                row, cols, source = (table.column(c).to_pylist() for c in ("row", "col", "_sr"))
                begin = np.append(np.flatnonzero(np.asarray(table.column("_at")) == 1), len(missing))
                place = np.arange(len(missing))
                fill = np.zeros(len(missing), bool)
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                    gone = np.flatnonzero(missing[a:b]).tolist()
                    if gone:
                        for g, k in zip(gone, solve(row[a], cols[a:b], source[a:b], gone)):
                            if k >= 0:
                                place[a + g], fill[a + g] = a + k, True
                taken = table.column("_sv").combine_chunks().take(pa.array(place))
                own = pa.compute.if_else(pa.array(fill), taken, own)
            out = pa.table([own if c == value else table.column(c) for c in columns], columns)
            yield from (out if real.all() else out.filter(pa.array(real))).to_batches()

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            first = np.flatnonzero(np.asarray(held.column("_at")) == 1)
            if len(first) and first[-1] > 0:
                yield from done(held.slice(0, first[-1]))
                held = held.slice(first[-1])
        if held is not None and held.num_rows:
            yield from done(held)

    return run


def fill_nearest(pixels: DataFrame, key=("raster_id",), value: str = "value", radius: int | None = None) -> DataFrame:
    """Missing cells take the value of the nearest valid one of their raster (on a tie the one of the first row, then
    column), within ``radius`` cells if that is given. Other columns stay; a raster without valid cells stays missing.

    Two sorts instead of pairs of cells: by column, where the valid cell above and the one below are running values, and
    by row, where the lower envelope of the columns' distances is found in one pass. A task holds one row of a raster at
    a time. Each cell (key, row, col) is there once; a raster that lacks cells of its bounding box has them laid out while
    it is filled, others cost no more than their counts.
    """
    keys, columns = list(key), pixels.columns
    span = [f(c).alias(f"_{f.__name__}_{c}") for c in ("row", "col") for f in (F.min, F.max)]
    bounds = pixels.groupBy(*keys).agg(*span, F.count(F.lit(1)).alias("_n"))
    ragged = bounds.where("_n < (_max_row - _min_row + 1) * (_max_col - _min_col + 1)")
    lattice = ragged.select(*keys, F.explode(F.sequence("_min_row", "_max_row")).alias("row"), "_min_col", "_max_col").select(*keys, "row", F.explode(F.sequence("_min_col", "_max_col")).alias("col"))
    cells = pixels.withColumn("_real", F.lit(True)).unionByName(lattice.withColumn("_real", F.lit(False)), allowMissingColumns=True)
    up = Window.partitionBy(*keys, "col").orderBy("row")
    cells = cells.withColumn("_held", F.max("_real").over(up.rangeBetween(0, 0))).where("_real or not _held")
    down = Window.partitionBy(*keys, "col").orderBy(F.desc("row"))
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("row").alias("row"), F.col(value).alias("value")))
    near = cells.withColumn("_here", here).withColumn("_up", F.last("_here", ignorenulls=True).over(up)).withColumn("_down", F.last("_here", ignorenulls=True).over(down))
    nearer = F.when(F.col("_down").isNull() | (F.col("row") - F.col("_up.row") <= F.col("_down.row") - F.col("row")), F.col("_up")).otherwise(F.col("_down"))
    near = near.withColumn("_s", nearer).withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col")))
    near = near.select(*columns, F.col("_s.row").alias("_sr"), F.col("_s.value").alias("_sv"), "_at", "_real")
    return near.mapInArrow(_row_pass(columns, value, radius), pixels.schema)


def filled_and_missing(pixels: DataFrame, key, value: str) -> tuple[DataFrame, Column]:
    """Pixels with missing cells filled, and a column that says which were missing."""
    marked = pixels.withColumn("_gone", F.col(value).isNull())
    return fill_nearest(marked, key, value), F.col("_gone")
