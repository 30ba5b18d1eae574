"""Best-fit-decreasing packing of token runs, planned on lengths and dealt out by rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, slices
from .tokens import encoder


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text plus ``end_id``, cut into pieces of ``size``; only the last may be shorter.

    Null text counts as empty and gives one piece, the end id alone. Null and repeated ids are kept as they
    are. Only the two named columns are read. Returns: id, piece (from 0), start, length, ids (little-endian
    unsigned 32-bit integers).
    """
    ship(docs.sparkSession)

    def cut(batches):
        code = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = code.encode(part.column("text"))
                n = np.diff(bounds) + 1
                full = np.full(int(n.sum()), end_id, "<u4")
                first = np.cumsum(n) - n
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                k = -(-n // size)
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * size
                length = np.minimum(size, n[row] - start)
                cuts = np.append(first[row] + start, len(full)).astype(np.int64) * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(full)]).cast(pa.binary())],
                    ["id", "piece", "start", "length", "ids"],
                )

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "id long, piece int, start long, length long, ids binary"
    )
    return out.withColumnRenamed("id", id_col)


class _Tightest:
    """Segment tree over remaining capacities: the smallest one at or above a length that has an open bin."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.open[i] += bins
            i >>= 1

    def find(self, length: int) -> int | None:
        i = length + self.leaves
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` items of each length into bins of ``size``.

    Items of one length are alike, so each descent of the tree places a whole run of them: the tightest open
    bins take one after another as many as fit, as they would one item at a time. Returns rows (length, rank of
    the first item, items, first bin, items per bin, offset of the first in its bin); the number of rows depends
    on ``size`` alone, not on the items.
    """
    tree, stacks, plan, bins = _Tightest(size), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room is None:
                per = size // length
                first, n = bins, -(-left // per)
                bins += n
                room = size
            else:
                first, n = stacks[room].pop()
                tree.add(room, -n)
                per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, size - room))
                rank, left = rank + full * per, left - full * per
                if rest := room - per * length:
                    stacks.setdefault(rest, []).append((first, full))
                    tree.add(rest, full)
            if full < n:  # one bin takes what is left of this length, the others stay open
                if left:
                    plan.append((length, rank, left, first + full, left, size - room))
                    if rest := room - left * length:
                        stacks.setdefault(rest, []).append((first + full, 1))
                        tree.add(rest, 1)
                    full, left = full + 1, 0
                if n > full:
                    stacks.setdefault(room, []).append((first + full, n - full))
                    tree.add(room, n - full)
    return plan


def best_fit_pack(pieces: DataFrame, size: int = 2048, id_col: str = "doc_id", length_col: str = "length") -> DataFrame:
    """Pack rows of 1 to ``size`` tokens into sequences by best-fit decreasing over the whole table.

    The driver sees one count per length (``size`` rows at most) and plans on them; every row then finds its
    place by its rank among the rows of its length. Ranks come from counts per (length, bucket), so a length
    that a third of the rows share is still spread over all buckets. Rows keep all their columns and gain
    sequence_id and offset. Longer or empty rows and ones without a length are refused (ValueError). An empty table gives an empty result.
    """
    ship(pieces.sparkSession)
    spark = pieces.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = list(pieces.columns)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*[c for c in known if c != length_col]), F.lit(n)).cast("int"))
    per_bucket = materialize(rows.groupBy(F.col(length_col).alias("_len"), "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = {r[0]: int(r[1]) for r in per_bucket.groupBy("_len").agg(F.sum("_n")).limit(size + 1).collect()}  # one row a length
    if any(length is None or not 0 < length <= size for length in counts):
        raise ValueError(f"lengths must be 1 to {size}, none null")
    plan = best_fit_plan(counts, size)
    base = {length: b for length, b in zip(sorted(counts), np.cumsum([0, *[counts[k] for k in sorted(counts)]]).tolist())}
    plan.sort(key=lambda p: (p[0], p[1]))
    table = spark.sparkContext.broadcast(  # bounded by size, like the plan
        tuple(np.array(x, np.int64) for x in ([base[p[0]] + p[1] for p in plan], [p[3] for p in plan], [p[4] for p in plan], [p[5] for p in plan], [p[0] for p in plan]))
    )
    run = Window.partitionBy("_len").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("_len", "_bucket", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_len", "_bucket").orderBy(*[F.col(c) for c in known if c != length_col])
    ranked = (
        rows.withColumn("_len", F.col(length_col)).withColumn("_rank", F.row_number().over(own) - 1)
        .join(offsets.hint("merge"), ["_len", "_bucket"])  # by the partitioning of the ranks; its rows grow with the partitions
        .withColumn("_at", F.col("_before") + F.col("_rank"))
    )
    firsts = spark.sparkContext.broadcast(base)

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, at):
        import pandas as pd

        start, first, per, offset, _ = table.value
        where = at.to_numpy() + length.map(firsts.value).to_numpy()
        i = np.searchsorted(start, where, side="right") - 1
        k = where - start[i]
        return pd.DataFrame({"sequence_id": first[i] + k // per[i], "offset": offset[i] + k % per[i] * length.to_numpy()})

    placed = ranked.withColumn("_place", place(F.col("_len"), F.col("_at")))
    return placed.select(*known, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))
