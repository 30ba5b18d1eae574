"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def byte_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Cut the documents, in ascending id order, into ``n_shards`` runs of nearly equal bytes.

    Law ``bytes``: a document goes to the shard in which the middle of its byte range falls, so every shard's
    size differs from the equal target by at most the largest document. Rows are dealt by id ranges; only the
    totals of these ranges (one row each) are summed across ranges, then added to the running sums inside.

    Equal texts are not kept together: each goes where its id puts it, as sizes alone decide (law ``bytes``).

    Size is the UTF-8 length of the text (null: 0) plus ``overhead``. Null ids sort first; rows with equal ids
    are ordered by checksum, and rows equal in both are interchangeable. Only the two named columns are read,
    so further columns of any name do no harm. An empty table gives an empty result.

    Returns: id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard (null: this law
    does not fix which rows a further shard would take).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("_size"),
        F.crc32(F.encode(text, "UTF-8")).alias("_crc"),
    )
    ranged = materialize(rows.repartitionByRange("_id", "_crc").withColumn("_part", F.spark_partition_id()), "shards")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes"))
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_row0"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.sum("_bytes").over(whole).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy("_id", "_crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("_upto", F.sum("_size").over(inside)).withColumn("_rank", F.count(F.lit(1)).over(inside) - 1)
        .join(starts, "_part")
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(
            (2 * (F.col("_byte0") + F.col("_upto")) - F.col("_size")).cast("decimal(38,0)") * n_shards / (2 * F.col("_all"))
        )).cast("int"))
        .withColumn("_row", F.col("_row0") + F.col("_rank"))
    )
    placed = materialize(placed.select("_id", "_size", "_crc", "shard", "_row"), "placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
