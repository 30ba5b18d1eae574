"""Token ids in directly addressable codes: written as a Parquet folder of blobs, read back at any position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, slices
from .tokens import encoder

#: Bits of the bitmaps between two entries of a rank directory.
RANK_BITS = 512
_HEAD = np.dtype("<u4")


def dac_encode(ids: np.ndarray) -> bytes:
    """Directly addressable code of unsigned 32-bit ids.

    Level k holds the k-th byte of every id that has one, in order; its bitmap marks the ids that go on to
    level k + 1, and its rank directory has the marks before every ``RANK_BITS`` bits. Layout (little-endian
    unsigned 32-bit integers unless said): ids, levels; for each level its number of entries, then the bytes
    padded to 4, then, unless it is the last, the bitmap (lowest bit first, padded to 4 bytes) and the directory.
    """
    rest, levels = ids.astype(np.uint32), []
    while True:
        low, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        levels.append((low, more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [np.array([len(ids), len(levels)], _HEAD).tobytes()]
    for k, (low, more) in enumerate(levels):
        out += [np.array([len(low)], _HEAD).tobytes(), low.tobytes(), bytes(-len(low) % 4)]
        if k + 1 < len(levels):
            bits = np.packbits(more, bitorder="little")
            before = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[:: RANK_BITS]
            out += [bits.tobytes(), bytes(-len(bits) % 4), before.astype(_HEAD).tobytes()]
    return b"".join(out)


class DacReader:
    """Random access to a code: ``reader[i]`` reads one byte, one mark and one directory entry a level."""

    def __init__(self, blob: bytes):
        self.n, levels = (int(x) for x in np.frombuffer(blob, _HEAD, 2))
        at, self.levels = 8, []
        for k in range(levels):
            n = int(np.frombuffer(blob, _HEAD, 1, at)[0])
            low = np.frombuffer(blob, np.uint8, n, at + 4)
            at += 4 + n + -n % 4
            bits = ranks = None
            if k + 1 < levels:
                m = -(-n // 8)
                bits = np.frombuffer(blob, np.uint8, m, at)
                at += m + -m % 4
                entries = n // RANK_BITS + 1
                ranks = np.frombuffer(blob, _HEAD, entries, at)
                at += 4 * entries
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(ranks[block]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the last."""
        value = self.levels[-1][0].astype(np.uint32)
        for low, bits, _ in reversed(self.levels[:-1]):
            whole = low.astype(np.uint32)
            more = np.unpackbits(bits, count=len(low), bitorder="little").view(bool)
            whole[more] |= value << np.uint32(8)
            value = whole
        return value


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending id order.

    Rows are dealt by ranges of id and checksum and sorted inside, so file order is id order (null ids first;
    among equal ids by a checksum of the text, so that only equal rows must share a task). A row of the folder is a segment of a few MB of text: shard, seg, first (ids before it in its
    shard), n_ids, doc_ids and doc_lens (packed 64- and 32-bit integers), codes (a directly addressable code, see ``dac_encode``). Null text counts
    as empty: the end id alone. An empty table writes an empty folder.
    """
    ship(docs.sparkSession)

    def write(batches):
        code, seg, first = encoder(tokenizer), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = code.encode(part.column("text"))
                n = np.diff(bounds) + 1
                full = np.full(int(n.sum()), end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                keys = part.column("id")
                missing = np.packbits(np.asarray(keys.is_null()), bitorder="little").tobytes() if keys.null_count else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("shard")[0].as_py()], pa.int32()), pa.array([seg], pa.int32()), pa.array([first], pa.int64()), pa.array([len(full)], pa.int64()),
                     pa.array([np.asarray(keys.fill_null(0), "<i8").tobytes()], pa.binary()), pa.array([missing], pa.binary()),
                     pa.array([n.astype("<u4").tobytes()], pa.binary()), pa.array([dac_encode(full)], pa.binary())],
                    ["shard", "seg", "first", "n_ids", "doc_ids", "null_ids", "doc_lens", "codes"],
                )
                seg, first = seg + 1, first + len(full)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sum"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id", "sum").sortWithinPartitions("id", "sum").select("id", "text", F.spark_partition_id().alias("shard"))
    out = rows.mapInArrow(write, "shard int, seg int, first long, n_ids long, doc_ids binary, null_ids binary, doc_lens binary, codes binary")
    out.write.option("compression", "uncompressed").parquet(path)  # so that a code's bytes are read as they are


def shard_starts(folder: DataFrame) -> DataFrame:
    """(shard, shard_first): ids before each shard, a row for each partition that was written."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = folder.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_first"))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of a folder: id, start (ids of all documents before it), n_tokens, ids (binary, little-endian
    unsigned 32-bit integers), from the codes alone."""
    ship(spark)

    def read(batches):
        for batch in batches:
            for shard, first, keys, missing, lens, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "doc_ids", "null_ids", "doc_lens", "codes"))):
                ids, n = DacReader(blob).all().astype("<u4", copy=False), np.frombuffer(lens, "<u4").astype(np.int64)
                cuts = np.concatenate([[0], np.cumsum(n)])
                mask = np.unpackbits(np.frombuffer(missing, np.uint8), count=len(n), bitorder="little").view(bool) if missing else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard, np.int32)), pa.array(np.frombuffer(keys, "<i8"), mask=mask), pa.array(cuts[:-1] + first), pa.array(n),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts * 4), pa.py_buffer(ids)]).cast(pa.binary())],
                    ["shard", "id", "start", "n", "ids"],
                )

    folder = spark.read.parquet(path)
    docs = folder.select("shard", "first", "doc_ids", "null_ids", "doc_lens", "codes").mapInArrow(read, "shard int, id long, start long, n long, ids binary")
    starts = F.broadcast(shard_starts(folder.select("shard", "n_ids")))  # as many rows as partitions were written
    return docs.join(starts, "shard").select(F.col("id").alias(id_col), (F.col("shard_first") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Ids at global positions (one column ``position``), by random access to the codes; places outside are left out."""
    ship(spark)

    def look(batches):
        for batch in batches:
            for blob, first, wanted in zip(batch.column("codes").to_pylist(), batch.column("first").to_pylist(), batch.column("wanted").to_pylist()):
                reader = DacReader(blob)
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([reader[p - first] for p in wanted], pa.int64())], ["position", "id"])

    folder = spark.read.parquet(path)
    narrow = folder.select("shard", "seg", "first", "n_ids")
    starts = narrow.join(F.broadcast(shard_starts(narrow)), "shard").select("shard", "seg", (F.col("first") + F.col("shard_first")).alias("first"), "n_ids")
    block = 1 << 20  # segments are looked up by the blocks of positions that they touch
    touched = starts.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("n_ids") - 1) / block))))
    hits = (
        positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("b", F.floor(F.col("position") / block))
        .join(touched, "b").where("position >= first and position < first + n_ids")
        .groupBy("shard", "seg", "first").agg(F.collect_list("position").alias("wanted"))  # at most a segment's ids
    )
    return hits.join(folder.select("shard", "seg", "codes"), ["shard", "seg"]).select("codes", "first", "wanted").mapInArrow(look, "position long, id long")
