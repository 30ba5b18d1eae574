"""What the corpus operators share: tables written to the shared folder, byte-level text helpers, components."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern: maximal runs of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch that goes to a Python worker, so that many long texts do not come at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application: their Python workers import it by name.

    Arrow batches are bounded by bytes in the session, unless its configuration says otherwise.
    """
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="canopy-code-"), "canopyframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor and the driver can reach: the session's, or one in the warehouse where none is set."""
    ship(spark)
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        there = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/canopy-checkpoint"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs neither recompute it nor depend on executors."""
    path = f"{shared_dir(df.sparkSession)}/canopy-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _SCRATCH:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Remove the tables written inside the block when it ends, but those given to the function that it yields.

    For callers that reduce an operator's result to a table of their own: what they return must not read others.
    """
    made: list[str] = []
    kept: list[str] = []
    _SCRATCH.append(made)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = materialize(df, tag)
        kept.append(made[-1])
        return out

    try:
        yield keep
    finally:
        _SCRATCH.remove(made)
        for path in set(made) - set(kept):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Let Spark build a Bloom filter of a join's small side, when its size allows, and drop other rows before the shuffle.
_PRUNE = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}


def materialize_pruned(df: DataFrame, wanted: DataFrame, key: str, tag: str) -> DataFrame:
    """Rows of df, one a key, whose key (a long) is in wanted; few others are shuffled where a Bloom filter fits."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _PRUNE}
    for k, v in _PRUNE.items():
        conf.set(k, v)
    try:
        return materialize(df.join(wanted.where(F.col(key) > -(1 << 63)), key, "left_semi").dropDuplicates([key]), tag)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def uniform(*cols) -> Column:
    """Uniform number in [0, 1) that depends on the given values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (first 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20, rows: int = 1 << 30):
    """Cut a batch into runs of at most ``rows`` rows and about ``limit`` bytes of text (one row at least), to bound memory."""
    _, off = string_buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            step, b = 1, np.uint64(base)
            out[1] = b
            while step < n:
                m = min(step, n - step)
                out[step : step + m] = out[:m] * np.uint64(pow(base, step, 1 << 64))
                step += m
    return out


class Powers:
    """Tables of powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = _powers(base, 1 << 16), _powers(self.inverse, 1 << 16)

    def need(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    """P with P[i] = sum of (values[j] + 1) * base**j over j < i; a slice's hash is (P[e] - P[s]) * base**-s."""
    powers.need(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers.up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * powers.down[start] + (end - start).astype(np.uint64))


_PRIME = (1 << 61) - 1
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Bytes whose products are summed without reduction.
_SUMMED = 1 << 24


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def times_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it."""
    au, ad, bu, bd = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = ad * bu + au * bd
    return _reduced(au * bu * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + ad * bd)


class PrimeHash:
    """Hashes of slices of byte arrays by a polynomial modulo the prime 2**61 - 1.

    Modulo a power of two the two strings of a Thue-Morse pair would agree under every odd base; modulo a prime two given
    strings agree under few bases only.
    """

    def __init__(self, base: int = 0x15A4E35C0DDB3A7B % _PRIME):
        self.base, self.inverse = base, pow(base, -1, _PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def _grown(self, base: int, table: np.ndarray, n: int) -> np.ndarray:
        while len(table) < n:
            table = np.concatenate([table, times_mod(table, np.uint64(pow(base, len(table), _PRIME)))])
        return table

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        """P with P[i] = sum of (raw[j] + 1) * base**j over j < i; raw: bytes."""
        self.up, self.down = self._grown(self.base, self.up, len(raw) + 1), self._grown(self.inverse, self.down, len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        for i in range(0, len(raw), _SUMMED):
            value, power = raw[i : i + _SUMMED].astype(np.uint64) + np.uint64(1), self.up[i : min(len(raw), i + _SUMMED)]
            high, low = _reduced(np.cumsum(value * (power >> np.uint64(31)))), _reduced(np.cumsum(value * (power & _LOW31)))
            high = ((high << np.uint64(31)) & np.uint64(_PRIME)) + (high >> np.uint64(30))  # times 2**31
            out[i + 1 : i + 1 + len(value)] = _reduced(_reduced(high + low) + out[i])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each slice; equal bytes anywhere have equal hashes."""
        with np.errstate(over="ignore"):
            part = times_mod(_reduced(prefix[end] + np.uint64(_PRIME) - prefix[start]), self.down[start])
            return mix64(part + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the offsets of each row's words among them."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~SPACE[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    filled = off[:-1] < off[1:]
    first[off[:-1][filled]] |= ink[off[:-1][filled]]
    last[off[1:][filled] - 1] |= ink[off[1:][filled] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


#: Counters in one row of a summed table.
CHUNK = 1 << 14


def counter_rows(counts: np.ndarray, turn: int, kind: int = 0) -> list[tuple[int, int, int, bytes]]:
    """Rows (kind, chunk, turn, counts) of a task's non-negative counters; chunks without any are left out."""
    pieces = [counts[i : i + CHUNK] for i in range(0, len(counts), CHUNK)]
    return [(kind, k, turn, p.astype(np.int64).tobytes()) for k, p in enumerate(pieces) if p.any()]


def _sum_rows(batches):
    """One row a chunk from the rows of a task."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, chunk, counts in zip(batch.column("kind").to_pylist(), batch.column("chunk").to_pylist(), batch.column("counts")):
            part = np.frombuffer(counts.as_buffer(), np.int64)
            whole = total.setdefault((kind, chunk), np.zeros(CHUNK, np.int64))
            whole[: len(part)] += part
    if total:
        kinds, chunks = zip(*total)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(chunks, pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["kind", "chunk", "counts"])


def sum_counters(rows: DataFrame, kinds: int, size: int) -> np.ndarray:
    """(kinds, size) sums of the tasks' counters, by task and then by chunk; a task holds one table at most."""
    schema = "kind int, chunk int, counts binary"
    once = rows.select("kind", "chunk", "counts").mapInArrow(_sum_rows, schema).repartition("kind", "chunk")
    total = np.zeros((kinds, size), np.int64)
    for r in once.mapInArrow(_sum_rows, schema).collect():  # a fixed number of rows
        part = np.frombuffer(r["counts"], np.int64)[: size - r["chunk"] * CHUNK]
        total[r["kind"], r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] += part
    return total


#: A key is hot in a join if it has over this share of the rows, so that few are.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, small: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """Left join of rows with small, one row a key, that counts its rows: keys with many of them are broadcast.

    Those have over a thousandth of the rows each, so they are less than a thousand; rows with any other key are
    shuffled to it. Null keys match nothing.
    """
    total = small.agg(F.sum(count_col)).first()[0] or 0
    often = F.col(count_col) > max(100, total // HOT_SHARE)
    values = [c for c in small.columns if c not in (*keys, count_col)]
    tagged = rows.join(F.broadcast(small.where(often).drop(count_col).withColumn("_hot", F.lit(True))), keys, "left")
    first = tagged.where("_hot").select(*rows.columns, *values)
    rest = tagged.where("_hot is null").select(*rows.columns).join(small.where(~often).drop(count_col), keys, "left").select(*rows.columns, *values)
    return first.unionByName(rest)


#: Nodes of a task's edges that are held at once.
_HELD = 500_000


def _forest(batches):
    """Edges of a task as stars around the least node of each of its components, some edges at a time."""
    parent: dict[int, int] = {}

    def find(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def stars():
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
            parent.setdefault(min(a, b), min(a, b))
        if len(parent) > _HELD:
            yield stars()
            parent.clear()
    yield stars()


def connected_components(nodes: DataFrame | None, edges: DataFrame, node: str = "node") -> DataFrame:
    """Smallest id reachable from every node, by alternating large-star and small-star rounds.

    nodes: one column ``node``, or None for only those that have edges; edges: columns ``a``, ``b``. Returns (node,
    component_id); a node without edges is its own component. Edges become stars inside each task first. A round
    is a combinable minimum per node and an equi-join back, so a node with very many links is pre-aggregated before
    the shuffle and its join partition can be split.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    e = materialize(pairs.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    before = None
    while not e.isEmpty():
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        e = materialize(small, "small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # at the fixed point each node points straight at the smallest of its component
    roots = e.groupBy("u").agg(F.min("v").alias("component_id"))
    if nodes is None:
        tops = roots.select(F.col("component_id").alias("u"), "component_id").distinct()
        return materialize(roots.unionAll(tops).select(F.col("u").alias(node), "component_id"), "roots")
    return nodes.select(node).join(roots, nodes[node] == roots["u"], "left").select(
        F.col(node), F.coalesce("component_id", node).alias("component_id")
    )
