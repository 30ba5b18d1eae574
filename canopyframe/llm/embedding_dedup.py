"""Near-duplicate vectors: iterative quantisation codes, Hamming tables, and exact cosines of what they retrieve."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_hot, materialize, materialize_pruned, ship

#: Vectors at most that a rotation is learnt from, rounds of learning, vectors of a bucket's block, rows compared at once.
FIT_ROWS = 20_000
ROUNDS = 30
BLOCK = 4096
_CHUNK = 512
#: Expected vectors a bucket, and the share of pairs at the threshold that all tables together may miss.
BUCKET = 32
MISS = 0.01


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rotation that brings unit vectors near the corners of the cube (iterative quantisation).

    Vectors are not centred: links are by angle from the origin, and a mean drawn to a large group of near
    copies would cut that group apart.
    """
    d = x.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        corners = np.where(x @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(x.T @ corners)
        rotation = u @ v
    return rotation


class Codes:
    """Binary codes of several learnt rotations, cut into the keys of ``tables`` Hamming tables of ``bits`` bits."""

    def __init__(self, sample: np.ndarray, bits: int, tables: int):
        self.bits, self.tables = bits, tables
        self.axes = np.concatenate([learn_rotation(sample, s) for s in range(-(-bits * tables // sample.shape[1]))], 1)[:, : bits * tables]

    def keys(self, x: np.ndarray) -> np.ndarray:
        signs = (x @ self.axes >= 0).reshape(len(x), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))

    def short(self, x: np.ndarray) -> np.ndarray:
        """The first 64 bits of the codes in one word."""
        signs = (x @ self.axes[:, :64] >= 0).astype(np.uint64)
        return (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)

    def radius(self, cosine: float) -> int:
        """Differing bits of the short code that a pair at ``cosine`` has with four deviations to spare."""
        n, p = min(64, self.axes.shape[1]), math.acos(cosine) / math.pi
        return math.ceil(n * p + 4 * math.sqrt(n * p * (1 - p)))


def tables_for(bits: int, cosine: float, miss: float = MISS) -> int:
    """Tables after which a pair at ``cosine`` is missed by all with probability ``miss`` at most, for even rotations."""
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _unit(column) -> np.ndarray:
    """Unit vectors of a list column; scaled by the largest component first, so that no square is out of range."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_BLOCK_KEY = ("label", "dim", "table", "key", "p", "q")


def _blocks(batches, columns):
    """Runs of rows of one block pair, which come sorted: (block key, arrays of the columns)."""

    def done(rows):
        return tuple(np.concatenate([r[k] for r in rows]) for k in range(len(columns)))

    rows, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([np.asarray(batch.column(c), np.int64) for c in _BLOCK_KEY], 1)
        cuts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [len(group)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            g = tuple(group[s].tolist())
            if g != current:
                if rows:
                    yield current, done(rows)
                rows, current = [], g
            part = batch.slice(s, e - s)
            rows.append([_unit(part.column(c)) if c == "x" else np.asarray(part.column(c), np.int64) for c in columns])
    if rows:
        yield current, done(rows)


def _sides(block, side) -> tuple[np.ndarray, np.ndarray]:
    a = np.arange(len(side)) if block[4] == block[5] else np.flatnonzero(side == 0)
    return a, a if block[4] == block[5] else np.flatnonzero(side == 1)


def _survivors(radius: int):
    """Rows of each block pair whose short code lies within the radius of another one's."""

    def run(batches):
        for block, (side, ids, weight, code) in _blocks(batches, ("side", "id", "weight", "code")):
            a, b = _sides(block, side)
            near, word = np.zeros(len(ids), bool), code.view(np.uint64)
            for k in range(0, len(a), _CHUNK):
                some = a[k : k + _CHUNK]
                close = np.bitwise_count(word[some, None] ^ word[None, b]) <= radius
                if block[4] == block[5]:
                    close[np.arange(len(some)), np.arange(k, k + len(some))] = False
                near[some] |= close.any(1)
                near[b] |= close.any(0)
            n = int(near.sum())
            if n:
                same = [pa.array(np.full(n, v, np.int64)) for v in block]
                yield pa.RecordBatch.from_arrays([*same, pa.array(side[near]), pa.array(ids[near]), pa.array(weight[near])], [*_BLOCK_KEY, "side", "id", "weight"])

    return run


def _links(threshold: float, codes):
    """For every block pair: weighted link counts and the edges of a spanning forest, by exact cosines."""

    def run(batches):
        for block, (side, ids, weight, x) in _blocks(batches, ("side", "id", "weight", "x")):
            a, b = _sides(block, side)
            table = block[2]
            keys = codes.value.keys(x)[:, :table] if table else None
            links, label = np.zeros(len(ids)), np.arange(len(ids))
            for k in range(0, len(a), _CHUNK):
                some = a[k : k + _CHUNK]
                near = x[some] @ x[b].T >= threshold
                if block[4] == block[5]:
                    near[np.arange(len(some)), np.arange(k, k + len(some))] = False
                i, j = np.nonzero(near)
                p, q = some[i], b[j]
                if table and len(p):  # a pair belongs to the first table that retrieves it
                    fresh = np.ones(len(p), bool)
                    for t in range(table):
                        fresh &= keys[p, t] != keys[q, t]
                    p, q = p[fresh], q[fresh]
                if not len(p):
                    continue
                links += np.bincount(p, weights=weight[q], minlength=len(ids))
                if block[4] != block[5]:
                    links += np.bincount(q, weights=weight[p], minlength=len(ids))
                label = _joined(label, p, q)
            hit = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[label[hit]]), pa.array(links[hit].astype(np.int64))], ["id", "root", "links"])

    return run


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels of components after more edges: the least place of each."""
    while True:
        low = label.copy()
        np.minimum.at(low, label[p], label[q])
        np.minimum.at(low, label[q], label[p])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def embedding_links(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", fit_rows: int = FIT_ROWS, bits: int | None = None
) -> DataFrame:
    """Links of vectors with equal label and cosine >= threshold, their components and the first of each.

    Equal vectors (128 bits of hash) form one class with a weight. Rotations are learnt on at most ``fit_rows``
    classes (the first by hash) and every class is coded; keys are cut from the codes, their width (``bits``) from the
    largest label so that buckets stay small, and the number of tables from the width so that a pair at the
    threshold is missed with probability ``MISS``. Only keys and 64 bits of the code are shuffled to the buckets, in
    blocks of ``BLOCK``; a larger bucket becomes pairs of blocks. Members with no other one within the Hamming radius
    of the threshold drop out, and the original vectors of the rest come to their blocks and are compared in double
    precision. A pair counts in the first table that retrieves it. So links found are exact and none is below the
    threshold; recall is measured in the tests.

    Null labels, null or zero vectors and ones with null or non-finite components link with nothing, nor do
    vectors of different length; any finite magnitude links. Every row is a vector of its own, with a null or repeated
    id too; null ids are never a component's id, unless it has no other. An empty table gives an empty result. Extra
    columns are ignored. Returns: id, n_links, component_id, kept (null id: null).
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    v = F.col("x")
    wide = "float" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(f"array<{wide}>").alias("x"))
    sound = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    sound = F.coalesce(sound, F.lit(False))
    valid = rows.where(sound).withColumn("x", F.transform(v, lambda e: e + F.lit(0).cast(wide)))  # no negative zeros
    # a class: label and two hashes of the vector; c is its key
    valid = valid.select("id", "label", "x", F.xxhash64("label", "x").alias("c"), F.xxhash64(F.lit(1), "x").alias("h"))
    named = materialize(valid.select("id", "label", F.size("x").alias("dim"), "c", "h"), "vectors")
    classes = materialize(named.groupBy("c", "h", "label", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    found = None
    for dim, most in [(r[0], r[1]) for r in classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count")).collect()]:
        own = valid.where(F.size("x") == dim)
        first = classes.where(F.col("dim") == dim).orderBy("c", "h").limit(fit_rows).select("c", "h")
        sample = own.join(F.broadcast(first), ["c", "h"], "left_semi").groupBy("c", "h").agg(F.first("x").alias("x")).orderBy("c", "h").select("x").toArrow()
        width = bits or min(24, max(4, int(math.log2(max(most, 1) / BUCKET)) if most > BUCKET else 4))
        codes = spark.sparkContext.broadcast(Codes(_unit(sample["x"].combine_chunks()), width, tables_for(width, threshold)))

        def coded(batches, codes=codes):
            for batch in batches:
                if batch.num_rows:
                    x = _unit(batch.column("x"))
                    keys = codes.value.keys(x)
                    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * codes.value.tables)
                    yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("h"), pa.array(codes.value.short(x).view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().astype(np.int32)))], ["c", "h", "code", "keys"])

        coding = own.select("c", "h", "x").mapInArrow(coded, "c long, h long, code long, keys array<int>").groupBy("c", "h").agg(F.first(F.struct("code", "keys")).alias("f"))
        keyed = materialize(coding.join(classes.select("c", "h", "label", "weight"), ["c", "h"]).select(F.col("c").alias("id"), "label", "weight", "f.code", "f.keys"), "codes")
        spread = keyed.select("id", "label", "weight", "code", F.posexplode("keys").alias("table", "key"))
        buckets = spread.groupBy("label", "table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        placed = (
            spread.join(buckets, ["label", "table", "key"])
            .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
            .withColumn("block", F.pmod(F.xxhash64("id", "table"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("label", F.lit(dim).alias("dim"), "table", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "weight", "code")
        )
        dealt = placed.repartition("label", "table", "key", "p", "q").sortWithinPartitions(*_BLOCK_KEY)
        out = ", ".join(f"{c} long" for c in (*_BLOCK_KEY, "side", "id", "weight"))
        near = materialize(dealt.mapInArrow(_survivors(codes.value.radius(threshold)), out), "near")
        wanted = materialize(near.select("id").distinct(), "wanted")
        originals = materialize_pruned(own.select(F.col("c").alias("id"), "x"), wanted, "id", "originals")
        full = near.join(originals, "id").repartition("label", "table", "key", "p", "q").sortWithinPartitions(*_BLOCK_KEY)
        links = materialize(full.select(*_BLOCK_KEY, "side", "id", "weight", "x").mapInArrow(_links(threshold, codes), "id long, root long, links long"), "links")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "id long, root long, links long")
    per_class = found.groupBy(F.col("id").alias("c")).agg(F.sum("links").alias("links"))
    parts = connected_components(None, found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("c"), F.col("component_id").alias("part"))
    least = parts.join(classes.select("c", "rep"), "c").groupBy("part").agg(F.min("rep").alias("component_id"))
    summary = (
        classes.join(per_class, "c", "left").join(parts.join(least, "part").drop("part"), "c", "left")
        .select("c", "h", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), "weight")
    )
    linked = join_hot(named.select("id", "c", "h"), materialize(summary, "summary"), ["c", "h"], "weight").select("id", "n_links", "component_id")
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
