"""Exact Jaccard join on word n-grams: rare-first prefixes, length, positional and suffix filters, one check a pair."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, PrimeHash, connected_components, counter_rows, join_hot, materialize, materialize_pruned, mix64, ship, slices, string_buffers, sum_counters, word_spans

#: Counters (their logarithm) that show which n-grams are too frequent for one shard; their number does not follow the data.
SKETCH_BITS = 20
#: N-grams of a shard, about; an n-gram with over an eighth of a shard's share is ordered by its counter.
SHARD_GRAMS = 1_000_000
#: Where the order of the frequent n-grams begins: behind all counts of the others.
_FREQUENT = 1 << 40
#: Postings of an n-gram that are put in order of length together.
RUN = 4096
#: Depth of the suffix filter's partitions.
DEPTH = 4


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int, powers: PrimeHash, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the rows' offsets among them.

    A-Z are lower-cased; a row with fewer words than ``words`` has its whole sequence as one shingle.
    """
    raw = ASCII_LOWER[raw]
    start, end, rows = word_spans(raw, off)
    hashes = powers.spans(powers.prefix(raw), start, end)
    count = np.diff(rows)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(rows[:-1], n)
    length = np.repeat(np.minimum(count, words), n)
    out = np.full(len(at), np.uint64(seed * 2 + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            has = length > k
            here = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else hashes
            out = np.where(has, mix64(out * np.uint64(0x9E3779B97F4A7C15) + here), out)
    bounds = np.append(first, n.sum())
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[first[n > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def _per_row(values: np.ndarray, bounds: np.ndarray, op) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, values.dtype)
    filled = bounds[:-1] < bounds[1:]
    if filled.any():
        out[filled] = op.reduceat(values, bounds[:-1][filled])
    return out


def _signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _per_row(mix64(sets), bounds, np.add)


def _summaries(words: int, columns):
    def run(batches):
        powers, counts = PrimeHash(), np.zeros(1 << SKETCH_BITS, np.int64)
        kinds = {}
        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in columns}
            for part in slices(batch, "text", 1 << 20):
                sets, bounds = shingle_sets(*string_buffers(part.column("text")), words, powers)
                counts += np.bincount(sets >> np.uint64(64 - SKETCH_BITS), minlength=len(counts))
                n = np.diff(bounds)
                s2 = _signatures(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5), bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("sum"), pa.array(n), pa.array(_signatures(sets, bounds).view(np.int64)), pa.array(s2.view(np.int64)),
                     *(part.column(c) for c in columns), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                    ["id", "sum", "n", "key", "s2", *columns, "chunk", "counts"],
                )
        context = TaskContext.get()
        turn = context.partitionId() if context else 0
        used = counter_rows(counts, turn)
        if used:
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.array([turn] * len(used), pa.int64()), none, none, *(pa.nulls(len(used), kinds[c]) for c in columns),
                 pa.array([r[1] for r in used], pa.int32()), pa.array([r[3] for r in used], pa.binary())],
                ["id", "sum", "n", "key", "s2", *columns, "chunk", "counts"],
            )

    return run


# frequencies, by shards of n-grams ------------------------------------------------------------------------------

_SENT = "shard int, packed binary, gram long, key long, df long, n int, m int"
_FOUND = "gram long, key long, df long, n int, m int"


def _kept_bits(bits: int) -> int:
    """Bits of an n-gram that are sent beside the ``bits`` of its shard."""
    return min(48, 64 - bits)


def _pack(keys: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> bytes:
    """Sets' keys, how many n-grams of each follow, and these n-grams in six bytes each."""
    six = grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join((np.array([len(keys)], "<u4").tobytes(), keys.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), six.tobytes()))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    keys = np.frombuffer(packed, "<u8", n, 4)
    counts = np.frombuffer(packed, "<u4", n, 4 + 8 * n)
    six = np.frombuffer(packed, np.uint8, -1, 4 + 12 * n).reshape(-1, 6)
    grams = np.zeros((len(six), 8), np.uint8)
    grams[:, :6] = six
    return grams.view("<u8").ravel(), np.repeat(keys, counts)


def _deal(words: int, percent: int, bits: int, table):
    """N-grams of each slice's distinct sets, packed by shard; and each set's size, with what it needs of frequent n-grams."""
    kept = _kept_bits(bits)

    def run(batches):
        powers = PrimeHash()
        frequency, frequent = table.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets, bounds = shingle_sets(*string_buffers(part.column("text")), words, powers)
                signature = _signatures(sets, bounds)
                rows = np.flatnonzero(np.diff(bounds))
                rows = rows[np.unique(signature[rows], return_index=True)[1]]  # equal sets of a slice are sent once
                n = np.diff(bounds)[rows]
                take = np.repeat(bounds[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                sets, of, key = sets[take], np.repeat(np.arange(len(rows)), n), signature[rows]
                cell = (sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                often = frequent[cell]
                m = n - np.bincount(of[often], minlength=len(rows))
                shard = (sets[~often] >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                shard, rare, owner = shard[order], sets[~often][order], of[~often][order]
                rare = (rare << np.uint64(bits)) >> np.uint64(64 - kept)
                cut = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (owner[1:] != owner[:-1])])) if len(shard) else np.zeros(0, np.int64)
                count = np.diff(np.append(cut, len(shard)))
                ends = np.append(np.flatnonzero(np.diff(shard[cut])) + 1, len(cut)) if len(cut) else np.zeros(0, np.int64)
                packed, shards, a = [], [], 0
                for b in ends.tolist():
                    last = cut[b] if b < len(cut) else len(shard)
                    packed.append(_pack(key[owner[cut[a:b]]], count[a:b], rare[cut[a] : last]))
                    shards.append(int(shard[cut[a]]))
                    a = b
                # frequent n-grams come last in the order: of them a prefix holds what the others leave open
                want = n - (percent * n + 99) // 100 + 1 - m
                some = often & (want[of] > 0)
                g, o, rank = sets[some], of[some], frequency[cell[some]] + _FREQUENT
                gram = g >> np.uint64(64 - bits - kept) << np.uint64(64 - bits - kept)
                by = np.lexsort((gram, rank, o))
                g, o, rank = gram[by], o[by], rank[by]
                first = np.searchsorted(o, o)
                near = np.arange(len(o)) - first < want[o]
                g, o, rank = g[near], o[near], rank[near]
                keys = np.concatenate([key, key[o]]).view(np.int64)
                none, blobs = len(packed), len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.array(shards, np.int64), keys & ((1 << bits) - 1)]).astype(np.int32)),
                     pa.array(packed + [None] * blobs, pa.binary()),
                     pa.concat_arrays([pa.nulls(none + len(key), pa.int64()), pa.array(g.view(np.int64))]),
                     pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(keys)]),
                     pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(np.concatenate([np.full(len(key), -1), rank]).astype(np.int64))]),
                     pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(np.concatenate([n, n[o]]).astype(np.int32))]),
                     pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(np.concatenate([m, m[o]]).astype(np.int32))])],
                    ["shard", "packed", "gram", "key", "df", "n", "m"],
                )

    return run


def _count(bits: int):
    """N-grams of a shard that several sets have, with their number; other rows pass."""
    kept = _kept_bits(bits)

    def flush(shard, blobs):
        grams, keys = (np.concatenate(c) for c in zip(*map(_unpack, blobs)))
        order = np.lexsort((keys, grams))
        grams, keys = grams[order], keys[order]
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        fresh = new.copy()
        fresh[1:] |= keys[1:] != keys[:-1]
        grams, keys, new = grams[fresh], keys[fresh], new[fresh]
        begin = np.flatnonzero(new)
        df = np.repeat(np.diff(np.append(begin, len(grams))), np.diff(np.append(begin, len(grams))))
        several = df > 1
        whole = (np.uint64(shard) << np.uint64(64 - bits)) | (grams[several] << np.uint64(64 - bits - kept))
        size = int(several.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(whole.view(np.int64)), pa.array(keys[several].view(np.int64)), pa.array(df[several]), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32())],
            ["gram", "key", "df", "n", "m"],
        )

    def run(batches):
        blobs, current = [], None
        for batch in batches:
            packed = batch.column("packed")
            yield batch.filter(packed.is_null()).select(["gram", "key", "df", "n", "m"])
            for shard, blob in zip(batch.column("shard").to_pylist(), packed.to_pylist()):
                if blob is None:
                    continue
                if blobs and shard != current:
                    yield flush(current, blobs)
                    blobs = []
                current = shard
                blobs.append(blob)
        if blobs:
            yield flush(current, blobs)

    return run


def _prefix_postings(text: DataFrame, seen: DataFrame, words: int, percent: int) -> DataFrame:
    """(gram, key, n, pos, support): places in the sets' prefixes of n-grams that several sets have."""
    spark = text.sparkSession
    counters = seen.where("chunk is not null").select(F.lit(0).alias("kind"), "chunk", F.col("n").alias("turn"), "counts")
    frequency = sum_counters(counters, 1, 1 << SKETCH_BITS)[0]
    total, parts = int(frequency.sum()), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(1, math.ceil(math.log2(2 * parts)), math.ceil(math.log2(max(1, total / SHARD_GRAMS))))
    table = spark.sparkContext.broadcast((frequency, frequency > max(2, total >> (bits + 3))))
    sent = text.select("text").mapInArrow(_deal(words, percent, bits, table), _SENT)
    found = sent.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_count(bits), _FOUND)
    of = Window.partitionBy("key")
    ranked = found.select(
        "gram", "key", "df", F.max("n").over(of).alias("n"), F.max("m").over(of).alias("m"),
        F.sum(F.expr("cast(df between 0 and %d as int)" % (_FREQUENT - 1))).over(of).alias("c"), F.dense_rank().over(of.orderBy("df", "gram")).alias("rank"),
    ).where("gram is not null")  # the first rank is the set's own row
    prefix = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    pos = (F.col("m") - F.col("c") + F.col("rank") - 2).cast("int")
    ranked = ranked.select("gram", "key", "n", pos.alias("pos"), (prefix - F.col("m") + F.col("c")).cast("int").alias("support"), prefix.alias("prefix"))
    return ranked.where("pos < prefix").drop("prefix").dropDuplicates(["gram", "key"])


# candidates and checks ------------------------------------------------------------------------------------------


def least_difference(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> int:
    """Suffix filter: lower bound of how many values only one of two sorted sets has.

    The middle value of one set parts both; on either side the sizes differ by that many at least, and each side is
    parted again.
    """
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    probe = y[len(y) // 2]
    i, j = int(np.searchsorted(x, probe)), len(y) // 2
    return least_difference(x[:i], y[:j], depth - 1) + least_difference(x[i:], y[j:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold; the suffix filter settles most that do not."""
    size = len(x) + len(y)
    if (100 + percent) * least_difference(x, y) > (100 - percent) * size:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (size - both)


def _check(words: int, percent: int):
    def run(batches):
        powers, known = PrimeHash(), {}
        for batch in batches:
            yes = []
            names = [batch.column(c).to_pylist() for c in ("a", "b")]
            for i in range(batch.num_rows):
                pair = []
                for key, column in ((names[0][i], "ta"), (names[1][i], "tb")):
                    if key not in known:
                        if len(known) > 500:
                            known.clear()
                        known[key] = shingle_sets(*string_buffers(batch.column(column).slice(i, 1)), words, powers)[0]
                    pair.append(known[key])
                yes.append(similar(*pair, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], ["a", "b", "linked"])

    return run


def _may_match(percent: int) -> Column:
    """Length filter, and positional filter at the first n-gram that both sets have: none before it is shared, so no
    more than the shorter rest from it on. At later shared n-grams it may fail; the first one brings the pair."""
    x, y = F.col("x.n"), F.col("y.n")
    most = F.least(x - F.col("x.pos"), y - F.col("y.pos"))
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * most >= percent * (x + y))


def _near_ones(postings: DataFrame) -> DataFrame:
    """(x, y): each posting with up to three others of its n-gram, so that candidates are in proportion to postings.

    They are its neighbour in length, the least set, and the set with most shared n-grams in its prefix, which is
    what near copies were made from.
    """
    item = F.struct("key", "n", "pos")
    groups = postings.groupBy("gram").agg(
        F.count(F.lit(1)).alias("here"), F.min(F.struct("n", "key", item.alias("set"))).alias("head"), F.max(F.struct("support", "n", "key", item.alias("set"))).alias("hub")
    ).where("here > 1")
    salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("here") / RUN))  # a hot n-gram's order is in several tasks
    joined = postings.join(groups, "gram").withColumn("salt", salt)
    before = F.lag(item).over(Window.partitionBy("gram", "salt").orderBy("n", "key"))
    joined = joined.select(item.alias("x"), before.alias("before"), F.col("head.set").alias("first"), F.col("hub.set").alias("most"))
    return joined.select("x", F.explode(F.array("before", "first", "most")).alias("y")).where("y is not null and x.key <> y.key")


def _across(postings: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(x, y): all pairs under an n-gram that lie in different components so far, x the smaller set.

    They meet by n-gram and band of length: similar sets lie in one band or in neighbouring ones.
    """
    parted = postings.join(parts.select(F.col("node").alias("key"), F.col("component_id").alias("part")), "key", "left").withColumn("part", F.coalesce("part", "key"))
    mixed = parted.groupBy("gram").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("gram")
    band = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * max(math.log(100 / percent), 1e-3)))
    parted = materialize(parted.join(mixed, "gram").select("gram", F.struct("key", "n", "pos").alias("x"), "part", band.alias("band")), "mixed")
    y = parted.select("gram", F.col("x").alias("y"), F.col("part").alias("other"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    small = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.key") < F.col("y.key")))
    return parted.join(y, ["gram", "band"]).where((F.col("part") != F.col("other")) & small & _may_match(percent)).select("x", "y")


def _checked(met: DataFrame, sums: DataFrame, text: DataFrame, words: int, percent: int, before: DataFrame | None = None) -> DataFrame:
    """(a, b, linked) for each pair once, by the whole texts; only texts of sets in some pair are moved."""
    pairs = met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    if before is not None:
        pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
    pairs = pairs.join(sums.select(F.col("key").alias("a"), F.col("sum").alias("sa")), "a").join(sums.select(F.col("key").alias("b"), F.col("sum").alias("sb")), "b")
    pairs = materialize(pairs, "pairs")
    wanted = materialize(pairs.select(F.col("sa").alias("sum")).unionAll(pairs.select(F.col("sb").alias("sum"))).distinct(), "wanted")
    texts = materialize_pruned(text.select("sum", "text"), wanted, "sum", "texts")
    both = pairs.join(texts.select(F.col("sum").alias("sa"), F.col("text").alias("ta")), "sa").join(texts.select(F.col("sum").alias("sb"), F.col("text").alias("tb")), "sb")
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_check(words, percent), "a long, b long, linked boolean"), "links")


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", columns=()) -> DataFrame:
    """Components of documents whose sets of distinct ``words``-word shingles have Jaccard >= percent / 100.

    Equal sets form one class (128 bits of hash). N-grams are ordered by the number of classes that have them,
    counted exactly over all documents in shards of n-grams; those that fill over an eighth of a shard's share come
    last, ordered by a table of counters. In that order, rare first, two similar sets share an n-gram within short
    prefixes. N-grams of one class only take their places in the prefixes but are not moved again.

    Under each shared prefix n-gram every class meets three others; what passes the length and positional filters
    is checked once, on the whole texts, behind the suffix filter. Then pairs that lie in different components so
    far are made, filtered and checked, without those rejected before: no link between components is lost, while
    a large group of near copies does not emit its pairs.

    Null text is empty; empty documents have no set and link with nothing. Every row is a document of its own, with
    a null or repeated id too; null ids are never a class's or component's id, unless it has no other. An empty table
    gives an empty result. Extra columns are ignored, unless named in ``columns``; these are handed on (names other
    than those used here: id, sum, n, key, s2, chunk, counts).
    Returns: id, n_shingles, class_id, component_id, part (a key of the component, which tells components apart where ids
    do not; null without words), columns, one row per row.
    """
    ship(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sum"), F.col(text_col).alias("text"), *columns)
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in text.select(*columns).schema) if columns else ""
    seen = materialize(text.mapInArrow(_summaries(words, list(columns)), f"id long, sum long, n long, key long, s2 long{extra}, chunk int, counts binary"), "sets")
    info = seen.where("chunk is null").drop("chunk", "counts")
    classes = info.where("n > 0").groupBy("key", "s2", "n").agg(F.min("id").alias("class_id"), F.min("sum").alias("sum"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes, "classes")
    # should two classes share the 64 bits of their key, only the first takes part in links
    sums = classes.groupBy("key").agg(F.min(F.struct("n", "s2", "sum", "class_id")).alias("c")).select("key", "c.n", "c.s2", "c.sum", "c.class_id")

    postings = materialize(_prefix_postings(text, seen, words, percent), "postings")
    checked = _checked(_near_ones(postings).where(_may_match(percent)), sums, text, words, percent)
    parts = connected_components(None, checked.where("linked").select("a", "b"))
    more = _checked(_across(postings, parts, percent), sums, text, words, percent, before=checked).where("linked").select("a", "b")
    if not more.isEmpty():
        parts = connected_components(None, checked.where("linked").select("a", "b").unionAll(more))

    named = parts.select(F.col("node").alias("key"), F.col("component_id").alias("part")).join(sums, "key")
    least = named.groupBy("part").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "part").select("key", "n", "s2", "part", "component_id")
    classes = classes.join(named, ["key", "s2", "n"], "left").select(
        "key", "s2", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("part", F.xxhash64("key", "s2", "n")).alias("part"), "rows"
    )
    out = join_hot(info.where("n > 0"), materialize(classes, "parts"), ["key", "s2", "n"], "rows")
    own = F.col("id")
    alone = info.where("n = 0").select("*", own.alias("class_id"), own.alias("component_id"), F.lit(None).cast("long").alias("part"))
    return out.unionByName(alone).select(own.alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id", "part", *columns)
