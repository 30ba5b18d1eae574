"""Exact removal of repeated byte strings with induced suffix arrays over shards of anchored segments."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Powers, materialize, mix64, prefix_hash, ship, slices, span_hash, string_buffers

#: Bytes of an anchor; every repeated string contains one, its least anchor by hash.
ANCHOR = 24
#: Bytes of segments that one suffix array is built over; what does not fit under one anchor is dealt by longer ones.
SHARD_BYTES = 1 << 20
#: Names that one symbol tells; larger ones are written as two digits, so that buckets hold enough to induce them as arrays.
WIDE = 1 << 10


# suffix arrays --------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one; the last is smaller by the sentinel behind it."""
    n = len(t)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    rises[-1] = -1  # the sentinel is smaller than every symbol
    at = np.where(rises != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return rises[nxt] > 0


def _append(sa, ends, symbols, places, step):
    """Put places into their symbols' buckets in order, from the running ends on (step 1) or back (step -1)."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")  # a radix sort, as symbols are below WIDE
    s, p = symbols[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(first, len(s)))
    rank = np.arange(len(s)) - np.repeat(first, n)
    sa[np.repeat(ends[s[first]], n) + step * rank] = p
    ends[s[first]] += step * n


def _induce(t, smaller, heads, tails, lms_sorted):
    """Suffix array induced from sorted leftmost-smaller places, bucket by bucket, a whole run of a bucket at a time."""
    n, k = len(t), len(heads)
    sa = np.full(n, -1, np.int64)
    # leftmost-smaller suffixes at the ends of their buckets, in order
    seeds, seed_end = lms_sorted, np.searchsorted(t[lms_sorted], np.arange(k), side="right")
    seed_start = np.concatenate([[0], seed_end[:-1]])
    grow = heads.copy()
    if not smaller[n - 1]:  # what stands before the sentinel
        _append(sa, grow, t[n - 1 : n].astype(np.int64), np.array([n - 1]), 1)

    def before(places, want):
        p = places[places > 0] - 1
        return p[smaller[p] == want]

    for c in range(k):
        done = heads[c]
        while done < grow[c]:
            run, done = sa[done : grow[c]], grow[c]
            p = before(run, False)
            if len(p):
                _append(sa, grow, t[p].astype(np.int64), p, 1)
        if seed_start[c] < seed_end[c]:
            p = before(seeds[seed_start[c] : seed_end[c]], False)
            if len(p):
                _append(sa, grow, t[p].astype(np.int64), p, 1)
    shrink = tails - 1
    for c in range(k - 1, -1, -1):
        done = tails[c] - 1
        while done > shrink[c]:
            run, done = sa[shrink[c] + 1 : done + 1][::-1], shrink[c]
            p = before(run, True)
            if len(p):
                _append(sa, shrink, t[p].astype(np.int64), p, -1)
        if grow[c] > heads[c]:
            p = before(sa[heads[c] : grow[c]][::-1], True)
            if len(p):
                _append(sa, shrink, t[p].astype(np.int64), p, -1)
    return sa


def _tied_in_order(lms, found, name, tied) -> np.ndarray:
    """Places of leftmost-smaller suffixes that share their name, in order of the suffixes of the string of names.

    Two of them differ at a unique name at the latest, so that string keeps, in order of the text, the shared names
    and what follows one of them directly.
    """
    place = np.searchsorted(lms, found)
    names, shared = np.empty(len(lms), np.int64), np.empty(len(lms), bool)
    names[place], shared[place] = name, tied
    kept = shared.copy()
    kept[1:] |= shared[:-1]
    kept = np.flatnonzero(kept)
    names = names[kept]
    used = np.zeros(int(name[-1]) + 1, bool)
    used[names] = True
    names = (np.cumsum(used) - 1)[names]
    kept = kept[suffix_array(names, int(used.sum()))]
    return lms[kept[shared[kept]]]


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of symbols below k by induced sorting, with an implicit sentinel behind the last.

    Suffixes are classified; the leftmost-smaller substrings are sorted by inducing from their places, named, and
    the string of names, without what unique names decide, is sorted the same way; its order induces the whole array
    in linear time. Symbols of a
    wide alphabet are written as two digits, which keeps the order of the suffixes that begin at first digits.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    if k > WIDE or 64 < k > n // 64:  # buckets would hold too few
        base = math.isqrt(k - 1) + 1
        digits = np.empty(2 * n, np.int64)
        digits[0::2], digits[1::2] = np.divmod(t, base)
        sa = suffix_array(digits, base)
        return sa[sa % 2 == 0] >> 1
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    count = np.bincount(t, minlength=k)
    tails = np.cumsum(count)
    heads = tails - count
    if len(lms) > 1:
        sa = _induce(t, smaller, heads, tails, lms[np.argsort(t[lms].astype(np.uint16), kind="stable")])
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = sa[is_lms[sa]]
        powers = Powers()
        p = prefix_hash(t, powers)
        end = np.zeros(n, np.int64)
        end[lms] = np.append(lms[1:] + 1, n)
        h = span_hash(p, found, end[found], powers)
        last = found == lms[-1]  # it ends at the sentinel and equals no other
        name = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | last[1:] | last[:-1])])
        del sa, is_lms, powers, p, end, h
        if name[-1] + 1 < len(lms):
            tied = np.bincount(name)[name] > 1
            found[tied] = _tied_in_order(lms, found, name, tied)
    else:
        found = lms
    return _induce(t, smaller, heads, tails, found)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, begin: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(previous suffix in order, common prefix with it), by text place.

    With the starts of segments, common prefixes are counted up to ``most`` bytes from each start on, which is to
    reach over the longest segment. Only irreducible places, where the bytes before the two suffixes differ, are compared, eight bytes at a time;
    along a run each further place shares one byte less.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), (n + 8, 8), (1, 1))
    eight = np.ascontiguousarray(eight).view("<u8").ravel()
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] <= 0) | (t[:-1] != t[np.maximum(phi[1:], 1) - 1])
    if begin is not None:
        fresh[begin] = True  # so that no run is longer than a segment
    at = np.flatnonzero(fresh & (phi >= 0))
    common = np.zeros(n, np.int64)
    open_ = at
    while len(open_):
        i, j = open_ + common[open_], phi[open_] + common[open_]
        inside = np.maximum(i, j) < n
        x = np.where(inside, eight[np.minimum(i, n)] ^ eight[np.minimum(j, n)], 1)
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.minimum(np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3, 8))
        same = np.minimum(np.where(inside, same, 0), n - np.maximum(i, j))
        common[open_] += np.maximum(same, 0)
        open_ = open_[(same == 8) & ((begin is None) | (common[open_] < most))]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return phi, np.maximum(common[start] - (np.arange(n) - start), 0)


# anchored segments ----------------------------------------------------------------------------------------------


def anchored_segments(raw: np.ndarray, off: np.ndarray, length: int, powers: Powers, anchor: int = ANCHOR):
    """Runs of ``length``-byte windows with the same least anchor: (row, start, bytes, anchor hash, segment hash).

    Windows of equal content have an equal anchor, so all copies of a window lie in segments of one anchor hash.
    """
    n, span = len(raw), length - anchor + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = prefix_hash(raw, powers)
    at = np.arange(n - anchor + 1)
    h = span_hash(p, at, at + anchor, powers)
    bits = np.uint64(max(20, n.bit_length()))
    key = (h >> bits << bits) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    least = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window at each place
    size = np.diff(off)
    windows = np.maximum(size - length + 1, 0)
    first = np.concatenate([[0], np.cumsum(windows)])
    row = np.repeat(np.arange(len(size)), windows)
    place = np.arange(first[-1]) - first[:-1][row] + off[:-1][row]
    if not len(place):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    own = least[place]
    cut = np.ones(len(place), bool)
    cut[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(place)) - 1
    s, e, mark = place[begin], place[end] + length, own[begin]
    with np.errstate(over="ignore"):
        segment = span_hash(p, s, e, powers) ^ ((mark - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row[begin], s - off[:-1][row[begin]], e - s, h[mark], segment


def _segments(length: int, anchor: int = ANCHOR, nested: bool = False):
    """Segments of texts; or, nested, of segments that have an anchor already, with their bytes."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, off = string_buffers(part.column("text"))
                row, begin, size, mark, segment = anchored_segments(raw, off, length, powers, anchor)
                ids, sums = np.asarray(part.column("id"), np.int64)[row], np.asarray(part.column("sum"), np.int64)[row]
                start = begin
                if nested:
                    start = begin + np.asarray(part.column("start"), np.int64)[row]
                    with np.errstate(over="ignore"):
                        mark = mix64(np.asarray(part.column("anchor"), np.int64)[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mark)
                order = np.lexsort((start, sums, ids, segment, mark))
                m, s, i, c, at = (x[order] for x in (mark, segment, ids, sums, start))
                again = np.zeros(len(order), bool)  # here already: settled before the shuffle
                again[1:] = (m[1:] == m[:-1]) & (s[1:] == s[:-1])
                fresh = np.ones(len(order), bool)  # the same place of an equal row under the same id says nothing new
                fresh[1:] = ~(again[1:] & (i[1:] == i[:-1]) & (c[1:] == c[:-1]) & (at[1:] == at[:-1]))
                m, s, i, c, at, again, order = (x[fresh] for x in (m, s, i, c, at, again, order))
                key = m.view(np.int64).copy()
                key[again] = (i[again] ^ c[again]) * 1_000_003 + at[again]
                out = [pa.array(key), pa.array(s.view(np.int64)), pa.array(i), pa.array(c), pa.array(at), pa.array(size[order].astype(np.int32)), pa.array(again)]
                if nested:
                    first = (off[:-1][row] + begin)[order].tolist()
                    whole = raw.tobytes()
                    out.append(pa.array([None if a else whole[f : f + n] for f, n, a in zip(first, size[order].tolist(), again.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, [*_PLACED, "text"][: len(out)])

    return run


_PLACED = ["anchor", "segment", "id", "sum", "start", "size", "again"]


def shard_repeats(ids: np.ndarray, starts: np.ndarray, texts: pa.Array, length: int):
    """Windows of the segments that equal an earlier one (smaller id, or same id and earlier start), as spans."""
    raw, off = string_buffers(texts)
    size = np.diff(off)
    base = off[:-1] + np.arange(len(size))
    t = np.full(len(raw) + len(size), 0xFF, np.uint8)  # a byte that UTF-8 does not have stands between segments
    row = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(len(t)) - base[row]
    text_places = inside < size[row]
    t[text_places] = raw
    sa = suffix_array(t, 256)
    _, common = permuted_prefixes(t, sa, base, int(size.max(initial=0)) + length)
    valid = inside + length <= size[row]
    same = common[sa] >= length
    group = np.cumsum(~same) - 1
    keep = valid[sa]
    place, group = sa[keep], group[keep]
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, order = np.unique(ids, return_inverse=True)
    key = (order[row[place]].astype(np.int64) << np.int64(36)) | (starts[row[place]] + inside[place])
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(key, cut), np.diff(np.append(cut, len(key))))
    hit = np.zeros(len(t), bool)
    hit[place[key != least]] = True
    first = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
    last = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
    return ids[row[first]], starts[row[first]] + inside[first], last - first + length


def _sharded(length: int):
    def run(batches):
        def flush(parts):
            whole = pa.Table.from_batches(parts).combine_chunks()
            ids = np.asarray(whole["id"], np.int64)
            sums = np.asarray(whole["sum"], np.int64) if "sum" in whole.column_names else np.zeros_like(ids)  # ids alone tell texts apart
            order = np.lexsort((sums, ids))
            change = np.zeros(len(ids), np.int64)
            change[1:] = (ids[order][1:] != ids[order][:-1]) | (sums[order][1:] != sums[order][:-1])
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.cumsum(change)
            row = np.empty(len(ids), np.int64)
            row[rank] = np.arange(len(ids))  # some row of each text
            of, start, size = shard_repeats(rank, np.asarray(whole["start"], np.int64), whole["text"].combine_chunks(), length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[row[of]], sums[row[of]], start, size)], ["id", "sum", "start", "size"])

        parts, held, last = [], 0, None
        for batch in batches:
            i, n = 0, batch.num_rows
            anchor = np.asarray(batch.column("anchor"), np.int64)
            size = np.asarray(batch.column("size"), np.int64)
            while i < n:
                before = np.concatenate([[anchor[i] if last is None else last], anchor[i:-1]])
                change = np.flatnonzero(anchor[i:] != before)  # only there may a shard end
                upto = np.cumsum(size[i:])
                j = n - i
                fresh = change[(held + np.concatenate([[0], upto])[change]) >= SHARD_BYTES] if len(change) else change
                if len(fresh):
                    j = int(fresh[0])
                if j:
                    parts.append(batch.slice(i, j))
                    held += int(upto[j - 1])
                    last = int(anchor[i + j - 1])
                if len(fresh):
                    yield flush(parts)
                    parts, held, last = [], 0, None
                i += j
        if parts:
            yield flush(parts)

    return run


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of bytes covered by ``length``-byte strings that also start earlier (smaller id, or earlier in the text).

    A text is told by its id and its checksum (64 bits of the whole text), so texts that share an id, or have none,
    stay apart; among them the one with the smaller checksum is earlier. Rows with equal id and equal text have
    the same spans, found as if there were one of them.

    Every window of ``length`` bytes has a least anchor by hash; runs of windows with one anchor are segments.
    Equal segments (by 128 bits of hash) are settled by their order; what remains under an anchor with several
    different segments goes, with its text, to a shard of that anchor, where a suffix array is induced, permuted
    common prefixes are taken, and of each group of windows with ``length`` bytes in common all but the earliest are
    marked. Equal segments of one batch are settled before the shuffle, so copies do not gather under their anchors.
    Segments of an anchor that do not fit into a shard are cut into segments of longer anchors and dealt again; the
    longest is the window itself, whose segments are all equal.

    Matches do not cross documents. Returns (id, sum, start, size), overlapping spans included.
    """
    ship(docs.sparkSession)
    return _spans(_texts(docs, id_col, text_col).select(F.col("_id").alias("id"), F.col("_sum").alias("sum"), F.col("_text").alias("text")), length)


#: Stands for null ids, before all others.
_NO_ID = -(1 << 62)


def _texts(docs: DataFrame, id_col: str, text_col: str, columns=()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text).alias("_sum"), F.encode(text, "UTF-8").alias("_text"), *columns)


def span_lists(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _sum, _spans): the spans of each text that has any, at most one a byte of it."""
    return repeated_spans(docs, length, id_col, text_col).groupBy(F.col("id").alias("_id"), F.col("sum").alias("_sum")).agg(F.collect_list(F.struct("start", "size")).alias("_spans"))


_SPAN = "id long, sum long, start long, size long"


def _judged(found: DataFrame, more=()) -> DataFrame:
    """Segments that equal an earlier one (``again``), and others of anchors with several different segments: with the
    bytes of the anchor's different segments."""
    group = Window.partitionBy("anchor").orderBy("segment", "id", "sum", "start")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("id", "sum", "start")
    judged = found.select(
        "anchor", "id", "sum", "start", "size", "again", *more,
        F.coalesce(F.lag("segment").over(group) == F.col("segment"), F.lit(False)).alias("equal"), F.coalesce(F.lag(place).over(group) == place, F.lit(False)).alias("copy"),
        (F.first("segment").over(whole) != F.last("segment").over(whole)).alias("several"),
    )
    judged = judged.withColumn("bytes", F.sum(F.when(~F.col("equal"), F.col("size"))).over(Window.partitionBy("anchor"))).where("not (equal and copy)")
    return judged.withColumn("again", F.col("again") | F.col("equal")).where("again or several").drop("equal", "copy", "several")


def _spans(text: DataFrame, length: int) -> DataFrame:
    parts = max(1, int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = "anchor long, segment long, id long, sum long, start long, size int, again boolean"
    wide = ["anchor", "bytes", "id", "sum", "start", "size", "text"]
    judged = materialize(_judged(text.mapInArrow(_segments(length), placed)), "segments")
    settled = [judged.where("again")]
    per_doc = judged.where("not again").groupBy("id", "sum").agg(F.collect_list(F.struct("anchor", "start", "size", "bytes")).alias("parts"))  # at most a text's own segments
    cut = _turns(text.join(per_doc, ["id", "sum"]), "id", "sum").where("_turn = 1").select("id", "sum", "text", F.explode("parts").alias("p"))
    piece = F.substring(F.col("text"), (F.col("p.start") + 1).cast("int"), F.col("p.size"))
    cut = materialize(cut.select("p.anchor", "p.bytes", "id", "sum", "p.start", "p.size", piece.alias("text")), "shards")
    shards = [cut.where(F.col("bytes") <= SHARD_BYTES)]
    for anchor in ((ANCHOR + length) // 2, length):
        cut = cut.where(F.col("bytes") > SHARD_BYTES)
        if cut.isEmpty():
            break
        longer = cut.select("anchor", "id", "sum", "start", "text").mapInArrow(_segments(length, anchor, nested=True), f"{placed}, text binary")
        judged = materialize(_judged(longer, ["text"]), "segments")
        settled.append(judged.where("again"))
        cut = judged.where("not again").select(*wide)
        shards.append(cut.where((F.col("bytes") <= SHARD_BYTES) | F.lit(anchor == length)))
    spans = None
    for some in shards:
        array = some.select("anchor", "id", "sum", "start", "size", "text").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sharded(length), _SPAN)
        spans = array if spans is None else spans.unionByName(array)
    for some in settled:
        spans = spans.unionByName(some.select("id", "sum", "start", F.col("size").cast("long").alias("size")))
    return spans


def _turns(rows: DataFrame, id_col: str, sum_col: str, columns=()) -> DataFrame:
    """rows with ``_turn``, 1 for all but repeats of a row with equal id and text: these go on in order of a hash of columns."""
    order = F.xxhash64(*columns) if columns else F.col(sum_col)
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(id_col, sum_col).orderBy(order)))


def whole_characters(part: bytes, cut_before: bool, cut_after: bool) -> bytes:
    """UTF-8 bytes of a text between two places, without what a cut at a place leaves of a character."""
    a, b = 0, len(part)
    while cut_before and a < b and part[a] & 0xC0 == 0x80:
        a += 1
    if cut_after:
        lead = b - 1
        while lead >= a and lead > b - 4 and part[lead] & 0xC0 == 0x80:
            lead -= 1
        if lead >= a:
            first = part[lead]
            size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            b = lead if size > b - lead else b
    return part[a:b]


def _strip(columns, length, characters):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "_text", 1 << 20)):
            kept, removed, runs, sizes, texts = [], [], [], [], []
            for text, spans, turn in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), batch.column("_turn").to_pylist()):
                out, at, n = [], 0, 0
                if turn > 1 and len(text) >= length:  # an earlier row has all its strings
                    spans = [{"start": 0, "size": len(text)}]
                for start, end in sorted((s["start"], s["start"] + s["size"]) for s in spans or ()):
                    if not n or start > at:  # spans that touch are one run
                        out.append(text[at:start])
                        n += 1
                    at = max(at, end)
                out.append(text[at:])
                whole = b"".join(out)
                if characters:
                    texts.append(b"".join(whole_characters(p, i > 0, i < len(out) - 1) for i, p in enumerate(out)))
                kept.append(whole), removed.append(len(text) - len(whole)), runs.append(n), sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), *([pa.array(texts, pa.binary())] if characters else []), *(batch.column(c) for c in columns)],
                ["_id", "n_bytes", "n_removed", "n_spans", "kept", *(["kept_text"] if characters else []), *columns],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", columns=(), spans: DataFrame | None = None, characters: bool = False) -> DataFrame:
    """Texts without the bytes of ``repeated_spans``; strings are judged on the input, not on what is left.

    Null text is empty; texts shorter than ``length`` stay whole. Null ids come before all others. Different texts
    that share an id, or have none, are separate documents, in order of the 64-bit checksum of their text. Of rows
    with equal id and equal text the first by a hash of ``columns`` counts as earlier; the others lose their whole
    text if it has ``length`` bytes. Other columns are ignored unless named in ``columns``. An empty table gives an
    empty result.
    spans: the result of ``span_lists``, where it is at hand.
    Returns: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary, the remaining bytes), with
    ``characters`` also kept_text (these without the parts of characters that a cut leaves), columns.
    """
    ship(docs.sparkSession)
    text = _texts(docs, id_col, text_col, columns)
    spans = span_lists(docs, length, id_col, text_col) if spans is None else spans
    out = _turns(text.join(spans, ["_id", "_sum"], "left"), "_id", "_sum", columns).select("_id", "_text", "_spans", "_turn", *columns)
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) if columns else ""
    more = ", kept_text binary" if characters else ""
    out = out.mapInArrow(_strip(list(columns), length, characters), f"_id long, n_bytes long, n_removed long, n_spans long, kept binary{more}{extra}")
    if characters:
        out = out.withColumn("kept_text", F.make_valid_utf8(F.col("kept_text").cast("string")))
    return out.withColumn("_id", F.nullif("_id", F.lit(_NO_ID))).withColumnRenamed("_id", id_col)
