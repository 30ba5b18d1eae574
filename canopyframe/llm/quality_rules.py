"""Rule counts of every text, and a length-normalised log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, SPACE, Powers, PrimeHash, counter_rows, materialize, mix64, prefix_hash, ship, slices, span_hash, string_buffers, sum_counters, word_spans

#: Cells that n-grams are hashed to.
CELLS = 1 << 16
#: Trusted ids up to which they are broadcast; more of them meet the documents by a join that is dealt out.
_BROADCAST_IDS = 1_000_000
#: A text is kept if its mean log-likelihood ratio reaches this.
THRESHOLD = -0.25

# 0 white space, 1 letters, digits and longer characters, 2 other ASCII
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[0x30:0x3A] = 1
_KIND[0x41:0x5B] = 1
_KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1


def hashed_ngrams(raw: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the unigrams and bigrams of every row, over lower-cased runs of letters or of symbols, and row offsets."""
    raw = ASCII_LOWER[raw]
    kind = _KIND[raw]
    prior = np.zeros_like(kind)
    prior[1:] = kind[:-1]
    filled = off[:-1] < off[1:]
    prior[off[:-1][filled]] = 0
    start = np.flatnonzero((kind > 0) & (kind != prior))
    after = np.zeros_like(kind)
    after[:-1] = kind[1:]
    after[off[1:][filled] - 1] = 0
    end = np.flatnonzero((kind > 0) & (kind != after)) + 1
    h = span_hash(prefix_hash(raw, powers), start, end, powers)
    rows = np.searchsorted(start, off)
    n = np.diff(rows)
    bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * n - 1, 0))])
    out = np.zeros(bounds[-1], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - rows[:-1][row]
    out[bounds[row] + place] = (h >> np.uint64(48)).astype(np.int64)
    pair = place > 0
    if pair.any():
        i = np.flatnonzero(pair)
        with np.errstate(over="ignore"):
            both = mix64(h[i - 1] * np.uint64(0x9E3779B97F4A7C15) + h[i])
        out[bounds[row[i]] + n[row[i]] + place[i] - 1] = (both >> np.uint64(48)).astype(np.int64)
    return out & (CELLS - 1), bounds


def _counts(batches):
    powers, total = Powers(), np.zeros((2, CELLS), np.int64)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            cells, bounds = hashed_ngrams(*string_buffers(part.column("text")), powers)
            total[0] += np.bincount(cells, minlength=CELLS)
            trusted = np.repeat(np.asarray(part.column("trusted")), np.diff(bounds))
            total[1] += np.bincount(cells[trusted], minlength=CELLS)
    turn = TaskContext.get().partitionId() if TaskContext.get() else 0
    rows = counter_rows(total[0], turn, 0) + counter_rows(total[1], turn, 1)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["kind", "chunk", "turn", "counts"])


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeats(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row's hashes: marks of those met twice or more in the row, and of those met before in it."""
    order = np.concatenate([a + np.argsort(h[a:b], kind="stable") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]) if len(h) else np.zeros(0, np.int64)
    s, same = h[order], np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = s[1:] == s[:-1]
        same[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
    twice, again = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[same]] = True
    at = np.flatnonzero(same)
    twice[order[at]] = True
    twice[order[at - 1]] = True
    return twice, again


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def rule_counts(raw: np.ndarray, off: np.ndarray, exact: PrimeHash, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row."""
    start, end, rows = word_spans(raw, off)
    prefix = exact.prefix(raw)
    n = np.diff(rows)
    h = exact.spans(prefix, start, end)
    windows = np.maximum(n - window + 1, 0)
    first = np.concatenate([[0], np.cumsum(windows)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], windows) + np.repeat(rows[:-1], windows)
    w = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window if len(at) else 0):
            w = mix64(w * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    twice, _ = _repeats(w, first)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    covered = np.cumsum(cover)[:-1] > 0
    # lines: row starts and what follows each newline
    breaks = np.flatnonzero(raw == 10)
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1]), kind="stable")
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    if len(owner):
        line_end[last] = off[1:][owner[last]]
    ink = np.concatenate([[0], np.cumsum(~SPACE[raw], dtype=np.int64)])
    worded = ink[line_end] > ink[line_start]
    line_h = exact.spans(prefix, line_start[worded], line_end[worded])
    per = np.concatenate([[0], np.cumsum(np.bincount(owner[worded], minlength=len(off) - 1))]).astype(np.int64)
    _, again = _repeats(line_h, per)
    lead = ~SPACE[raw] & ((raw & 0xC0) != 0x80)
    return {"n_words": n.astype(np.int64), "word_chars": _sum(lead, off), "n_symbols": _sum(_SYMBOL[raw], off), "n_dup_lines": _sum(again, per), "n_repeat_words": _sum(covered, rows)}


def _score(ratio):
    def run(batches):
        powers, exact, value = Powers(), PrimeHash(), ratio.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, off = string_buffers(part.column("text"))
                counts = rule_counts(raw, off, exact)
                cells, bounds = hashed_ngrams(raw, off, powers)
                size = np.diff(bounds)
                total = np.bincount(np.repeat(np.arange(len(size)), size), weights=value[cells], minlength=len(size))  # each row by itself
                mean = total / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, counts.values()), pa.array(np.round(mean, 9))], ["id", *counts, "ratio"])

    return run


def quality_rules(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Keep texts that look more like trusted ones than like the raw corpus, and that pass two base rules.

    Two multinomials over hashed unigrams and bigrams: of all trusted rows (``labels.quality`` = 1; with
    ``trusted_rows`` only so many, the first by hash), and of all documents. A text's score is the mean of log p_trusted - log p_raw
    over its n-grams, both smoothed by one half a cell; it passes at ``threshold`` or above. Base rules: fewer
    than 10 words, or over 20 % of the words in 5-word windows found twice or more, fail.

    Two scans, no shuffle of texts up to a million trusted ids; the counters have a fixed size. Null text is empty (score 0, base failed).
    Ties at the threshold pass. Repeated ids are scored each. No labels: all ratios are 0. Extra columns are
    ignored. Returns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept.
    """
    spark = docs.sparkSession
    ship(spark)
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("good")).where("good is not null").distinct()
    good = materialize(good if trusted_rows is None else good.orderBy(F.xxhash64("good")).limit(trusted_rows), "trusted")
    good = F.broadcast(good) if good.count() <= _BROADCAST_IDS else good.hint("merge")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = text.join(good, F.col("id") == F.col("good"), "left").select("text", F.col("good").isNotNull().alias("trusted"))
    rows = materialize(marked.mapInArrow(_counts, "kind int, chunk int, turn long, counts binary"), "ngrams")
    raw, trusted = sum_counters(rows, 2, CELLS)
    if trusted.sum():
        ratio = np.log((trusted + 0.5) / (trusted.sum() + 0.5 * CELLS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * CELLS))
    else:
        ratio = np.zeros(CELLS)
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double"
    scored = text.mapInArrow(_score(spark.sparkContext.broadcast(ratio)), schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold)).withColumnRenamed("id", id_col)
