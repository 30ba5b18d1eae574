"""Toxicity from confirmed examples and unlabelled text: non-negative risk of positive and unlabelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Powers, materialize, mix64, prefix_hash, ship, slices, span_hash, string_buffers

#: Confirmed examples and unlabelled texts at most that the classifiers are fitted on.
POSITIVES, UNLABELLED = 3_000, 6_000
#: Classifiers, each with hashed features of its own, whose logits are averaged.
MEMBERS = 3
#: Cells of hashed features; at most 2**16.
CELLS = 1 << 16
#: Bytes of a token's beginning that are features beside the whole token.
PREFIXES = (3, 4, 5, 6, 8)
#: Steps of the fit, of which the later half is averaged, its rate, and the weight of the squared norm.
_STEPS, _RATE, _DECAY = 160, 0.1, 1e-4
#: A feature counts if it is so many times as frequent among confirmed examples as among unlabelled texts, and in two of them.
_LIFT = 1.25
_TEXTS, _ROWS, _BLOCK = 1 << 10, 64, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def token_features(raw: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens of every row and of their beginnings, and the row of each, row by row.

    Tokens are runs of letters, digits and characters beyond ASCII, with A to Z lower-cased.
    """
    low = ASCII_LOWER[raw]
    ink = _LETTER[low]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    filled = off[:-1] < off[1:]
    first[off[:-1][filled]] |= ink[off[:-1][filled]]
    last[off[1:][filled] - 1] |= ink[off[1:][filled] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, side="right") - 1
    prefix = prefix_hash(low, powers)
    h = span_hash(prefix, start, end, powers)
    # one place of each token of a row
    with np.errstate(over="ignore"):
        _, at = np.unique(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    start, end, row = start[at], end[at], row[at]
    hashes, rows = [h[at]], [row]
    for k in PREFIXES:
        long = end - start > k
        hashes.append(mix64(span_hash(prefix, start[long], start[long] + k, powers) + np.uint64(k)))
        rows.append(row[long])
    rows = np.concatenate(rows)
    order = np.argsort(rows.astype(np.uint16) if len(off) <= 1 << 16 else rows, kind="stable")
    return np.concatenate(hashes)[order], rows[order]


def feature_cells(hashes: np.ndarray, rows: np.ndarray, n: int, member: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of each of n rows under a member's hash, and the rows' offsets among them."""
    cells, sizes = [], np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        cell = (mix64(hashes + np.uint64(member + 1) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(40)).astype(np.int64) % CELLS
    bounds = np.searchsorted(rows, np.arange(n + 1))
    for a in range(0, n, _ROWS):
        b = min(n, a + _ROWS)
        held = np.zeros((b - a) * CELLS, bool)
        part = slice(bounds[a], bounds[b])
        held[(rows[part] - a) * CELLS + cell[part]] = True
        found = held.nonzero()[0]
        cells.append((found % CELLS).astype(np.uint16))
        sizes[a:b] = np.bincount(found // CELLS, minlength=b - a)
    return np.concatenate(cells) if cells else np.zeros(0, np.uint16), np.concatenate([[0], np.cumsum(sizes)])


def _dot(cells: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's cells, some at a time."""
    out = np.zeros(len(bounds) - 1)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _BLOCK, side="right")) - 1)
        filled = np.flatnonzero(bounds[a:b] < bounds[a + 1 : b + 1])
        if len(filled):
            out[a + filled] = np.add.reduceat(weights[cells[bounds[a] : bounds[b]]], bounds[a:b][filled] - bounds[a])
        a = b
    return out


def _spread(cells: np.ndarray, bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of the rows that hold each cell, some at a time."""
    out = np.zeros(CELLS)
    a = 0
    while a < len(values):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _BLOCK, side="right")) - 1)
        out += np.bincount(cells[bounds[a] : bounds[b]], weights=np.repeat(values[a:b], np.diff(bounds[a : b + 1])), minlength=CELLS)
        a = b
    return out


def _keep(cells: np.ndarray, bounds: np.ndarray, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held = useful[cells]
    return cells[held], np.concatenate([[0], np.cumsum(held, dtype=np.int64)])[bounds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_risk(positive, unlabelled, prior: float) -> tuple[np.ndarray, float]:
    """Weights of cells and a constant that minimise the non-negative risk of confirmed and unlabelled rows.

    ``positive`` and ``unlabelled`` are (cells, bounds). The risk is prior * E_p[loss(+)] + max(0, E_u[loss(-)] -
    prior * E_p[loss(-)]): what unlabelled rows lose as negatives, less the share of it that hidden positives
    account for. Where that difference falls below zero the step goes against it, so that confirmed examples are not
    fitted at its expense. The loss of a positive is logistic, that of a negative the sigmoid, which is bounded: rows far
    on one side cannot outweigh the others in the difference. A cell's feature is the logarithm of how much more frequent
    it is among the confirmed.
    """
    (p, pb), (u, ub) = positive, unlabelled
    np_, nu = len(pb) - 1, len(ub) - 1
    in_p, in_u = np.bincount(p, minlength=CELLS), np.bincount(u, minlength=CELLS)
    scale = np.log((in_p + 1) / (np_ + 2)) - np.log((in_u + 1) / (nu + 2))
    scale[(scale < np.log(_LIFT)) | (in_p < 2)] = 0
    (p, pb), (u, ub) = _keep(p, pb, scale > 0), _keep(u, ub, scale > 0)
    w, total = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    mean, square = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    for step in range(1, _STEPS + 1):
        fp, fu = _dot(p, pb, w[:-1] * scale) + w[-1], _dot(u, ub, w[:-1] * scale) + w[-1]
        sp, su = _sigmoid(fp), _sigmoid(fu)
        bend_p, bend_u = sp * (1 - sp) / np_, su * (1 - su) / nu
        if su.mean() >= prior * sp.mean():
            gp, gu = -prior * ((1 - sp) / np_ + bend_p), bend_u
        else:
            gp, gu = prior * bend_p, -bend_u
        slope = np.append((_spread(p, pb, gp) + _spread(u, ub, gu)) * scale + _DECAY * w[:-1], gp.sum() + gu.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w -= _RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        if step > _STEPS // 2:
            total += w
    total /= _STEPS - _STEPS // 2
    return (total[:-1] * scale).astype(np.float32), float(total[-1])


def _cells_of(batches):
    """Distinct cells of labelled texts under every member's hash."""
    powers = Powers()
    for batch in batches:
        for part in slices(batch, "text", 1 << 20, _TEXTS):
            raw, off = string_buffers(part.column("text"))
            hashes, rows = token_features(raw, off, powers)
            for member in range(MEMBERS):
                cells, bounds = feature_cells(hashes, rows, part.num_rows, member)
                found = [cells[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([member] * part.num_rows, pa.int32()), part.column("id"), part.column("confirmed"), part.column("unlabelled"), pa.array(found, pa.binary())],
                    ["member", "id", "confirmed", "unlabelled", "cells"],
                )


def _fit(prior: float):
    def run(batches):
        """One member a group: rows of (member, id, confirmed, unlabelled, cells)."""
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("member", "id", "confirmed", "unlabelled", "cells")))]
        for member in sorted({r[0] for r in rows}):
            mine = sorted((r for r in rows if r[0] == member), key=lambda r: r[1])

            def table(flag):
                found = [np.frombuffer(r[4], np.uint16) for r in mine if r[flag]]
                return (np.concatenate(found) if found else np.zeros(0, np.uint16)), np.cumsum([0, *map(len, found)])

            weights, constant = fit_risk(table(2), table(3), prior)
            yield pa.RecordBatch.from_arrays([pa.array([member], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([constant], pa.float64())], ["member", "weights", "constant"])

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score every whole text for toxicity with classifiers of confirmed examples and unlabelled texts.

    Confirmed are texts with ``labels.toxic`` = 1; the unlabelled ones are texts of the same rows, whose labels are not
    read. Each is the first ``positives`` or ``unlabelled`` rows by hash, none of them held out; the class prior is
    the share of confirmed ones among all rows that are not held out. Features are the distinct tokens of a text
    and their beginnings, hashed; each member is fitted in a task of its own by ``fit_risk``, and what reaches the driver
    are its weights. Two scans of the texts, no shuffle of them but of the labelled rows' features.

    Held out: crc32 of the id as text modulo 5 is 0 (null id: not). A repeated label takes its largest value, a null
    one is ignored. Where labelled rows share an id, the text with the least checksum stands for it. Null text is empty;
    an empty text has the constants' score. Without a confirmed example all scores are 0. Repeated ids are scored
    each. Extra columns are ignored. An empty table gives an empty result.
    Returns: id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).
    """
    spark = docs.sparkSession
    ship(spark)
    held = lambda c: F.coalesce(F.crc32(F.encode(c.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("known")).agg((F.max("toxic") > 0).alias("toxic"))
    known = materialize(known.where(~held(F.col("known"))), "labelled")
    total, toxic = known.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    models = []
    if toxic:
        mix = F.xxhash64("known")
        confirmed = known.where("toxic").orderBy(mix).limit(positives).select("known", F.lit(True).alias("confirmed"), F.lit(False).alias("unlabelled"))
        drawn = known.orderBy(F.xxhash64("known", F.lit(1))).limit(unlabelled).select("known", F.lit(False).alias("confirmed"), F.lit(True).alias("unlabelled"))
        sample = materialize(confirmed.unionAll(drawn).groupBy("known").agg(F.max("confirmed").alias("confirmed"), F.max("unlabelled").alias("unlabelled")), "sample")
        rows = text.join(F.broadcast(sample), F.col("id") == F.col("known"))  # at most positives + unlabelled ids
        one = F.min(F.struct(F.xxhash64("text").alias("sum"), "text", "confirmed", "unlabelled")).alias("one")
        rows = rows.groupBy("id").agg(one).select("id", "one.text", "one.confirmed", "one.unlabelled")
        schema = "member int, id long, confirmed boolean, unlabelled boolean, cells binary"
        cells = materialize(rows.mapInArrow(_cells_of, schema), "features")
        fitted = cells.repartition(MEMBERS, "member").mapInArrow(_fit(toxic / total), "member int, weights binary, constant double")
        models = [(r["member"], np.frombuffer(r["weights"], np.float32), r["constant"]) for r in fitted.collect()]
    shared = spark.sparkContext.broadcast(sorted(models, key=lambda m: m[0]))

    def score(batches):
        powers, members = Powers(), shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20, _TEXTS):
                logit = np.full(part.num_rows, -np.inf)
                if members:
                    raw, off = string_buffers(part.column("text"))
                    hashes, rows = token_features(raw, off, powers)
                    logit = sum(_dot(*feature_cells(hashes, rows, part.num_rows, m), w) + c for m, w, c in members) / len(members)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(1 / (1 + np.exp(-np.maximum(logit, -700))) * np.isfinite(logit))], ["id", "score"])

    scored = text.mapInArrow(score, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
