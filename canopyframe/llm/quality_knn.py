"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, SPACE, Powers, materialize, mix64, prefix_hash, ship, slices, span_hash, string_buffers, word_spans

#: Labelled rows at most that vectors are kept of, latent dimensions, and neighbours that vote.
LABELLED_ROWS = 4_000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Cells of hashed words and word pairs.
CELLS = 1 << 14
#: Hashed byte pairs, single bytes, and the counts about repetition and shape behind them.
PAIRS, SINGLES, EXTRA = 1024, 256, 6
TERMS = PAIRS + SINGLES + EXTRA
#: A neighbour's vote weighs its cosine to this power.
SHARPNESS = 4
_BLOCK = 1024
#: Iterations of the randomised decomposition, and dimensions that it carries beyond those kept.
_ITERATIONS, _SPARE = 2, 16


def terms(raw: np.ndarray, off: np.ndarray, powers: Powers) -> np.ndarray:
    """Square roots of the relative term frequencies of every row; an empty text has none."""
    n, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    b = raw.astype(np.int64)
    single = np.bincount(row * SINGLES + b, minlength=n * SINGLES).reshape(n, SINGLES)
    if len(b) > 1:
        cell = (b[:-1] * 37 + b[1:] * 101) & (PAIRS - 1)
        inside = row[:-1] == row[1:]
        pairs = np.bincount((row[:-1] * PAIRS + cell)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    else:
        pairs = np.zeros((n, PAIRS), np.int64)
    start, end, rows = word_spans(raw, off)
    h = span_hash(prefix_hash(raw, powers), start, end, powers)
    words = np.diff(rows)
    owner = np.repeat(np.arange(n), words)
    count = lambda marks: np.bincount(owner[marks], minlength=n)
    follows = np.zeros(len(h), bool)
    follows[1:] = owner[1:] == owner[:-1]
    same = follows.copy()
    same[1:] &= h[1:] == h[:-1]
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())], np.int64) if n else words
    upper = ((raw >= 0x41) & (raw <= 0x5A)).astype(np.int64)
    symbol = ((raw < 0x80) & ~SPACE[raw] & ~((raw | 32) >= 0x61) & ~((raw >= 0x30) & (raw <= 0x39))).astype(np.int64)
    total = lambda v: np.bincount(row, weights=v, minlength=n)
    w = np.maximum(words, 1)
    extra = np.stack([count(same) / w, (words - distinct) / w, total(upper) / np.maximum(size, 1), total(symbol) / np.maximum(size, 1),
                      np.minimum(size / (words + 1) / 20, 1), 1 / (1 + np.log1p(words))], 1)
    out = np.concatenate([pairs / np.maximum(size, 1)[:, None], single / np.maximum(size, 1)[:, None], extra], 1)
    out[size == 0] = 0
    return np.sqrt(out).astype(np.float32)


def word_terms(raw: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of every row's distinct hashed words and word pairs (A-Z lower-cased), in order, the square roots of their
    counts, and the rows' offsets among them."""
    low = ASCII_LOWER[raw]
    start, end, rows = word_spans(low, off)
    h = span_hash(prefix_hash(low, powers), start, end, powers)
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(row[1:] == row[:-1]) + 1
    with np.errstate(over="ignore"):
        both = mix64(h[pair - 1] * np.uint64(0x9E3779B97F4A7C15) + h[pair])
    cell = np.concatenate([mix64(h ^ np.uint64(1)), both]) >> np.uint64(50)
    key, count = np.unique(np.concatenate([row, row[pair]]) * CELLS + cell.astype(np.int64), return_counts=True)
    return key % CELLS, np.sqrt(count), np.searchsorted(key, np.arange(len(n) + 1) * CELLS)


def _products(cells: np.ndarray, values: np.ndarray, bounds: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of a sparse matrix times a dense one, some rows at a time."""
    out = np.zeros((len(bounds) - 1, matrix.shape[1]), np.float32)
    matrix, values = matrix.astype(np.float32, copy=False), values.astype(np.float32, copy=False)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 14), side="right")) - 1)
        part = slice(bounds[a], bounds[b])
        filled = np.flatnonzero(bounds[a:b] < bounds[a + 1 : b + 1])
        if len(filled):
            out[a + filled] = np.add.reduceat(matrix[cells[part]] * values[part, None], bounds[a:b][filled] - bounds[a], axis=0)
        a = b
    return out


class Voter:
    """Latent vectors of labelled texts, and the vote of a text's nearest ones.

    A text's vector has two blocks of equal length: its words and word pairs, and its characters and shape, both
    weighted by inverse document frequency. A randomised singular value decomposition of the centred vectors of
    the labelled texts gives the latent dimensions.
    """

    def __init__(self, words, x: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        cells, counts, bounds = words
        n = len(x)
        inverse = lambda held: np.log((1 + n) / (1 + held)) + 1
        self.word_weight, self.weight = inverse(np.bincount(cells, minlength=CELLS)), inverse((x > 0).sum(0)).astype(np.float32)
        values, dense = self._word_block(words), self._shape_block(x)
        word_mean, mean = np.bincount(cells, weights=values, minlength=CELLS) / n, dense.mean(0)

        def blocks():
            for i in range(0, n, 256):
                part = slice(bounds[i], bounds[min(i + 256, n)])
                full = np.zeros((min(256, n - i), CELLS + TERMS), np.float32)
                full[np.repeat(np.arange(len(full)), np.diff(bounds[i : i + len(full) + 1])), cells[part]] = values[part]
                full[:, CELLS:] = dense[i : i + len(full)]
                yield i, full

        centre = np.concatenate([word_mean, mean]).astype(np.float32)

        def times(m):
            m = m.astype(np.float32)
            return np.concatenate([full @ m for _, full in blocks()]) - centre @ m

        def back(z):
            z = z.astype(np.float32)
            return sum(full.T @ z[i : i + len(full)] for i, full in blocks()) - np.outer(centre, z.sum(0))

        q = np.linalg.qr(back(np.random.default_rng(0).standard_normal((n, dimensions + _SPARE))))[0]
        for _ in range(_ITERATIONS):
            q = np.linalg.qr(back(times(q)))[0]
        _, _, v = np.linalg.svd(times(q), full_matrices=False)
        axes = q @ v[:dimensions].T
        signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        self.axes = np.ascontiguousarray(axes * np.where(signs == 0, 1, signs), np.float32)
        self.centre = word_mean @ self.axes[:CELLS] + mean @ self.axes[CELLS:]
        self.vectors, self.labels, self.k = self.latent(words, x), y.astype(np.float64), min(neighbours, n)

    def _word_block(self, words) -> np.ndarray:
        cells, counts, bounds = words
        values = (counts * self.word_weight[cells]).astype(np.float32)
        row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        return values / np.sqrt(np.maximum(np.bincount(row, weights=values**2, minlength=len(bounds) - 1), 1e-30)).astype(np.float32)[row]

    def _shape_block(self, x: np.ndarray) -> np.ndarray:
        out = x * self.weight
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(norm > 0, norm, 1)
        return out

    def latent(self, words, x: np.ndarray) -> np.ndarray:
        z = _products(words[0], self._word_block(words), words[2], self.axes[:CELLS]) + self._shape_block(x) @ self.axes[CELLS:] - self.centre
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def score(self, words, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by cosine; blocks of rows against every labelled vector."""
        z, out = self.latent(words, x), np.empty(len(x))
        for i in range(0, len(x), _BLOCK):
            cosine = z[i : i + _BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, self.k - 1, axis=1)[:, : self.k]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** SHARPNESS
            out[i : i + _BLOCK] = (w * self.labels[near]).sum(1) / w.sum(1)
        return out


def quality_votes(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", columns=()
) -> DataFrame:
    """Score every whole text by its nearest labelled texts in a latent-semantic space.

    Hashed words and word pairs (sparse), and byte pairs, bytes and repetition, are weighted by inverse document
    frequency and reduced by a randomised singular value decomposition, both fitted on at most ``labelled_rows``
    labelled rows (the first by hash), none of them held out. Their vectors are broadcast (a fixed bound), every
    document's cosine to each is computed in blocks, and the nearest vote, each with the fourth power of its cosine.

    Held out: crc32 of the id as text modulo 5 is 0 (null id: not). A repeated label takes its largest value, a
    null one is ignored. Where labelled rows share an id, the text with the least checksum stands for it. Null text
    is empty, and empty texts are scored like others. Without labels all scores are 0.5. Repeated ids are scored
    each. Columns are ignored unless named in ``columns``, which go on with the row. An empty table gives an empty result.
    Returns: id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0), columns.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    held = lambda c: F.coalesce(F.crc32(F.encode(c.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("known")).agg((F.max("quality") > 0).cast("int").alias("y"))
    known = materialize(known.where(~held(F.col("known"))).orderBy(F.xxhash64("known")).limit(labelled_rows), "labelled")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def vectors(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20, _BLOCK):
                raw, off = string_buffers(part.column("text"))
                x = terms(raw, off, powers)
                cells, counts, bounds = word_terms(raw, off, powers)
                rows = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"), pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array([cells[a:b].astype(np.uint16).tobytes() for a, b in rows], pa.binary()), pa.array([counts[a:b].astype(np.float32).tobytes() for a, b in rows], pa.binary())],
                    ["id", "y", "x", "cells", "counts"],
                )

    labelled = text.join(F.broadcast(known), F.col("id") == F.col("known"))
    labelled = labelled.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("sum"), "text", "y")).alias("one")).select("id", "one.text", "one.y")
    rows = labelled.mapInArrow(vectors, "id long, y int, x binary, cells binary, counts binary").collect()  # at most labelled_rows
    voter = None
    if rows:
        rows.sort(key=lambda r: r["id"])
        cells = [np.frombuffer(r["cells"], np.uint16) for r in rows]
        words = (np.concatenate(cells), np.concatenate([np.frombuffer(r["counts"], np.float32) for r in rows]), np.cumsum([0, *map(len, cells)]))
        x, y = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), np.array([r["y"] for r in rows])
        del rows, cells
        voter = spark.sparkContext.broadcast(Voter(words, x, y))
        del words, x

    def score(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20, _BLOCK):
                if voter is None:
                    s = np.full(part.num_rows, 0.5)
                else:
                    raw, off = string_buffers(part.column("text"))
                    s = voter.value.score(word_terms(raw, off, powers), terms(raw, off, powers))
                more = [part.column("text" if c == text_col else f"_{c}") for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.clip(s, 0, 1)), *more], ["id", "score", *(f"_{c}" for c in columns)])

    extra = "".join(f", `_{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) if columns else ""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{c}") for c in columns if c != text_col))
    scored = rows.mapInArrow(score, f"id long, score double{extra}")
    return scored.select(
        F.col("id").alias(id_col), held(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"_{c}").alias(c) for c in columns)
    )
