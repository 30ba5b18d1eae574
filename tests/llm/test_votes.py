"""Scores of the quality vote and verdicts of the likelihood ratio, recomputed by hand."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from test_dealt import SCHEMA, WORD, docs, empty, fixture_rows  # noqa: F401


def test_vote_of_the_nearest(spark):
    """A text's score from cosines to every labelled vector, one by one; whatever rows come beside it."""
    from canopyframe.llm import quality_knn as qk
    from canopyframe.llm.common import Powers, string_buffers

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    powers = Powers()

    def both(texts):
        raw, off = string_buffers(pa.array(texts, pa.string()))
        return qk.word_terms(raw, off, powers), qk.terms(raw, off, powers)

    known = [r for r in rows if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 5]
    voter = qk.Voter(*both([r.text for r in known]), np.array([quality[r.doc_id] for r in known]), dimensions=8, neighbours=5)
    texts = [r.text for r in rows] + [None, "", "x"]
    score = voter.score(*both(texts))
    for i in (0, 7, 50, len(texts) - 3, len(texts) - 2, len(texts) - 1):
        z = voter.latent(*both(texts[i : i + 1]))[0]
        cosine = [sum(a * b for a, b in zip(z, v)) for v in voter.vectors]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[:5]
        w = [max(cosine[k], 1e-6) ** 4 for k in near]
        assert abs(score[i] - sum(a * voter.labels[k] for a, k in zip(w, near)) / sum(w)) < 1e-4
    assert np.isfinite(score).all() and (0 <= score).all() and (score <= 1).all()
    # the sparse block: counts of distinct words and pairs
    (cells, counts, bounds), _ = both(["a b A b", None, "c"])
    assert bounds.tolist() == [0, 4, 4, 5] and sorted((counts[:4] ** 2).round().tolist()) == [1, 2, 2, 2]


def test_votes_do_not_need_ids(spark):
    from canopyframe.llm.quality_knn import quality_votes

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    base = {r.text: r.score for r in quality_votes(spark.createDataFrame(rows), labels, columns=["text"]).collect()}
    more = [(None, r.text) for r in rows[:40]] + [(r.doc_id, r.text) for r in rows] * 2 + [(None, None)]
    got = quality_votes(spark.createDataFrame(more, "doc_id long, text string").repartition(7), labels, columns=["text"]).collect()
    assert len(got) == len(more) and all(abs(r.score - base[r.text]) < 1e-3 for r in got if r.text)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def brute_ratio(texts, trusted, cells):
    """Mean log-likelihood ratio of each text's unigrams and bigrams, hashed by the operator's own cells."""
    raw, good = Counter(), Counter()
    for d, t in texts.items():
        raw.update(cells[d])
        if d in trusted:
            good.update(cells[d])
    size = 1 << 16
    a, b = sum(good.values()) + 0.5 * size, sum(raw.values()) + 0.5 * size
    value = lambda c: math.log((good[c] + 0.5) / a) - math.log((raw[c] + 0.5) / b)
    return {d: sum(map(value, cells[d])) / max(len(cells[d]), 1) for d in texts}


def test_ratio_and_verdict(spark, sf):
    from canopyframe.llm import quality_rules as qr
    from canopyframe.llm.common import Powers, string_buffers

    df = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    powers, cells = Powers(), {}
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")
    for d, t in texts.items():
        c, bounds = qr.hashed_ngrams(*string_buffers(pa.array([t], pa.string())), powers)
        n = len(token.findall((t or "").encode()))
        assert len(c) == max(2 * n - 1, 0)
        cells[d] = c.tolist()
    want = brute_ratio(texts, trusted, cells)
    got = {r.doc_id: r for r in qr.quality_rules(df, labels).collect()}
    assert all(abs(got[d].ratio - want[d]) < 1e-8 for d in texts)
    assert all(r.kept == (not r.base_failed and r.ratio >= qr.THRESHOLD) for r in got.values())
    assert len({r.kept for r in got.values()}) == 2
    for parts in (1, 7):  # the same numbers under any partitions
        assert {r.doc_id: tuple(r) for r in qr.quality_rules(df.repartition(parts), labels).collect()} == {d: tuple(r) for d, r in got.items()}
    more = spark.createDataFrame([(None, texts[1]), (None, None), (1, texts[2]), (1, texts[2])], "doc_id long, text string")
    rows = qr.quality_rules(more, labels).collect()
    assert Counter(r.doc_id for r in rows) == {None: 2, 1: 2} and {r.n_words for r in rows if r.doc_id} == {len(WORD.findall(texts[2]))}


def test_rules_count_every_trusted_row(spark):
    from canopyframe.llm.quality_rules import quality_rules

    docs = spark.range(20_400).selectExpr("id AS doc_id", "concat('word', id % 7, ' text') AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    assert [r.ratio for r in quality_rules(docs, labels).select("ratio").distinct().collect()] == [0.0]  # all rows are trusted
