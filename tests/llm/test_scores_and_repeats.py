"""Suffix dedup, quality votes, embedding links and quality rules against brute force or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_dealt import SCHEMA, WORD, docs, empty, fixture_rows, table  # noqa: F401


# 2 suffix arrays and repeats ----------------------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    from canopyframe.llm import suffix_dedup as sd

    rng = random.Random(5)
    for trial in range(200):
        t = np.array([rng.randrange(rng.choice([1, 2, 3, 256])) for _ in range(rng.randint(1, 150))], np.uint8)
        if trial % 4 == 0:
            t = np.tile(t[:9], 12)
        b = bytes(t.tolist())
        sa = sd.suffix_array(t, 256)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        phi, common = sd.permuted_prefixes(t, sa)
        for i in range(len(b)):
            n, j = 0, int(phi[i])
            while j >= 0 and max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert common[i] == n


def test_suffix_array_of_wide_alphabets(monkeypatch):
    """Names above one symbol are written as digits, at every level; a text long enough to have many names."""
    from canopyframe.llm import suffix_dedup as sd

    rng = np.random.default_rng(3)
    for n, k in ((3000, 50_000), (3000, 1500), (2000, 1_000_000)):
        t = rng.integers(0, k, n)
        t[n // 2 : n // 2 + 300] = t[:300]
        a = t.tolist()
        assert sd.suffix_array(t, k).tolist() == sorted(range(n), key=lambda i: a[i:])
    alphabets = []
    inner = sd.suffix_array
    monkeypatch.setattr(sd, "suffix_array", lambda t, k: alphabets.append(k) or inner(t, k))
    b = bytes(rng.integers(97, 123, 60_000).astype(np.uint8)) + b"ab" * 2000
    got = sd.suffix_array(np.frombuffer(b, np.uint8), 256)
    assert got.tolist() == sorted(range(len(b)), key=lambda i: b[i : i + 5000])
    assert max(alphabets) > 2048 and len(alphabets) > 2


def test_long_runs_of_equal_segments():
    """Common prefixes that reach over many equal segments."""
    from canopyframe.llm import suffix_dedup as sd

    rng = random.Random(9)
    parts = [bytes(rng.randrange(97, 123) for _ in range(rng.randint(100, 176))) for _ in range(12)]
    texts = parts + parts + [p[: 100 + k] for k, p in enumerate(parts)] + parts
    ids = np.arange(len(texts)) // 5
    starts = np.arange(len(texts)) % 5 * 1000
    rows = sd.shard_repeats(ids, starts, pa.array(texts, pa.binary()), 100)
    got = {(int(i), int(s) + k) for i, s, n in zip(*rows) for k in range(int(n) - 99)}
    first, want = {}, set()
    for i, s, t in sorted(zip(ids.tolist(), starts.tolist(), texts)):
        for k in range(len(t) - 99):
            if first.setdefault(t[k : k + 100], (i, s + k)) != (i, s + k):
                want.add((i, s + k))
    assert got == want


def brute_repeats(texts, length):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                hit[i : i + length] = True
            seen.add(w)
        runs = int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out[d] = (len(b), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def planted_repeats():
    rng = random.Random(11)
    letters = "abcdefghij klmnop"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared, short, long_ = text(140), text(99), text(100)
    rows = {}
    for i in range(60):
        parts = [text(rng.randint(0, 300)) for _ in range(3)]
        rows[i] = rng.choice([shared, short, long_, shared[20:], "é" * 60, "z" * 150]).join(parts)
    rows |= {60: "q" * 1000, 61: "q" * 100, 62: "q" * 99, 63: rows[5], 64: rows[5], 65: rows[7] + rows[8], 66: None, 67: "", 68: text(101) * 3, 69: shared}
    return rows


def repeats_of(df, length=100):
    from pyspark.sql import functions as F

    from canopyframe.llm.suffix_dedup import remove_repeats

    rows = remove_repeats(df, length).withColumn("sha", F.sha2("kept", 256)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in rows}


def test_repeats(spark, docs, empty, table, sf, monkeypatch):  # noqa: F811
    from canopyframe.llm import suffix_dedup as sd
    from canopyframe.llm.queries import op2_suffix_dedup

    texts = planted_repeats()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    want = brute_repeats(texts, 100)
    assert repeats_of(df) == want
    from canopyframe.llm import suffix_dedup

    def shards_of(limit):
        rows = [(a, i, 0, 150, ("%03d" % a * 50).encode()) for a in range(9) for i in range(7)]
        columns = [pa.array(c) for c in zip(*rows)]
        batch = pa.RecordBatch.from_arrays(columns, ["anchor", "id", "start", "size", "text"])
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", limit)
        out = [b for k in (1, 5, 63) for b in suffix_dedup._sharded(100)(batch.slice(i, k) for i in range(0, 63, k))]
        return sum(b.num_rows for b in out)

    assert shards_of(1) == shards_of(1000) == shards_of(2500) == shards_of(1 << 20) == 3 * 9 * 7  # periodic texts repeat themselves too
    monkeypatch.undo()
    for limit in (200, 1500):  # anchors whose segments do not fit into a shard are dealt by longer ones
        monkeypatch.setattr(sd, "SHARD_BYTES", limit)
        assert repeats_of(df) == want
    monkeypatch.undo()
    assert repeats_of(docs) == brute_repeats({r[0]: r[1] for r in fixture_rows()}, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_dedup(spark, sf).collect()}
    assert got == brute_repeats(table, 100)
    assert sd.remove_repeats(empty).count() == 0


# 5 quality votes ----------------------------------------------------------------------------------------------------


def test_quality_votes(spark, docs, empty):  # noqa: F811
    from canopyframe.llm.quality_knn import quality_votes
    from canopyframe.llm.queries import op5_quality_knn

    folder = "/root/testdata/sf0.01"
    rows = op5_quality_knn(spark, folder).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op5_quality_knn(spark, folder).collect()))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_votes(docs, labels).count() == len(fixture_rows())
    assert {r.score for r in quality_votes(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_votes(empty, labels).count() == 0


# 6 embedding links --------------------------------------------------------------------------------------------------


def brute_links(rows, threshold):
    sound = {}
    for i, (vid, x, label) in enumerate(rows):
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x) and any(x):
            sound[i] = np.array(x, np.float64)
    links, label_of = defaultdict(int), {vid: vid for vid, _, _ in rows}

    def find(a):
        while label_of[a] != a:
            a = label_of[a]
        return a

    pairs = set()
    for i in sound:
        for j in sound:
            if i < j and rows[i][2] == rows[j][2] and len(sound[i]) == len(sound[j]):
                if sound[i] @ sound[j] / np.linalg.norm(sound[i]) / np.linalg.norm(sound[j]) >= threshold:
                    links[rows[i][0]] += 1
                    links[rows[j][0]] += 1
                    pairs.add((i, j))
                    a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                    label_of[b] = a
    return {vid: (links[vid], find(vid)) for vid, _, _ in rows}, len(pairs)


def planted_vectors(dim=64):
    rng = np.random.default_rng(2)
    rows, vid = [], 0
    for label in range(3):
        for _ in range(60):
            centre = rng.standard_normal(dim)
            for _ in range(int(rng.integers(1, 5))):
                noise = rng.standard_normal(dim) * rng.choice([0, 0.05, 0.15, 0.25, 0.35])
                rows.append((vid, [float(np.float32(v)) for v in centre + noise], label))
                vid += 1
        rows += [(vid + k, rows[-1][1], label) for k in range(3)]
        vid += 3
    bad = [None, [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] * dim, [1.0, 2.0], [2.0, 4.0]]
    rows += [(vid + k, x, 0) for k, x in enumerate(bad)] + [(vid + 10, rows[0][1], None)]
    return rows


def test_embedding_links(spark, sf):
    from canopyframe.llm.embedding_dedup import embedding_links
    from canopyframe.llm.queries import op6_embedding_dedup

    rows = planted_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embedding_links(df).collect()}
    want, pairs = brute_links(rows, 0.93)
    assert set(got) == set(want) and pairs > 100
    assert all(got[v].n_links <= want[v][0] for v in want)  # none below the threshold
    assert sum(r.n_links for r in got.values()) >= 0.95 * 2 * pairs
    assert np.mean([got[v].component_id == want[v][1] for v in want]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_links(df.limit(0)).count() == 0
    assert op6_embedding_dedup(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_embedding_blocks(spark, monkeypatch):
    """A group larger than a block: the count of links does not depend on how it is cut."""
    from canopyframe.llm import embedding_dedup as ed

    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, [float(v) for v in base + 0.05 * rng.standard_normal(16)], 1) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(ed, "BLOCK", 8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.embedding_links(df).collect()}
    want, _ = brute_links(rows, 0.93)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())
    assert {v[1] for v in got.values()} == {0} and all(got[k][0] <= want[k][0] for k in want)


# 7 quality rules ----------------------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_quality_rules(spark, docs, empty, table, sf):  # noqa: F811
    from canopyframe.llm.quality_rules import quality_rules
    from canopyframe.llm.queries import op7_quality_rules

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    own = {0: "a b\na b\n\n \na b\nc", 1: "\n\n", 2: "x y z w v x y z w v", 3: "é#|é <<\r\né#|é <<\r\n"}
    more = spark.createDataFrame([(k, v) for k, v in own.items()], "doc_id long, text string")
    for df, texts in ((docs, {r[0]: r[1] for r in fixture_rows()}), (more, own)):
        for r in quality_rules(df, labels).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
            assert not (r.kept and r.base_failed)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op7_quality_rules(spark, sf).collect()
    assert len(rows) == len(table)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(table[r.doc_id])
    clean = [r for r in rows if truth.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean([r.kept for r in clean]) > 0.97
    assert quality_rules(docs, labels.limit(0)).where("ratio <> 0").count() == 0
    assert quality_rules(empty, labels).count() == 0
