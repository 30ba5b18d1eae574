"""Rows without an id and rows that share one."""

import random
from collections import Counter

import numpy as np
import pytest


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def kept_by_brute_force(rows, checksum, length=100):
    """Multiset of (id, text, kept bytes); rows come in order of id (null first), then checksum of the text."""
    seen, out = set(), Counter()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, checksum[r[1]])):
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                hit[i : i + length] = True
            seen.add(w)
        out[d, t, bytes(c for c, h in zip(b, hit) if not h)] += 1
    return out


@pytest.mark.parametrize("shard", [1 << 20, 300])
@pytest.mark.parametrize("parts", [1, 7])
def test_repeats_with_shared_ids(spark, monkeypatch, shard, parts):
    from pyspark.sql import functions as F

    from canopyframe.llm import suffix_dedup as sd

    rng = random.Random(3)
    shared = words(rng, 40)
    texts = [words(rng, rng.randint(5, 60)) for _ in range(8)]
    texts += [shared, shared + words(rng, 50), words(rng, 50) + shared, words(rng, 20) + shared + words(rng, 20) + shared, "", None, "short", texts[0] + texts[1]]
    rows = [(i, t) for t in texts for i in (None, 7)]
    rows += [(None, texts[2]), (None, texts[9]), (7, texts[9]), (3, shared), (3, "x" + shared), (9, words(rng, 40)), (None, "short"), (None, words(rng, 60)), (None, words(rng, 60))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    checksum = {r.text: r.c for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    got = Counter((r.doc_id, r.text, bytes(r.kept)) for r in sd.remove_repeats(df, 100, columns=["text"]).collect())
    assert got == kept_by_brute_force(rows, checksum)


def rows_of(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def mixed_ids(spark):
    """Rows of sf0.001, a third without an id and a third that share ids in threes; and some equal rows."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150).collect()
    rows = [(None if i % 3 == 0 else 10_000 + i // 9 if i % 3 == 1 else r.doc_id, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(base)]
    rows += [rows[0], rows[1], rows[2], (None, "", None, "a", 0), (None, "", None, "a", 0), (5, "", "a", None, 0), (5, "", "a", None, 0)]
    return base, rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_quality_keeps_rows_by_their_own_text(spark, mixed_ids):
    import corpus_pipeline as cp

    from canopyframe.llm import quality_knn

    _, rows, df = mixed_ids
    texts = sorted({r[1] for r in rows})
    key = {t: i + 1_000_000 for i, t in enumerate(texts)}
    labels = spark.createDataFrame([(2, 1, 0), (5, 0, 0), (8, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    folder = spark.conf.get("spark.checkpoint.dir") + "/shared-ids"
    labels.write.mode("overwrite").parquet(folder + "/labels.parquet")
    got = rows_of(cp.quality(spark, df, folder))
    assert any(r[0] is None for r in got)
    votes = quality_knn.quality_votes(df, labels, columns=["text"]).collect()
    accepted = {}
    for v in votes:
        accepted.setdefault(v.text, v.predicted)
        assert accepted[v.text] == v.predicted
    assert set(accepted) == set(key) and len(votes) == len(rows)
    assert got == Counter(r for r in rows if accepted[r[1]] == 1)


def test_near_duplicates_with_shared_ids(spark):
    import corpus_pipeline as cp

    rng = random.Random(4)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    near = lambda t: t + " " + words(rng, 1)
    rows = [(None, a), (None, b), (4, near(a)), (7, c), (7, d), (9, near(c)), (9, near(d)), (3, near(near(d))), (5, words(rng, 50)), (5, words(rng, 50))]
    rows += [(6, rows[8][1]), (2, b), (None, b), (None, ""), (None, ""), (8, " "), (8, " ")]
    df = spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = rows_of(cp.near_duplicates(spark, df, ""))
    want = [rows[0], rows[1], rows[3], rows[7], rows[8], rows[9], (None, ""), (None, ""), (8, " "), (8, " ")]
    assert got == Counter((i, t, "x", "y", len(t)) for i, t in want)


def test_passages_with_shared_ids(spark):
    import corpus_pipeline as cp

    rng = random.Random(6)
    shared = words(rng, 40)
    rows = [(None, words(rng, 60)), (None, shared + " one"), (None, words(rng, 60)), (4, words(rng, 9) + " " + shared), (4, words(rng, 60)), (4, "short"), (4, "short"), (None, "")]
    df = spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = Counter((i, t) for i, t, *_ in rows_of(cp.repeated_passages(spark, df, "")).elements())
    cut = [r for r in rows if r[1] != rows[3][1]]
    assert not Counter(cut) - got and sum(got.values()) == len(rows)
    assert [t for i, t in got if (i, t) not in rows] and all(shared not in t for i, t in got if i == 4)


def test_mixture_and_packing_with_shared_ids(spark, mixed_ids):
    import corpus_pipeline as cp

    _, rows, df = mixed_ids
    got = rows_of(cp.mixture(spark, df, ""))
    have = Counter(rows)
    assert set(got) <= set(have) and all(n <= 2 * have[r] for r, n in got.items())
    size = lambda c: sum(len((r[1] or "").split()) * n for r, n in c.items())
    assert abs(size(got) - 1.5 * size(have)) < 0.1 * size(have)
    packed = cp.packing(spark, df, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows)
