"""Recall of embedding links at the widths of large tables, and both link operators without usable ids."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest


def crowd(n=6000, dim=64, seed=8):
    """One label: a third is one group of distinct near copies, another third pairs at cosines of 0.93 to 0.95, the rest alone."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    third = n // 3
    group = unit(unit(rng.standard_normal(dim)) + 0.02 * rng.standard_normal((third, dim)))
    a = unit(rng.standard_normal((third // 2, dim)))
    b = rng.standard_normal((third // 2, dim))
    b = unit(b - (b * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.93, 0.95, (third // 2, 1))
    pairs = np.stack([a, c * a + np.sqrt(1 - c * c) * b], 1).reshape(-1, dim)
    x = np.concatenate([group, pairs, unit(rng.standard_normal((n - third - len(pairs), dim)))])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("bits", [None, 8, 13])
def test_recall_at_width(spark, bits):
    from canopyframe.llm.embedding_dedup import embedding_links

    x = crowd()
    df = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(6)
    want = np.zeros(len(x), int)
    label = np.arange(len(x))
    cosine = x @ x.T >= 0.93
    np.fill_diagonal(cosine, False)
    want = cosine.sum(1)
    while True:
        low = np.minimum(label, np.where(cosine, label[None, :], len(x)).min(1))
        if (low == label).all():
            break
        label = low
    got = {r.vec_id: r for r in embedding_links(df, bits=bits).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= want).all() and want.sum() > 1_000_000
    lone = want < 50  # the planted pairs, which the large group would drown
    assert lone.sum() > 3000 and links[lone].sum() >= 0.95 * want[lone].sum() > 1500
    assert links.sum() >= 0.95 * want.sum()
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.97


def test_any_magnitude_and_id(spark):
    from canopyframe.llm.embedding_dedup import embedding_links

    base = np.random.default_rng(1).standard_normal(8)
    scale = [1e200, 1e-200, 1.0, -1.0, 1e307 / np.abs(base).max()]
    rows = [(i, [float(v) for v in base * s], 1) for i, s in enumerate(scale)]
    rows += [(None, rows[0][1], 1), (None, rows[2][1], 1), (7, rows[2][1], 1), (7, [1.0] * 8, 1), (7, [1.0] * 8, 2), (None, None, 1), (8, [0.0] * 8, 1), (9, rows[0][1], None)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect())
    same = 7  # the five rows that point the same way but one, and their copies
    want = Counter({(0, same - 1, 0, True): 1, (1, same - 1, 0, False): 1, (2, same - 1, 0, False): 1, (3, 0, 3, True): 1, (4, same - 1, 0, False): 1, (None, same - 1, 0, None): 2, (7, same - 1, 0, False): 1})
    want += Counter({(7, 0, 7, True): 2, (None, 0, None, None): 1, (8, 0, 8, True): 1, (9, 0, 9, True): 1})
    assert got == want


def brute(rows, words, percent):
    """(n, smallest id of the component) of every row, each a document of its own."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("percent", [85, 60])
def test_ngram_links_of_rows_without_ids(spark, monkeypatch, percent):
    """Null and repeated ids, many frequent n-grams (ordered by counters), and groups whose members link only in part."""
    from canopyframe.llm import ngram_join as nj

    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(7)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((rng.choice([None, 5, i]), " ".join(own[: rng.randint(55, 70)])))
    for i in range(60):
        rows.append((i + 500, " ".join(rng.choice(["the", "of", "and"]) for _ in range(rng.randint(0, 14)))))
    rows += [(None, None), (5, ""), (5, " \n"), (None, rows[0][1]), (900, rows[0][1].upper()), (5, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 3, percent)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_components(df, 3, percent).collect())
    assert got == want
    # most n-grams count as frequent where shards are small
    monkeypatch.setattr(nj, "SHARD_GRAMS", 4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_components(df.repartition(3), 3, percent).collect())
    assert got == want


def test_suffix_filter_is_a_lower_bound():
    from canopyframe.llm.ngram_join import least_difference, similar

    rng = np.random.default_rng(0)
    for _ in range(300):
        x = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64)]))
        real = len(np.setxor1d(x, y))
        assert all(least_difference(x, y, d) <= real for d in range(7))
        both = len(np.intersect1d(x, y))
        for percent in (50, 80, 85, 100):
            assert similar(x, y, percent) == (100 * both >= percent * (len(x) + len(y) - both))
