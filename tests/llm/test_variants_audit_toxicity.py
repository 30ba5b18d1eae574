"""Spelling variants, the audit of filter orders and toxicity scores, against brute force and their SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from compare import check, connection

EXTRA = "word string, n string, key string, id string, part string, mask string, sum string, member string, cells string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, *["clash"] * 9) for i, t, lang in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_filter_audit"])
def test_equals_sql(spark, sf, name):
    from canopyframe.llm.queries import oracle_sql, queries

    check(queries()[name](spark, sf), connection(sf), oracle_sql()[name])


# spelling variants --------------------------------------------------------------------------------------------------


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(count, ratio=10):
    form, n_near = {}, {}
    for w in count:
        others = [o for o in count if near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, count[w], n_near[w], count[form[w]] if form[w] else None))
    return out


def test_near_words_of_any_length(spark):
    from canopyframe.llm.spelling_variants import spelling_variants

    rng = random.Random(3)
    letters = "abcéÿ"
    count = {}
    for size in [*[3] * 20, *[6] * 25, *[62, 63, 64, 65, 66, 130] * 2]:
        w = "".join(rng.choice(letters) for _ in range(size))
        for _ in range(9):
            count[w] = rng.choice([1, 2, 2, 20, 21, 210, 2500])
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
    count |= {"a" * k: 10**k for k in range(1, 7)} | {"a" * k: k for k in (70, 71, 72)} | {"": 1, "é" * 90: 1, "é" * 89 + "e": 10}
    df = spark.createDataFrame([*count.items()], "word string, n long").selectExpr("word", "n", "'x' as id", "'x' as key", "'x' as form").repartition(5)
    got = spelling_variants(df.unionByName(df.limit(1).selectExpr("cast(null as string) as word", "n", "id", "key", "form"))).collect()
    assert len(got) == len(count) and {tuple(r) for r in got} == brute_variants(count)
    assert spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(df, ratio=1)


def test_words_of_documents(spark):
    from canopyframe.llm.spelling_variants import document_words, spelling_variants

    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdeÀÿ×") for _ in range(rng.choice([6, 7, 8, 12]))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pool).title() + rng.choice(["", ",", "9", " x"]) for _ in range(60)), "en") for i in range(40)]
    rows += [(None, rows[0][1], None), (None, rows[0][1], None), (3, rows[3][1], "en"), (50, None, "en"), (51, "", "en"), (52, "b" * 300, "en"), (53, "b" * 300 + " " + "b" * 301, "en"), (54, "b" * 30_000, None), (55, "b" * 30_000, None)]
    count = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    docs = frame(spark, rows)
    assert {tuple(r) for r in document_words(docs).collect()} == set(count.items())
    assert {tuple(r) for r in spelling_variants(document_words(docs)).collect()} == brute_variants(count)
    assert document_words(docs.limit(0)).count() == 0


def test_ranges_skip_one_letter(spark):
    """The keys are prefixes of the sorted rotations; a range holds at most one word a letter, and no pairs are made."""
    from pyspark.sql import functions as F

    from canopyframe.llm.spelling_variants import near_words, rotation_ranges

    words = spark.createDataFrame([(0, "abb", 5), (1, "ab", 3)], "id long, word string, n long")
    got = {(r.key, r.id, r.kind) for r in rotation_ranges(words).collect()}
    assert {k for k in got if k[1] == 1} == {("ab$", 1, 0), ("b$a", 1, 0), ("$ab", 1, 0), ("b$", 1, 2), ("$a", 1, 2)}
    assert {k for k in got if k[1] == 0 and k[2]} == {("bb$", 0, 2), ("b$a", 0, 1), ("$ab", 0, 2)}
    many = spark.range(26 * 26).select(F.col("id"), F.expr("concat('same', char(97 + id div 26), char(97 + id % 26))").alias("word"), F.lit(2).alias("n"))
    plan = near_words(many)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert {r.n_near for r in near_words(many).collect()} == {50}


# audit of filter orders ---------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    good, toxic = defaultdict(bool), defaultdict(bool)
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])
        parts[lang or ""].append((fails, i is not None and good[i], i is not None and toxic[i]))
    out = []
    for part, docs in parts.items():
        shapley, mine = Counter(), []
        for order in permutations(range(5)):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                failing = [d for d in docs if d[0][f]]
                mine.append([part, "".join("ABCDE"[x] for x in order), step + 1, len(left), len(gone), len(failing) - len(gone), sum(sum(d[0]) == 1 for d in failing), sum(d[1] for d in gone), sum(d[2] for d in gone), f])
        out += [(*r[:9], shapley[r[9]]) for r in mine]
    return sorted(out)


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_by_hand(spark):
    from canopyframe.llm.filter_audit import filter_audit

    rng = random.Random(9)
    pieces = ["word", "Word", "WORD", "é", "漢字", "#", "a|b", "x\x0by"]
    texts = [None, "", " ", "ABC", " ".join(rng.choice(pieces) for _ in range(30_000))]
    texts += [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) + tail for n in (150, 199, 200, 260) for k in (40, 400) for tail in ("", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFG")]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts * 3)]
    rows += [(None, texts[5], "en"), (None, texts[5], "de"), (7, texts[6], "fr"), rows[9], rows[9], *[(100 + i, texts[8], rng.choice(["en", "fr"])) for i in range(300)]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(frame(spark, rows), marks).select(*NAMES).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, labels)
    assert filter_audit(frame(spark, rows).limit(0), marks).count() == 0
    clean = [(1, " ".join(f"w{i}" for i in range(250)), "en")]
    zeros = filter_audit(frame(spark, clean), marks.limit(0)).select(*NAMES).collect()
    assert sorted(map(tuple, zeros)) == brute_audit(clean, []) and all(r.removed == 0 and r.kept == 1 for r in zeros)


def test_intervals_of_orders():
    from canopyframe.llm.filter_audit import lehmer_start, removal_intervals

    for size in (1, 3, 5):
        orders = list(permutations(range(size)))
        for k in range(1, size + 1):
            for before in permutations(range(size), k):
                assert lehmer_start(before, size) == min(r for r, o in enumerate(orders) if o[:k] == before)
        steps = defaultdict(list)
        for mask, step, start, stop in removal_intervals(size):
            for r in range(start, stop):
                steps[mask, r].append(step)
        for mask in range(1, 1 << size):
            for r, o in enumerate(orders):
                assert steps[mask, r] == [next(i for i, f in enumerate(o) if mask >> f & 1) + 1]


def test_copies_are_summed_before_they_meet(spark):
    """Copies of one text come to its task as one row a part, whatever their number."""
    from canopyframe.llm.filter_audit import mask_counts

    text = " ".join(f"w{i}" for i in range(250))
    rows = [(i, text, "en") for i in range(500)]
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["mask"]: (r.n, r.good, r.toxic) for r in mask_counts(frame(spark, rows), labels).collect()}
    assert got == {0: (1, 1, 0), 16: (499, 0, 1)}


# toxicity -----------------------------------------------------------------------------------------------------------


def test_features_by_hand():
    from canopyframe.llm import toxicity as tx
    from canopyframe.llm.common import Powers, string_buffers

    texts = ["Idiot, idiotic! idiot", None, "", "é é's x9", "!!!", "idiot"]
    raw, off = string_buffers(pa.array(texts, pa.string()))
    hashes, rows = tx.token_features(raw, off, Powers())

    def features(t):
        tokens = set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode())))
        return len(tokens) + sum(len(w) > k for w in tokens for k in tx.PREFIXES)

    assert np.bincount(rows, minlength=len(texts)).tolist() == [features(t) for t in texts] and (np.diff(rows) >= 0).all()
    cells, bounds = tx.feature_cells(hashes, rows, len(texts), 0)
    per = [set(cells[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert per[5] < per[0] and len(per[3]) == 3 and not per[1] and not per[2] and not per[4]
    w = np.arange(tx.CELLS, dtype=np.float64)
    assert np.allclose(tx._dot(cells, bounds, w), [sum(p) for p in per])
    assert np.allclose(tx._spread(cells, bounds, np.array([1, 2, 3, 4, 5, 6.0])), sum(v * np.bincount([c for c in p], minlength=tx.CELLS) for v, p in zip(range(1, 7), per)))


def test_risk_of_hidden_positives():
    """Half of the unlabelled rows are hidden positives; the class prior keeps them from being fitted as negatives."""
    from canopyframe.llm import toxicity as tx

    rng = np.random.default_rng(4)

    def table(rows):
        return np.concatenate(rows).astype(np.uint16), np.cumsum([0, *map(len, rows)])

    def draw(toxic):
        return np.unique(np.append(rng.integers(100, 400, 30), rng.integers(0, 20, 2) if toxic else rng.integers(50, 90, 2)))

    p, hidden, clean = [draw(True) for _ in range(150)], [draw(True) for _ in range(150)], [draw(False) for _ in range(150)]
    unlabelled = table(hidden + clean)
    w, c = tx.fit_risk(table(p), unlabelled, 0.5)
    f = tx._dot(*table([draw(True) for _ in range(200)] + [draw(False) for _ in range(200)]), w) + c
    assert ((f >= 0) == (np.arange(400) < 200)).mean() > 0.95
    assert ((tx._dot(*unlabelled, w) + c >= 0) == (np.arange(300) < 150)).mean() > 0.95
    # without that correction the same rows are taken for negatives
    w, c = tx.fit_risk(table(p), unlabelled, 0.05)
    assert (tx._dot(*unlabelled, w) + c >= 0)[:150].mean() < 0.5


def test_held_out_toxicity(spark):
    from canopyframe.llm.queries import queries

    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries()["op13_toxicity"](spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    count = Counter(held)
    assert len(held) > 700 and count[1, 1] / (count[1, 1] + count[0, 1]) > 0.9 and count[1, 0] / (count[1, 0] + count[0, 0]) < 0.005


def test_toxicity_edges(spark):
    from canopyframe.llm.toxicity import toxicity_scores

    rng = random.Random(8)
    plain = lambda n: " ".join(rng.choice(["tree", "river", "stone", "cloud", "meadow", "hill"]) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, plain(40) + (" vilest" if i % 4 == 0 else ""), "en") for i in range(400)]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(0, 400)] + [(3, 0, None), (None, 0, 1), (0, 0, 0)]
    far = plain(400_000) + " vilest"
    extra = [(None, None, None), (None, "", None), (None, plain(30), None), (None, plain(30) + " Vilest!", None), (None, far, None), (4, plain(20), None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity_scores(frame(spark, rows + extra), marks).collect()
    assert len(got) == len(rows) + len(extra)
    assert [r.predicted for r in sorted((r for r in got if r.doc_id is not None and r.doc_id != 4), key=lambda r: r.doc_id)] == [int(i % 4 == 0) for i in range(400) if i != 4]
    odd = sorted(r.score for r in got if r.doc_id is None)
    assert odd[0] == odd[1] and [s >= 0.5 for s in odd] == [False, False, False, True, True]
    again = toxicity_scores(frame(spark, rows + extra).repartition(7), marks).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == Counter((r.doc_id, round(r.score, 6)) for r in again)
    # labels of held-out rows, and labels other than 1, are not read
    other = spark.createDataFrame([(i, 1, 1 - t if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and t is not None else t) for i, _, t in labels], "doc_id long, quality int, toxic int")
    assert Counter(toxicity_scores(frame(spark, rows), other).collect()) == Counter(toxicity_scores(frame(spark, rows), marks).collect())
    assert {r.score for r in toxicity_scores(frame(spark, rows), marks.where("toxic = 0")).collect()} == {0.0}
    assert toxicity_scores(frame(spark, rows).limit(0), marks).count() == 0
