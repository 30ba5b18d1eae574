"""Each stage against a brute-force version of its decision on the small tables."""

import re
from collections import Counter, defaultdict

from test_dealt import brute_components, check_packing, words_of
from test_scores_and_repeats import brute_repeats


def test_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}

    good = cp.quality(spark, docs, sf).cache()
    assert good.columns == columns
    left = texts(good)
    hit = [labels[d] == 1 for d in left if d in labels]
    assert sum(hit) / len(hit) > 0.95 and sum(y == 1 and d in left for d, y in labels.items()) / sum(y == 1 for y in labels.values()) > 0.97

    alone = cp.near_duplicates(spark, good, sf).cache()
    want = {d for d, (_, c) in brute_components(left, 5, 80).items() if d == c}
    assert alone.columns == columns and set(texts(alone)) == want and alone.count() == len(want)

    clean = cp.repeated_passages(spark, alone, sf).cache()
    before, got = texts(alone), texts(clean)
    for d, (n, removed, runs, _) in brute_repeats(before, 100).items():
        if not removed:
            assert got[d] == before[d]
        elif d in got:
            assert abs(len(got[d].encode()) - (n - removed)) <= 6 * runs
        else:
            assert n - removed < 200

    mixed = cp.mixture(spark, clean, sf).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    source = {r.doc_id: r.source for r in clean.collect()}
    size = {d: len(words_of(t)) for d, t in got.items()}
    total, taken = defaultdict(int), defaultdict(int)
    for d in got:
        total[source[d]] += size[d]
        taken[source[d]] += copies[d] * size[d]
    assert mixed.columns == columns and max(copies.values()) <= 2 and set(copies) <= set(got)
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) < 0.1 * sum(total.values())

    ones = mixed.dropDuplicates(["doc_id"])
    check_packing(cp.packing(spark, ones, sf).collect(), texts(ones))
    packed = cp.packing(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert not any(re.search("�", t) for t in got.values())


def test_run(spark):
    import corpus_pipeline as cp

    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0


def test_replacement_signs_stay(spark):
    """Only what a cut leaves of a character goes; a text's own U+FFFD and its other characters stay."""
    import corpus_pipeline as cp

    from canopyframe.llm.suffix_dedup import whole_characters

    long = " ".join(f"w{i:03d}" for i in range(40))
    for tail in ("\ufffd", "é", "漢", "\U0001f600"):
        rows = [(1, long, "en", "s", 1), (2, f"keep \ufffd mark {long} here \ufffd tail {tail}", "en", "s", 1)]
        got = {r.doc_id: r.text for r in cp.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
        assert got[1] == long and got[2].count("\ufffd") == rows[1][1].count("\ufffd") and got[2].startswith("keep \ufffd mark ") and got[2].endswith(f" here \ufffd tail {tail}")
    for text in ("aé漢\U0001f600b", "é", "漢漢", "\U0001f600"):
        raw = text.encode()
        for i in range(len(raw) + 1):
            for j in range(i, len(raw) + 1):
                part = whole_characters(raw[i:j], True, True).decode()  # never half a character
                assert part in text and len(part.encode()) >= j - i - 6
