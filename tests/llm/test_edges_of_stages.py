"""Every stage and the operators behind them on empty tables, nulls in any column, repeats and clashing names."""

import math
import random
from collections import Counter

import pytest
from test_shared_ids import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EXTRA = "id string, sum string, key string, n string, _row string, _turn string, shard string, row string, copies string, part string, anchor string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def edge_rows():
    rng = random.Random(12)
    base = words(rng, 120)
    texts = [None, "", " \n\t", "one", base, base, base + " tail", base.replace(" ", "\n"), words(rng, 5000), "x" * 5000, "é漢 " * 400, words(rng, 90), words(rng, 90)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i % 4 or None, t, [None, "en"][i % 2], [None, "a", "b"][i % 3], [None, 7][i % 2]))
    return rows + [rows[4], rows[0], (None, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, *["clash"] * 11) for r in edge_rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_stages(spark, edge, nothing):
    import corpus_pipeline as cp

    have = Counter(edge_rows())
    for name, stage in cp.STAGES:
        for df in (edge, nothing):
            out = stage(spark, df, "/root/testdata/sf0.001")
            rows = out.collect()
            assert (len(rows) == 0) == (df is nothing)
            if name == "packing":
                assert Counter(r.doc_id for r in rows if r.piece == 0) == (Counter() if df is nothing else Counter(r[0] for r in have.elements()))
                continue
            assert out.columns == COLUMNS
            got = Counter(map(tuple, rows))
            if name in ("quality", "near_duplicates"):
                assert not got - have  # rows go, none changes
            if name == "near_duplicates" and df is edge:
                assert all(got[r] == n for r, n in have.items() if not (r[1] or "").strip())  # rows without words stay
                assert sum(n for r, n in got.items() if (r[1] or "").startswith(edge_rows()[4][1][:20])) == 1
            if name == "repeated_passages" and df is edge:
                assert sum(got.values()) <= sum(have.values()) and all(got[r] == n for r, n in have.items() if len((r[1] or "").encode()) < 100)
            if name == "mixture" and df is edge:
                assert set(got) <= set(have) and all(n <= 2 * have[r] for r, n in got.items())


def test_shards_and_files(spark, edge, nothing, tmp_path):
    """Shards and token files of rows with null and repeated ids; each row is there once, in order of ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from canopyframe.llm.sharding import byte_shards
    from canopyframe.llm.token_files import read_token_files, write_token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = byte_shards(edge, 5).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], size(r[1])) for r in edge_rows())
    by = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id or 0 for r in by] == sorted(r.doc_id or 0 for r in rows)
    for s in {r.shard for r in rows}:
        assert [r.slot for r in by if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    assert byte_shards(nothing, 5).count() == 0

    tokenizer = Tokenizer.from_file(path)
    write_token_files(edge, f"{tmp_path}/a", path, end_id=1)
    got = sorted(read_token_files(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    want = Counter((r[0], b"".join(i.to_bytes(4, "little") for i in ids(r[1]))) for r in edge_rows())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert [r.doc_id or 0 for r in got] == sorted(r.doc_id or 0 for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_packing_of_many_equal_rows(spark):
    from canopyframe.llm.packing import best_fit_pack

    rows = [(None, 0, 700)] * 500 + [(3, 0, 700)] * 100 + [(3, 1, 2048)] * 3 + [(4, 0, 648)] * 50
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(4)
    got = best_fit_pack(df, 2048).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter(rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(600 / 2) + 3 + 1
    for bad in ([(1, 0, None)], [(1, 0, 0)], [(1, 0, 2049)]):
        with pytest.raises(ValueError):
            best_fit_pack(spark.createDataFrame(bad, "doc_id long, piece int, length long"), 2048)
    assert best_fit_pack(df.limit(0), 2048).count() == 0
