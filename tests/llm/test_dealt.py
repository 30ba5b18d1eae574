"""The corpus operators against brute force on small tables, with nulls, empties, ties, repeats and extra columns."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, n string, id string"


def fixture_rows():
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "délta", "x,y", "99", "it's", "ok!!", "zeta", "eta", "theta", "iota"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(60)
    rows = [None, "", "   \n\t ", "one", "one two three", base, base, base.upper(), base + " tail", base.replace("zeta", "other", 1), text(3000), text(40), text(40)]
    rows += [base] * 5 + ["a\x0bb\x0cc d\x1ce　f", text(4) + "\n" + text(4)]
    out = [(i, t, "en", ["s0", None, "s1", "é"][i % 4], 0, "clash", "clash", "clash", "clash") for i, t in enumerate(rows)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return dict(rows)


def words_of(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# 1 sharding ---------------------------------------------------------------------------------------------------------


def check_shards(rows, texts, n):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = defaultdict(int)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r["size"] == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        sizes[r["shard"]] += r["size"]
    target, largest = sum(sizes.values()) / n, max(r["size"] for r in rows)
    assert all(0 <= s < n for s in sizes) and all(abs(v - target) <= largest for v in sizes.values())
    for s in sizes:
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert [r.doc_id for r in own] == sorted(r.doc_id for r in own)
    assert [r["shard"] for r in sorted(rows, key=lambda r: r.doc_id)] == sorted(r["shard"] for r in rows)


def test_shards(spark, docs, empty, table, sf):
    from canopyframe.llm.queries import op1_sharding
    from canopyframe.llm.sharding import byte_shards

    check_shards(byte_shards(docs, 5).collect(), {r[0]: r[1] for r in fixture_rows()}, 5)
    check_shards(op1_sharding(spark, sf).collect(), table, 24)
    assert byte_shards(empty, 5).count() == 0


# 3 n-gram join ------------------------------------------------------------------------------------------------------


def brute_components(texts, words, percent):
    sets = {}
    for d, t in texts.items():
        w = words_of(ascii_lower(t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    label = {d: d for d in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    pairs = {(a, b) for ids in where.values() for i, a in enumerate(sorted(ids)) for b in sorted(ids)[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_ngram_components(spark, docs, empty, table, sf):
    from canopyframe.llm.ngram_join import ngram_components
    from canopyframe.llm.queries import op3_ngram_join

    texts = {r[0]: r[1] for r in fixture_rows()}
    for words, percent in ((4, 85), (5, 80), (1, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs, words, percent).collect()}
        assert got == brute_components(texts, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op3_ngram_join(spark, sf).collect()} == brute_components(table, 4, 85)
    assert ngram_components(empty).count() == 0


def test_ngram_components_of_a_chain(spark):
    """A chain of texts, each linked to its neighbours only, and many near copies of one text."""
    from canopyframe.llm.ngram_join import ngram_components

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = {0: " ".join(words)}
    for i in range(1, 30):
        words = words[1:] + [f"v{i}"]
        texts[i] = " ".join(words)
    base = [f"b{i}" for i in range(80)]
    for i in range(30, 120):
        own = list(base)
        own[rng.randrange(80)] = f"c{i}"
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df, 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


# 4 token counts -----------------------------------------------------------------------------------------------------


def brute_split(word, pieces, unknown):
    """(score, tokens) of the best split, by trying every last piece at every place."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        options = [(best[i - 1][0] + unknown, best[i - 1][1] - len(word[i - 1].encode()))]
        options += [(best[k][0] + pieces[word[k:i]], best[k][1] - 1) for k in range(i) if word[k:i] in pieces]
        best.append(max(options))
    return best[-1][0], -best[-1][1]


def brute_estimate(texts, pieces, rounds):
    """Log-probabilities of the pieces from counted best splits of every single word."""
    score = dict.fromkeys(pieces, -1.0)
    for _ in range(rounds):
        unknown, used = min(score.values()) - 10, Counter()
        for word, n in Counter(w for t in texts for w in words_of(t)).items():
            word, best = "▁" + word, [(0.0, 0, [])]
            for i in range(1, len(word) + 1):
                options = [(best[i - 1][0] + unknown, best[i - 1][1] - len(word[i - 1].encode()), best[i - 1][2])]
                options += [(best[k][0] + score[word[k:i]], best[k][1] - 1, best[k][2] + [word[k:i]]) for k in range(i) if word[k:i] in score]
                best.append(max(options, key=lambda o: o[:2] + (0 if o is options[0] else 1,)))
            for p in best[-1][2]:
                used[p] += n
        total = sum(used.values()) + 0.5 * len(pieces)
        score = {p: math.log((used[p] + 0.5) / total) for p in pieces}
    return score


def test_token_counts(spark, docs, empty, table, sf, monkeypatch):
    import public_tokenizers

    from canopyframe.llm import token_counts as tc
    from canopyframe.llm.queries import op4_token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    names = tc.load_pieces(path)
    big = spark.read.parquet(f"{sf}/documents.parquet")
    for df, rows, texts in ((docs, tc.token_counts(docs, path).collect(), {r[0]: r[1] for r in fixture_rows()}), (big, op4_token_counts(spark, sf).collect(), table)):
        model = tc.estimate(df, names)
        score = dict(zip(names, model.scores.tolist()))
        if df is docs:
            assert score == pytest.approx(brute_estimate(texts.values(), names, tc.ROUNDS))
        else:
            assert score == dict(zip(names, tc.estimate(df.repartition(7), names).scores.tolist()))
            assert all(model.alone("▁" + w)[1] == 1 for w in ("the", "and", "of"))
        assert sum(map(math.exp, score.values())) == pytest.approx(1)
        unknown, seen = min(score.values()) - 10, {}
        assert len(rows) == len(texts)
        for r in rows:
            words = words_of(texts[r.doc_id])
            for w in words:
                if w not in seen:
                    seen[w] = brute_split("▁" + w, score, unknown)
            assert (r.n_words, r.n_tokens) == (len(words), sum(seen[w][1] for w in words))
            assert r.score == pytest.approx(sum(seen[w][0] for w in words))
    again = {r.doc_id: tuple(r) for r in tc.token_counts(big.repartition(7), path).collect()}
    assert again == {r.doc_id: tuple(r) for r in rows}
    small = {"▁": -1.0, "a": -2.0, "ab": -2.5, "b": -2.0, "▁a": -2.0, "é": -3.0}
    model = tc.Pieces(list(small), np.array(list(small.values())))
    words = ["▁", "▁ab", "▁ba", "▁é", "▁漢"]
    score, tokens, used = tc.trie_splits(pa.array(words, pa.large_string()), model, np.array([1, 2, 1, 1, 1]))
    assert tokens.tolist() == [1, 2, 3, 2, 4] and score[1] == -3.5
    assert [model.alone(w) for w in words] == list(zip(score.tolist(), tokens.tolist()))
    assert dict(zip(small, used.tolist())) == {"▁": 6, "a": 1, "ab": 2, "b": 1, "▁a": 0, "é": 1}
    # words longer than the trie takes, and ids that are null or shared
    long_ = spark.createDataFrame([(None, "ab" * 500 + " a"), (None, "ab" * 500), (3, "漢" * 300), (3, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in tc.token_counts(long_, path).collect())
    model = tc.estimate(long_, names)
    t = lambda w: model.alone("▁" + w)[1]
    assert got == Counter({(None, 2, t("ab" * 500) + t("a")): 1, (None, 1, t("ab" * 500)): 1, (3, 1, t("漢" * 300)): 1, (3, 0, 0): 1})
    assert tc.token_counts(empty, path).count() == 0


# 8 packing and 9 token files ----------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_best_fit(lengths, size):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(size - length)
    return sorted(bins)


def test_best_fit_plan():
    from canopyframe.llm.packing import best_fit_plan

    rng = random.Random(1)
    for _ in range(150):
        size = rng.choice([1, 5, 37, 100])
        items = [rng.randint(1, size) for _ in range(rng.randint(0, 150))] + [rng.randint(1, size)] * rng.choice([0, 80])
        bins = defaultdict(list)
        for length, _, n, first, per, offset in best_fit_plan(Counter(items), size):
            for k in range(n):
                bins[first + k // per].append((offset + k % per * length, length))
        for runs in bins.values():
            at = 0
            for offset, length in sorted(runs):
                assert offset == at
                at += length
        assert sorted(size - sum(x for _, x in runs) for runs in bins.values()) == brute_best_fit(items, size)


def check_packing(rows, texts, size=2048):
    coder = tokenizer()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    lengths = []
    for d, t in texts.items():
        ids = coder.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // size)))
        for r in pieces:
            own = ids[r.piece * size : (r.piece + 1) * size]
            assert (r.start, r.length) == (r.piece * size, len(own))
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
            lengths.append(len(own))
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert len(by_bin) == len(brute_best_fit(lengths, size))


def test_packing(spark, docs, empty, table, sf):
    from pyspark.sql import functions as F

    from canopyframe.llm.packing import best_fit_pack, token_pieces
    from canopyframe.llm.queries import _word_bpe, op8_best_fit_packing

    pieces = token_pieces(docs, _word_bpe())
    packed = best_fit_pack(pieces).withColumn("ids_crc32", F.crc32("ids"))
    check_packing(packed.collect(), {r[0]: r[1] for r in fixture_rows()})
    check_packing(op8_best_fit_packing(spark, sf).collect(), table)
    assert best_fit_pack(token_pieces(empty, _word_bpe())).count() == 0


def test_encoder_equals_tokenizer():
    import pyarrow as pa

    from canopyframe.llm.queries import _word_bpe
    from canopyframe.llm.tokens import WordEncoder

    texts = [None, "", "it's a dog's 'tis \"'s\" x!'s don't!! 99'a a'9", "a <|endoftext|> b", "<|STARTOFTEXT|> x", "\x1c\x85 a　b 日本語 １２ Ⅻ ½ 😀!! ﬁ Å",
             "é!̸≠ ≮ …, é, ,é 12é é12 a9b9 'S THE'RE", "z" * 5000]
    code = WordEncoder(_word_bpe())
    ids, bounds = code.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == code.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_dac_round_trip():
    import numpy as np

    from canopyframe.llm.token_files import DacReader, dac_encode

    rng = np.random.default_rng(0)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1, 0], rng.integers(0, 300, 5000), rng.integers(0, 50000, 4096), rng.integers(0, 256, 512)):
        ids = np.array(ids, np.uint32)
        reader = DacReader(dac_encode(ids))
        assert reader.all().tolist() == ids.tolist() and len(reader) == len(ids)
        assert [reader[int(i)] for i in range(0, len(ids), 7)] == ids[::7].tolist()


def check_tokens(rows, texts):
    coder, start = tokenizer(), 0
    by = {r.doc_id: r for r in rows}
    assert set(by) == set(texts) and len(by) == len(rows)
    for d in sorted(texts):
        ids = coder.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        assert (by[d].start, by[d].n_tokens, by[d].ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_token_files(spark, docs, empty, table, sf, tmp_path):
    from pyspark.sql import functions as F

    from canopyframe.llm.queries import _word_bpe, op9_token_files
    from canopyframe.llm.token_files import read_token_files, token_at, write_token_files

    write_token_files(docs, f"{tmp_path}/a", _word_bpe())
    read = read_token_files(spark, f"{tmp_path}/a").withColumn("ids_crc32", F.crc32("ids"))
    check_tokens(read.collect(), {r[0]: r[1] for r in fixture_rows()})
    ids = [int.from_bytes(r.ids[i : i + 4], "little") for r in read.orderBy("start").collect() for i in range(0, len(r.ids), 4)]
    wanted = [0, 5, 17, len(ids) - 1, len(ids)]
    got = {r.position: r.id for r in token_at(spark, f"{tmp_path}/a", spark.createDataFrame([(p,) for p in wanted], "position long")).collect()}
    assert got == {p: ids[p] for p in wanted[:-1]}
    check_tokens(op9_token_files(spark, sf).collect(), table)
    write_token_files(empty, f"{tmp_path}/b", _word_bpe())
    assert read_token_files(spark, f"{tmp_path}/b").count() == 0


# 10 mixing ----------------------------------------------------------------------------------------------------------


def brute_targets(size_of, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in size_of if s is not None)) + [None] * (None in size_of)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(size_of.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= cap * size_of[s]]
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = cap * size_of[s]
            left -= out[s]
            free.remove(s)
    return out


def check_mix(rows, texts, source_of):
    size = {d: len(words_of(t)) for d, t in texts.items()}
    total = defaultdict(int)
    for d in texts:
        total[source_of[d]] += size[d]
    target, taken, largest = brute_targets(total), defaultdict(int), defaultdict(int)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        s = source_of[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def test_mixing(spark, docs, empty, table, sf):
    from canopyframe.llm.mixing import mix_sources
    from canopyframe.llm.queries import op10_mixing

    rows = fixture_rows()
    check_mix(mix_sources(docs).collect(), {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows})
    source_of = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    first = op10_mixing(spark, sf).collect()
    check_mix(first, table, source_of)
    assert sorted(map(tuple, first)) == sorted(map(tuple, op10_mixing(spark, sf).collect()))
    assert mix_sources(empty).count() == 0


def test_mixing_of_equal_rows(spark):
    """Many rows without an id, equal in all; and rows with an id that differ: as even as others, under any partitions."""
    from canopyframe.llm.mixing import mix_sources

    rows = [(None, "a b c", "x")] * 30_000 + [(5, f"w{i}", "y") for i in range(2000)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    begun = time.time()
    got = [Counter(map(tuple, mix_sources(df.repartition(n)).select("doc_id", "source", "size", "copies").collect())) for n in (3, 8)]
    assert got[0] == got[1] and time.time() - begun < 60
    assert sum(got[0].values()) == len(rows)
    taken = Counter()
    for (_, source, size, copies), n in got[0].items():
        taken[source] += size * copies * n
        assert copies <= 2
    want = brute_targets({"x": 90_000, "y": 2000, None: 0})
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)
