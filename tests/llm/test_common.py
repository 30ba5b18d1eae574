"""Shared helpers: scratch tables, components, word spans."""

import os
import random

import numpy as np


def test_scratch_keeps_what_it_is_told_to(spark):
    from canopyframe.llm.common import materialize, scratch, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark) as keep:
        part = materialize(spark.range(10), "gone")
        kept = keep(part.where("id > 3"), "kept")
    new = set(os.listdir(folder)) - before
    assert kept.count() == 6 and len(new) == 1 and next(iter(new)).startswith("canopy-kept")


def test_components_of_random_graphs(spark):
    from canopyframe.llm.common import connected_components

    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(12)] + [(5, 5)]
    label = {n: n for n in [*range(60), *range(100, 113), 999]}
    for _ in range(120):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    nodes = spark.createDataFrame([(n,) for n in label], "node long")
    got = {r.node: r.component_id for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_word_spans_and_hashes():
    import pyarrow as pa

    from canopyframe.llm.common import Powers, prefix_hash, span_hash, string_buffers, word_spans

    texts = ["a bc", None, "", " x\ty ", "bc", "é\x0bé"]
    raw, off = string_buffers(pa.array(texts))
    start, end, rows = word_spans(raw, off)
    words = [bytes(raw[s:e]).decode() for s, e in zip(start, end)]
    assert words == ["a", "bc", "x", "y", "bc", "é", "é"] and rows.tolist() == [0, 2, 2, 2, 4, 5, 7]
    powers = Powers()
    h = span_hash(prefix_hash(raw, powers), start, end, powers)
    assert h[1] == h[4] and h[5] == h[6] and len(np.unique(h)) == 5


def test_stars_of_edges_in_parts(monkeypatch):
    """Stars of a task keep what its edges connect, however few nodes are held at once."""
    import pyarrow as pa

    from canopyframe.llm import common

    rng = random.Random(6)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(45)]

    def parts(pairs):
        label = {n: n for n in range(50)}
        for _ in range(60):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    batches = [pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges[i : i + 5]]), pa.array([e[1] for e in edges[i : i + 5]])], ["u", "v"]) for i in range(0, 45, 5)]
    for held in (1 << 20, 7):
        monkeypatch.setattr(common, "_HELD", held)
        out = [(u, v) for b in common._forest(batches) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist())]
        assert parts(out) == parts(edges) and len(out) <= len(edges)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_prime_hashes():
    """Slices by a plain polynomial; two strings of a Thue-Morse pair differ, which agree modulo a power of two."""
    import pyarrow as pa

    from canopyframe.llm import common as c

    rng = random.Random(4)
    exact = c.PrimeHash()
    raw = np.frombuffer(rng.randbytes(5000), np.uint8)
    prefix, want = exact.prefix(raw), [0]
    for i, v in enumerate(raw.tolist()):
        want.append((want[-1] + (v + 1) * pow(exact.base, i, c._PRIME)) % c._PRIME)
    assert prefix.tolist() == want
    a, b = np.array([3, 100, 7]), np.array([3, 160, 67])
    twice = np.concatenate([raw[100:160], raw[7:67]])
    again = exact.spans(exact.prefix(twice), np.array([0, 60]), np.array([60, 120]))
    assert exact.spans(prefix, a, b)[1:].tolist() == again.tolist()
    x = np.array([c._PRIME - 1, 1 << 60, 12345], np.uint64)
    assert c.times_mod(x, x[::-1].copy()).tolist() == [int(i) * int(j) % c._PRIME for i, j in zip(x, x[::-1])]
    first, second = thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))
    raw, off = c.string_buffers(pa.array([first, second]))
    assert np.unique(exact.spans(exact.prefix(raw), off[:-1], off[1:])).size == 2
    powers = c.Powers()
    assert np.unique(c.span_hash(c.prefix_hash(raw, powers), off[:-1], off[1:], powers)).size == 1
    many, parts = np.frombuffer(rng.randbytes(100), np.uint8), []
    whole = exact.prefix(many)
    summed, c._SUMMED = c._SUMMED, 7
    try:
        parts = exact.prefix(many)
    finally:
        c._SUMMED = summed
    assert parts.tolist() == whole.tolist()


def test_different_words_and_lines_do_not_agree(spark):
    from canopyframe.llm.ngram_join import ngram_components
    from canopyframe.llm.quality_rules import quality_rules

    first, second = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(91, first), (92, second), (93, f"{first}\n{second}\n{first}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_components(df, words=4, percent=85).collect()} == {91: 91, 92: 92, 93: 93}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_dup_lines for r in quality_rules(df, labels).collect()} == {91: 0, 92: 0, 93: 1}


def test_first_calls_need_no_source_folder(tmp_path):
    """Each public function is the first call of a session whose workers do not see the repository."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys, os
sys.path.insert(0, {repo!r})
import public_tokenizers
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
s.sparkContext.setLogLevel("OFF")
d = s.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x " * 90)], "doc_id long, text string")
labels = s.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
bpe, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
from canopyframe.llm import common, ngram_join, packing, quality_knn, quality_rules, spelling_variants, suffix_dedup, token_counts, token_files, toxicity
calls = [lambda: ngram_join.ngram_components(d).count(), lambda: suffix_dedup.span_lists(d).count(), lambda: suffix_dedup.remove_repeats(d).count(), lambda: packing.token_pieces(d, bpe).count(),
    lambda: token_counts.token_counts(d, pieces).count(), lambda: token_files.write_token_files(d, {str(tmp_path)!r} + "/t", bpe), lambda: quality_knn.quality_votes(d, labels).count(),
    lambda: quality_rules.quality_rules(d, labels).count(), lambda: toxicity.toxicity_scores(d, labels).count(), lambda: spelling_variants.spelling_variants(spelling_variants.document_words(d)).count()]
done = 0
for call in calls:
    common._SHIPPED.clear()  # as if it were the first call: Python functions made before it sends the package lack it
    s.sparkContext._python_includes.clear()
    call()
    done += 1
    type(s.sparkContext).addPyFile = lambda self, path: self._python_includes.append("canopyframe.zip")  # the file is there by now
print("DONE", done)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "DONE 10" in out.stdout, out.stderr[-3000:]
