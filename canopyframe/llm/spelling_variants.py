"""Words that are one edit apart, found among the sorted rotations of all words, and the form of each word."""

from __future__ import annotations

from math import ceil, floor, log, log2

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

#: Letters that words are made of, as a class of a regular expression.
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands behind a word's last letter in its rotations.
_MARK = "$"
#: A range of rotations is named by its prefix up to so many code points, and by a 127-bit hash of it beyond.
_SPELLED = 64
_PRIME, _BASE = (1 << 127) - 1, 0x5BD1E9955BD1E9956A09E667F3BCC909
_ROWS = 1 << 15


def document_words(docs: DataFrame, min_length: int = 7, min_count: int = 2, noise: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of whole texts, with their number of occurrences (word, n).

    Words are maximal runs of ``LETTERS`` with A to Z lower-cased. With ``noise``, a run loses one letter where the
    crc32 of ``<id>:<run>`` is divisible by it: the one at that checksum modulo the length (a null id is the empty
    string). Then words of fewer than ``min_length`` code points or ``min_count`` occurrences are left out.
    Null text has no words. Counts are summed in each task before words are shuffled.
    """
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if noise:
        rows = rows.withColumn("sum", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))).withColumn("at", (F.col("sum") % F.length("word")).cast("int"))
        cut = F.expr("concat(substring(word, 1, at), substring(word, at + 2))")
        rows = rows.select(F.when(F.col("sum") % noise == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _hashed(batches):
    """Ranges of the rotations of words whose prefixes are too long to be spelled, some thousand rows at a time."""
    for batch in batches:
        for word, number, n in zip(*(batch.column(c).to_pylist() for c in ("word", "id", "n"))):
            codes = list(map(ord, word))
            size = len(codes)
            power, head = [1], [0]
            for c in codes:
                head.append((head[-1] * _BASE + c) % _PRIME)
                power.append(power[-1] * _BASE % _PRIME)
            keys, kinds = [], []

            def block():
                return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([number] * len(keys), pa.int64()), pa.array([n] * len(keys), pa.int64()), pa.array(kinds, pa.int32())], ["key", "id", "n", "kind"])

            for i in range(size + 1):
                for kind in (0, 1):
                    if size + 1 - kind <= _SPELLED or i + kind > size:
                        continue
                    # letters behind the edited one, the mark, letters before it
                    tail = (head[size] - head[i + kind] * power[size - i - kind]) % _PRIME
                    whole = ((tail * _BASE + ord(_MARK)) * power[i] + head[i]) % _PRIME
                    keys.append(f"{size + 1 - kind}:{whole:032x}")
                    kinds.append(0 if not kind else 1 if i + 1 < size and codes[i] == codes[i + 1] else 2)
                if len(keys) >= _ROWS:
                    yield block()
                    keys, kinds = [], []
            if keys:
                yield block()


def rotation_ranges(words: DataFrame) -> DataFrame:
    """Every place of words (id, word, n) in the sorted rotations: (key, id, n, kind).

    A word with its mark is rotated so that what follows one place comes first and what precedes it last. Words that
    differ by a letter at that place agree in the rotation but for its last letter (kind 1, or 2 where the next letter is
    another); the word without that letter is the prefix itself (kind 0). The key is that prefix, so a range of
    the sorted rotations that skips one letter has one key. Keys of over 64 code points are hashed, so a word of any
    length has rows of bounded size.
    """
    places = words.where(F.length("word") <= _SPELLED).select("id", "n", "word", F.explode(F.expr("sequence(0, 2 * length(word))")).alias("p"))
    places = places.selectExpr("id", "n", "word", "p div 2 as i", "p % 2 as skip").selectExpr(
        "id", "n", "word", "cast(i as int) as i", "skip", "length(word) + 1 - skip as size"
    ).where(F.col("size") <= _SPELLED)
    spelled = places.selectExpr(
        f"concat(substring(word, i + 1 + skip), '{_MARK}', substring(word, 1, i)) as key", "id", "n",
        "case when skip = 0 then 0 when substring(word, i + 1, 1) = substring(word, i + 2, 1) then 1 else 2 end as kind",
    )
    hashed = words.where(F.length("word") >= _SPELLED).select("word", "id", "n").mapInArrow(_hashed, "key string, id long, n long, kind int")
    return spelled.unionByName(hashed)


def near_words(words: DataFrame) -> DataFrame:
    """Near words of words (id, word, n; ids in the order of words): id, n_near, best_n, best, for those that have any.

    Two words are near if one inserted, deleted or replaced letter parts them. The rotations are sorted by range, and
    each range is scanned once: every member takes the number of others near it, and the first other by n (then by
    id). A range has one word at most for each letter and one without, so it is bounded by the alphabet, and no
    pair is written. A replacement lies in one range; a letter inserted into a run of its like is counted at the run's
    end only.
    """
    by = Window.partitionBy("key").orderBy(F.desc("n"), "id")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marks = lambda kind: F.sum(F.when(kind, 1).otherwise(0)).over(whole)
    rows = rotation_ranges(words).select(
        "id", "kind", F.row_number().over(by).alias("place"), F.count(F.lit(1)).over(whole).alias("members"),
        marks(F.col("kind") > 0).alias("long"), marks(F.col("kind") == 2).alias("ends"),
        F.first(F.struct("n", "id")).over(whole).alias("one"), F.nth_value(F.struct("n", "id"), 2).over(whole).alias("two"),
    ).where("members > 1")
    short = F.col("members") - F.col("long")
    count = F.when(F.col("kind") == 0, F.col("ends")).when(F.col("kind") == 2, F.col("long") - 1 + short).otherwise(F.col("long") - 1)
    other = F.when(F.col("place") == 1, F.col("two")).otherwise(F.col("one"))
    rows = rows.select("id", count.alias("near"), other.getField("n").alias("best_n"), (-other.getField("id")).alias("back"))
    best = F.max(F.struct("best_n", "back"))
    return rows.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best")).select("id", "n_near", "best.best_n", (-F.col("best.back")).alias("best"))


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Group counted words (word, n; each word once) by spelling.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is at least ``ratio``
    times its own; its root is the last word that forms lead to. n grows by ``ratio`` from form to form, so chains
    are short and are followed by doubling. Null words are left out; words may be of any length; extra columns are
    ignored; no words, no rows. Returns: word, form, root, n, n_near, form_n.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    ship(words.sparkSession)
    counted = materialize(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    # numbers in the order of the words: ranges of words, sorted, each with numbers above those of the one before
    counted = counted.repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    counted = materialize(counted, "numbered")
    near = materialize(near_words(counted), "near")
    forms = counted.select("id", "n").join(near, "id").where(F.col("best_n") >= ratio * F.col("n")).select("id", F.col("best").alias("form"), F.col("best").alias("root"))
    forms = materialize(forms, "forms")
    most = counted.agg(F.max("n")).first()[0] or 1
    hops = floor(log(most) / log(ratio)) + 1
    for _ in range(ceil(log2(hops)) if hops > 1 else 0):
        after = forms.select(F.col("id").alias("root"), F.col("root").alias("next"))
        forms = materialize(forms.join(after, "root", "left").select("id", "form", F.coalesce("next", "root").alias("root")), "forms")
    named = forms.join(counted.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form")
    named = named.join(counted.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "form_word", "root_word", "form_n")
    out = counted.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
