"""Clean a corpus in five stages: quality votes, near duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyframe.llm.common import materialize, scratch, shared_dir
from canopyframe.llm.mixing import mix_sources
from canopyframe.llm.ngram_join import ngram_components
from canopyframe.llm.packing import best_fit_pack, token_pieces
from canopyframe.llm.quality_knn import quality_votes
from canopyframe.llm.queries import _word_bpe
from canopyframe.llm.suffix_dedup import remove_repeats, span_lists

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row_hash():
    """64-bit hash of a whole row; hashes skip nulls, so flags tell them."""
    return F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote of their nearest labelled neighbours accepts; each row, without an id too, by its own text.

    Null text is empty, and empty texts are voted on like others. Without labels every score is a half, so all rows stay.
    An empty table gives an empty one.
    """
    with scratch(spark):
        votes = quality_votes(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=COLUMNS[1:])
    return votes.where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more: the one with the smallest id.

    Rows that share an id, or have none, are documents of their own; a null id is smaller than all others, and
    equal ids are ordered by a hash of the row. Of rows that are equal throughout one stays, but every row
    without words (null and empty texts too) does, as it links with nothing. An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS, _row_hash().alias("_row"))
    with scratch(spark) as keep:
        groups = ngram_components(docs, words=5, percent=80, columns=["_row"]).where("part is not null")
        first = keep(groups.groupBy("part").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("first._row"), "first")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    turn = F.row_number().over(Window.partitionBy("_row").orderBy("n_chars"))  # rows with one hash are equal
    one = docs.where(worded).join(first, "_row").withColumn("_turn", turn).where("_turn = 1")
    return one.select(*COLUMNS).unionByName(docs.where(~worded).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier in the corpus; emptied documents go, cut characters too.

    Null ids are earlier than all others; different texts with one id, or none, are ordered by a checksum of the
    text. Rows with equal id and text are copies: all but one are emptied, if they have 100 bytes. Null and empty texts
    stay as they are; an empty table gives an empty one.
    """
    with scratch(spark) as keep:
        spans = keep(span_lists(docs, 100), "spans")
    out = remove_repeats(docs, 100, columns=["text", "lang", "source", "n_chars"], spans=spans, characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))  # without what a cut leaves of a character
    out = out.withColumn("text", text)
    out = out.where((F.col("n_removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times; one without words stays out).

    Rows that share an id, or have none, are documents of their own and take what the mix gives each of them. Null text
    has no words; an empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS, _row_hash().alias("_row"))
    with scratch(spark) as keep:
        taken = mix_sources(docs, id_col="_row").groupBy("_row").agg(F.sort_array(F.collect_list(F.when(F.col("copies") > 0, F.col("copies"))), asc=False).alias("taken"))
        copies = keep(taken.where("size(taken) > 0"), "copies")
    turn = F.row_number().over(Window.partitionBy("_row").orderBy("n_chars"))  # rows with one hash are equal
    out = docs.join(copies, "_row").withColumn("_n", F.try_element_at("taken", turn)).where("_n > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: the place of every piece of every row, with a null or repeated id as with any.

    Null text is empty: a piece of the end id alone. An empty table gives an empty one.
    """
    pieces = token_pieces(docs, _word_bpe(), size=2048, end_id=0).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_pack(materialize(pieces, "pieces"), 2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

#: The stages call a tokenizer, a fitted model and seeded draws, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
