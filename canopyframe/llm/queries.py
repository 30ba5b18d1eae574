"""Queries of the corpus operators over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import ship

    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark, sf_dir):
    from .sharding import byte_shards

    return byte_shards(_documents(spark, sf_dir), 24)


def op2_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeats

    out = remove_repeats(_documents(spark, sf_dir), 100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_ngram_join(spark, sf_dir):
    from .ngram_join import ngram_components

    return ngram_components(_documents(spark, sf_dir), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_knn(spark, sf_dir):
    from .quality_knn import quality_votes

    return quality_votes(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_embedding_dedup(spark, sf_dir):
    from .embedding_dedup import embedding_links

    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_quality_rules(spark, sf_dir):
    from .quality_rules import quality_rules

    return quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_best_fit_packing(spark, sf_dir):
    from .common import materialize
    from .packing import best_fit_pack, token_pieces

    pieces = token_pieces(_documents(spark, sf_dir), _word_bpe(), size=2048, end_id=0)
    pieces = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return best_fit_pack(pieces, 2048)


def op9_token_files(spark, sf_dir):
    import uuid

    from .common import shared_dir
    from .token_files import read_token_files, write_token_files

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(_documents(spark, sf_dir), path, _word_bpe(), end_id=1)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_mixing(spark, sf_dir):
    from .mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_spelling_variants(spark, sf_dir):
    from .spelling_variants import document_words, spelling_variants

    return spelling_variants(document_words(_documents(spark, sf_dir)))


def op12_filter_audit(spark, sf_dir):
    from .filter_audit import filter_audit

    return filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_toxicity(spark, sf_dir):
    from .toxicity import toxicity_scores

    return toxicity_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_sharding, op2_suffix_dedup, op3_ngram_join, op4_token_counts, op5_quality_knn, op6_embedding_dedup, op7_quality_rules,
            op8_best_fit_packing, op9_token_files, op10_mixing, op11_spelling_variants, op12_filter_audit, op13_toxicity,
        )
    }


def oracle_sql() -> dict:
    from .oracles import OP11, OP12

    return {"op11_spelling_variants": OP11, "op12_filter_audit": OP12}
