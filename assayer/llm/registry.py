"""The queries of the corpus operators, by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import imi, importance, kdtopk, langid, mixing, negatives, packing, pii, simhash, sitetree, spiece, substr, toxicity
from .common import table

#: The SentencePiece model that op5 and the pipeline encode with.
PIECE_MODEL = "piece_bpe_32k.model"
#: The tokenizer whose ids op13 packs.
WORD_MODEL = "word_bpe_49k.json"


def model_file(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtopk.top_k(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digests(table(spark, sf_dir, "documents"), model_file())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.remove_repeats(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), model_file(WORD_MODEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_exact_top_k,
        op3_pii,
        op4_toxicity,
        op5_sentencepiece,
        op6_language_id,
        op7_simhash_near_dedup,
        op8_html_extraction,
        op9_mix_sources,
        op10_substring_dedup,
        op11_hard_negatives,
        op12_importance_resampling,
        op13_packing,
    )
}

#: The other operators train models, hash with XXH64 or CRC-32, or search token tables.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": imi.ORACLE_SQL,
    "op2_exact_top_k": kdtopk.ORACLE_SQL,
    "op9_mix_sources": mixing.ORACLE_SQL,
    "op10_substring_dedup": substr.ORACLE_SQL,
    "op11_hard_negatives": negatives.ORACLE_SQL,
}
