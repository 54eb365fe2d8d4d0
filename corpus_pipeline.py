"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before
it kept, and returns the columns of ``docs`` but for the last, which adds its
own. Null and empty texts, very long ones, repeated rows and ids, ties, empty
tables and further columns of any name go through every stage as its docstring
says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import langid, mixing, pii, simhash, spiece
from assayer.llm.common import drop_kept, kept, table
from assayer.llm.registry import model_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), or between two languages' codewords, go.

    Whole texts count, however long. Repeated rows are judged alike, each by
    itself; a null id plays no part. Where no document has a language, none is
    known and all go. An empty table stays empty.
    """
    return langid.accepted(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays, once if its row repeats.

    Null and empty texts count as near copies of one another; rows with a null
    id all stay, as nothing tells which document they are. Different texts
    under one id are documents of their own, each in the component of its text;
    ties go to the smallest hash of the text. An empty table stays empty.
    """
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones too; personal data in its text becomes its kind in brackets.

    Null and empty texts stay as they are, long ones are read whole. Where
    spans overlap, the one that starts first, and of these the first kind,
    stands. An empty table stays empty.
    """
    return pii.mask(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own.

    Null texts and texts without words, of which nothing is taken, go. The
    order of taking is by a hash of the id, ties and null ids by size; repeated
    rows are documents of their own. An empty table stays empty.
    """
    return mixing.repeat(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, and the digest of what they decode to; null texts count as empty ones.

    Rows stay one for one, repeated ones and those with a null id too, and
    texts are encoded whole. An empty table stays empty.
    """
    return spiece.encode(docs, model_file())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_tokens),
]

#: Fingerprints, models and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared checkpoint folder.

    A stage's folder goes when the next one is written, the last one's when the
    application ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, f"pipeline-{k}-{name}")
            if before is not None:
                drop_kept(before)
            before = docs
    return docs
