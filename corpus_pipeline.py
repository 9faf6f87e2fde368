"""A training-corpus pipeline: each stage works on all documents its predecessor kept.

All stages but the last return the columns of their input, whatever their names; none drops a row because its id is
null or repeated.  Texts are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm import bpe, jaccard, langid, line_dedup, mixing
from tidemesh.llm.common import saved, unused


def _id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7.  Rows whose text is null or has no letter, or all where no row has a `lang` to learn from, go; mixtures
    of learned languages stay.  Null and repeated ids are judged like others."""
    docs = _id(docs)
    return langid.spoken(docs, langid.train(docs.where(~langid.held_out())))


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3.  Repeated passages are cut from the texts, and n_chars follows; a document of which nothing is left
    goes.  Rows with a null id, and null and empty texts, stay as they are; rows of one id are one document."""
    names = unused(docs.columns, "removed_chunks"), unused(docs.columns, "removed_lines")
    done = line_dedup.dedup(docs, counts=names)
    kept = done.where((F.col(names[0]) == 0) | (F.col("text") != "")).drop(*names)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10.  Of each group of similar documents the one with the smallest id stays; of rows alike in id and text
    one.  Rows with a null id, and texts without words, stay."""
    return jaccard.dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5.  Rows stand as often as the mix takes them, at most three times; a null source is one of its own, and
    rows without words come with the complete epochs of their source."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1.  (doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row; a null text has no tokens."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(encoded, "ids")


STAGES = [("language_id", language_id), ("line_chunks", line_chunks), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("token_ids", token_ids)]

#: Language inference and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
