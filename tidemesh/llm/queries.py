"""The operators applied to their whole tables with production parameters, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, fill_middle, jaccard, langid, lexical_search, license_scan, line_dedup, mixing, quality, token_counts, url_filter, warc
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return done.select("doc_id", "removed_chunks", "removed_lines", "text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(url_filter.labelled_rows(), "url string, blocked int")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(labelled_urls(spark)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("languages").cast("long").alias("n_languages"))


def edits_of(docs: DataFrame) -> DataFrame:
    """Three edits of every document: its first word doubled, its middle replaced by a date, its last tenth removed."""
    n = F.length(F.coalesce("text", F.lit("")))
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\S*\s*", 0)
    edit = lambda k, start, end, new: F.struct(F.lit(k).cast("long").alias("seq"), start.cast("long").alias("start"), end.cast("long").alias("end"), new.alias("replacement"))
    middle = F.floor(n / 2)
    edits = F.array(edit(1, F.lit(0), F.lit(0), first), edit(2, middle, middle + F.floor(n / 100), F.lit(" on 2024-01-31, it's ")), edit(3, n - F.floor(n / 10), n + F.length(first) + 40, F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.alias("edits"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.applied(rows, public_tokenizers.path("byte_bpe_50k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near(table(spark, sf_dir, "embeddings"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents"))))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_bpe, op2_license, op3_line_dedup, op4_quality, op5_mixing, op6_url_filter, op7_langid, op8_token_counts, op9_embedding_dedup, op10_jaccard, op11_fill_middle, op12_warc,
    op13_lexical_search,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {"op5_mixing": mixing.ORACLE, "op11_fill_middle": fill_middle.ORACLE, "op12_warc": warc.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
