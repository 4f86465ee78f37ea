"""From documents to token ids: language, near-duplicates, benchmark leaks, mixing of sources, token-ID output."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import decontaminate, langid, mixing, simhash, tokenids
from umbra.llm.common import crc32_of_id, materialize, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that rows with crc32(id) mod 3 other than 1 teach; those without a letter or a likely language go,
    null and empty texts among them. Repeated rows stay; an empty table stays empty."""
    model = langid.fit(docs.where(F.pmod(crc32_of_id("doc_id"), F.lit(3)) != 1))
    return langid.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: five-word shingles with a similarity of 0.8 or more.

    Texts without a word are one group. Of rows that repeat an id all go or all stay; rows without an id stay; an empty table stays empty."""
    return simhash.keep_one_of_each(docs, similarity=0.8)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts hold none; without items all documents stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and time that the mix of sources takes it, its text the words taken that time.

    Null texts and texts without a word are never taken; rows that repeat an id are taken each for itself; an empty table stays empty."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files of all documents, read back: a row per document. Null texts count as empty and have the end id alone; an empty table
    gives no rows."""
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    tokenids.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenids.read_tokens(spark, path)


STAGES = [("language", language), ("near_dedup", near_dedup), ("without_leaks", without_leaks), ("mix", mix), ("token_ids", token_ids)]

#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another from the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
