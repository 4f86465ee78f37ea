"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import decontaminate, embeddings, langid, linededup, lmscore, mixing, simhash, tokencount, tokenids, toxicity
from umbra.llm.common import crc32_of_id, shared_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = F.pmod(crc32_of_id("doc_id"), F.lit(3)) == 1
    model = langid.fit(docs.where(~out))
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(_documents(spark, sf_dir))
    return made.rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    tokenids.write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), chars=1 << 22, kept_bytes=160 << 20)
    return tokenids.read_tokens(spark, path)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = F.pmod(crc32_of_id("doc_id"), F.lit(5)) == 0
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out))
    return toxicity.classify(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.spans(_documents(spark, sf_dir))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return lmscore.score(docs, lmscore.fit(docs))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_documents(spark, sf_dir), tokencount.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), words=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: All pairs of a label by cosine, and what each vector reaches over them.
_LINKS = """
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT vec_id FROM (SELECT vec_id, unnest(e) AS x FROM vectors WHERE label IS NOT NULL) AS parts
  GROUP BY vec_id HAVING count(*) = count(x) AND bool_and(isfinite(x)) AND bool_or(x <> 0)
),
good AS (SELECT v.* FROM vectors v JOIN usable u ON v.vec_id = u.vec_id),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reached AS (SELECT vec_id AS node, vec_id AS other FROM vectors UNION SELECT r.node, l.v FROM reached r JOIN links l ON r.other = l.u),
components AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node),
counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT c.node AS vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.node = c.component_id AS kept
FROM components c LEFT JOIN counts n ON c.node = n.u
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_embedding_near_dedup": _LINKS}
