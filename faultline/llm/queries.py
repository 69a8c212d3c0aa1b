"""The queries op1_ to op10_ and pipeline, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embedding, language_id, lm_score, oracles, simhash, toxicity, url_filter, warc

#: The rules of op1.
RULES = tuple(url_filter.Rule(v, h, p) for v, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), "toxic", ~out)
    return toxicity.score(docs, model, ["doc_id", out.alias("held_out")])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = language_id.train(docs, ~out)
    return language_id.identify(docs, model, ["doc_id", out.alias("held_out")])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, role in enumerate(("user", "assistant"))))).alias("t")).select("t.*")
    return chat.digest(chat.windows(conversations.unionByName(more)))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", ["doc_id"])


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_language_id, op4_simhash, op5_decontamination, op6_warc, op7_chat, op8_lm_score, op9_embedding, op10_bpe)}
ORACLES: dict[str, str] = {
    "op1_url_filter": oracles.url_sql(RULES, url_filter.Vocabulary()),
    "op5_decontamination": oracles.DECONTAMINATION,
    "op6_warc": oracles.WARC,
    "op7_chat": oracles.chat_sql(chat.ChatParams()),
    "op9_embedding": oracles.EMBEDDING,
}
