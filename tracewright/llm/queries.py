"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, packing, pii, quality, rangejoin, sharding, simhash, toxicity, urlfilter, vptree
from tracewright.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(documents(spark, sf_dir)))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_rangejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.link(documents(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(documents(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, quality.grades(documents(spark, sf_dir, "labels")))
    out = quality.rate(docs.select("doc_id", "text"), model, grade=1)
    kept = (F.col("tail_probability") >= 0.5).alias("kept")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", kept)


def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, factor=1.1)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_toxicity": op2_toxicity,
        "op3_bpe": op3_bpe,
        "op4_sharding": op4_sharding,
        "op5_rangejoin": op5_rangejoin,
        "op6_pii": op6_pii,
        "op7_urls": op7_urls,
        "op8_quality": op8_quality,
        "op9_vptree": op9_vptree,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_urls": urlfilter.ORACLE}
