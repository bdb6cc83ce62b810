"""From raw documents to packed training sequences, in five stages; each is written as Parquet before the next.

A stage reads ``doc_id`` and ``text``; all but the last return the columns that they got, in their order, whatever else
they are named. Defined results of all stages: null text counts as empty; a null doc_id is kept; every row of a repeated
document is treated alike, so it stays or goes with the others until near_dedup keeps one; texts are taken whole however
long they are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import neartext, packing, pii, quality, toxicity
from tracewright.llm.common import documents, give_back, materialize


def set_aside(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``: other columns in one, so that none has the name of one that an operator makes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("__none")).alias("row"))


def brought_back(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Empty text has the score of the bias; it stays unless most text is
    toxic. Ties at 0.5 go. Without labels all stay."""
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    give_back(spark)
    return brought_back(toxicity.score(set_aside(docs), model).where("score < 0.5"), docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely of the lowest grade than of a higher one go. Ties at 0.5 stay, and without ratings
    all do."""
    model = quality.train(docs, quality.grades(documents(spark, sf_dir, "labels")))
    give_back(spark)
    return brought_back(quality.rate(set_aside(docs), model, grade=1).where("tail_probability >= 0.5"), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document of the least id stays, of equal rows one. Texts without words
    are copies of each other; a null id stays only where its group has no other."""
    return brought_back(neartext.deduplicate(set_aside(docs)), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind; n_chars, where there is one, follows the text. Null text stays."""
    give_back(spark)
    out = pii.find(set_aside(docs)).withColumn("text", pii.masked())
    found = F.size("spans") > 0
    out = brought_back(out.withColumn("row", F.struct("row.*", found.alias("__found"))), [*docs.columns, "__found"])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__found"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("__found")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids; an empty text is its end id."""
    give_back(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The stages train models, tokenize and follow links: SQL can't express them. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
