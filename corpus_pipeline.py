"""From raw documents to encoded ones: five stages, each one operator over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents; the last returns doc_id, the ids of the text, their number, and
the text decoded from them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import decontaminate, pieces, secrets, simhash, toxicity
from glossa.llm.common import clip_columns, spare, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that aren't held out."""
    model = toxicity.train(spark, clip_columns(docs, "doc_id", "text"), clip_columns(table(spark, sf_dir, "labels"), "doc_id", "toxic"))
    out = spare(docs, "_toxic")
    return toxicity.score(spark, docs, model, out).where(F.col(out) < toxicity.THRESHOLD).drop(out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.near_dedup(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(spark, docs, clip_columns(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text."""
    redacted = secrets.redact(spark, docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return redacted.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, and the texts that they decode to."""
    encoded = pieces.encode(spark, clip_columns(docs, "doc_id", "text"), back="decoded")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

#: A trained classifier and a byte-pair encoder have no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), name)
    return docs
