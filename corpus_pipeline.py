"""Corpus pipeline: toxic documents out, near duplicates out, leaked benchmark items out, secrets masked, encoded.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each result as Parquet
to the shared folder and hands it to the next stage. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.llm import bpe, decontaminate, neardup, secrets, toxicity
from prequenta.llm.common import drop_written, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = {c: f"_kept_{c}" for c in ("score", "predicted") if c in docs.columns}
    scored = toxicity.score(docs.withColumnsRenamed(names), model)
    return scored.where("predicted = 0").drop("score", "predicted").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return neardup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; ``n_chars`` follows the text."""
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return masked.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the ids and the decoded text as digests."""
    return bpe.encode_digests(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: A fitted classifier, sketches and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return docs
