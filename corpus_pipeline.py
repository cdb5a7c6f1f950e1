"""Cleaning a corpus in five stages, each one operator of ``sitescan.llm`` on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescan.llm.bpe import encode_texts
from sitescan.llm.common import columns_of, free_name, table
from sitescan.llm.decontamination import decontaminate
from sitescan.llm.edited_copies import deduplicate_copies
from sitescan.llm.personal_data import redact
from sitescan.llm.queries import TOKENIZER
from sitescan.llm.toxicity import fit_toxicity, score_toxicity
from sitescan.session import drop_path, scratch, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labelled ones among them, calls toxic go."""
    chain = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, chain)
    predicted = scored.columns[len(docs.columns) + 1]
    return scored.where(F.col(f"`{predicted}`") == 0).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, edited copies included, the document with the smallest id stays."""
    return deduplicate_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; ``n_chars``, where there is one, is counted anew."""
    made = redact(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the digest of the decoded text."""
    made = encode_texts(docs, TOKENIZER)
    ids, decoded = made.columns[-2:]
    return made.select(
        *columns_of(docs), F.col(f"`{ids}`"), F.size(f"`{ids}`").cast("long").alias(free_name(docs, "n_tokens")),
        F.sha2(F.col(f"`{decoded}`"), 256).alias(free_name(docs, "decoded_sha256")),
    )


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data), ("bpe", encode),
]
#: Hashes, model and tokenizer are beyond SQL; the tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written in the shared folder and read again.

    The inner tables of a stage go when its rows are written, and so do the rows of the stage before.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch(spark, f"{name}-inner"):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
