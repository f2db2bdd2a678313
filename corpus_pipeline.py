"""Corpus pipeline over ``documents``: toxic documents go, one document of each near-duplicate group
stays, personal data is masked, sources are mixed to their target weights, and what is left is
encoded and decoded again. Every stage is written as Parquet in the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import bpe, mixing, pii, simhash, toxicity
from flowsieve.llm.common import documents, stored

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it learns from the labelled ones of ``docs``."""
    return toxicity.reject(docs, toxicity.trained(docs, documents(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-equal fingerprints stays."""
    return simhash.keep_one(docs, words=4, max_distance=4)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are masked; n_chars follows the text."""
    return pii.sanitise(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts, the tokenizer's decoded form of them, and the number of ids."""
    import public_tokenizers

    tokens = bpe.encode_documents(docs.select("doc_id", "text", "lang", "source", "n_chars"), public_tokenizers.path(TOKENIZER), decoded=True)
    return tokens.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("pii", mask_personal_data),
          ("mixing", mix_to_weights), ("bpe", encode)]

# Fitted classifiers, randomised rounding and token merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
