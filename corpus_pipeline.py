"""The corpus pipeline: from raw documents to token ids, in stages that are each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halfstar.llm import exact_dedup, jaccard, kneser_ney, mixing, pieces
from halfstar.session import scratch_base

MODEL = "piece_bpe_32k.model"


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go; its model is trained on the labelled documents of ``docs``."""
    return kneser_ney.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents equal but for white space, the longest stays."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more, the one with the least id stays."""
    return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The token ids of every document of the mix."""
    import public_tokenizers  # the other stages work without it

    encoded = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(MODEL))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("piece encoding", tokenised),
]

# Texts are scored and tokenised, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes Parquet to the shared scratch folder for the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base = f"{scratch_base(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{base}/{place}")
        docs = spark.read.parquet(f"{base}/{place}")
    return docs
