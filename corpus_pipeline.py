"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, BPE.

Each stage reads all that the one before kept, as Parquet, and its decisions take effect:
toxic documents go; of equal texts one stays; of each group of near copies one stays; the
mixture takes documents to the target weights, a row for each epoch; the rest is encoded.
The stages before the last return the columns of documents, so a document that the mixture takes in two epochs is two equal rows.

Defined cases: documents with a null or empty text pass toxicity; null texts are no copies of each other, empty ones are; rows without an
id are kept by near dedup; among equal ids and texts one row stays; the mixture takes texts without a token while their leaf's share isn't
full; a null text has null tokens. Without labels of both classes no document is toxic. Very long texts are processed whole. Empty tables
give empty tables. Other columns pass through to the last stage, whatever their names but "_mx_epoch" and "_mx_tokens". Ids must be integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.bpe_chunks import encode_documents
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.mixing import mix_sources
from tickloom.llm.shared import columns, discard, materialise
from tickloom.llm.simhash_dedup import near_dedup
from tickloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(*columns(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources", mixing), ("BPE encoding", bpe)]

#: SQL can't express toxicity, near-dedup and BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again as the next one's."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
            if last is not None:  # the stage's rows are written, so what it read isn't needed any more
                discard(last)
            last = docs
    return docs
