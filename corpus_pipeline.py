"""From documents to token ids: quality, near duplicates, mixture, tokens. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.bpe import encode_documents, vocabulary_path
from recordloom.llm.cotrain import keep_good
from recordloom.llm.mixing import mixed_documents
from recordloom.llm.near_dup import keep_representatives
from recordloom.llm.rules import fit_rules, keep_by_rules
from recordloom.llm.tables import table
from recordloom.session import scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers of text and metadata score below one half go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counted rules or the n-gram classifier, which is fitted on the labelled ones of the whole table, go."""
    return keep_by_rules(docs, fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five words a shingle, similarity 0.8 or more."""
    return keep_representatives(docs, shingle=5, percent=80)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy (little-endian unsigned 32-bit), and whether they decode to the text."""
    encoded = encode_documents(docs, *vocabulary_path(), ["doc_id", "text"])
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_to_weights", mix_to_weights),
    ("byte_bpe", byte_bpe),
]

#: Fitted models, hashes of a shuffle and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
