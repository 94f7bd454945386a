"""A training-corpus pipeline over ``documents``: toxicity, near duplicates, decontamination, personal data, token pieces.

Each stage takes all rows of the one before and all but the last give back the same
columns, clashing names and further ones included. Null and empty texts and null
doc_ids pass every filter; repeated rows are one document for near duplicates (all or
none of them stay) and are kept or dropped alike by the others; ties are broken by the
smallest doc_id; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.decontaminate import drop_leaks
from weftspark.llm.parity_join import BROADCAST_IDS, link_components
from weftspark.llm.personal_data import redact
from weftspark.llm.piece_dropout import encode_pieces, piece_digest
from weftspark.llm.registry import tokenizer
from weftspark.llm.shared import broadcast_if_small, written
from weftspark.llm.toxicity import drop_toxic, table_categories


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; without labels none does."""
    return drop_toxic(docs, table_categories(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; texts without words and null ids are in no group."""
    linked = link_components(docs.select("doc_id", "text"))
    gone = written(linked.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, gone.count(), BROADCAST_IDS), "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its allowed edits, go; an empty benchmark drops none."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and n_chars, where there is such a column, follows; null texts stay null."""
    masked = redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def token_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts and checksums of the encoded texts, one row a document."""
    return piece_digest(encode_pieces(docs, tokenizer("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", token_pieces),
]

#: The stages are trained, iterative or tokenizing steps that SQL cannot express; tests check each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
