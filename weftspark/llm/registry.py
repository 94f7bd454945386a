"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.alignment import aligned_digest
from weftspark.llm.decontaminate import find_leaks
from weftspark.llm.interpolation import interpolated_scores
from weftspark.llm.media import media_columns, media_digest
from weftspark.llm.parity_join import link_components
from weftspark.llm.periodic_runs import find_runs, planted, run_digest
from weftspark.llm.personal_data import find_personal_data, personal_digest
from weftspark.llm.piece_dropout import encode_pieces, piece_digest
from weftspark.llm.secrets import scan_secrets, secret_digest
from weftspark.llm.simhash_ring import near_duplicates
from weftspark.llm.token_records import record_digest, token_records
from weftspark.llm.toxicity import chain_scores, table_categories, toxic_digest
from weftspark.llm.url_rules import judge_urls, rules_sql


def tokenizer(name: str) -> str:
    """A public vocabulary file: in the folder WEFT_TOKENIZERS, else where the package of these files has it. Looked up when a query is called."""
    if folder := os.environ.get("WEFT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(_docs(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(_docs(spark, sf_dir)))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_digest(token_records(_docs(spark, sf_dir), tokenizer("byte_bpe_50k.json")))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(encode_pieces(_docs(spark, sf_dir), tokenizer("piece_bpe_32k.model")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(media_columns(_docs(spark, sf_dir)))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table_categories(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_digest(chain_scores(_docs(spark, sf_dir), labels))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(find_personal_data(_docs(spark, sf_dir)))


def op10_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(_docs(spark, sf_dir))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_digest(_docs(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return run_digest(find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_parity_join, op2_secrets, op3_decontaminate, op4_token_records, op5_pieces, op6_media, op7_url_rules, op8_toxicity, op9_personal_data, op10_interpolation, op11_simhash, op12_alignment, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_rules": rules_sql()}
