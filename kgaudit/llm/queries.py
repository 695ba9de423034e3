"""The registered queries of this subpackage: each applies one operator, with its production parameters, to its whole
table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgaudit.llm import ann, bpe, fingerprints, line_dedup, mixing, ngram_join, pii, secrets, toxicity, warc
from kgaudit.session import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("text_key", "component")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the owner, the document for the repository."""
    return secrets.scan(table(spark, sf_dir, "documents")).withColumnsRenamed({"most_owners": "most_sources", "most_repos": "most_documents"})


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii": op1_pii, "op4_line_dedup": op4_line_dedup, "op5_bpe": op5_bpe, "op6_secrets": op6_secrets, "op2_ngram_join": op2_ngram_join, "op3_warc": op3_warc, "op7_ann": op7_ann, "op8_fingerprints": op8_fingerprints, "op9_mixing": op9_mixing, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op4_line_dedup": line_dedup.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
