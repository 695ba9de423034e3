"""A corpus from raw documents to tokens: five stages, each one operator on all that the stage before it kept.

toxicity    documents that the classifier rejects go
line_dedup  lines that match an earlier line of the corpus go; documents stay, if need be with an empty text
ngram_join  of documents whose word n-grams are alike, the one with the least id stays
mixing      documents are taken as often as their source's target weight asks for, up to three times
bpe         texts are encoded and decoded; a row for each document that is in the mix

All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from kgaudit.session import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup.dedup(docs.withColumnsRenamed(own)).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("bpe", tokenise)]

#: The classifier and the tokens have no SQL form; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
