"""Incremental ingestion: a ledger of content hashes, batches, status counts, storage inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.operators.order import numbered


def pending(docs: DataFrame, ledger: DataFrame, limit: int | None = None, force: bool = False) -> DataFrame:
    """path, text, sha of documents that the ledger (path, sha) doesn't have in this form; the first by path if there
    is a limit. With force all are pending."""
    if limit is not None:
        docs = docs.orderBy("path").limit(limit)
    docs = docs.select("path", "text", F.sha2("text", 256).alias("sha"))
    return docs if force else docs.join(ledger.select("path", "sha"), ["path", "sha"], "left_anti")


def batches(docs: DataFrame, size: int = 10) -> DataFrame:
    """With batch: numbers of batches in the order of paths."""
    return numbered(docs, ["path"], "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def commit(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger after documents were ingested: new hashes replace old ones, other files stay."""
    return ledger.join(done.select("path"), "path", "left_anti").select("path", "sha").unionByName(done.select("path", "sha"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """status, n, final from rows with a status: counted in lower case; `processed` is final."""
    return statuses.groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("n")).withColumn("final", F.col("status") == "processed")


def inventory(files: DataFrame) -> DataFrame:
    """files, bytes of non-empty files (length)."""
    return files.filter("length > 0").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
