"""Corpus planning: shares of narrators, seeded plans, slices of the reference for each document."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgaudit.functions.text import document_name, percent

#: Narrators and their shares; the last takes what is left.
SHARES = (("encyclopedia", 0.30), ("dossier", 0.25), ("propaganda", 0.25), ("log", 0.20))


def allocate(shares: DataFrame, count: Column) -> DataFrame:
    """key, planned from shares (key, share, ord): rounded half to even, the last one takes what is left."""
    last = F.col("ord") == F.max("ord").over(Window.partitionBy())
    part = F.bround(count * F.col("share")).cast("long")
    others = F.sum(F.when(last, 0).otherwise(part)).over(Window.partitionBy())
    return shares.select("key", F.when(last, count - others).otherwise(part).cast("long").alias("planned"))


def distribution(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """narrator, n, pct; of the known narrators alone, if they are given, then with those that have none."""
    per = documents.groupBy("narrator").agg(F.count("*").alias("n"))
    if known is not None:
        per = known.select("narrator").join(per, "narrator", "left").select("narrator", F.coalesce("n", F.lit(0)).alias("n"))
    return per.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def plan(spark: SparkSession, entities: list[tuple[str, str]], events: list[tuple[str, list[str]]], count: int = 24, seed: int = 42) -> DataFrame:
    """doc_num, narrator, subject_entity_ids, source_event_ids, filename: a document for each turn of a seeded
    generator. entities: (id, name); events: (id, participants)."""
    rng = random.Random(seed)
    left, narrators = count, []
    for i, (name, share) in enumerate(SHARES):
        n = left if i == len(SHARES) - 1 else min(left, round(count * share))
        narrators += [name] * n
        left -= n
    rng.shuffle(narrators)
    ids, rows = [i for i, _ in entities], []
    for k, narrator in enumerate(narrators, 1):
        if not ids:
            break
        focal = rng.choice(ids)
        own = [e for e, who in events if focal in who]
        chosen = sorted(rng.sample(own, min(len(own), 2)))
        others = sorted({p for e, who in events if e in chosen for p in who} - {focal})
        rows.append((k, narrator, focal, sorted({focal, *rng.sample(others, min(len(others), 2))}), chosen))
    made = spark.createDataFrame(rows, "doc_num int, narrator string, focal string, subject_entity_ids array<string>, source_event_ids array<string>")
    named = made.join(spark.createDataFrame(entities, "id string, name string"), F.col("focal") == F.col("id"))
    return named.select("doc_num", "narrator", "subject_entity_ids", "source_event_ids", document_name("doc_num", "narrator", "name").alias("filename"))


def plan_by_hash(entities: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """id, doc_num: subjects by hash order, for plans of any size."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")), 256)
    return entities.select("id", key.alias("k")).orderBy("k", "id").limit(count).withColumn("doc_num", F.row_number().over(Window.orderBy("k", "id"))).select("id", "doc_num")


def slices(plan_rows: DataFrame, entities: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """doc_num with arrays of the entities, events and hierarchy links that a document is about."""
    subject = plan_rows.select("doc_num", F.explode("subject_entity_ids").alias("id"))
    e = subject.join(entities, "id").groupBy("doc_num").agg(F.sort_array(F.collect_list("id")).alias("entities"))
    v = plan_rows.select("doc_num", F.explode("source_event_ids").alias("event_id")).join(events.select("event_id"), "event_id").groupBy("doc_num").agg(F.sort_array(F.collect_list("event_id")).alias("events"))
    ends = lambda c: subject.join(links, F.col("id") == F.col(c)).select("doc_num", "parent_id", "child_id")
    h = ends("parent_id").union(ends("child_id")).distinct().groupBy("doc_num").agg(F.sort_array(F.collect_list(F.struct("parent_id", "child_id"))).alias("hierarchy_links"))
    return plan_rows.select("doc_num").join(e, "doc_num", "left").join(v, "doc_num", "left").join(h, "doc_num", "left")


def chosen_events(events: DataFrame, focal: DataFrame) -> DataFrame:
    """doc_num, event_id: the events (event_id, participant_ids) that a document's focal entity (doc_num, focal) took
    part in."""
    return focal.join(events.select("event_id", F.explode("participant_ids").alias("focal")).distinct(), "focal").select("doc_num", "event_id")


def missing_targets(plan_rows: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Planned documents whose file isn't there yet; tested before anything costly is done."""
    return plan_rows if overwrite else plan_rows.join(existing.select("filename"), "filename", "left_anti")


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))
