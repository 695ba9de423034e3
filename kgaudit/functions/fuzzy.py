"""Fuzzy name matching: exact matching-block ratio, a match rule, and a lossless blocked join."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgaudit.functions.text import normalize

THRESHOLD = 0.82
_CONTAINED = 0.7


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts. Not symmetric: the order of arguments counts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal, else the ratio."""
    empty = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    return F.when(empty, 0.0).when(a == b, 1.0).otherwise(ratio(a, b))


def length_bound(threshold: float = THRESHOLD) -> float:
    """The least quotient of lengths that a match can have: 2 min / (min + max) bounds the ratio, and the containment
    rule asks for a quotient of its own."""
    return min(threshold / (2 - threshold), _CONTAINED)


def least_for_pairs(threshold: float = THRESHOLD) -> int:
    """Length from which two texts that match surely share two signs in a row. Of s signs in both, a match has blocks of
    t s / 2 signs in all and at most (1 - t) s / 2 + 1 blocks; were all of one sign, s would be 2 / (2 t - 1) at most. A
    contained text of six signs or more shares them anyway."""
    return 1 << 30 if threshold <= 0.5 else max(2, int(1 / (2 * threshold - 1)) + 1)


def _two_signs(name: str) -> Column:
    """The distinct pairs of signs that follow one another in a text of two signs or more."""
    c = F.col(name)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2))))


def _contained(node: Column, name: Column) -> Column:
    n, m = F.length(node), F.length(name)
    inside = ((m >= 6) & F.contains(node, name)) | ((n >= 6) & F.contains(name, node))
    return inside & (F.least(n, m) / F.greatest(n, m) >= _CONTAINED)


def _signs(col: Column) -> Column:
    """Signs of a text, each with its count so far, so that set intersection counts like a multiset's."""
    s = F.filter(F.split(col, ""), lambda x: x != "")
    return F.transform(s, lambda x, i: F.concat(x, F.size(F.filter(F.slice(s, 1, i + 1), lambda y: y == x)).cast("string")))


def match(names: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """entity_id, node_id, matched_by, matched_name, score: the best matching name of an entity for each node.

    names: entity_id, name, matched_by, name_ord. nodes: node_id. Both are normalised and compared as distinct texts.
    Equal texts meet by an equi-join. For the others a text meets only texts whose length lies within the bound and with
    which it shares two signs that follow one another, by an equi-join on both, so no length is a hot key; a multiset
    bound on the signs follows, and the ratio is computed for what is left."""
    left = names.withColumn("name_norm", normalize("name")).filter("name_norm <> ''")
    right = nodes.select("node_id", normalize("node_id").alias("node_norm")).filter("node_norm <> ''")
    low = length_bound(threshold)
    a = left.select("name_norm").distinct().withColumn("n", F.length("name_norm"))
    a = a.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * low - 1e-9).cast("int"), F.floor(F.col("n") / low + 1e-9).cast("int"))))
    b = right.select("node_norm").distinct().withColumn("m", F.length("node_norm"))
    long = least_for_pairs(threshold)
    two = F.when((F.col("n") >= long) & (F.col("m") >= long), _two_signs("name_norm")).otherwise(F.array(F.lit("")))
    a = a.withColumn("two", F.explode(two))
    also = b.withColumn("two", F.explode(F.array_append(_two_signs("node_norm"), "")))
    pairs = a.join(also, ["m", "two"]).filter("name_norm <> node_norm").drop("two").distinct()
    most = 2.0 * F.size(F.array_intersect(_signs(F.col("node_norm")), _signs(F.col("name_norm")))) / (F.col("n") + F.col("m"))
    contained = _contained(F.col("node_norm"), F.col("name_norm"))
    pairs = pairs.withColumn("contained", contained).filter(F.col("contained") | (most >= threshold - 1e-12))
    scored = pairs.withColumn("score", F.when(F.col("contained"), 0.9).otherwise(ratio("node_norm", "name_norm"))).filter(F.col("contained") | (F.col("score") >= threshold))
    equal = left.select("name_norm").distinct().join(b.select("node_norm"), F.col("name_norm") == F.col("node_norm")).withColumn("score", F.lit(1.0))
    both = scored.select("name_norm", "node_norm", "score").unionByName(equal.select("name_norm", "node_norm", "score"))
    found = left.join(both, "name_norm").join(right, "node_norm")
    best = Window.partitionBy("entity_id", "node_id").orderBy(F.desc("score"), "name_ord")
    return found.withColumn("at", F.row_number().over(best)).filter("at = 1").select("entity_id", "node_id", "matched_by", F.col("name").alias("matched_name"), "score")
