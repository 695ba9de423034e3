from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgaudit.functions import fuzzy


def rule(node, name, threshold=fuzzy.THRESHOLD):
    """The match rule in plain Python, for texts that are normalised."""
    if not node or not name:
        return None
    if node == name:
        return 1.0
    inside = len(name) >= 6 and name in node or len(node) >= 6 and node in name
    if inside and min(len(node), len(name)) / max(len(node), len(name)) >= 0.7:
        return 0.9
    r = SequenceMatcher(None, node, name).ratio()
    return r if r >= threshold else None


def matched(spark, names, nodes, threshold=fuzzy.THRESHOLD):
    a = spark.createDataFrame([(n, n, "canonical", 0) for n in names], "entity_id string, name string, matched_by string, name_ord int")
    b = spark.createDataFrame([(n,) for n in nodes], "node_id string")
    return {(r["entity_id"], r["node_id"]): r["score"] for r in fuzzy.match(a, b, threshold).collect()}


def test_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.ratio("a", "b")).collect()] == [0.25, 0.5]
    assert [r[0] for r in df.select(fuzzy.similarity(F.col("a"), F.lit(""))).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("node,name,want", [("Vanguard-2", "Vanguard", 0.9), ("Aurilia-Prime", "Aurelia-Prime", 0.9231), ("Cassandra Aurelius", "Empress Cassandria Aurelius", None), ("Vanguard Prime", "Vanguard", None), ("Aurelia Prime Flagship", "Aurelia-Prime", None)])
def test_match_rule(spark, node, name, want):
    got = matched(spark, [name], [node]).get((name, node))
    assert got is None if want is None else round(got, 4) == want


word = st.text("abcd ", min_size=1, max_size=12).map(lambda s: " ".join(s.split())).filter(bool)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(word, min_size=1, max_size=25, unique=True), st.lists(word, min_size=1, max_size=25, unique=True), st.sampled_from([0.6, 0.82, 0.95]))
def test_blocking_loses_no_match(spark, names, nodes, threshold):
    want = {(a, b): s for a in names for b in nodes if (s := rule(b, a, threshold)) is not None}
    got = matched(spark, names, nodes, threshold)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
