"""The toy graph with hand-computed results."""

import pytest

from kgaudit.operators import entities as en
from kgaudit.operators import verify


@pytest.fixture(scope="module")
def toy(spark):
    e = [
        ("h1", "House Alpha", ["Alpha Crown"], [], [], "house"),
        ("h2", "House Beta", [], [], [], "house"),
        ("c1", "Gamma Works", ["GW"], [], [], "megacorporation"),
        ("p1", "Captain Dora Quill", ["Iron Wren"], ["Keeper of Gamma"], ["Wren Lead"], "person"),
        ("s1", "Lantern", ["GW-Lantern-One"], [], [], "station_or_ship"),
        ("s2", "Lantern", ["Beta Lantern"], [], [], "station_or_ship"),
        ("st1", "Far Harbor Station", [], [], [], "station_or_ship"),
    ]
    entities = spark.createDataFrame(e, "id string, name string, aliases array<string>, titles array<string>, callsigns array<string>, category string")
    nodes = ["House Alpha", "House-Beta", "Gamma Works", "Iron Wren", "Captain Dora Quil", "Lantern", "Beta Lantern", "Loner"]
    edges = [("House Alpha", "House-Beta"), ("House-Beta", "Gamma Works"), ("Gamma Works", "Lantern"), ("House-Beta", "Beta Lantern"), ("Iron Wren", "Lantern")]
    n = spark.createDataFrame([(x, "a.md<SEP>/x/b.md") for x in nodes], "node_id string, file_path string")
    ed = spark.createDataFrame([(a, b, "a.md") for a, b in edges], "src string, dst string, file_path string")
    links = spark.createDataFrame([("h1", "h2", 2), ("h2", "c1", 3), ("c1", "s1", 4), ("h2", "s2", 4), ("s1", "s2", 4), ("h1", "st1", 4)], "parent_id string, child_id string, level int")
    who = [("e1", "h1"), ("e1", "h2"), ("e2", "s1"), ("e2", "s2"), ("e2", "p1"), ("e3", "st1"), ("e4", "c1"), ("e5", "p1")]
    p = spark.createDataFrame(who, "event_id string, entity_id string")
    narrators = spark.createDataFrame([("a.md", "log")], "file string, narrator string")
    return entities, verify.run(entities, links, p, n, ed, narrators)


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_matches(toy):
    got = rows(toy[1].matches, "entity_id", "node_id", "matched_by", "score")
    assert {x for x in got if x[0] == "p1"} == {("p1", "Iron Wren", "alias", 1.0), ("p1", "Captain Dora Quil", "canonical", 0.9)}
    assert {x[:3] for x in got if x[0] == "s2"} == {("s2", "Lantern", "canonical"), ("s2", "Beta Lantern", "alias")}
    assert ("h2", "House-Beta", "canonical", 1.0) in got and not any(x[0] == "st1" for x in got)


def test_coverage_and_homonyms(toy):
    assert toy[1].coverage.first().asDict() == {"total": 7, "found": 6, "missing": 1, "pct": 85.71}
    assert rows(toy[1].missing, "entity_id") == {("st1",)}
    assert rows(toy[1].homonyms, "norm_name", "group_size", "shared", "nodes", "collapsed") == {("lantern", 2, 1, 2, True)}
    assert rows(toy[1].splits, "entity_id", "nodes") == {("p1", 2), ("s2", 2)}


def test_hierarchy(toy):
    h = {(r["parent_id"], r["child_id"]): r for r in toy[1].hierarchy.collect()}
    assert {k: r["hops"] for k, r in h.items()} == {("h1", "h2"): 1, ("h2", "c1"): 1, ("c1", "s1"): 1, ("h2", "s2"): 1, ("s1", "s2"): 3, ("h1", "st1"): None}
    assert verify.hierarchy_summary(toy[1].hierarchy).first().asDict() == {"total": 6, "covered": 5, "direct": 4, "collapsed_pairs": 1, "collapsed_links": 1, "max_level": 4, "pct": 83.33}


def test_multi_hop(toy):
    got = rows(toy[1].multi_hop, "grandparent_id", "parent_id", "child_id", "hops", "reachable")
    assert got == {("h1", "h2", "c1", 2, True), ("h1", "h2", "s2", 2, True), ("h2", "c1", "s1", 2, True), ("c1", "s1", "s2", 1, True)}


def test_degrees_and_timeline(toy):
    assert rows(toy[1].isolated, "node_id") == {("Captain Dora Quil",), ("Loner",)}
    assert rows(toy[1].dead_ends, "node_id") == {("House Alpha",), ("Iron Wren",), ("Beta Lantern",)}
    t = {r["event_id"]: (r["is_covered"], r["counted"]) for r in toy[1].timeline.collect()}
    assert t == {"e1": (True, True), "e2": (True, True), "e3": (False, False), "e4": (False, True), "e5": (False, False)}


def test_summary_and_report(toy):
    s = toy[1].summary.first().asDict()
    assert s == {"entity_pct": 85.71, "collapsed": 1, "separated": 0, "hierarchy_pct": 83.33, "max_level": 4, "multi_hop_pct": 100.0, "timeline_pct": 60.0, "passed": False}
    assert toy[1].text(verbose=True).startswith("FAIL") and '"entity_id": "st1"' in toy[1].to_json()
    assert rows(toy[1].contributions, "narrator", "nodes", "edges") == {("log", 8, 5), ("unknown", 8, 0)}


def test_empty_denominators(spark, toy):
    links = spark.createDataFrame([], "parent_id string, child_id string, level int")
    none = spark.createDataFrame([], "entity_id string, node_id string")
    edges = spark.createDataFrame([], "src string, dst string")
    from kgaudit.operators import graph

    parts = graph.components(edges)
    assert verify.coverage(toy[0].limit(0), none).first()["pct"] == 0.0
    assert verify.multi_hop_summary(verify.multi_hop(links, none, edges, parts)).first()["pct"] == 100.0


def test_split_laws(spark, toy):
    held = en.choose_holdout(toy[0], 0.2)
    ids = {r["id"] for r in held.collect()}
    assert {"s1", "s2"} <= ids and len(ids) == 3
    links = spark.createDataFrame([("h1", "h2"), ("c1", "s1")], "parent_id string, child_id string")
    kept, out, left = en.split(toy[0], held, links)
    assert en.accounted(toy[0], kept, out).first()["complete"]
    assert not rows(left, "parent_id", "child_id") & {("c1", "s1")}
    assert "lantern" not in {r["norm"] for r in en.alias_map(toy[0]).collect()}
