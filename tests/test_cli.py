import json

import pytest

from kgaudit import cli
from kgaudit.operators import graph
from tests.test_files_and_streams import GRAPH


@pytest.fixture
def registry(tmp_path):
    doc = {"sector_name": "S", "houses": [{"id": f"h{k}", "name": n, "aliases": [], "description": "d"} for k, n in enumerate(["A", "Other", "Third"])], "stations_and_ships": [{"id": x, "name": "B", "type": "t", "owner_id": "h0", "description": "d"} for x in ("s1", "s2")], "hierarchy": [{"parent_id": "h0", "child_id": "s1", "level": 2}, {"parent_id": "h0", "child_id": "h1", "level": 2}], "timeline": [{"event_id": "e", "year": 1, "title": "t", "description": "", "participant_ids": ["h0", "s1"]}]}
    (tmp_path / "gt.json").write_text(json.dumps(doc))
    (tmp_path / "g.graphml").write_text(GRAPH)
    return tmp_path


def test_verify_and_split(spark, registry, capsys):
    out = registry / "report.json"
    assert cli.main(["verify", "--graph", str(registry / "g.graphml"), "--ground-truth", str(registry / "gt.json"), "--json", str(out), "--verbose"]) == 1
    said = capsys.readouterr().out
    assert all(f"\n{block}" in said for block in ("coverage:", "homonym groups:", "entities of several nodes:", "hierarchy:", "two hops:", "timeline:", "narrators:"))
    assert said.startswith("FAIL") and json.loads(out.read_text())["summary"][0]["collapsed"] == 1
    assert cli.main(["split", "--ground-truth", str(registry / "gt.json"), "--registry", str(registry / "r.json"), "--holdout", str(registry / "h.json")]) == 0
    held = json.loads((registry / "h.json").read_text())
    assert {"s1", "s2"} <= set(held["withheld_entity_ids"]) and "timeline" not in held
    assert all(x["child_id"] not in held["withheld_entity_ids"] for x in json.loads((registry / "r.json").read_text())["hierarchy"])


def test_generate_skips_what_is_there(spark, registry, capsys):
    out = registry / "docs"
    args = ["generate", "--ground-truth", str(registry / "gt.json"), "--out-dir", str(out), "--count", "4"]
    assert cli.main(args) == 0
    first = capsys.readouterr().out.splitlines()
    assert len(first) == 5 and first[-1] == "planned: 4"
    out.mkdir()
    (out / first[0].split()[0]).write_text("x")
    assert cli.main(args) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["planned: 3", "skipped: 1"]
    assert cli.main([*args, "--overwrite"]) == 0 and capsys.readouterr().out.splitlines()[-1] == "planned: 4"


def test_disambiguate_is_a_dry_run_unless_told(spark, registry, capsys):
    before = (registry / "g.graphml").read_text()
    (registry / "specs.json").write_text(json.dumps({"norm": "b", "target": "B one", "target_ord": 0, "keywords": ["x"]}) + "\n" + json.dumps({"norm": "b", "target": "B two", "target_ord": 1, "keywords": ["y"]}))
    args = ["disambiguate", "--graph", str(registry / "g.graphml"), "--ground-truth", str(registry / "gt.json"), "--specs", str(registry / "specs.json")]
    assert cli.main(args) == 0 and "homonyms: 1" in capsys.readouterr().out and (registry / "g.graphml").read_text() == before
    assert cli.main([*args, "--output-graph", str(registry / "o.graphml"), "--verbose"]) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ["A", "B one", "B two"]
    assert cli.main([*args, "--in-place"]) == 0
    assert (registry / "g.graphml").read_text() == (registry / "o.graphml").read_text() != before


def test_repl(spark, tmp_path, capsys):
    import argparse

    spark.createDataFrame([(1, "entity", [1.0, 0.0])], "id long, kind string, embedding array<float>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([], "rel_id long, src long, dst long").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query array<float>").write.parquet(str(tmp_path / "q"))
    a = argparse.Namespace(vectors=str(tmp_path / "v"), edges=str(tmp_path / "e"), questions=str(tmp_path / "q"), mode="local", top_k=4)
    assert cli._repl(spark, a, ["7\n", "\n", "exit\n", "7\n"]) == 0
    assert capsys.readouterr().out.count("entity") == 1


def test_pending_gate_and_errors(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("the secret name")
    (tmp_path / "t.txt").write_text("secret name\n")
    assert cli.main(["pending", "--input-dir", str(tmp_path / "d")]) == 0 and "a.md" in capsys.readouterr().out
    assert cli.main(["gate", str(tmp_path / "d"), "--terms", str(tmp_path / "t.txt")]) == 1 and "a.md: secret name" in capsys.readouterr().out
    assert cli.main(["pending", "--input-dir", str(tmp_path / "none")]) == 1


def test_query(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "entity", [1.0, 0.0])], "id long, kind string, embedding array<float>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([], "rel_id long, src long, dst long").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query array<float>").write.parquet(str(tmp_path / "q"))
    assert cli.main(["query", "--vectors", str(tmp_path / "v"), "--edges", str(tmp_path / "e"), "--questions", str(tmp_path / "q"), "--mode", "local"]) == 0
    assert "entity" in capsys.readouterr().out


def test_disambiguation_isnt_undone(spark):
    nodes = spark.createDataFrame([("Lantern", "ship", 0), ("House", "house", 1), ("Old House", "house", 2)], "node_id string, entity_type string, ord long")
    edges = spark.createDataFrame([("House", "Lantern", 1.0, "a harbor", 0), ("Old House", "Lantern", 1.0, "a carrier", 1)], "src string, dst string, weight double, description string, ord long")
    specs = spark.createDataFrame([("lantern", "Lantern Ship", 0, ["carrier"]), ("lantern", "Lantern Station", 1, ["harbor"])], "norm string, target string, target_ord int, keywords array<string>")
    aliases = spark.createDataFrame([("old house", "House"), ("lantern ship", "Lantern")], "norm string, canonical string")
    n, e, totals = graph.disambiguate(nodes, edges, specs, aliases)
    assert {r["node_id"] for r in n.collect()} == {"House", "Lantern Ship", "Lantern Station"}
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("House", "Lantern Station"), ("House", "Lantern Ship"), ("Lantern Ship", "Lantern Station")}
    assert totals.first().asDict() == {"homonyms": 1, "renamed": 1, "nodes": 3, "edges": 3}
