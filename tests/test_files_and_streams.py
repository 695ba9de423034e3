import json

from kgaudit.functions import text as tx
from kgaudit.sources import files
from kgaudit.streaming import ingest

GRAPH = """<?xml version='1.0' encoding='utf-8'?>
<graphml><key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d1" for="edge" attr.name="weight" attr.type="double"/>
<graph edgedefault="undirected"><node id="B"><data key="d0">ship</data></node><node id="A"/><edge source="B" target="A"><data key="d1">2.5</data></edge></graph></graphml>"""


def test_graph_round_trip(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH)
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.graphml"))
    assert {(r["node_id"], r["entity_type"]) for r in nodes.collect()} == {("B", "ship"), ("A", None)}
    assert [(r["src"], r["dst"], r["weight"]) for r in edges.collect()] == [("A", "B", 2.5)]
    files.write_graph(nodes, edges, str(tmp_path / "out"))
    again, _ = files.read_graph(spark, str(tmp_path / "out" / "nodes"))
    assert {(r["node_id"], r["entity_type"]) for r in again.collect()} == {("B", "ship"), ("A", None)}


def test_graphml_round_trip_in_place(spark, tmp_path):
    path = str(tmp_path / "g.graphml")
    nodes = spark.createDataFrame([("A & B", "ship", None), ('C "q"', None, "x<y")], "node_id string, entity_type string, description string")
    edges = spark.createDataFrame([("A & B", 'C "q"', 2.5, "d")], "src string, dst string, weight double, description string")
    assert files.write_graphml(nodes, edges, path, dry_run=True) == {"nodes": 2, "edges": 1} and not (tmp_path / "g.graphml").exists()
    for _ in range(2):  # the second time over itself
        assert files.write_graphml(nodes, edges, path) == {"nodes": 2, "edges": 1}
        n, e = files.read_graph(spark, path)
        assert {(r["node_id"], r["entity_type"], r["description"]) for r in n.collect()} == {("A & B", "ship", None), ('C "q"', None, "x<y")}
        assert [(r["src"], r["dst"], r["weight"], r["description"]) for r in e.collect()] == [("A & B", 'C "q"', 2.5, "d")]
    assert [x.name for x in tmp_path.iterdir()] == ["g.graphml"]


def test_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# keys\nexport KG_A='one'\nKG_B = two\nplain\n")
    monkeypatch.setenv("KG_B", "three")
    assert files.settings(spark, str(tmp_path / "env")) == {"KG_A": "one", "KG_B": "three"}


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    from kgaudit.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            self.path = value

    class Session:
        conf = Conf()

    for master, ok in (("local[2]", True), ("local", True), ("spark://h:7077", False), ("local-cluster[3,2,1000]", False), ("yarn", False)):
        Session.sparkContext = type("Context", (), {"master": master})
        if ok:
            assert shared_dir(Session).startswith("file://")
        else:
            with pytest.raises(RuntimeError):
                shared_dir(Session)


def test_registry(spark, tmp_path):
    doc = {"sector_name": "S", "houses": [{"id": "h", "name": "H", "aliases": ["x"], "description": "d"}], "stations_and_ships": [{"id": "s", "name": "N", "type": "t", "owner_id": "h", "description": "d"}], "hierarchy": [{"parent_id": "h", "child_id": "s"}], "timeline": [{"event_id": "e", "year": 1, "title": "t", "description": "", "participant_ids": ["h", "s"]}]}
    files.write_json(doc, str(tmp_path / "r.json"))
    r = files.read_registry(spark, str(tmp_path / "r.json"))
    assert {(x["id"], x["category"], x["entity_ord"]) for x in files.registry_entities(r).collect()} == {("h", "house", 0), ("s", "station_or_ship", 3_000_000)}
    assert tuple(files.timeline(r).first()) == ("e", "1", "t", "")
    assert files.hierarchy_links(r).first()["level"] == 1 and files.participants(r).count() == 2
    assert files.read_registry(spark, str(tmp_path / "none.json"), tolerant=True).first()["houses"] is None


def test_corpus(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "---\nnarrator: log\n---", "Body"), ("b.md", "text", "Body")], "filename string, frontmatter string, body string")
    files.write_corpus(rows, str(tmp_path / "c"))
    corpus = files.read_corpus(spark, str(tmp_path / "c"))
    assert {(r["file"], r["narrator"]) for r in files.corpus_narrators(corpus).collect()} == {("a.md", "log"), ("b.md", "unknown")}
    assert files.read_corpus(spark, str(tmp_path / "c"), limit=1).select("file").collect()[0][0] == "a.md"
    assert files.read_inventory(spark, str(tmp_path / "c")).filter("path like '%.md'").count() == 2
    assert (tmp_path / "c" / "a.md").read_text() == "---\nnarrator: log\n---\n\nBody\n"
    files.write_corpus(rows.limit(1).replace("Body", "Other"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "a.md").read_text().endswith("Other\n") and len([x for x in (tmp_path / "c").iterdir() if x.suffix == ".md"]) == 2


def test_key_value_stores(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"d1": {"status": "Processed", "x": 1}, "d2": {"status": "failed"}}))
    (tmp_path / "l.json").write_text(json.dumps({"a.md": "ff"}))
    (tmp_path / "q.txt").write_text("# no\n\n who? \n")
    assert {tuple(r) for r in files.read_statuses(spark, str(tmp_path / "s.json")).collect()} == {("d1", "Processed"), ("d2", "failed")}
    assert [tuple(r) for r in files.read_ledger(spark, str(tmp_path / "l.json")).collect()] == [("a.md", "ff")]
    assert [r[0] for r in files.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["who?"]


def test_ingest_is_incremental(spark, tmp_path):
    seen = []
    schema = "id long, text string"

    def go():
        ingest.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "ledger"), str(tmp_path / "state"), lambda df, n: seen.extend(r["id"] for r in df.collect())).awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    go()
    spark.createDataFrame([(2, "b"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted(seen) == [1, 2, 3]


def test_stateful_limiter(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(3)], "key long, request_id long, at double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.limited(stream, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["admitted"] for r in spark.table("limited").collect()) == [0.0, 1.0, 60.05]


def test_provider(spark):
    rows = spark.createDataFrame([("q",)], "question string")
    assert files.provider(rows, lambda p: p.assign(answer=p["question"] + "!"), "question string, answer string").first()["answer"] == "q!"
    assert tx.SEP == "<SEP>"
