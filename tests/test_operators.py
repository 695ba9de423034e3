import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgaudit.operators import gate, graph, ledger, limiter, planning, resolve, vectors


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_distances_against_plain_search(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(45)} | {(i, i + 1) for i in range(100, 130)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(s):
        seen, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen

    df = spark.createDataFrame(list(edges), "src long, dst long")
    nodes = spark.createDataFrame([(x,) for x in (*near, 999)], "node long")
    got = {r["node"]: r["component"] for r in graph.components(df, nodes).collect()}
    assert got == {x: min(reach(x)) for x in (*near, 999)}
    s = sorted(near)[:3]
    far = {(r["source"], r["node"]): r["hops"] for r in graph.distances(df, spark.createDataFrame([(x,) for x in s], "source long")).collect()}
    assert far == {(a, b): d for a in s for b, d in reach(a).items()}
    wanted = {(a, rng.choice(sorted(reach(a)))) for a in near for _ in range(2)} | {(s[0], 999)}
    some = spark.createDataFrame(sorted(wanted), "source long, node long")
    far = {(r["source"], r["node"]): r["hops"] for r in graph.distances(df, some, some).collect()}
    assert far == {(a, b): reach(a)[b] for a, b in wanted if b in reach(a)}


def test_distances_run_to_the_end_of_a_long_chain(spark):
    df = spark.range(45).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.distances(df, spark.createDataFrame([(0,)], "source long")).agg(F.max("hops"), F.count("*")).first()
    assert tuple(got) == (45, 46)


def test_star_graph_converges(spark):
    df = spark.range(1, 3000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert graph.components(df).select("component").distinct().collect()[0][0] == 0


def test_loops_count_twice_in_degrees(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert {(r["node_id"], r["degree"]) for r in graph.degrees(nodes, edges).collect()} == {("a", 2), ("b", 0)}


def test_merge_aliases_drops_edges_to_itself(spark):
    nodes = spark.createDataFrame([("A", "", "x", 0), ("Al", "t", "y", 1), ("B", "u", "z", 2)], "node_id string, entity_type string, description string, ord long")
    edges = spark.createDataFrame([("A", "Al", 1.0, 0), ("Al", "B", 2.0, 1), ("A", "B", None, 2)], "src string, dst string, weight double, ord long")
    aliases = spark.createDataFrame([("al", "A")], "norm string, canonical string")
    n, e, renames = graph.merge_aliases(nodes, edges, aliases)
    assert {(r["node_id"], r["entity_type"], r["description"]) for r in n.collect()} == {("A", "t", "x<SEP>y"), ("B", "u", "z")}
    assert [tuple(r) for r in e.select("src", "dst", "weight").collect()] == [("A", "B", 3.0)]
    assert renames.count() == 1


REGISTRY = [("s1", 0, "Lantern", ["One"], "ship", "carrier of gamma works", True), ("s2", 1, "Lantern", ["Two"], "station", "harbor of house beta", True), ("h1", 2, "House Alpha", [], None, "ruling house", False)]


def resolved(spark, rows, compat=False):
    e = spark.createDataFrame(REGISTRY, "id string, entity_ord int, name string, aliases array<string>, type string, description string, is_homonym_risk boolean")
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "mention_id int, raw_name string, description string, context string")
    return [(r["resolved"], r["method"]) for r in resolve.resolve(m, resolve.registry_index(e), compat).orderBy("mention_id").collect()]


def test_resolve(spark):
    rows = [("house-alpha", "", ""), ("Lantern", "a station with a harbor", ""), ("Lantern", "nothing", ""), ("Unknown", "callsign: Unknown-7", ""), ("", "", ""), ("LANTERN", "gamma station", "works")]
    assert resolved(spark, rows) == [("House Alpha", "registry"), ("Two", "evidence"), ("Lantern", "raw"), ("Unknown-7", "designation"), ("", "raw"), ("One", "evidence")]
    assert resolved(spark, [("Zed", "code: other-long-name", "")]) == [("Zed", "raw")]
    e = spark.createDataFrame(REGISTRY, "id string, entity_ord int, name string, aliases array<string>, type string, description string, is_homonym_risk boolean")
    m = spark.createDataFrame([(1, "Lantern", "", "nothing", "House Beta", "ship"), (2, "lantern", "", "", " ", "station"), (3, "Lantern", "", "", None, None), (4, "Zed", "", "", "X", "y")], "mention_id int, raw_name string, description string, context string, owner string, entity_type string")
    got = [tuple(r)[1:] for r in resolve.resolve(m, resolve.registry_index(e), qualify=True).orderBy("mention_id").collect()]
    assert got == [("Lantern (House Beta)", "qualified"), ("lantern (station)", "qualified"), ("Lantern", "raw"), ("Zed", "raw")]
    assert resolved(spark, [("Zed", "code: other-long-name", "")], compat=True) == [("other-long-name", "designation")]


def most_rows(spark, df):
    """The rows of df, and the most rows that a step of its plan put out."""
    got = df.collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    run = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
    for metrics in (nodes.apply(i).metrics() for i in range(nodes.size())):
        for m in (metrics.apply(i) for i in range(metrics.size())):
            if m.name() in ("number of output rows", "shuffle records written") and values.get(m.accumulatorId()).isDefined():
                most = max(most, int(values.get(m.accumulatorId()).get().replace(",", "")))
    return got, most


def test_resolve_a_name_of_many(spark):
    """Mentions of a name that many entities have don't meet each of them."""
    kinds = ["dredger", "lantern", "beacon"]
    e = [(f"e{i}", i, "Hot", [f"Hot {i}"], kinds[i % 3], "", False) for i in range(300)] + [("u", 300, "Hot", ["The One"], "anchorage", "", False)]
    e = spark.createDataFrame(e, "id string, entity_ord int, name string, aliases array<string>, type string, description string, is_homonym_risk boolean")
    texts = ["a dredger", "an anchorage", "nothing"]
    m = spark.createDataFrame([(i, "HOT", texts[i % 3], "", "Beta", "ship") for i in range(300)] + [(300, "hot 7", "", "", "", "")], "mention_id int, raw_name string, description string, context string, owner string, entity_type string")
    index = resolve.registry_index(e)
    got, most = most_rows(spark, resolve.resolve(m, index, qualify=True))
    owned, one = ("HOT (Beta)", "qualified"), ("The One", "evidence")
    assert sorted(map(tuple, got)) == [(i, *(one if i % 3 == 1 else owned)) for i in range(300)] + [(300, "Hot", "registry")]
    assert most < 2000  # mentions times entities are 90,300
    assert {tuple(r)[1:] for r in resolve.resolve(m, index, compat=True).collect()} == {("Hot 0", "evidence"), one, ("HOT", "raw"), ("Hot", "registry")}


def test_as_of_rename(spark):
    text = "\n".join(["entity<|#|>V<|#|>t<|#|>d", "relation<|#|>V<|#|>Q<|#|>k<|#|>d", "entity<|#|>V<|#|>t<|#|>d", "relation<|#|>v<|#|>Z<|#|>k<|#|>d", "free text", "entity<|#|>short"])
    lines = resolve.records(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    names = spark.createDataFrame([(1, 0, "V1"), (1, 2, "V2")], "doc_id int, line_no int, resolved string")
    got = [r["line"] for r in resolve.canonicalize(lines, names).orderBy("line_no").collect()]
    assert got == ["entity<|#|>V1<|#|>t<|#|>d", "relation<|#|>V1<|#|>Q<|#|>k<|#|>d", "entity<|#|>V2<|#|>t<|#|>d", "relation<|#|>V2<|#|>Z<|#|>k<|#|>d", "free text", "entity<|#|>short"]
    late = spark.createDataFrame([(1, "relation<|#|>V<|#|>Q<|#|>k<|#|>d\nentity<|#|>V<|#|>t<|#|>d")], "doc_id int, text string")
    names = spark.createDataFrame([(1, 1, "V1")], "doc_id int, line_no int, resolved string")
    assert resolve.canonicalize(resolve.records(late), names).orderBy("line_no").first()["line"].split("<|#|>")[1] == "V"
    assert resolve.canonicalize(resolve.records(late), names, two_pass=True).orderBy("line_no").first()["line"].split("<|#|>")[1] == "V1"


def test_ledger_force_keeps_other_files(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    old = spark.createDataFrame([("a", "stale"), ("z", "kept")], "path string, sha string")
    todo = ledger.pending(docs, old, limit=1, force=True)
    assert {r["path"] for r in ledger.commit(old, todo).collect()} == {"a", "z"}
    assert ledger.pending(docs, ledger.commit(old, todo)).select("path").collect()[0][0] == "b"


def test_limiter():
    assert limiter.admit([0, 1, 2, 3], 2) == [0, 1, 60.05, 61.05]
    assert limiter.admit([0, 60], 1) == [0, 60]


def test_limiter_by_key(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(4)] + [(2, 9, 0.0)], "key long, request_id long, at double")
    got = {(r["key"], r["request_id"]): r["admitted"] for r in limiter.admissions(rows, 2).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 60.05, (1, 3): 61.05, (2, 9): 0.0}


def test_leaks_against_all_pairs(spark):
    texts = [(1, "see the alpha-beta gamma, at last"), (2, "alphabeta"), (3, "x alpha-beta gammas"), (4, "tiny"), (5, None)]
    terms = [(1, "alpha-beta gamma"), (2, "alpha"), (3, "tiny"), (4, "beta gamma, at"), (5, None), (6, "-beta ")]
    got = {tuple(r) for r in gate.leaks(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(terms, "term_id int, term string")).collect()}
    want = {(i, k) for i, t in texts for k, s in terms if t and s and len(s) >= 5 and s in t}
    assert got == want
    by_key = gate.leaks_by_key(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(terms, "term_id int, term string"))
    assert {tuple(r) for r in by_key.collect()} == want


def test_both_leak_scans_agree(spark):
    rng = random.Random(4)
    words = ["alpha", "be", "Gamma", "δέλτα", "x-1", "..", "omega7"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(120)]
    terms = [(k, "".join(rng.choices([*words, " ", " "], k=rng.randint(1, 9)))) for k in range(80)] + [(k + 1000, texts[k][1][3:60]) for k in range(40)]
    t, m = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(terms, "term_id long, term string")
    want = {(i, k) for i, x in texts for k, s in terms if len(s) >= 5 and s in x}
    assert len(want) > 40
    for scan in (gate.leaks, gate.leaks_by_key):
        assert {tuple(r) for r in scan(t, m).collect()} == want


def test_order_over_many_parts(spark):
    from kgaudit.operators import order

    rng = random.Random(5)
    ids = rng.sample(range(10**6), 500)
    rows = [(i, rng.choice([None, None, i])) for i in ids]
    df = spark.createDataFrame(rows, "id long, v long").repartition(6)
    got = {r["id"]: r["number"] for r in order.numbered(df, ["id"]).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}
    held = sorted(v for _, v in rows if v is not None)
    near = {r["id"]: (r["last"], r["next"]) for r in order.nearest(df, "id", F.col("v")).collect()}
    assert near == {i: (max((h for h in held if h <= i), default=None), min((h for h in held if h >= i), default=None)) for i in ids}
    assert order.numbered(df.limit(0), ["id"]).count() == 0 and order.nearest(df.limit(0), "id", F.col("v")).count() == 0


def test_missing_modules(spark):
    files = spark.createDataFrame([("a/one.py", "import os\nfrom two import x\n  import three.sub"), ("a/two.py", "import one"), ("a/x.txt", None)], "file string, text string")
    assert [tuple(r) for r in gate.missing_modules(files, ["os"]).collect()] == [("a/one.py", "three")]


def test_gate(spark):
    files = spark.createDataFrame([(1, "import os\nclass A:"), (2, "eval(x)")], "file int, text string")
    rules = spark.createDataFrame([("no eval", r"\beval\(", False), ("class", "^class ", True)], "rule string, pattern string, required boolean")
    assert {r["file"]: (r["passed"], r["broken"]) for r in gate.verdict(gate.scan(files, rules)).collect()} == {1: (True, 0), 2: (False, 2)}


def test_allocation_and_plan(spark):
    shares = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(planning.SHARES)], "key string, share double, ord int")
    assert {r["key"]: r["planned"] for r in planning.allocate(shares, F.lit(24)).collect()} == {"encyclopedia": 7, "dossier": 6, "propaganda": 6, "log": 5}
    entities = [(f"e{i}", f"Name {i}") for i in range(5)]
    events = [("v1", ["e0", "e1", "e2"]), ("v2", ["e3"])]
    a, b = planning.plan(spark, entities, events), planning.plan(spark, entities, events)
    assert a.count() == 24 and a.exceptAll(b).count() == 0
    assert {r["narrator"]: r["n"] for r in planning.distribution(a).collect()} == {"encyclopedia": 7, "dossier": 6, "propaganda": 6, "log": 5}
    cut = planning.slices(a, spark.createDataFrame(entities, "id string, name string"), spark.createDataFrame(events, "event_id string, participant_ids array<string>"), spark.createDataFrame([("e0", "e1")], "parent_id string, child_id string"))
    assert cut.count() == 24
    assert planning.missing_targets(a, a.select("filename").limit(1)).count() < 24


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).astype(np.float32).astype(float)
    x[50:60], x[70] = x[10], 0
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(900, None)], "id long, embedding array<double>").repartition(5)
    q = v.filter("id % 20 = 10").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    cos = lambda a, b: 0.0 if not a.any() or not b.any() else float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    for block in (32 << 20, 100):
        got = {}
        for r in vectors.top_k(v, q, 7, block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
        assert set(got) == set(range(10, 300, 20))
        for i, best in got.items():
            want = sorted(((round(cos(x[i], x[j]), 9), j) for j in range(300)), key=lambda p: (-p[0], p[1]))[:7]
            assert best == [(j, s) for s, j in want]
    assert vectors.top_k(v, q.limit(0)).count() == 0 and vectors.top_k(v.limit(0), q).count() == 0


def test_stacked_vectors_are_checked(spark):
    good = spark.createDataFrame([(1, [[1.0, 2.0]])], "id long, matrix array<array<double>>")
    assert vectors.stacked(good, 2).first()["embedding"] == [1.0, 2.0]
    for bad in ([[1.0, 2.0], [3.0, 4.0]], [[1.0]], []):
        with pytest.raises(Exception, match="not one vector"):
            vectors.stacked(spark.createDataFrame([(1, bad)], "id long, matrix array<array<double>>"), 2).collect()


def test_seeded_holdout_and_plan_against_plain_versions(spark):
    from kgaudit.operators import entities

    rows = [(f"e{k:02d}", f"name {k % 37}") for k in range(40)]
    held = sorted(r["id"] for r in entities.choose_holdout(spark.createDataFrame(rows, "id string, name string")).collect())
    groups = {}
    for i, n in rows:
        groups.setdefault(n, []).append(i)
    last = max(n for n, ids in groups.items() if len(ids) > 1)
    rest = sorted(i for i, _ in rows if i not in groups[last])
    assert held == sorted([*groups[last], *random.Random(20260806).sample(rest, round(len(rest) * 0.2))])


def test_retrieval_modes(spark):
    v = spark.createDataFrame([(1, "entity", [1.0, 0.0]), (2, "entity", [0.0, 1.0]), (3, "relation", [1.0, 0.1]), (4, "chunk", [0.5, 0.5]), (5, "chunk", [0.0, 0.0])], "id long, kind string, embedding array<float>")
    edges = spark.createDataFrame([(3, 1, 2)], "rel_id long, src long, dst long")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<float>")
    got = lambda mode: {(r["kind"], r["id"]) for r in vectors.retrieve(v, edges, q, mode, k=1, chunk_k=1).collect()}
    assert got("local") == {("entity", 1), ("relation", 3)}
    assert got("global") == {("relation", 3), ("entity", 1), ("entity", 2)}
    assert got("naive") == {("chunk", 4)} and got("mix") == got("hybrid") | got("naive") and got("bypass") == set()
    with pytest.raises(ValueError):
        vectors.retrieve(v, edges, q, "other")
