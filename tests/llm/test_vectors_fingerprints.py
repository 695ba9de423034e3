import base64
import hashlib
import random
import re
import struct

import numpy as np
import pytest

from kgaudit.llm import ann, fingerprints


def exact(rows, step=20, k=20):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q, v in ok.items():
        if q % step == 0:
            scores = sorted((-sum(float(a) * float(b) for a, b in zip(v, x, strict=True)), i) for i, x in ok.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("shape", ["sphere", "clusters", "one hot place"])
def test_recall(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    if shape == "clusters":
        x = rng.normal(size=(8, 16))[rng.integers(0, 8, 1500)] * 3 + x
    if shape == "one hot place":
        x[::3] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=200).collect()
    want = exact(rows)
    mine = {}
    for r in got:
        mine.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q, best in want.items():
        found = [mine[q][k] for k in range(1, 21)]
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and q not in [i for i, _ in found]
        at = dict(best)
        for i, s in found:
            assert i not in at or abs(at[i] - s) < 1e-9
        hit += len({i for i, _ in found} & set(at))
    assert hit / (20 * len(want)) >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (20, [3.0, -1.0]), (0, [1.0, 2.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, leaf int")
    got = sorted(((r["query_id"], r["rank"], -1 if r["vec_id"] is None else r["vec_id"], r["score"]) for r in ann.search(df).collect()))
    # two rows of id 0 with equal vectors: each is a query, and a candidate of the other; the row without id comes last
    one = [(0, 1, 0, 5.0), (0, 2, 1, 5.0), (0, 3, -1, 3.0), (0, 4, 20, 1.0)]
    assert got == sorted(one + one + [(20, 1, -1, 2.0), (20, 2, 0, 1.0), (20, 3, 0, 1.0), (20, 4, 1, 1.0)])
    assert ann.search(df.limit(0)).count() == 0


def test_lengths_are_searched_apart(spark):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(3)] + [(20 * i + 1, [1.0, 2.0, float(i)]) for i in range(4)] + [(100, [1.0, 1.0, 1.0]), (120, [4.0])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(40, 4.0), (20, 3.0)], 20: [(40, 7.0), (0, 3.0)], 40: [(20, 7.0), (0, 4.0)], 100: [(61, 6.0), (41, 5.0), (21, 4.0), (1, 3.0)]}


def test_leaves_grow_and_recall_is_logged(spark, caplog):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(3000, 8)))]
    with caplog.at_level("INFO", logger="kgaudit.llm.ann"):
        ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf_rows=8).count()
    leaves, visited, reached = re.search(r"(\d+) leaves, ([\d.]+) % .* recall ([\d.]+)", caplog.text).groups()
    assert int(leaves) > 300 and float(visited) < 100 and float(reached) >= 0.9


def test_walk_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(500, 5))
    t = ann.fit(x, leaves=32)
    seen = list(t.walk(ann.lift(x[:1], t.norm)[0]))
    assert sorted(seen) == list(range(t.leaves))
    assert set(t.place(ann.lift(x, t.norm))) <= set(seen)


def pieces(t):
    return set(re.findall(r"\S+(?:[^\S\n]+\S+){0,23}", t))


def like(a, b):
    a, b = pieces(a), pieces(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_against_plain_sets(spark, parts):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "é", "x", "😀"]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 70)))
    rows = [(rng.randrange(10**9), "\n".join(line() for _ in range(rng.choice([0, 1, 3, 40])))) for _ in range(60)]
    rows.append((10**9 + 1, rows[3][1]))
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - like(t, edited)) < 1e-9 and abs(r["near_next"] - like(t, n)) < 1e-9
    assert got[10**9 + 1]["fingerprint"] == got[rows[3][0]]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == len({frozenset(pieces(t)) for _, t in rows})


def cells_of(fingerprint):
    raw = base64.b64decode(fingerprint)
    return [struct.unpack_from(">IQI", raw, 16 * k) for k in range(len(raw) // 16)]


def test_printed_fingerprints_peel(spark):
    """Two fingerprints as printed, subtracted and peeled by hand, give the digests that only one of the texts has."""
    rng = random.Random(9)
    lines = [f"line {rng.random()} é" for _ in range(40)]
    a, b = "\n".join(lines), "\n".join(lines[:30] + [f"new {k}" for k in range(5)])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    x, y = cells_of(got[1]["fingerprint"]), cells_of(got[2]["fingerprint"])
    assert len(x) == 48 and sum(n for n, *_ in x) == 3 * len(pieces(a))
    left = [[n - m, k ^ q, h ^ c] for (n, k, h), (m, q, c) in zip(x, y, strict=True)]
    hashes = {}
    for text in (a, b):
        for piece in pieces(text):
            d, y1 = spark.sql("SELECT xxhash64(:p) d, xxhash64(xxhash64(:p), 1) y", args={"p": piece}).first()
            hashes[d & (1 << 64) - 1] = (y1 & (1 << 64) - 1, piece)
    found = set()
    while pure := [k for n, k, h in left if abs(n) == 1 and k in hashes and hashes[k][0] >> 32 == h]:
        k = pure[0]
        sign = next(n for n, d, _ in left if d == k and abs(n) == 1)
        found.add((sign, hashes[k][1]))
        for j in range(3):
            cell = left[16 * j + (hashes[k][0] >> 8 * j & 15)]
            cell[0], cell[1], cell[2] = cell[0] - sign, cell[1] ^ k, cell[2] ^ hashes[k][0] >> 32
    assert all(c == [0, 0, 0] for c in left)
    assert found == {(1, p) for p in pieces(a) - pieces(b)} | {(-1, p) for p in pieces(b) - pieces(a)}


def test_one_id_in_very_many_rows(spark):
    rows = [(7, f"text {k} of many\nline {k % 5}") for k in range(400)] + [(None, f"none {k}") for k in range(200)] + [(9, "a b"), (3, "c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed, _ = fingerprints.with_next(df, parts=12)
    sizes = [r["count"] for r in keyed.filter("guest = 0").groupBy("part").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 150
    hashed = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r["near_next"] for r in fingerprints.fingerprints(df, parts=12).collect()}
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert abs(got[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] - like(t, n)) < 1e-9


def test_fingerprint_edge_cases(spark):
    rows = [(1, None), (2, "a b"), (2, "c d\ne f g"), (None, "z z"), (None, ""), (2, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    got = sorted(((r["doc_id"] or 0, r["n_chars"]) for r in fingerprints.fingerprints(df).collect()))
    assert got == [(0, 0), (0, 3), (1, 0), (2, 3), (2, 3), (2, 9)]
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a").hexdigest()


def test_very_long_texts(spark):
    rng = random.Random(8)
    a = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    b = a[: len(a) // 2] + " ".join(f"v{k}" for k in range(30_000))
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprints(spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")).collect()}
    assert abs(got[2] - like(a, b)) < 1e-9 and abs(got[1] - like(a, b)) < 1e-9


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fingerprints.fingerprints(spark.read.schema(df.schema).parquet("file:///root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
