"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted in the driver on at most `sample_rows` vectors (those of least hash) and broadcast. It has a leaf for
every `leaf_rows` vectors, within what the sample can tell apart: its size is bounded by the sample, not by the table.
Every vector is then indexed: it goes down the tree to its leaf. A query walks the tree with a priority queue, always
into the bin whose centre promises the largest inner product, and so gets all leaves in the order of promise; it visits
leaves until it has seen `share` of the indexed vectors. That share is calibrated: sampled queries are searched by brute
force over all rows, and the share is widened until they reach the wanted recall; it is logged with the recall.

Vectors are dealt to shards of whole leaves that lie side by side in the tree; a leaf of many vectors is cut into several
shards, so no task holds an unbounded leaf. Queries go to the shards of the leaves they visit. A shard gives one row a
query with its best k; the last step merges those.

Inner products needn't be of unit vectors: vectors are indexed with one more coordinate that gives all the same norm,
so that the largest inner product is the least distance.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as query nor as
candidate. Vectors of different lengths have no inner product: those of each length are searched by themselves. Equal
scores go to the smaller id. Rows that repeat an id are rows of their own: each is a query, and a candidate of the
others. A row without an id is a candidate (its id null, after all others) and no query. Fewer than k candidates give
fewer rows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.llm.memory import lean
from kgaudit.session import discard, materialize

log = logging.getLogger(__name__)
_NO_ID = (1 << 63) - 1
SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass
class Tree:
    """centres of all nodes, children of inner nodes, leaf number of leaves (else -1), largest norm."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    norm: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each (lifted) vector."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            best = (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            todo += [(k, rows[best == i]) for i, k in enumerate(kids) if (best == i).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order for a (lifted) query: nearest centre first, bins left aside come back."""
        queue, n = [(0.0, 0)], 0
        while queue:
            _, node = heapq.heappop(queue)
            while kids := self.children[node]:
                c = self.centres[kids]
                d = ((c - q) ** 2).sum(1)
                order = d.argsort(kind="stable")
                for i in order[1:]:
                    heapq.heappush(queue, (float(d[i]), kids[i]))
                node = kids[order[0]]
            n += 1
            yield int(self.leaf[node])


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """One more coordinate, so that all norms equal `norm`; longer vectors get none."""
    rest = norm * norm - (x * x).sum(1)
    return np.hstack([x, np.sqrt(np.maximum(rest, 0.0))[:, None]])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        for i in range(k):
            if (own := x[best == i]).size:
                c[i] = own.mean(0)
    return c


def fit(x: np.ndarray, branching: int = 8, leaves: int = 128, seed: int = 5) -> Tree:
    """Splits the largest node into `branching` by k-means until there are about so many leaves."""
    norm = float(np.sqrt((x * x).sum(1).max())) if len(x) else 1.0
    y = lift(x, norm)
    rng = np.random.default_rng(seed)
    centres, children = [y.mean(0) if len(y) else np.zeros(x.shape[1] + 1)], [[]]
    heap, count = [(-len(y), 0, y)], 1
    while heap and count + branching - 1 <= leaves:
        _, node, own = heapq.heappop(heap)
        if len(own) < 2 * branching or not (own != own[0]).any():
            continue
        c = _kmeans(own, branching, rng)
        best = (own @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        for i in range(branching):
            children[node].append(len(centres))
            centres.append(c[i])
            children.append([])
            heapq.heappush(heap, (-int((best == i).sum()), len(centres) - 1, own[best == i]))
        count += branching - 1
    leaf, n, todo = np.full(len(centres), -1), 0, [0]
    while todo:  # leaves are numbered as they lie side by side
        node = todo.pop()
        todo += reversed(children[node])
        if not children[node]:
            leaf[node], n = n, n + 1
    return Tree(np.array(centres), children, leaf, norm)


def _top(q: np.ndarray, asked: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Best k of x for each query but its own row: query row, places in x, exact scores; ties to the smaller id. Products
    in bulk only choose; a final score adds up coordinate after coordinate, so equal vectors get equal scores."""
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ x.T
        for i, r in enumerate(rough):
            own = asked[a + i] != rows
            r = np.where(own, r, -np.inf)
            n = min(k, int(own.sum()))
            if not n:
                continue
            least = np.partition(r, len(r) - n)[len(r) - n]
            near = np.flatnonzero(r >= least - 1e-9 * max(1.0, abs(least)))
            v, score = q[a + i], np.zeros(len(near))
            for d in range(x.shape[1]):
                score += v[d] * x[near, d]
            order = np.lexsort((rows[near], ids[near], -score))[:n]
            yield int(asked[a + i]), near[order], score[order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id, v, n: the vectors that take part, numbered, with their length."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("vec_id"), v.alias("v")).filter("v is not null").filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("n"))


def index(rows: DataFrame, tree: Tree) -> DataFrame:
    """row, vec_id, v, leaf: each vector at its leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            if b.num_rows:
                leaf = t.place(lift(_matrix(b.column(2)), t.norm))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["row", "vec_id", "v", "leaf"])

    return materialize(rows.select("row", "vec_id", "v").mapInArrow(lean(run), "row long, vec_id long, v array<double>, leaf long"), "ann-index")


def brute_force(queries: np.ndarray, asked: np.ndarray, rows: DataFrame, k: int) -> dict[int, list[tuple[int, int]]]:
    """Exact neighbours (row, leaf) of a few queries over all rows, in blocks; each task gives its best k a query."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, asked = shared.value
        for b in batches:
            if b.num_rows:
                row, ids, leaf = (b.column(c).to_numpy() for c in (0, 1, 3))
                got = list(_top(q, asked, _matrix(b.column(2)), row, ids, k))
                at = np.concatenate([i for _, i, _ in got] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(i), n) for n, i, _ in got] or [at]), pa.int64()), pa.array(row[at]), pa.array(ids[at]), pa.array(leaf[at]), pa.array(np.concatenate([s for *_, s in got] or [np.zeros(0)]), pa.float64())], names=["asked", "row", "vec_id", "leaf", "score"])

    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    found = rows.select("row", "vec_id", "v", "leaf").mapInArrow(lean(run), "asked long, row long, vec_id long, leaf long, score double").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out: dict[int, list[tuple[int, int]]] = {}
    for r in found.collect():  # calibration queries x k rows
        out.setdefault(r["asked"], []).append((r["row"], r["leaf"]))
    return out


def _asked(query_step: int):
    return (F.col("vec_id") != _NO_ID) & (F.col("vec_id") % query_step == 0)


def calibrated(placed: DataFrame, tree: Tree, sizes: np.ndarray, query_step: int, k: int, recall: float, queries: int) -> tuple[float, float]:
    """The share of the vectors that must be seen before the wanted share of true neighbours is among them, by one half
    of some queries; and the recall that it gives on the other half."""
    some = placed.filter(_asked(query_step)).orderBy(F.xxhash64(F.lit(1), "row"), "row").limit(queries).toArrow()
    if not some.num_rows:
        return 1.0, 1.0
    q, asked = _matrix(some.column("v")), some.column("row").to_numpy()
    truth = brute_force(q, asked, placed, k)
    need: list[np.ndarray] = []
    for v, i in zip(lift(q, tree.norm), asked, strict=True):
        seen, at = 0, {}
        for leaf in tree.walk(v):
            seen += sizes[leaf]
            at[leaf] = seen
        need.append(np.array([at[leaf] for _, leaf in truth.get(int(i), ())], float))
    all_, fit_, test = (np.concatenate(x or [np.zeros(0)]) for x in (need, need[::2], need[1::2]))
    if not len(all_):
        return 1.0, 1.0
    wanted = min(1.0, recall + 0.01)
    half = np.quantile(fit_, wanted) if len(fit_) else np.inf
    return float(np.quantile(all_, wanted)) / max(1, sizes.sum()), float((test <= half).mean()) if len(test) else 1.0


def search(vectors: DataFrame, query_step: int = 20, k: int = 20, recall: float = 0.95, sample_rows: int = 20_000, leaf_rows: int = 256, calibrate: int = 128, shard_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each row whose id is divisible by query_step: query_id, rank, vec_id, score."""
    rows = materialize(usable(vectors, id_col, vector_col), "ann-vectors")
    out = vectors.sparkSession.createDataFrame([], SCHEMA)
    lengths = sorted((r["n"], r["count"]) for r in rows.groupBy("n").count().collect())  # a row for each length
    for n, count in lengths:
        leaves = max(128, min(count // leaf_rows, sample_rows // 16))
        found = _search_one(rows.filter(F.col("n") == n).drop("n"), query_step, k, recall, sample_rows, leaves, calibrate, shard_rows)
        out = found if len(lengths) == 1 else out.unionByName(found)
    discard(rows)
    return out


def _search_one(rows: DataFrame, query_step: int, k: int, recall: float, sample_rows: int, leaves: int, calibrate: int, shard_rows: int) -> DataFrame:
    """The search among vectors (row, vec_id, v) of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).toArrow()
    tree = fit(_matrix(sample.column("v")), leaves=leaves)
    placed = index(rows, tree)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row for each leaf
        sizes[r["leaf"]] = r["count"]
    share, reached = calibrated(placed, tree, sizes, query_step, k, recall, calibrate)
    log.info("%d leaves, %.1f %% of the vectors are visited, recall %.3f on queries that weren't calibrated on", tree.leaves, 100 * share, reached)

    # shards of whole leaves, or parts of one large leaf
    parts = np.maximum(1, -(-sizes // shard_rows))
    shard_of, held, shard = {}, 0, 0
    for leaf in range(tree.leaves):
        if parts[leaf] > 1:
            shard_of[leaf] = list(range(shard + 1, shard + 1 + int(parts[leaf])))
            shard, held = shard + 1 + int(parts[leaf]), 0
        else:
            if held + sizes[leaf] > shard_rows:
                shard, held = shard + 1, 0
            held += sizes[leaf]
            shard_of[leaf] = [shard]
    plan = spark.sparkContext.broadcast((tree, sizes, share, shard_of))
    names = ["shard", "row", "vec_id", "v", "visits", "query"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, size, part, shards = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            row, ids, leaf = (b.column(c).to_numpy() for c in (0, 1, 3))
            own = [shards[n][i % len(shards[n])] for n, i in zip(leaf, row, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *b.columns[:3], pa.array([[n] for n in leaf], pa.list_(pa.int64())), pa.array(np.zeros(len(ids), bool))], names=names)
            if len(asked := np.flatnonzero((ids != _NO_ID) & (ids % query_step == 0))):
                x = _matrix(b.column(2))[asked]
                to, at, seen_leaves = [], [], []
                for j, v in zip(asked, lift(x, t.norm), strict=True):
                    seen, mine = 0, {}
                    for n in t.walk(v):
                        for s in shards[n]:
                            mine.setdefault(s, []).append(n)
                        seen += size[n]
                        if seen >= part * size.sum() and seen > k:
                            break
                    for s, ns in mine.items():
                        to.append(s), at.append(j), seen_leaves.append(ns)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(c.take(pa.array(at)) for c in b.columns[:3]), pa.array(seen_leaves, pa.list_(pa.int64())), pa.array(np.ones(len(to), bool))], names=names)

    def answer(table: pa.Table) -> pa.Table:
        ask = table.column("query").to_numpy()
        base, asked = table.filter(pa.array(~ask)), table.filter(pa.array(ask))
        row, ids, x, leaf = base.column("row").to_numpy(), base.column("vec_id").to_numpy(), _matrix(base.column("v")), base.column("visits").combine_chunks().flatten().to_numpy()
        order = np.lexsort((row, leaf))
        row, ids, x, leaf = row[order], ids[order], x[order], leaf[order]
        out: dict[str, list] = {"asked": [], "query_id": [], "ids": [], "scores": []}
        groups: dict[tuple, list[int]] = {}
        for i, n in enumerate(asked.column("visits").to_pylist()):
            groups.setdefault(tuple(sorted(n)), []).append(i)
        q, asked_row, asked_id = _matrix(asked.column("v")), asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        name = dict(zip(asked_row.tolist(), asked_id.tolist(), strict=True))
        for leaves_, rows_ in groups.items():
            own = np.isin(leaf, leaves_)
            if own.any():
                for n, i, s in _top(q[rows_], asked_row[rows_], x[own], row[own], ids[own], k):
                    out["asked"].append(n), out["query_id"].append(name[n]), out["ids"].append(ids[own][i]), out["scores"].append(s)
        return pa.table([pa.array(out["asked"], pa.int64()), pa.array(out["query_id"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["scores"], pa.list_(pa.float64()))], names=list(out))

    dealt = placed.select("row", "vec_id", "v", "leaf").mapInArrow(lean(deal), "shard int, row long, vec_id long, v array<double>, visits array<long>, query boolean")
    best = dealt.groupBy("shard").applyInArrow(answer, "asked long, query_id long, ids array<long>, scores array<double>")
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i")))
    merged = best.select("asked", "query_id", pairs.alias("p")).groupBy("asked", "query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    found = merged.select("query_id", F.posexplode("p").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("x.i"), F.lit(_NO_ID)).alias("vec_id"), (-F.col("x.s")).alias("score"))
    out = materialize(found, "ann-found")
    discard(placed)
    return out
