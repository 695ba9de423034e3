"""Exact vector retrieval and the retrieval modes built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("local", "global", "hybrid", "naive", "mix", "bypass")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, F.try_divide(dot(a, b), n)).otherwise(0.0)


def integrity(vectors: DataFrame, texts: DataFrame, dim: int) -> DataFrame:
    """vectors, wrong_dim, texts_without, vectors_without, from vectors (id, embedding) and texts (id)."""
    v = vectors.select("id", F.size("embedding").alias("n"))
    both = v.join(texts.select("id", F.lit(1).alias("t")), "id", "full")
    return both.agg(F.count("n").alias("vectors"), F.count_if(F.col("n") != dim).alias("wrong_dim"), F.count_if(F.col("n").isNull()).alias("texts_without"), F.count_if(F.col("t").isNull()).alias("vectors_without"))


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place of each query, ids and cosines of its best k rows, ties to the smaller id. Products in bulk only choose; the
    cosine adds up coordinate after coordinate, so equal vectors get equal ones."""
    norm = lambda v: np.sqrt((v * v).sum(-1))
    nq, nx = norm(q), norm(x)
    rough = q @ x.T / np.where(nq > 0, nq, 1)[:, None] / np.where(nx > 0, nx, 1)[None, :]
    for i, r in enumerate(rough):
        n = min(k, len(r))
        near = np.flatnonzero(r >= np.partition(r, len(r) - n)[len(r) - n] - 1e-9)
        dot, own, other = np.zeros(len(near)), np.zeros(len(near)), 0.0
        for d in range(x.shape[1]):
            c = x[near, d]
            dot, own, other = dot + q[i, d] * c, own + c * c, other + q[i, d] * q[i, d]
        size = np.sqrt(own) * np.sqrt(other)
        score = np.where(size > 0, dot / np.where(size > 0, size, 1), 0.0)
        order = np.lexsort((ids[near], -score))[:n]
        yield i, ids[near][order], score[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 40, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, id, score, rank by cosine, ties to the smaller id. vectors: id, embedding; queries: query_id, query; all
    of one length, null vectors left out. Queries are dealt by hash to blocks of about so many bytes; each block is
    broadcast and meets the vectors where they are read, and a batch of vectors gives its best k a query."""
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).filter("query is not null")
    size = asked.agg(F.coalesce(F.sum(F.size("query") * 8), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-size // block_bytes))
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null")
    kind = lambda c, df: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind('query_id', queries)}, id {kind('id', vectors)}, score double"
    found: DataFrame | None = None
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()  # about block_bytes
        shared = vectors.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), _matrix(block.column("query"))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for b in batches:
                if b.num_rows and len(q):
                    got = list(_best(q, _matrix(b.column(1)), b.column(0).to_numpy(), k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.repeat(names[i], len(x)) for i, x, _ in got])), pa.array(np.concatenate([x for _, x, _ in got])), pa.array(np.concatenate([s for *_, s in got]))], names=["query_id", "id", "score"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def stacked(rows: DataFrame, dim: int) -> DataFrame:
    """id, embedding from rows (id, matrix): matrices of one row each, stacked to a vector a text. Raises on any other
    shape, for a batch that is answered by one vector would go unnoticed."""
    ok = (F.size("matrix") == 1) & (F.size(F.get("matrix", F.lit(0))) == dim)
    checked = F.when(F.coalesce(ok, F.lit(False)), F.get("matrix", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not one vector of the wanted length for "), F.col("id").cast("string"))))
    return rows.select("id", checked.alias("embedding"))


def retrieve(vectors: DataFrame, edges: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = 40, chunk_k: int = 20) -> DataFrame:
    """query_id, mode, kind, id, score: the context rows of a question. vectors: id, kind (entity, relation, chunk),
    embedding; edges: rel_id, src, dst by entity id.

    local: nearest entities and the relations at them. global: nearest relations and their ends. hybrid: both.
    naive: nearest chunks. mix: hybrid and naive. bypass: nothing."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")

    def near(kind: str, n: int) -> DataFrame:
        return top_k(vectors.filter(F.col("kind") == kind).select("id", "embedding"), queries, n).select("query_id", F.lit(kind).alias("kind"), "id", "score")

    parts: list[DataFrame] = []
    if mode in ("local", "hybrid", "mix"):
        e = near("entity", k)
        at = edges.select("rel_id", F.explode(F.array("src", "dst")).alias("end"))
        parts += [e, e.join(at, F.col("id") == F.col("end")).select("query_id", F.lit("relation").alias("kind"), F.col("rel_id").alias("id"), "score")]
    if mode in ("global", "hybrid", "mix"):
        r = near("relation", k)
        ends = r.join(edges, F.col("id") == F.col("rel_id"))
        parts += [r, ends.select("query_id", F.lit("entity").alias("kind"), F.explode(F.array("src", "dst")).alias("id"), "score")]
    if mode in ("naive", "mix"):
        parts.append(near("chunk", chunk_k))
    if not parts:
        return near("chunk", chunk_k).limit(0).withColumn("mode", F.lit(mode)).select("query_id", "mode", "kind", "id", "score")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "kind", "id").agg(F.max("score").alias("score")).select("query_id", F.lit(mode).alias("mode"), "kind", "id", "score")


def retrieve_all(vectors: DataFrame, edges: DataFrame, queries: DataFrame, modes: tuple[str, ...] = ("local", "global", "hybrid"), **kw) -> DataFrame:
    out = retrieve(vectors, edges, queries, modes[0], **kw)
    for m in modes[1:]:
        out = out.unionByName(retrieve(vectors, edges, queries, m, **kw))
    return out
