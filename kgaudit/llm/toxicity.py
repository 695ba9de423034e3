"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: words in lower case and the beginnings of long words, so that endings of a
stem share a term. The model has a weight and a short vector for each hash; the score is the logistic of the bias, the
weights, and the products of all pairs of vectors, so that two terms may mean together what neither does alone.

Terms are screened first, by likelihood ratios on the labelled rows: a term is in the model if the rows that hold it are
so unevenly toxic that chance would hardly do it, or if it has a partner with which it tells much more about the label
than the two do apart (as when either of two terms is toxic, but not both). Partners are sought among the `most_terms`
most frequent terms. Without a screen, a few thousand rows are learnt by heart through their rare words.

It is fitted in the driver on at most `max_rows` labelled rows (those of least hash, so the same ones each time; of rows
that repeat an id, that with the least hash of its text) and then broadcast: its size is set by `bits` and `factors`
alone. Scoring is one pass over whole texts.

Defined cases: null and empty texts have no terms and the score of the bias; rows are independent, so repeated rows
and null ids pass through (a null id is held out: it has no label to learn from); labels that are null are not learnt;
an id with labels of both kinds counts as toxic. Without labels of both kinds every text gets one score. Extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.llm.memory import Recent, lean

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_WORDS = re.compile(r"[^\W\d_]+")
_KEPT_TERMS = 100_000


class _Terms(Recent):
    """Hashes of a word and of its beginnings; given the places of a model's terms, the places of those it has."""

    def __init__(self, bits: int, place: np.ndarray | None = None) -> None:
        mask = (1 << bits) - 1

        def hashes(word: str) -> tuple[int, ...]:
            parts = [word, *(f"{word[:k]}~" for k in range(2, 8) if len(word) > k)]
            found = (zlib.crc32(p.encode()) & mask for p in parts)
            return tuple(found) if place is None else tuple(int(place[h]) for h in found if place[h] >= 0)

        super().__init__(hashes, _KEPT_TERMS)


def terms(text: str | None, cache: _Terms) -> np.ndarray:
    """The distinct hashed terms of a text."""
    words = set(_WORDS.findall((text or "").lower()))
    return np.fromiter(sorted({h for w in words for h in cache[w]}), np.int64)


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    bits: int

    def margin(self, x: np.ndarray) -> float:
        """Bias, weights, and the products of all pairs of vectors (half of what the square of the sum has beyond the
        squares)."""
        v = self.vectors[x]
        s = v.sum(0)
        return float(self.bias + self.weights[x].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))

    def score(self, x: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30))))


def _part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A cell's part of a likelihood ratio."""
    return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)


def _cells(n: np.ndarray, pos: np.ndarray, rate: float) -> np.ndarray:
    """The parts of the cells with n rows, pos of them toxic, if `rate` of all are."""
    return 2 * (_part(pos, n * rate) + _part(n - pos, n * (1 - rate)))


def screen(rows: list[np.ndarray], labels: np.ndarray, bits: int, least_rows: int = 3, least_ratio: float = 16.0, most_terms: int = 1024, least_gain: float = 40.0, least_cell: int = 5) -> np.ndarray:
    """Which hashes are terms of the model: a mask. A term's own ratio (G2) compares the label with holding the term; a
    pair's gain is the ratio of the label with the four ways of holding two terms, less the two terms' own."""
    n, rate = float(len(rows)), labels.sum() / len(rows)
    size = 1 << bits
    df, pos = np.zeros(size), np.zeros(size)
    for x, y in zip(rows, labels, strict=True):
        df[x] += 1
        pos[x] += y
    ratio = _cells(df, pos, rate) + _cells(n - df, labels.sum() - pos, rate)
    kept = (df >= least_rows) & (ratio >= least_ratio)

    some = np.flatnonzero((df >= 2 * least_cell) & (df <= n - 2 * least_cell))
    some = some[np.argsort(-df[some], kind="stable")[:most_terms]]
    place = np.full(size, -1)
    place[some] = np.arange(len(some))
    held = np.zeros((len(rows), len(some)), np.float32)
    for i, x in enumerate(rows):
        at = place[x]
        held[i, at[at >= 0]] = 1
    both, both_pos = (held.T @ held).astype(float), (held.T @ (held * labels[:, None].astype(np.float32))).astype(float)
    d, p = df[some], pos[some]
    gain, least = -(ratio[some][:, None] + ratio[some][None, :]), np.full(both.shape, np.inf)
    for rows_of, toxic in ((both, both_pos), (d[:, None] - both, p[:, None] - both_pos), (d[None, :] - both, p[None, :] - both_pos), (n - d[:, None] - d[None, :] + both, labels.sum() - p[:, None] - p[None, :] + both_pos)):
        gain += _cells(rows_of, toxic, rate)
        least = np.minimum(least, rows_of)
    kept[some[((gain >= least_gain) & (least >= least_cell)).any(1)]] = True
    return kept


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = 18, factors: int = 8, epochs: int = 20, rate: float = 0.3, pair_rate: float = 0.05, l2: float = 1e-3, seed: int = 3, most_terms: int = 1024) -> FactorizationMachine:
    """AdaGrad on logistic loss, one row at a time in a seeded order, from the base rate's log odds."""
    rng = np.random.default_rng(seed)
    n = 1 << bits
    m = FactorizationMachine(0.0, np.zeros(n), np.zeros((n, factors)), bits)
    toxic = labels.sum() if len(rows) else 0
    if not 0 < toxic < len(rows):
        m.bias = 4.0 if toxic else -4.0
        return m
    kept = screen(rows, labels, bits, most_terms=most_terms)
    m.vectors[kept] = rng.normal(0, 0.05, (int(kept.sum()), factors))
    m.bias = float(np.log(toxic / (len(rows) - toxic)))
    rows = [x[kept[x]] for x in rows]
    gw, gv, gb = np.full(n, 1e-2), np.full((n, factors), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            g = m.score(x) - labels[i]
            gb += g * g
            m.bias -= 0.02 * g / np.sqrt(gb)
            if not len(x):
                continue
            step = g + l2 * m.weights[x]
            gw[x] += step * step
            m.weights[x] -= rate * step / np.sqrt(gw[x])
            v = m.vectors[x]
            step = g * (v.sum(0) - v) + l2 * v
            gv[x] += step * step
            m.vectors[x] -= pair_rate * step / np.sqrt(gv[x])
    return m


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, bits: int = 18, **kw) -> FactorizationMachine:
    """The model, from at most max_rows labelled rows that are not held out."""
    gold = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    gold = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    cache_bits = bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Terms(cache_bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t.as_py(), cache).astype(np.int32) for t in b.column(2)], pa.list_(pa.int32()))], names=["doc_id", "toxic", "x"])

    # the labelled rows are few by their bound, so their ids may be broadcast
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(gold), "doc_id")
    one = some.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    found = one.select("doc_id", "toxic", "text").mapInArrow(lean(run), "doc_id long, toxic int, x array<int>").toArrow()
    found = found.sort_by("doc_id")
    rows = [x.values.to_numpy() for x in found.column("x")]  # views of one flat array
    return fit(rows, found.column("toxic").to_numpy().astype(float), bits, **kw)


def _share(docs: DataFrame, model: FactorizationMachine) -> Broadcast:
    """The terms that a model has; a few thousand at most, for each must be uneven among max_rows rows."""
    at = np.flatnonzero((model.weights != 0) | model.vectors.any(1))
    return docs.sparkSession.sparkContext.broadcast((model.bias, at, model.weights[at], model.vectors[at], model.bits))


def _scorer(shared: Broadcast) -> Callable[[str | None], float]:
    bias, at, weights, vectors, bits = shared.value
    place = np.full(1 << bits, -1, np.int32)
    place[at] = np.arange(len(at))
    m, cache = FactorizationMachine(bias, weights, vectors, bits), _Terms(bits, place)
    return lambda text: m.score(terms(text, cache))


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = _share(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared)
        for b in batches:
            got = np.array([scored(t.as_py()) for t in b.column(2)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)


def keep_clean(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    shared = _share(docs, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared)
        for b in batches:
            yield b.filter(pa.array([scored(t.as_py()) < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
