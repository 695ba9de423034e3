"""Hashed words and word n-grams as numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

from kgaudit.llm.memory import Recent, lean

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS = 100_000


class WordHashes(Recent):
    """64-bit hash of a word."""

    def __init__(self) -> None:
        super().__init__(lambda word: xxhash.xxh64_intdigest(word.encode()), KEPT_WORDS)


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscore, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def ngrams(text: str | None, cache: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a text of fewer words is one n-gram; none has none."""
    w = words(text)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(out)


BITS = 1 << 26
#: Ids that a task gathers before it cuts them up.
HELD = 1 << 19


def bitmap(rows: DataFrame, ids: Callable[[pa.RecordBatch], np.ndarray]) -> Broadcast:
    """A bitmap of BITS bits with the low bits of the ids that a function takes from the rows' batches, broadcast; its
    size is fixed. What it lets through is tested again by a join."""
    chunk = 1 << 16

    def cut(held: list[np.ndarray]) -> pa.RecordBatch:
        at = np.unique(np.concatenate(held))
        part = at // chunk
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(at) else []
        return pa.RecordBatch.from_arrays([pa.array([int(part[c]) for c in cuts], pa.int32()), pa.array([(x % chunk).astype("<u2").tobytes() for x in np.split(at, cuts[1:])] if len(at) else [], pa.binary())], names=["chunk", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(ids(b).astype(np.int64) & (BITS - 1))
            n += len(held[-1])
            if n >= HELD:
                yield cut(held)
                held, n = [], 0
        if held:
            yield cut(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at in zip(*(x.to_pylist() for x in b.columns), strict=True):
                bits = np.zeros(chunk, bool)
                bits[np.frombuffer(at, "<u2")] = True
                sums[k] = np.packbits(bits) | sums.get(k, np.uint8(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.mapInArrow(lean(run), "chunk int, at binary").repartition("chunk").mapInArrow(lean(merge), "chunk int, bits binary").collect():
        out[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.int64) & (BITS - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
