"""Secrets, judged by who owns them across the corpus.

A scan finds candidates in each text. Their hashes are counted over the whole corpus by distinct repository and
distinct owner: a value that several owners share, or that many repositories of one owner hold, is a copied example; one
that a single owner holds in few repositories, and whose signs look random, is taken for live. Candidates outside the
exact patterns ("token") become spans only with that verdict. Only hashes are counted and stored, never the values. Where
the rows have no columns for owner and repository, the source stands for the owner and the document for the repository;
the registered query does so, and its columns say so.

Copies of one value in a third of all rows meet as partial sums, for each count is a groupBy with map-side combine.

Defined cases: a null or empty text has no spans; a null owner or repository counts as one owner of its own; repeated
rows are each reported and count once. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.llm.memory import lean
from kgaudit.llm.spans import digest, join_spans
from kgaudit.session import materialize

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token")

_ASSIGN = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_FOUND = "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:int,end:int,hash:string,random:boolean>>"


def entropy(value: str) -> float:
    """Bits a sign."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def looks_random(value: str) -> bool:
    return len(value) >= 16 and entropy(value) >= 3.0 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def find_base(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the exact patterns, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return out


def find(text: str | None) -> list[tuple[str, int, int, str]]:
    """Base spans, and other long runs with letters, digits and a random look that touch none of them."""
    if not text:
        return []
    base = find_base(text)
    more = [("token", *m.span(), m[0]) for m in _TOKEN.finditer(text) if looks_random(m[0]) and entropy(m[0]) >= 3.5]
    if base and more:
        order = sorted((s, e) for _, s, e, _ in base)
        starts, reach = [s for s, _ in order], list(accumulate((e for _, e in order), max))
        # of the base spans that begin before a run's end, does any reach beyond its start?
        more = [x for x in more if not (at := bisect_left(starts, x[2])) or reach[at - 1] <= x[1]]
    return base + more


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())]))
    for batch in batches:
        rows = [find(t.as_py()) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(2),
                *(pa.array([sum(x[0] == k for x in r) for r in rows], pa.int64()) for k in BASE_KINDS),
                pa.array([digest(join_spans([x[:3] for x in r if x[0] != "token"], KINDS)) for r in rows], pa.string()),
                pa.array([[{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "random": looks_random(v)} for k, s, e, v in r] for r in rows], kinds),
            ],
            names=["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row a document with the spans found in it, numbered; written once, so that the numbers stay and two later
    steps may read it."""
    found = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{owner_col}` as string) owner", f"cast(`{repo_col}` as string) repo", f"cast(`{text_col}` as string) text").mapInArrow(lean(_scan), _FOUND)
    return materialize(found.withColumn("at", F.monotonically_increasing_id()), "secret-candidates")


def ownership(found: DataFrame, example_owners: int = 3, example_repos: int = 10) -> DataFrame:
    """hash, owners, repos, verdict: 'example' from so many distinct owners or repositories on, 'live' for one owner
    and a random look, else 'shared'."""
    one = found.select("owner", "repo", F.explode("spans").alias("s")).select("owner", "repo", F.col("s.hash").alias("hash"), F.col("s.random").alias("random"))
    by_repo = one.groupBy("hash", "owner", "repo").agg(F.max("random").alias("random"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("random").alias("random"))
    total = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("random").alias("random"))
    verdict = F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("shared")
    return total.select("hash", "owners", "repos", verdict.alias("verdict"))


def scan(docs: DataFrame, example_owners: int = 3, example_repos: int = 10, **cols: str) -> DataFrame:
    """A row a document: counts and digest of base spans, all spans joined, how many of its candidates are live or
    copied examples, the number of its spans, and of its candidates the most owners and repositories that hold one."""
    found = candidates(docs, **cols)
    owned = materialize(ownership(found, example_owners, example_repos), "secret-owners")  # a table: then a hash that very many rows hold can be split
    some = found.filter(F.size("spans") > 0).select("at", F.explode("spans").alias("s"))
    judged = some.join(owned, F.col("s.hash") == F.col("hash"))
    order = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("s.kind"))
    kept = F.when((F.col("s.kind") != "token") | (F.col("verdict") == "live"), F.struct(F.col("s.start").alias("start"), order.alias("k"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")))
    is_ = lambda verdict: F.sum((F.col("verdict") == verdict).cast("long"))
    each = judged.groupBy("at").agg(F.sort_array(F.collect_list(kept)).alias("kept"), is_("live").alias("n_live"), is_("example").alias("n_example"), F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"))
    joined = F.array_join(F.transform("kept", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    each = each.select("at", joined.alias("joined"), F.size("kept").cast("long").alias("n_total"), "n_live", "n_example", "most_owners", "most_repos")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_live", "n_example", "n_total", "most_owners", "most_repos")]
    return found.join(each, "at", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("joined", F.lit("")).alias("spans"), *counts)
