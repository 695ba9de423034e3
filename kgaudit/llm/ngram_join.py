"""Similarity join of documents on word n-grams: MinHash banding, then full n-gram sets.

One pass gives each document a hash of its n-gram set, its band hashes and a byte of each MinHash. Documents with equal
sets are one class of copies from here on. Number of bands and rows follow from the wanted recall at the threshold. Sets
that share a band hash meet in a shuffle on band hashes. In a bucket of at most SMALL sets each pair is a candidate, if
the bytes of their MinHashes don't say that it is far from alike (six deviations below the threshold, so that no match
is lost); most buckets that chance makes fall away here, and can't tie groups to one another. In a larger bucket each
set is a candidate with the least one, and none falls away. The components of these candidates are verified on full
n-gram sets: only their texts are fetched (by a bitmap of fixed size and a join), and a component is compared by products
of incidence matrices, in blocks of at most BLOCK sets: a larger one is dealt to pairs of blocks in many tasks. No pairs
are emitted: a block gives for each set the number of its links and one link to the least set that it is connected with.
So rows stay linear in the input, and no link within a component is lost.

Defined cases: words are runs of letters, digits and underscore in lower case; a document of one to four words is one
n-gram; documents without words (null, empty) are copies of one another. Repeated rows are copies. Null ids are allowed;
the class of documents whose ids are all null is null. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.llm.memory import lean
from kgaudit.llm.shingles import WordHashes, bitmap, hits, mix, ngrams
from kgaudit.operators.graph import components
from kgaudit.session import discard, materialize

BLOCK = 1024
_COLUMNS = 2048
#: Sets in a bucket up to which all its pairs are looked at, and deviations below the threshold that rule a pair out.
SMALL, DEVIATIONS = 8, 6.0


def bands_for(threshold: float, recall: float, most_hashes: int = 144) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold shares some band with the wanted
    probability, within so many hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most_hashes):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 1 << 32, n, np.uint32)[:, None]
        self.by = (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.weights = rng.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, bands, np.uint64)

    def band_hashes(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        """A hash for each band, and the low byte of each MinHash."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.xor), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), 1024):  # stays in cache
            least = np.minimum(least, ((x[None, a : a + 1024] ^ self.xor) * self.by).min(1))
        cells = least.reshape(self.bands, self.rows).astype(np.uint64)
        return mix((cells * self.weights).sum(1, dtype=np.uint64) + self.salt).astype(np.int64), least.astype(np.uint8).tobytes()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, k1, k2 (hash of the n-gram set), bands, signs (a byte of each MinHash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, cache = MinHash(bands, rows), WordHashes()
        for b in batches:
            keys, found, signs = [], [], []
            for t in b.column(2):
                g = ngrams(t.as_py(), cache, n)
                keys.append(xxhash.xxh3_128_intdigest(g.tobytes()))
                bands_, signs_ = made.band_hashes(g) if len(g) else (None, None)
                found.append(bands_), signs.append(signs_)
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([signed(k >> 64) for k in keys], pa.int64()), pa.array([signed(k & (1 << 64) - 1) for k in keys], pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["doc_id", "text_key", "k1", "k2", "bands", "signs"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(lean(run), "doc_id long, text_key long, k1 long, k2 long, bands array<long>, signs binary")


def likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """src, dst of pairs (src, dst, a, b) whose signs agree about as often as those of sets at the threshold do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
                n, p = a.shape[1], threshold + (1 - threshold) / 256
                near = (a == c).sum(1) >= n * p - DEVIATIONS * math.sqrt(n * p * (1 - p))
                yield b.select([0, 1]).filter(pa.array(near))

    return pairs.select("src", "dst", "a", "b").mapInArrow(lean(run), "src long, dst long")


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """src, dst: pairs of sets that meet in a bucket, all of small buckets but those that are far from alike, and those
    with the least set of large ones."""
    held = sets.select("sid", F.posexplode("bands").alias("band", "hash")).select("sid", F.xxhash64("band", "hash").alias("bucket"))
    sized = held.groupBy("bucket").agg(F.min("sid").alias("least"), F.count("*").alias("n")).filter("n > 1")
    met = materialize(held.join(sized, "bucket"), "buckets")
    large = met.filter(f"n > {SMALL} and sid <> least").select(F.col("sid").alias("src"), F.col("least").alias("dst"))
    small = met.filter(f"n <= {SMALL}").groupBy("bucket").agg(F.sort_array(F.collect_list("sid")).alias("s"))  # SMALL at most
    each = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, SMALL), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    pairs = small.select(F.explode(each).alias("p")).select("p.src", "p.dst").distinct()
    signs = lambda end, name: sets.select(F.col("sid").alias(end), F.col("signs").alias(name))
    near = likely(pairs.join(signs("src", "a"), "src").join(signs("dst", "b"), "dst"), threshold)
    out = materialize(near.union(large.distinct()), "candidates")
    discard(met)
    return out


def _links(own: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs (own x other, or own x own) have Jaccard similarity of at least the threshold."""
    sets = own if other is None else own + other
    sizes = np.array([len(x) for x in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, gram, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[gram] > 1
    doc, gram = doc[shared], gram[shared]
    place = np.cumsum(seen > 1) - 1
    gram = place[gram]
    order = np.argsort(gram, kind="stable")
    doc, gram = doc[order], gram[order]
    m = len(own)
    both = np.zeros((m, m if other is None else len(other)), np.float32)
    last = int(gram[-1]) + 1 if len(gram) else 0
    for a in range(0, last, _COLUMNS):
        lo, hi = np.searchsorted(gram, (a, a + _COLUMNS))
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[doc[lo:hi], gram[lo:hi] - a] = 1
        both += part[:m] @ (part[:m] if other is None else part[m:]).T
    union = sizes[:m, None] + (sizes[:m] if other is None else sizes[m:])[None, :] - both
    near = both >= threshold * union - 1e-6
    if other is None:
        np.fill_diagonal(near, False)
    return near


def _roots(near: np.ndarray) -> np.ndarray:
    """The least member that each is connected with, given a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(rows: DataFrame, threshold: float, n: int) -> DataFrame:
    """sid, links (documents that its set is linked with), root, from rows (bin, grp, i, j, block, sid, copies, text)
    dealt to bins. A group is compared within its bin."""

    def run(table: pa.Table) -> pa.Table:
        cache = WordHashes()
        col = {c: table.column(c).to_pylist() for c in ("grp", "i", "j", "block", "sid", "copies")}
        groups: dict[tuple, dict[int, int]] = {}
        for at, key in enumerate(zip(col["grp"], col["i"], col["j"], strict=True)):
            groups.setdefault(key, {}).setdefault(col["sid"][at], at)  # a set once, whatever rows repeat it
        texts = table.column("text")
        out: tuple[list, list, list] = ([], [], [])
        for (_, i, j), members in groups.items():
            order = [members[s] for s in sorted(members)]
            sets = [ngrams(texts[at].as_py(), cache, n) for at in order]
            sids = np.array([col["sid"][at] for at in order])
            copies = np.array([col["copies"][at] for at in order], np.int64)
            if i == j:
                near = _links(sets, None, threshold)
            else:
                first = np.array([col["block"][at] == i for at in order])
                near = np.zeros((len(sets), len(sets)), bool)
                if first.any() and not first.all():
                    cross = _links([s for s, f in zip(sets, first, strict=True) if f], [s for s, f in zip(sets, first, strict=True) if not f], threshold)
                    near[np.ix_(first, ~first)] = cross
                    near[np.ix_(~first, first)] = cross.T
            out[0].extend(sids.tolist())
            out[1].extend((near @ copies).tolist())
            out[2].extend(sids[_roots(near)].tolist())
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["sid", "links", "root"])

    return rows.groupBy("bin").applyInArrow(run, "sid long, links long, root long")


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy_id (least id with an equal n-gram set), class_id (least id in its component of links), n_links
    (other documents at the threshold or above), text_key (hash of the text, tells rows of one id apart), component (its
    least set; tells classes apart whose class_id is equal or null, and holds for this result only)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    bands, per = bands_for(threshold, recall)
    signed = materialize(signatures(rows, n, bands, per), "signatures")
    sets = signed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("copy_id"), F.min(F.struct("text_key", "doc_id")).alias("rep"), F.any_value("bands").alias("bands"), F.any_value("signs").alias("signs"))
    sets = materialize(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")  # written, so that ids stay

    linked = candidates(sets, threshold)
    groups = components(linked)

    # blocks of large groups; a group of one block has the one pair (0, 0)
    sized = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = groups.join(sized, "component").join(sets.select("sid", "copies", "rep"), F.col("node") == F.col("sid"))
    members = members.select("sid", "copies", F.col("component").alias("grp"), "blocks", F.col("rep.text_key").alias("rep_key"), F.col("rep.doc_id").alias("rep_id"))
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")), "members")
    few = members.count()
    if few:
        bits = bitmap(members.select("rep_key"), lambda b: b.column(0).to_numpy())

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(hits(bits.value, b.column(1).to_numpy())))

        texts = rows.mapInArrow(lean(wanted), "doc_id long, text_key long, text string")
        texts = texts.join(members, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = texts.select("grp", "block", "sid", "copies", "text", other.alias("k")).select("grp", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "sid", "copies", "text")
        dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(max(1, few // 1024))))
        found = materialize(compare(dealt, threshold, n), "links")
        bits.destroy()
    else:
        found = sets.sparkSession.createDataFrame([], "sid long, links long, root long")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    tied = components(found.filter("sid <> root").select(F.col("sid").alias("src"), F.col("root").alias("dst")))
    named = sets.select("k1", "k2", "sid", "copies", "copy_id").join(links, "sid", "left").join(tied, F.col("sid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    named = named.join(least, "component").select("k1", "k2", "copy_id", "class_id", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = materialize(signed.select("doc_id", "text_key", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "copy_id", "class_id", "n_links", "text_key", "component"), "classes")
    for scratch in (signed, sets, linked, groups, members, found, tied):
        discard(scratch)
    return out


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each component, with all its columns: that with the least id (null after all others), and of rows
    with this id the one with the least text hash. Rows alike in id and text are one document."""
    found = join(docs, id_col=id_col, text_col=text_col, **kw)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = found.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("least"))
    keep = first.select(F.col("least.doc_id").alias("__id"), F.col("least.text_key").alias("__key"))
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__key": F.xxhash64(text)})
    kept = keyed.join(keep, keyed["__id"].eqNullSafe(keep["__id"]) & (keyed["__key"] == keep["__key"]), "left_semi")
    return kept.drop("__id", "__key")


#: The same rows by all pairs of n-gram sets that share an n-gram.
ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM w),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY copy_id, g) AS sid, g, len(g) AS n, c, copy_id FROM (SELECT g, count(*) AS c, min(doc_id) AS copy_id FROM g GROUP BY g)),
u AS (SELECT sid, n, unnest(g) AS x FROM s),
p AS (SELECT a.sid AS i, b.sid AS j, a.n AS ni, b.n AS nj, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.sid <> b.sid GROUP BY ALL),
l AS MATERIALIZED (SELECT i, j FROM p WHERE n >= 0.8 * (ni + nj - n) - 1e-9),
r(sid, other) AS (SELECT sid, sid FROM s UNION SELECT r.sid, l.j FROM r JOIN l ON l.i = r.other),
k AS (SELECT r.sid, min(o.copy_id) AS class_id FROM r JOIN s o ON o.sid = r.other GROUP BY r.sid),
f AS (SELECT l.i AS sid, sum(o.c) AS links FROM l JOIN s o ON o.sid = l.j GROUP BY l.i)
SELECT g.doc_id, s.copy_id, k.class_id, (s.c - 1 + coalesce(f.links, 0))::BIGINT AS n_links FROM g JOIN s ON s.g = g.g JOIN k ON k.sid = s.sid LEFT JOIN f ON f.sid = s.sid
"""
