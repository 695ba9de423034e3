"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL expressions alone.

A paragraph is a line; a line of more than WORDS words is cut after every WORDS words. The distinct digests of a text
go into a sketch of 48 cells, three cells each (one in each third): a cell holds how many digests it got, their xor,
and the xor of their check hashes. The fingerprint is the whole sketch, written out.

Two sketches subtract cell by cell, which leaves the digests that only one of the texts has. Peeling finds a cell with
one digest, takes the digest out of its three cells, and goes on until all cells are empty. If cells are left, or too few
are empty from the start, the difference is too large for the sketch, and the pair is sketched anew with cells for the
size of the difference. That is estimated from the share of empty cells, or, if there are none, from a stratum: the
digests whose hash falls into one of so many classes that about 32 of both texts do, sketched, subtracted and peeled by
themselves. The new sketch is one of many small ones: digests are dealt to groups by
hash, 24 cells for every 6 digests that are expected to differ, and each group is subtracted and peeled apart. A group
that fails is dealt to 4, 16, 64, 256 with other hashes. Lists of more than LEAF digests are dealt to 64 lists first, level
by level, so that no group looks through all of a long text and the work stays in proportion to its length. So every
digest that differs is recovered by peeling, and likeness is 1 - differing / all digests of both.

The next document of each is found without a global sort in one task: ids are cut into ranges by approximate
quantiles, an id that fills several of them is cut by text hash, each part is sorted apart, and the head of the part that
follows is added to it as its last row.

Defined cases: a null text is empty; an empty text has no paragraphs, an empty sketch, and likeness 1 to another empty
text. Null ids come last in the descending order. Rows with equal ids follow one another in the order of a hash of
their text; rows alike in both keep their own results. A single row is its own next. No rows give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.session import width

WORDS = 24
THIRD, SMALL = 16, 8
ROUNDS = 16
#: Digests that are expected to differ in a group of 24 cells, and digests of both texts in a stratum.
PER_GROUP, PER_STRATUM = 6, 32
#: With so few empty cells of 48 the difference is some 40 digests or more, which 48 cells can't tell apart.
LEAST_EMPTY = 4
#: Digests of both texts in a list that groups are taken from.
LEAF, FAN = 1024, 64
_PIECE = rf"\\S+(?:[^\\S\\n]+\\S+){{0,{WORDS - 1}}}"
_EMPTY = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def digests(text: str) -> str:
    """SQL: the distinct paragraph digests of a text."""
    return f"array_distinct(transform(regexp_extract_all({text}, '{_PIECE}', 0), p -> xxhash64(p)))"


def signed(a: str, b: str) -> str:
    """SQL: digests of a text, and with a minus those of another."""
    return f"concat(transform({a}, d -> named_struct('n', 1, 'd', d)), transform({b}, d -> named_struct('n', -1, 'd', d)))"


def _places(hash_: str, third: int) -> str:
    """SQL: fields with the check hash and the cell in each third, all taken from one hash of a digest."""
    return ", ".join([f"'h', shiftrightunsigned({hash_}, 32)", *(f"'p{j}', CAST(shiftrightunsigned({hash_}, {8 * j}) & {third - 1} AS INT)" for j in range(3))])


def sketch(signed_digests: str, seed: int = 1, third: int = THIRD) -> str:
    """SQL: the cells of signed digests (n, d). The entries are bound first, lest they be made anew for each cell."""
    hashed = f"transform({signed_digests}, e -> named_struct('n', e.n, 'd', e.d, 'y', xxhash64(e.d, {seed})))"
    entries = f"transform({hashed}, e -> named_struct('n', e.n, 'd', e.d, {_places('e.y', third)}))"
    add = "named_struct('n', s.n + e.n, 'k', s.k ^ e.d, 'h', s.h ^ e.h)"
    thirds = ", ".join(f"transform(sequence(0, {third - 1}), c -> aggregate(filter(v, e -> e.p{j} = c), {_EMPTY}, (s, e) -> {add}))" for j in range(3))
    return f"transform(array({entries}), v -> concat({thirds}))[0]"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def empty_cells(cells: str) -> str:
    """SQL: how many cells are empty."""
    return f"size(filter({cells}, x -> x.n = 0 AND x.k = 0 AND x.h = 0))"


def peel(cells: str, seed: int = 1, third: int = THIRD) -> str:
    """SQL: how many digests the cells hold; null if cells are left."""
    single = f"transform(filter(s.c, x -> x.n = 1 OR x.n = -1), x -> named_struct('n', x.n, 'd', x.k, 'h', x.h, 'y', xxhash64(x.k, {seed})))"
    pure = f"array_distinct(transform(filter({single}, x -> shiftrightunsigned(x.y, 32) = x.h), x -> named_struct('n', x.n, 'd', x.d, {_places('x.y', third)})))"
    out = "named_struct('n', y.n - e.n, 'k', y.k ^ e.d, 'h', y.h ^ e.h)"
    thirds = ", ".join(f"transform(slice(s.c, {j * third + 1}, {third}), (x, i) -> aggregate(filter(u, e -> e.p{j} = i), x, (y, e) -> {out}))" for j in range(3))
    step = f"named_struct('c', concat({thirds}), 'm', s.m + size(u), 'stop', false)"
    one = f"transform(array({pure}), u -> if(size(u) = 0, named_struct('c', s.c, 'm', s.m, 'stop', true), {step}))[0]"
    left = "exists(z.c, x -> x.n <> 0 OR x.k <> 0 OR x.h <> 0)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('c', {cells}, 'm', 0, 'stop', false), (s, r) -> if(s.stop, s, {one}), z -> if({left}, CAST(NULL AS INT), z.m))"


def expected(w: str, empty: str) -> str:
    """SQL: how many of signed digests are expected to differ, given the empty cells of the sketch that was too small. A
    stratum that can't be peeled holds more than it has cells for."""
    strata = f"CAST(pow(2, ceil(log2(greatest(1, size({w}) / {PER_STRATUM})))) AS INT)"
    found = f"coalesce({peel(sketch(f'filter({w}, e -> pmod(xxhash64(e.d, 3), t) = 0)'))}, {3 * THIRD})"
    stratum = f"transform(array({strata}), t -> greatest({PER_STRATUM}, t * {found}))[0]"
    return f"if({empty} > 1, CAST(ceil(ln({empty} / {3 * THIRD}) / ln({THIRD - 1} / {THIRD})) AS INT), {stratum})"


def leaves(w: str) -> str:
    """SQL: signed digests in lists of about LEAF or fewer, dealt by hash level by level."""
    levels = f"CAST(ceil(ln(size({w}) / {LEAF}) / ln({FAN})) AS INT)"
    split = f"aggregate(sequence(1, {levels}), array({w}), (s, l) -> flatten(transform(s, o -> transform(sequence(0, {FAN - 1}), k -> filter(o, e -> pmod(xxhash64(e.d, 20 + l), {FAN}) = k)))))"
    return f"if(size({w}) <= {LEAF}, array({w}), {split})"


def grouped(w: str, n: str) -> str:
    """SQL: how many of signed digests differ, from groups for n of them."""
    add = "0, (q, x) -> q + x"
    again = lambda parts, seed: f"aggregate(transform(sequence(0, {parts - 1}), f -> {peel(sketch(f'filter(o, e -> pmod(xxhash64(e.d, {seed}), {parts}) = f)', seed + 1, SMALL), seed + 1, SMALL)}), {add})"
    tries = [peel(sketch("o", 5, SMALL), 5, SMALL), *(again(4**i, 5 + 2 * i) for i in range(1, 5)), "CAST(raise_error('cells are left') AS INT)"]
    one = f"transform(array(filter(v, e -> e.g = g)), o -> coalesce({', '.join(tries)}))[0]"
    dealt = "transform(leaf, e -> named_struct('n', e.n, 'd', e.d, 'g', pmod(xxhash64(e.d, 6), t)))"
    of_leaf = f"transform(array({dealt}), v -> aggregate(transform(sequence(0, t - 1), g -> {one}), {add}))[0]"
    count = f"greatest(1, CAST(ceil({n} / size(lists) / {PER_GROUP}) AS INT))"
    return f"transform(array({leaves(w)}), lists -> transform(array({count}), t -> aggregate(transform(lists, leaf -> {of_leaf}), {add}))[0])[0]"


def differing(a: str, b: str, cells_a: str, cells_b: str) -> Column:
    """How many digests only one of two texts has: by their sketches, or by larger ones."""
    first = f"if({empty_cells('c')} < {LEAST_EMPTY}, CAST(NULL AS INT), {peel('c')})"
    larger = f"transform(array({signed(a, b)}), w -> transform(array({expected('w', empty_cells('c'))}), n -> {grouped('w', 'n')})[0])[0]"
    return F.expr(f"transform(array({subtract(cells_a, cells_b)}), c -> coalesce({first}, {larger}))[0]")


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> Column:
    both = F.expr(f"size({a}) + size({b})")
    return F.when(both == 0, 1.0).otherwise(1.0 - differing(a, b, cells_a, cells_b) / both)


def as_text(cells: str) -> Column:
    """The whole sketch: four bytes of a cell's count, eight of its digests, four of its checks, cell after cell, in
    base 64. Sketches read from it may be subtracted and peeled like any."""
    return F.expr(f"base64(unhex(array_join(transform({cells}, x -> concat(lpad(hex(x.n), 8, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 8, '0'))), '')))")


def with_next(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, object]:
    """doc_id, text, part, guest, next: each text with that of the next document in descending order of id. A guest is
    the head of another part, there to be the last one's next. Also the window in which rows follow one another."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(lowest)))
    parts = parts or 2 * width(spark)
    # as many values as there are parts come to the driver
    found = Counter(rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("c")).first()["c"] or [])
    cuts = sorted(found)
    # parts are numbered in the descending order; a key that is a cut several times has as many parts, by text hash
    shares = [found[c] if found[c] > 1 else 0 for c in cuts] + [0]
    first = [0] * len(shares)
    for i in range(len(cuts) - 1, -1, -1):
        first[i] = first[i + 1] + shares[i + 1] + 1
    count = first[0] + shares[0] + 1
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    part, at_hash = F.lit(0), F.lit(0).cast("long")
    if cuts:
        rows = rows.withColumn("range", F.size(F.filter(literal(cuts), lambda c: c < F.col("key"))))
        part = F.get(literal(first), F.col("range"))
        if any(shares):
            share = F.get(literal(shares), F.col("range"))
            hot = (share > 0) & (F.col("key") == F.get(literal([*cuts, lowest]), F.col("range")))
            inside = F.least(share - 1, F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * share).cast("int"))
            part, at_hash = part + F.when(hot, inside).otherwise(share), F.when(hot, F.xxhash64("text")).otherwise(at_hash)
    rows = rows.select("doc_id", "text", "key", part.cast("int").alias("part"), at_hash.alias("at_hash"), F.lit(0).alias("guest"))
    heads = {r["part"]: (r["k"], r["h"]) for r in rows.groupBy("part").agg(F.max("key").alias("k")).join(rows.select("part", "key", "at_hash").groupBy("part").agg(F.min("at_hash").alias("h")), "part").collect()}
    if heads:
        order = sorted(heads)
        to = {p: order[i - 1] for i, p in enumerate(order)}
        of = lambda f: F.get(literal([f(p) for p in range(count)]), F.col("part"))
        is_head = (F.col("key") == of(lambda p: heads.get(p, (None, None))[0])) & (F.col("at_hash") == of(lambda p: heads.get(p, (None, None))[1]))
        # a guest is needed once; of several rows that may be it, the first in order
        guests = rows.filter(is_head).groupBy("part", "key").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.xxhash64("text"), "text")).alias("x"))
        rows = rows.unionByName(guests.select("x.doc_id", "x.text", "key", of(lambda p: to.get(p)).alias("part"), F.lit(0).cast("long").alias("at_hash"), F.lit(1).alias("guest")))
    window = Window.partitionBy("part").orderBy("guest", F.desc("key"), F.xxhash64("text"))
    return rows.withColumn("next", F.lead("text").over(window)), window


def fingerprints(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, window = with_next(docs, **kw)
    cut = "cast(floor(length(text) / 3) as int)"
    edited = F.concat(F.expr(f"left(text, length(text) - {cut})"), F.expr(f"left(next, {cut})"))
    rows = rows.select("doc_id", "key", "part", "guest", "text", F.length("text").cast("long").alias("n_chars"), F.coalesce(edited, F.col("text")).alias("edited"))
    rows = rows.select("doc_id", "key", "part", "guest", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(digests("text")).alias("a"), F.expr(digests("edited")).alias("e"))
    rows = rows.withColumn("b", F.lead("a").over(window)).filter("guest = 0").select("doc_id", "n_chars", "edited_sha256", "a", "e", F.coalesce("b", "a").alias("b"))
    none = "CAST(array() AS ARRAY<BIGINT>)"
    rows = rows.withColumns({f"c{x}": F.expr(sketch(signed(x, none))) for x in "aeb"})
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text("ca").alias("fingerprint"), as_text("ce").alias("edited_fingerprint"), likeness("a", "e", "ca", "ce").alias("near_edited"), likeness("a", "b", "ca", "cb").alias("near_next"))
