"""Mixing sources to target weights by weighted fair queueing.

Each source has a target: its share of the budget by weight, at most `epochs` times its size, the excess going to the
others by weight. Its documents are put in a random but repeatable order, up to `epochs` passes long. A copy's virtual
finish time is the number of the source's words up to its end, divided by the source's target. All copies of all sources
are range-sorted by that time, and a running total of their words tells where the budget ends: at the virtual time of
the copy that uses it up. The mix is cut off there. What is left before the cut is served in the same order, a source up
to its target: the copy that a source is being served at the end is taken in part.

Nothing needs a source in one task. Orders are range partitions of narrow rows, cut by sampled bounds down to the row
itself, so a source, an id or a time with a third of all rows is many tasks' work. Each part is summed apart, and what
comes before it is added from a small table of parts. Only the part in which the budget ends is sorted through.

Defined cases: a null or empty text has size 0 and is taken 0 words of. A null source is a source of its own, last in
order. Rows that are alike are separate documents. Null ids are allowed; their place follows from the text. No rows give
no rows. Of the input columns only the three that are named are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.session import discard, materialize, width

#: A word is a run of signs other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3, share: float = 1.0) -> DataFrame:
    """source, source_size, target of each source, given source and size. Weights go round the sources by code point,
    null last. Water filling: sources reach their cap in the order of cap to weight; the rest share what is left. The
    table has a row for each source, not for each document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    all_rows, up_to = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(all_rows) * float(share)
    # words for each unit of weight, if all sources before this one are at their cap
    level = (budget - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    place = F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last()))
    held = F.when(level <= F.col("ratio"), F.struct(place.alias("place"), level.alias("level")))  # the first under its ratio holds
    per = per.withColumn("held", held)
    level = F.coalesce(F.min("held").over(all_rows)["level"], F.lit(float("inf")))
    return per.select("source", "source_size", F.least(level * F.col("weight"), F.col("cap")).alias("target"))


def sized(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """The narrow columns that the queue works on: doc_id, source, size, tie, and key, the place in the random order."""
    doc, tie = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    name = F.coalesce(doc.cast("string"), F.concat(F.lit("~"), tie.cast("string")))  # else all null ids had one place
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col(source_col).cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    return [doc.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), tie.alias("tie"), key.alias("key")]


def _spread(rows: DataFrame, by: Sequence[Column], name: str) -> DataFrame:
    """Rows range-partitioned by some columns, written with the number of their part, so that it stays."""
    spread = rows.repartitionByRange(width(rows.sparkSession), *by).withColumn("part", F.spark_partition_id())
    return materialize(spread, name)


def queue(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3, share: float = 1.0) -> DataFrame:
    """From written rows (those of sized() and row, a number of its own): row, doc_id, source, size, source_size,
    target, before: the words of the source that come before the document in one pass. From these follow the virtual
    times of all its copies."""
    placed = _spread(rows, [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")], "mix-order")
    by_part = placed.groupBy("source", "part").agg(F.sum("size").alias("size"))
    goal = targets(by_part, weights, epochs, share)
    in_order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.withColumn("offset", F.coalesce(F.sum("size").over(in_order), F.lit(0))).drop("size")
    offsets = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).select(offsets["source"].alias("s"), offsets["part"].alias("p"), "offset", "source_size", "target")
    inside = Window.partitionBy("part", "source").orderBy("key", F.col("doc_id").asc_nulls_last(), "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = own.join(offsets, own["source"].eqNullSafe(offsets["s"]) & (own["part"] == offsets["p"]))
    out = materialize(both.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("offset") + F.col("inside")).alias("before")), "mix-queued")
    discard(placed)
    return out


def _start(k: int) -> Column:
    """The words of the source before copy k."""
    return F.col("before") + k * F.col("source_size")


def _finish(k: int) -> Column:
    return F.try_divide(_start(k) + F.col("size"), F.col("target"))


def cut(q: DataFrame, epochs: int = 3) -> float:
    """The virtual time at which the budget, the sum of all targets in whole words, is used up: all copies are sorted by
    their finish, and the copy that takes the running total to the budget tells the time."""
    goals = q.groupBy("source").agg(F.max(F.floor("target")).alias("words"))
    budget = goals.agg(F.sum("words").alias("b")).first()["b"] or 0
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("copy"), _finish(k).alias("finish")) for k in range(epochs)]))
    copies = q.filter("size > 0 and target > 0").select("row", "size", each.alias("x")).select("row", "size", "x.copy", "x.finish")
    placed = _spread(copies, [F.col("finish"), F.col("row"), F.col("copy")], "mix-queue")
    total, time = 0, 0.0
    for part in sorted(placed.groupBy("part").agg(F.sum("size").alias("size")).collect(), key=lambda r: r["part"]):  # a row for each part
        if total + part["size"] >= budget:
            running = Window.orderBy("finish", "row", "copy").rowsBetween(Window.unboundedPreceding, -1)
            inside = placed.filter(F.col("part") == part["part"]).withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0)) + total)
            time = inside.filter(F.col("ahead") < budget).agg(F.max("finish").alias("t")).first()["t"]
            break
        total += part["size"]
    discard(placed)
    return time or 0.0


def _served(k: int, end: float) -> Column:
    """Words that copy k of a document is given, if it begins before the cut. The parts of one source sum up to its
    target, rounded down."""
    given = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")) - _start(k))).cast("long")
    return F.when(_start(k) < F.lit(end) * F.col("target"), given).otherwise(F.lit(0).cast("long"))


def _queued(docs: DataFrame, epochs: int, seed: int, id_col: str, text_col: str, source_col: str, **kw) -> tuple[DataFrame, float]:
    rows = docs.select(*sized(docs, seed, id_col, text_col, source_col)).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "mix-sizes")
    q = queue(rows, epochs=epochs, **kw)
    discard(rows)
    return q, cut(q, epochs)


def taken(docs: DataFrame, epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes, repeats counted; and the virtual finish
    time of the first copy."""
    q, end = _queued(docs, epochs, seed, id_col, text_col, source_col, **kw)
    total = sum((_served(k, end) for k in range(1, epochs)), _served(0, end))
    return q.select("doc_id", "size", "source_size", "target", total.alias("taken"), _finish(0).alias("finish"))


def copies(docs: DataFrame, epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: a row for each copy that is served, range-sorted by virtual finish time and cut off at the
    budget. doc_id, row (of the input), copy, words, finish."""
    q, end = _queued(docs, epochs, seed, id_col, text_col, source_col, **kw)
    each = F.array(*[F.struct(F.lit(k).alias("copy"), _served(k, end).alias("words"), _finish(k).alias("finish")) for k in range(epochs)])
    out = q.select("doc_id", "row", F.explode(F.filter(each, lambda x: x["words"] > 0)).alias("x")).select("doc_id", "row", "x.copy", "x.words", "x.finish")
    return out.orderBy("finish", "row", "copy")


def mixed(docs: DataFrame, epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The documents of the mix, whole and with all their columns, as often as they are taken: a copy that is served in
    part is in if that is half of it or more. Documents without words aren't in the mix."""
    whole = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-documents")
    rows = materialize(whole.select(*sized(docs, seed, id_col, text_col, source_col), F.col("__row").alias("row")), "mix-sizes")
    q = queue(rows, epochs=epochs, **kw)
    discard(rows)
    end = cut(q, epochs)
    times = sum(((_served(k, end) * 2 >= F.col("size")).cast("int") for k in range(1, epochs)), (_served(0, end) * 2 >= F.col("size")).cast("int"))
    often = q.filter("size > 0").select(F.col("row").alias("__of"), times.alias("__times")).filter("__times > 0")
    both = whole.join(often, F.col("__row") == F.col("__of"))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")


#: The same rows as taken() gives with its defaults, by one window a source; for ids that are distinct and not null.
ORACLE_SQL = """
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(concat_ws('|', '7', doc_id, source)), 1, 7))::BIGINT AS key FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM z GROUP BY source),
c AS (SELECT *, source_size::DOUBLE * 3.0::DOUBLE AS cap, source_size::DOUBLE * 3.0::DOUBLE / weight AS ratio FROM p),
l AS (SELECT *, row_number() OVER w AS place, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c WINDOW w AS (ORDER BY ratio, source NULLS LAST)),
t AS (SELECT source, source_size, least(coalesce((SELECT arg_min(level, place) FROM l WHERE level <= ratio), 'inf'::DOUBLE) * weight, cap) AS target FROM l),
q AS (SELECT z.doc_id, z.size, t.source_size, t.target, coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - before - source_size)) + greatest(0, least(size, floor(target) - before - 2 * source_size)))::BIGINT AS taken,
  CASE WHEN target <> 0 THEN (before + size) / target END AS finish FROM q
"""
