"""Global order without a task that holds all rows: range partitions, and what comes before each from a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.session import materialize, width


def _spread(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """Rows range-partitioned by some columns, written with the number of their part, so that it stays."""
    return materialize(df.repartitionByRange(width(df.sparkSession), *by).withColumn("__part", F.spark_partition_id()), "ordered")


def _by_part(values: dict[int, object], kind: str) -> Column:
    """The value of a row's part; there are as many parts as shuffle partitions."""
    return F.get(F.array(*[F.lit(values.get(p)).cast(kind) for p in range(max(values, default=0) + 1)]), F.col("__part"))


def numbered(df: DataFrame, by: list[Column | str], name: str = "number") -> DataFrame:
    """The rows with their place, from 0, in the order of some columns that tell rows apart."""
    rows, before, total = _spread(df, by), {}, 0
    for r in sorted(rows.groupBy("__part").count().collect()):  # a row for each part
        before[r["__part"]] = total
        total += r["count"]
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    return rows.withColumn(name, (place + _by_part(before, "long")).cast("long")).drop("__part")


def nearest(df: DataFrame, by: str, value: Column, last: str = "last", next: str = "next") -> DataFrame:
    """The rows with the latest value up to and with each, and the first from each on, nulls passed over, in the order of
    a column that tells rows apart. Values are whole numbers."""
    rows = _spread(df.withColumn("__value", value), [by])
    ends = rows.filter("__value is not null").groupBy("__part").agg(F.max_by("__value", by).alias("last"), F.min_by("__value", by).alias("first")).collect()  # a row for each part
    ends, parts = {r["__part"]: r for r in ends}, rows.agg(F.max("__part")).first()[0] or 0
    before, after, held = {}, {}, None
    for p in range(parts + 1):
        before[p], held = held, ends[p]["last"] if p in ends else held
    held = None
    for p in range(parts, -1, -1):
        after[p], held = held, ends[p]["first"] if p in ends else held
    w = Window.partitionBy("__part").orderBy(by)
    up_to = F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    from_on = F.first("__value", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.withColumns({last: F.coalesce(up_to, _by_part(before, "long")), next: F.coalesce(from_on, _by_part(after, "long"))}).drop("__part", "__value")
