"""Streaming faces: incremental ingestion with a ledger, windowed counts, a stateful limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kgaudit.operators.limiter import admit
from kgaudit.session import exists


def ingest(spark: SparkSession, folder: str, schema, ledger_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files_per_batch: int = 10, **options: str) -> StreamingQuery:
    """Reads new parquet files in batches, gives rows (id, text) with an unseen hash to the sink, and then adds them to
    the ledger, in this order: what failed isn't in the ledger and comes again. Ledger files carry the number of their
    batch, so a batch that is repeated after a failure overwrites its own."""

    def batch(df: DataFrame, number: int) -> None:
        new = df.select("id", "text", F.sha2("text", 256).alias("sha")).dropDuplicates(["id", "sha"])
        if exists(spark, ledger_path):
            seen = spark.read.schema("id long, sha string").parquet(f"{ledger_path}/*").filter(F.col("_metadata.file_path").contains(f"/batch={number}/") == F.lit(False))
            new = new.join(seen, ["id", "sha"], "left_anti")
        new = new.persist()
        sink(new, number)
        new.select("id", "sha").write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")
        new.unpersist()

    stream = spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, **options).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day", time: str = "ts", key: str = "event_type") -> DataFrame:
    """start, key, n, total of tumbling windows; rows later than the watermark are dropped in a stream."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def limited(requests: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """The limiter as a stream: key, request_id, at, admitted. State: the admissions of the last window."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(pdfs)).sort_values(["at", "request_id"], kind="stable")
        rows["admitted"] = admit(rows["at"].tolist(), limit, window, held=held)
        state.update((list(held),))
        yield rows[["key", "request_id", "at", "admitted"]]

    return requests.select("key", "request_id", F.col("at").cast("double").alias("at")).groupBy("key").applyInPandasWithState(run, "key long, request_id long, at double, admitted double", "held array<double>", "append", GroupStateTimeout.NoTimeout)
