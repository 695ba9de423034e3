"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "kgaudit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. Settings that the cluster gives win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where a session has none, one is made on a
    single machine; a cluster has to name it."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kgaudit-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again. The writer commits whole
    tasks only, and the files outlive the executors that wrote them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that materialize() gave and that nothing reads any more."""
    if path := getattr(df, "written_to", None):
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def put(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """Writes one file from the driver, by whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    out = fs.create(p, True)
    try:
        for c in chunks:
            out.write(bytearray(c))
    finally:
        out.close()


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps: its cleaner removes them once their plans are garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
