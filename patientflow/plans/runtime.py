"""Session helpers: the shared folder, written intermediate tables, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of its file system, as every machine must read it."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``, with its scheme.

    Only where the session names none and all work is done in this process (a
    ``local`` master) a temporary folder is made; elsewhere that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return _qualified(spark, named)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return _qualified(spark, have.get())
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="patientflow-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return _qualified(spark, sc._jsc.sc().getCheckpointDir().get())


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's part of the shared folder, which is deleted when the driver ends."""
    sc = spark.sparkContext
    base = f"{shared_dir(spark)}/patientflow-{sc.applicationId}"
    p = sc._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder (a folder for each value of the text column ``by``) and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """As :func:`persisted`, with aggregates over what was written (0 where that is nothing)."""
    kept = persisted(df, name)
    found = kept.agg(*[c.alias(k) for k, c in metrics.items()]).first()
    return kept, {k: found[k] or 0 for k in metrics}


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()``: as :func:`persisted`, but partitions and their order stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one parquet table of a table folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
