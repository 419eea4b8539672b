"""Where intermediate tables and stream checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local: dict[str, tempfile.TemporaryDirectory] = {}


def _base(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, one for
    the whole session, which goes when Python ends.
    """
    base = spark.conf.get(_SETTING, None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.TemporaryDirectory(prefix="veilframe-")
    return _local[context.applicationId].name


def _root(spark: SparkSession) -> str:
    return f"{_base(spark)}/veilframe/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-scan of texts.
    ``release`` removes what a session has written.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this session; results read from them end too."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
