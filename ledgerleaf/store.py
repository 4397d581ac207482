"""Written intermediate tables in the cluster's shared folder.

A table written here is read back with real file statistics, so Catalyst decides on a broadcast from a known size
and falls back to a shuffled join (with AQE skew splitting) above ``spark.sql.autoBroadcastJoinThreshold``. It also
survives the loss of executors, because nothing depends on executor-local blocks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (``local``, ``local[n]``) gets one folder of its own, since its driver
    and its tasks share the disk. On any other master there is no folder that all executors see, so that is an error.
    """
    named = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"{_CHECKPOINT_CONF} names no shared folder for the intermediate tables of master {context.master}")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="ledgerleaf-")
    return _own[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once and return it as a table scan."""
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed_table(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` with less disk, for rows of text."""
    return materialize(df, label, compression="zstd")


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that ``materialize`` returned; nothing may read them any more."""
    for table in tables:
        spark = table.sparkSession
        folder = shared_folder(spark).removeprefix("file://")
        jvm = spark.sparkContext._jvm
        for parent in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder not in parent:
                raise ValueError(f"{parent} is no intermediate table")
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
