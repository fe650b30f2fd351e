"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("graphweir")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; a folder of our own is
    made only where that is unset and the master is local (tests, benchmarks).
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "graphweir-checkpoints")
    os.makedirs(own, exist_ok=True)
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    Reliable: the rows survive the loss of any executor, which a local
    checkpoint would not.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several later jobs read the same columns: Parquet keeps column
    pruning, which a checkpointed RDD does not.
    """
    spark = df.sparkSession
    path = remembered(spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of :func:`written` that nothing reads any more, and lets go of the shuffle files of all jobs that are done.

    Spark removes these when the driver's garbage collector meets their plans, which may be long after.
    """
    for path in {os.path.dirname(file) for table in tables for file in table.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remembered(spark: SparkSession, path: str) -> str:
    """A path in the shared folder, to be removed when this process ends."""
    if not _WRITTEN:
        atexit.register(_drop_written, spark)
    _WRITTEN.append(path)
    return path


_WRITTEN: list[str] = []


def _drop_written(spark: SparkSession) -> None:
    """Removes the tables of this process from the shared folder when it ends; best effort."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _WRITTEN:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone
        return
