"""Session helpers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed.

    It serves local mode and clusters with a shared home; elsewhere ship the package with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *(p for p in paths if p)])
    return small_batches(spark)


#: Bytes of rows that go to a Python worker at a time; Spark's default is 64 MiB.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches take about ``ARROW_BYTES``, as each task holds some in the JVM and in Python; a session that
    sets ``spark.sql.execution.arrow.maxBytesPerBatch`` itself keeps what it says."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs in one process (tests in local mode) a folder is chosen here; on a cluster
    the executors would not share it, so there it must be set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; computes ``df`` once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*cuts: DataFrame) -> None:
    """Delete the files behind frames that :func:`cut` made and that nothing reads any more; other frames are left."""
    for df in cuts:
        name = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if name.isDefined():
            remove(df.sparkSession, name.get())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, in whatever file system it lies."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
