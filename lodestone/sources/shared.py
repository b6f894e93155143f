"""Tables that cut a lineage, in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_told: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below the one that the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is used only where that is unset, in local tests.  The
    folder goes when the driver ends.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    folder = context._jsc.sc().getCheckpointDir().get()
    if folder not in _told:
        _told.add(folder)
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        atexit.register(_remove, path.getFileSystem(context._jsc.hadoopConfiguration()), path)
    return folder


def _remove(fs, path) -> None:
    """Best effort: the JVM may be gone by then."""
    with contextlib.suppress(Exception):
        fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: what made it runs once, however often it is read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """``df`` written as a compact table in the shared folder and read back.

    The table stands for the shuffles that made it, so Spark is told to remove
    their files as soon as it is written.  It is told so in a copy of the
    session that runs this one job; the session itself stays as it is.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    own = spark._jsparkSession.cloneSession()
    own.conf().set(_CLEAN_UP, "true")
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.queryExecution().logical())
    rows.write().option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    table._stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``store`` wrote and that nothing will read any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
