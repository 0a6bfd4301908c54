"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, tuple] = {}  # folders of written tables: their application, and a weak reference to their list of files


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that setting is missing a local
    folder is set on one machine, and anything else is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and later reads prune columns.

    The table lives as long as some DataFrame reads it (see ``swept``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _made[path] = spark.sparkContext.applicationId, spark._jvm.java.lang.ref.WeakReference(files)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    for t in tables:
        if getattr(t, "written_to", None) in _made:
            _delete(t.sparkSession, t.written_to)


def swept(spark: SparkSession) -> None:
    """Deletes the tables of ``written`` that no DataFrame reads any more.

    Every DataFrame that reads a table, derived ones too, holds the table's list of files; once
    the JVM has let go of that list, nothing can read the table.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()
    for path, (application, files) in list(_made.items()):
        if application != spark.sparkContext.applicationId:
            _made.pop(path)  # of a session that has ended
        elif files.get() is None:
            _delete(spark, path)


def stage(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A pipeline stage, which begins by deleting tables that earlier ones left and nothing reads."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, *args, **options) -> DataFrame:
        swept(spark)
        return function(spark, docs, *args, **options)

    return run


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

