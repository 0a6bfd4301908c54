"""STM1: statistics that follow a stream of files, kept in a table that survives restarts.

Counts and sums add up, so statistics of all files are sums over one row a file.
Each micro-batch writes the sums of its files to a folder of its own, and a batch
that is run again replaces that folder. The table is keyed by file: a file that
arrives once more, changed or not, takes the place of its earlier row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from asmlens.operators.stats import merge_stats


def sum_columns(columns: tuple[str, ...]) -> list[str]:
    return ["all_count", *(f"{c}_{k}" for c in columns for k in ("n", "sum", "sum2"))]


def running_sums(stats: DataFrame, columns: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Sums of all ``stats`` rows (of ``sufficient_stats``)."""
    return stats.groupBy(*(by or [])).agg(*(F.sum(c).alias(c) for c in sum_columns(columns)))


def incremental_stats(stream: DataFrame, columns: tuple[str, ...], table: str, checkpoint: str, file: str = "file", available_now: bool = True) -> StreamingQuery:
    """Merge a stream of ``stats`` rows into ``table``, a folder that driver and executors share; goes on from ``checkpoint``."""

    def merge(rows: DataFrame, batch: int) -> None:
        sums = running_sums(rows, columns, [file])
        sums.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def file_sums(spark: SparkSession, columns: tuple[str, ...], table: str, file: str = "file", file_type: str = "string") -> DataFrame:
    """One row a file: its sums from the newest batch that had it. An empty table before the first batch."""
    names = sum_columns(columns)
    kinds = {c: "bigint" if c == "all_count" or c.endswith("_n") else "double" for c in names}
    schema = T.StructType.fromDDL(", ".join([f"`{file}` {file_type}", *(f"`{c}` {kinds[c]}" for c in names), "batch bigint"]))
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).drop("batch")
    rows = spark.read.schema(schema).parquet(table)
    newest = F.row_number().over(Window.partitionBy(file).orderBy(F.desc("batch")))  # one row a batch that had the file
    return rows.withColumn("_turn", newest).where("_turn = 1").drop("_turn", "batch")


def normalizer(sums: DataFrame, columns: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Means and deviations of sums."""
    return merge_stats(sums, columns, by)
