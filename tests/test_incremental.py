import pytest
from pyspark.sql import functions as F

from asmlens.operators import stats as N
from asmlens.streaming import incremental as I


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "file string, mapq double")
    N.sufficient_stats(df, ["file"], ("mapq",)).coalesce(1).write.mode("append").parquet(folder)


def sums(spark, table):
    return {r.file: (r.all_count, r.mapq_n, r.mapq_sum, r.mapq_sum2) for r in I.file_sums(spark, ("mapq",), table).collect()}


def test_stop_restart_and_a_file_that_comes_twice(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("source", "table", "checkpoint"))
    put(spark, source, [("a", 1.0), ("a", 3.0), ("b", None)])
    schema = spark.read.parquet(source).schema

    def go():
        stream = spark.readStream.schema(schema).parquet(source)
        I.incremental_stats(stream, ("mapq",), table, checkpoint).awaitTermination()

    assert sums(spark, table) == {}
    go()
    first = sums(spark, table)
    assert first == {"a": (2, 2, 4.0, 10.0), "b": (1, 0, None, None)}
    go()  # nothing new
    assert sums(spark, table) == first
    put(spark, source, [("c", 5.0)])
    put(spark, source, [("a", 1.0), ("a", 3.0)])  # the same file once more
    go()
    assert sums(spark, table) == first | {"c": (1, 1, 5.0, 25.0)}
    put(spark, source, [("a", 10.0)])  # and a new state of it
    go()
    assert sums(spark, table)["a"] == (1, 1, 10.0, 100.0)
    row = I.normalizer(I.running_sums(I.file_sums(spark, ("mapq",), table), ("mapq",)), ("mapq",)).first()
    assert row.mapq_mean == 7.5 and row.mapq_stdev == 2.5


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    source, table = str(tmp_path / "source"), str(tmp_path / "table")
    put(spark, source, [("a", 1.0), ("b", 2.0)])
    for checkpoint in ("one", "two"):  # a lost checkpoint replays batch 0
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        I.incremental_stats(stream, ("mapq",), table, str(tmp_path / checkpoint)).awaitTermination()
        assert sums(spark, table) == {"a": (1, 1, 1.0, 1.0), "b": (1, 1, 2.0, 4.0)}


def test_clustered_tables_join_and_aggregate_without_an_exchange(spark, tmp_path):
    from asmlens.sources.writers import write_clustered

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    names = [f"clustered_{tmp_path.name}_{k}".replace("-", "_") for k in "ab"]
    try:
        rows = spark.range(4000).select((F.col("id") % 5).alias("sample"), (F.col("id") % 40).alias("contig"), F.floor(F.col("id") / 40).alias("position"), F.rand(1).alias("x"))
        for name in names:
            write_clustered(rows, name, ["sample", "contig"], ["position"], 4)
        a, b = map(spark.table, names)
        joined = a.join(b, ["sample", "contig", "position"]).groupBy("sample", "contig").agg(F.sum(a.x).alias("s"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() == 40
        part = spark.table(names[0]).where("sample = 1 and contig = 6 and position between 10 and 20")
        assert part.count() == 11 and "EqualTo(contig,6)" in part._jdf.queryExecution().executedPlan().toString()  # row groups are skipped by it
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("text", ["AS:i:1\tAS:i:2", "AS:i:2"])
def test_repeated_and_many_tags(spark, tmp_path, text):
    from asmlens.sources.readers import read_alignments_text

    many = "\t".join(f"X{chr(65 + k // 10 % 26)}:i:{k}" for k in range(1500))
    line = "r1\t0\tc\t1\t60\t5M\t*\t0\t0\tACGTA\t*\t"
    (tmp_path / "a.sam").write_text(f"@HD\n{line}{text}\n{line}{many}\tNM:i:7\n{line.rstrip()}\n")
    rows = read_alignments_text(spark, str(tmp_path / "a.sam")).collect()
    assert [r.as_score for r in rows] == [2, None, None]
    assert rows[1].tags["NM"] == "7" and rows[1].tags["XA"] == "1309" and rows[2].tags == {}
