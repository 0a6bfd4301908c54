"""Study set-up and run logs (CMP1-CMP7, LOG1-LOG3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asmlens.functions.columns import basename, strip_ansi
from asmlens.operators.misassembly import carry_forward
from asmlens.operators.ordered import numbered, with_group_values
from asmlens.operators.relational import grid, keep_first


def sim_grid(spark: SparkSession, lists: dict[str, list | DataFrame]) -> DataFrame:
    """CMP1: all combinations of parameter lists (or of tables with one column), with a name in which ``:`` and ``,`` are ``-``."""
    make = lambda name, values: values.toDF(name) if isinstance(values, DataFrame) else spark.createDataFrame([(str(v),) for v in values], f"`{name}` string")
    tables = [make(name, values) for name, values in lists.items()]
    return grid(*tables).withColumn("run", F.regexp_replace(F.concat_ws("_", *lists), "[:,]+", "-"))


def input_type(columns: Column) -> Column:
    """CMP2: of an array of column names: ``real`` with both reads, ``provided`` with BAM files, else ``simulation``."""
    have = F.transform(columns, F.lower)
    reads = F.array_contains(have, "read1") & F.array_contains(have, "read2")
    return F.when(reads, "real").when(F.array_contains(have, "bam"), "provided").otherwise("simulation")


def even_abundance(taxa: DataFrame, by: str = "community", taxon: str = "taxon") -> DataFrame:
    """CMP3: 100 / n to each taxon, ranked by name."""
    rows = taxa.select(by, taxon)
    rows = with_group_values(rows, rows.groupBy(by).agg((100 / F.count("*")).alias("perc_rel_abund")), [by])
    return numbered(rows, [by], [taxon], "rank")


def genomes_in_community(genomes: DataFrame, abundance: DataFrame) -> DataFrame:
    """CMP4: genomes of positive abundance, the first file of each taxon."""
    return keep_first(genomes, ["taxon"], ["fasta"]).join(abundance.where("perc_rel_abund > 0"), "taxon")


def output_plan(runs: DataFrame, steps: dict[str, str], existing: DataFrame | None = None) -> DataFrame:
    """CMP5: the path of every run and step (``%s`` is the run); with ``existing`` only what is missing."""
    todo = runs.select("run", F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.format_string(p, F.col("run")).alias("path")) for s, p in steps.items()))).alias("x")).select("run", "x.*")
    return todo if existing is None else todo.join(existing.select("path"), "path", "left_anti")


def resource_estimate(refs: Column, depth: Column, attempt: Column, base_gb: float = 8.0, per_ref_gb: float = 0.05, per_million_gb: float = 0.5) -> dict[str, Column]:
    """CMP7: memory and hours of a job, growing with references, depth and attempt."""
    gb = (base_gb + per_ref_gb * refs + per_million_gb * depth / 1_000_000) * attempt
    return {"mem_gb": gb, "hours": F.ceil(gb / base_gb * attempt).cast("long")}


# What a line of a run log can be: a time in brackets, a heading, an indented entry, or an end or a submission.
TIME = r"^\[([^\]]* \d{4})\]$"
HEADING = r"^(?:Error in )?\w*rule (\S+):$"
ENTRY = r"^\s+([\w-]+): (.*)$"
ENDED = r"^Finished \w+ (\d+)"
SENT = r"external \w+ '([^']*)'"


def log_time(text: Column) -> Column:
    """A log's timestamp without its day name."""
    parts = F.split(F.regexp_replace(text, " +", " "), " ")
    plain = F.concat_ws(" ", *(F.try_element_at(parts, F.lit(k)) for k in (2, 3, 4, 5)))
    return F.try_to_timestamp(plain, F.lit("MMM d HH:mm:ss yyyy"))


def summarize_run_log(lines: DataFrame, line: str = "line", number: str = "line_no", by: str = "file") -> DataFrame:
    """LOG1: one row a job: rule, inputs, log, wildcards, resources, ids, start, end, status (finished, error or null), attempt.

    Sections begin at date lines; a section is a job, an error or an end. No line is parsed twice.
    """
    rows = lines.select(by, number, strip_ansi(line).alias("l"))
    part = lambda pattern, k=1: F.when(F.col("l").rlike(pattern), F.regexp_extract("l", pattern, k))
    # a section has the number of its date line; what else a line says is read after the lines have moved
    rows = carry_forward(rows, F.when(F.col("l").rlike(TIME), F.col(number)), [by], number, "section").where("section is not null")
    rows = rows.withColumns({"date": part(TIME), "key": part(ENTRY), "entry": part(ENTRY, 2), "heading": part(HEADING)})
    entry = lambda key: F.max(F.when(F.col("key") == key, F.col("entry")))
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    failing = F.col("heading").isNotNull() & F.col("l").startswith("Error")
    sections = rows.groupBy(by, "section").agg(
        F.max("date").alias("date"),
        F.max(F.when(~failing, F.col("heading"))).alias("rule"),
        entry("input").alias("input_files"),
        entry("log").alias("log_file"),
        tight(entry("wildcards")).alias("wildcards"),
        tight(entry("resources")).alias("resources"),
        entry("jobid").alias("sm_job"),
        F.max(part(SENT)).alias("clust_job"),
        entry("conda-env").alias("conda_env"),
        F.max(part(ENDED)).alias("finished"),
        F.max(failing).alias("failed"),
    )
    # a section is a start, an end, both or neither; it is made once, and its sides meet by their job without a join
    start = F.when(F.col("rule").isNotNull(), F.struct(F.col("sm_job").alias("job"), F.lit(1).alias("starts")))
    ended = F.coalesce("finished", F.when(F.col("failed"), F.col("sm_job")))
    end = F.when(ended.isNotNull(), F.struct(ended.alias("job"), F.lit(0).alias("starts")))
    attempt = F.row_number().over(Window.partitionBy(by, "rule", "input_files", F.when(F.col("rule").isNull(), F.col("section"))).orderBy("section"))  # sections without a rule are spread
    sides = sections.withColumn("attempt", attempt).withColumn("side", F.explode(F.filter(F.array(start, end), lambda x: x.isNotNull())))
    # an end belongs to the last start of its job before it
    before = Window.partitionBy(by, "side.job").orderBy("section", "side.starts").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("side.starts") == 1
    sides = sides.withColumn("start_section", F.last(F.when(starts, F.col("section")), ignorenulls=True).over(before)).where("start_section is not null")
    fields = ("rule", "input_files", "attempt", "log_file", "wildcards", "resources", "sm_job", "clust_job", F.col("date").alias("date_start"))
    last = F.struct(F.col("date").alias("date_end"), F.when(F.col("failed"), "error").otherwise("finished").alias("pass_fail"), "conda_env")
    jobs = sides.groupBy(by, "side.job", "start_section").agg(F.max(F.when(starts, F.struct(*fields))).alias("s"), F.max_by(last, F.when(~starts, F.col("section"))).alias("e"))
    out = jobs.select(by, "s.*", "e.*")
    return out.withColumn("seconds", F.unix_timestamp(log_time(F.col("date_end"))) - F.unix_timestamp(log_time(F.col("date_start"))))


def join_accounting(jobs: DataFrame, accounting: DataFrame, on: str = "clust_job") -> DataFrame:
    """LOG2: accounting columns of each cluster job, null where there are none."""
    return jobs.join(accounting, on, "left")


def format_inputs(files: Column, width: int = 40) -> Column:
    """LOG3: base names joined by commas, cut to a width."""
    names = F.transform(F.split(files, ", *"), lambda f: F.element_at(F.split(f, "/"), -1))
    return F.substring(F.array_join(names, ","), 1, width)


def registry_rows(files: DataFrame, path: str = "path") -> DataFrame:
    """CMP6: registry of feature files: name and folder of each output."""
    return files.withColumn("feature_file", F.col(path)).withColumn("file_name", basename(path))
