"""Readers (SRC1-SRC17). All return DataFrames; files are read by Spark, never opened on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asmlens.functions.columns import basename, path_part, strip_ansi
from asmlens.operators.misassembly import carry_forward, parse_misassembly

Paths = str | list[str]


def _lines(spark: SparkSession, paths: Paths, **options) -> DataFrame:
    return spark.read.options(**options).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value"))


def _numbered(spark: SparkSession, paths: Paths) -> DataFrame:
    """Rows (file, line_no, line), lines of a file counted from 0; large plain files are read in blocks.

    Within a block of a file, ids rise by one a line; counts of blocks give each block its first number.
    """
    at = F.col("_metadata")
    raw = spark.read.text(paths).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # one row a block
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), "line")


def read_fasta(spark: SparkSession, paths: Paths, name: str = "word") -> DataFrame:
    """SRC1: rows (file, contig, comment, seq, length); one record a row, so large files split. ``name``: first ``word`` or whole ``line``."""
    records = _lines(spark, paths, lineSep="\n>").withColumn("r", F.regexp_replace("value", "^\\s*>", "")).where("trim(r) <> ''")
    head = F.trim(F.regexp_extract("r", "^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace("r", "^[^\r\n]*", ""), "\\s", "")
    word, rest = F.regexp_extract(head, "^(\\S*)", 1), F.trim(F.regexp_replace(head, "^\\S*", ""))
    return records.select("file", (word if name == "word" else head).alias("contig"), rest.alias("comment"), seq.alias("seq"), F.length(seq).alias("length"))


def read_alignments_text(spark: SparkSession, paths: Paths) -> DataFrame:
    """SRC2: SAM text to alignments; header lines dropped, all optional tags as a map, the last of a tag that repeats. Positions become 0-based."""
    rows = _lines(spark, paths).where(~F.col("value").startswith("@") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))
    field = lambda k: F.try_element_at("f", F.lit(k + 1))
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.regexp_replace(t, "^..:.:?", "").alias("value"))
    found = F.transform(F.filter("f", lambda t, k: (k > 10) & t.rlike("^[A-Za-z][A-Za-z0-9]:")), tag)
    names = F.array_distinct(F.transform(found, lambda e: e["key"]))
    tags = F.map_from_entries(F.transform(names, lambda name: F.element_at(F.filter(found, lambda e: e["key"] == name), -1)))
    rows = rows.withColumn("tags", F.when(F.size("f") > 11, tags).otherwise(F.create_map().cast("map<string,string>")))
    ints = {"flag": 1, "mapq": 4, "tlen": 8}
    return rows.select(
        basename(F.col("file")).alias("sample"),
        field(0).alias("read_id"),
        field(2).alias("contig"),
        (field(3).cast("int") - 1).alias("pos"),
        (field(7).cast("int") - 1).alias("mate_pos"),
        *(field(k).cast("int").alias(n) for n, k in ints.items()),
        field(5).alias("cigar"),
        field(9).alias("seq"),
        F.nullif(field(10), F.lit("*")).alias("qual"),
        F.try_element_at("tags", F.lit("AS")).try_cast("int").alias("as_score"),
        "tags",
    )


def read_misassembly_report(spark: SparkSession, paths: Paths, parse: bool = True) -> DataFrame:
    """SRC3: contig names and the misassembly lines below them, parsed to intervals unless ``parse`` is off."""
    lines = _numbered(spark, paths).where("trim(line) <> ''")
    is_event = F.col("line").startswith("Extensive misassembly")
    named = carry_forward(lines, F.when(~is_event, F.trim("line")), ["file"], "line_no", "contig").where(is_event)
    events = named.select("file", "contig", F.col("line_no").alias("ord"), F.trim("line").alias("line"))
    return parse_misassembly(events) if parse else events


def breakpoints_array(text: Column) -> Column:
    """``a-b,c-d`` or ``-`` to an array of (lo, hi)."""
    pair = lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("lo"), F.split(x, "-")[1].cast("int").alias("hi"))
    return F.when(text.isNull() | text.isin("-", ""), F.array().cast("array<struct<lo:int,hi:int>>")).otherwise(F.transform(F.split(text, ","), pair))


def read_toc(spark: SparkSession, paths: Paths, default_coverage: float = 100.0) -> DataFrame:
    """SRC4: contig metadata with 4, 5 or 6 columns; a missing coverage is 100; empty files give no rows."""
    rows = _lines(spark, paths).where("trim(value) <> ''").withColumn("f", F.split("value", "\t"))
    field = lambda k: F.try_element_at("f", F.lit(k + 1))
    rows = rows.where(field(1).try_cast("int").isNotNull())  # a header has names there
    return rows.select(
        "file",
        field(0).alias("contig"),
        field(1).cast("int").alias("length"),
        field(2).cast("int").alias("misassembly_cnt"),
        field(3).cast("long").alias("size_bytes"),
        breakpoints_array(field(4)).alias("breakpoints"),
        F.coalesce(field(5).try_cast("double"), F.lit(default_coverage)).alias("avg_coverage"),
    )


_FAMILY = T.StructType([T.StructField(k, T.StructType([T.StructField(p, T.DoubleType()) for p in ("min", "mean", "stdev", "max")])) for k in ("sum", "sum2")])
_SINGLE = T.StructType([T.StructField(k, T.DoubleType()) for k in ("sum", "sum2")])
STATS = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("all_count", "mean_cnt", "stdev_cnt")]
    + [T.StructField(k, _FAMILY) for k in ("insert_size", "mapq", "al_score")]
    + [T.StructField(k, _SINGLE) for k in ("coverage", "seq_window_entropy", "seq_window_perc_gc")]
)


def read_stats_json(spark: SparkSession, paths: Paths) -> DataFrame:
    """SRC5: per-file sufficient statistics; newer metrics may be missing."""
    return spark.read.schema(STATS).option("multiLine", True).json(paths).select(F.col("_metadata.file_path").alias("file"), *STATS.names)


def discover_feature_files(spark: SparkSession, roots: str, match: str = "", names: str = "{stats,toc}") -> DataFrame:
    """SRC6: rows (path, size) of the stats and toc files below comma-separated roots, by a substring of the path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load([r.strip() for r in roots.split(",") if r.strip()])
    return found.select("path", F.col("length").alias("size")).where(F.col("path").contains(match) if match else F.lit(True))


def read_feature_table(spark: SparkSession, paths: Paths, schema: str | None = None) -> DataFrame:
    """SRC7: position table as TSV (also compressed), ``NA`` as null, with its file."""
    reader = spark.read.options(sep="\t", header=True, nullValue="NA")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(paths)
    return df.select(F.col("_metadata.file_path").alias("file"), *df.columns)


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def read_predictions(spark: SparkSession, path: Paths, delim: str = ",", name_regex: str = "") -> DataFrame:
    """SRC8: rows (contig, score, length); the id is a base name with a pattern taken out; the last row of an id wins."""
    df = require_columns(spark.read.options(sep=delim, header=True).csv(path), ["cont_name", "score", "length"], "prediction table")
    name = basename(F.col("cont_name"))
    name = F.regexp_replace(name, name_regex, "") if name_regex else name
    row = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = df.select(name.alias("contig"), F.col("score").cast("double").alias("score"), F.col("length").cast("int").alias("length"), row.alias("at"))
    return rows.groupBy("contig").agg(F.max_by(F.struct("score", "length"), "at").alias("r")).select("contig", "r.*")


def read_paf(spark: SparkSession, path: Paths) -> DataFrame:
    """SRC9: alignment hits; a thirteenth field that is no NM tag is an error."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where("trim(value) <> ''").select(f.alias("f"))
    nm = F.split(F.try_element_at("f", F.lit(13)), ":")
    checked = F.when(F.try_element_at(nm, F.lit(1)) == "NM", F.try_element_at(nm, F.lit(3)).cast("int")).otherwise(F.raise_error(F.lit("malformed NM tag")).cast("int"))
    col = lambda k: F.try_element_at("f", F.lit(k))
    return rows.select(col(1).alias("query"), col(2).cast("int").alias("qlen"), col(3).cast("int").alias("qstart"), col(4).cast("int").alias("qend"), col(6).alias("target"), col(7).cast("int").alias("tlen"), checked.alias("nm")).withColumn("hit_len", F.col("qend") - F.col("qstart"))


def read_input_map(spark: SparkSession, path: Paths) -> DataFrame:
    """SRC10: header in any case, blank lines skipped, columns Taxon, Fasta, Sample and BAM required; paths also relative to the map."""
    df = spark.read.options(sep="\t", header=True).csv(path)
    df = require_columns(df.toDF(*[c.strip().lower() for c in df.columns]), ["taxon", "fasta", "sample", "bam"], "input map")
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    full = lambda c: F.when(F.col(c).rlike("^(/|[a-z0-9]+:)"), F.col(c)).otherwise(F.concat_ws("/", folder, F.col(c)))
    return df.where(F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in df.columns)).isNotNull()).withColumns({"fasta_path": full("fasta"), "bam_path": full("bam")})


def read_fastq(spark: SparkSession, paths: Paths) -> DataFrame:
    """SRC11: rows (file, read_id, seq, qual): four lines a record, by number, as a quality line may begin with @.

    Plain files are read in blocks, and the lines of a record meet by its number; a record cut short at the end is left out.
    """
    lines = _numbered(spark, paths).select("file", F.floor(F.col("line_no") / 4).alias("record"), (F.col("line_no") % 4).alias("k"), "line")
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    records = lines.groupBy("file", "record").agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual")).where("qual is not null")
    return records.select("file", F.regexp_extract("head", r"^@(\S*)", 1).alias("read_id"), "seq", "qual")


def read_genome_metadata(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """SRC12: several metadata tables, united by name."""
    parts = [spark.read.options(sep="\t", header=True, inferSchema=True, nullValue="none").csv(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*columns)


def read_depth_table(spark: SparkSession, paths: Paths, sample_pattern: str = "([^/]+)/[^/]*$") -> DataFrame:
    """SRC13: headerless triplets, with the sample out of the path."""
    df = spark.read.option("sep", "\t").schema("contig string, pos int, depth int").csv(paths)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), sample_pattern, 1).alias("sample"), "contig", "pos", "depth")


def read_run_log(spark: SparkSession, paths: Paths) -> DataFrame:
    """SRC14: rows (file, line_no, line), terminal escapes taken out."""
    return _numbered(spark, paths).withColumn("line", strip_ansi("line"))


# Places of the fields in an accounting row.
ACCOUNTING = {"job": 5, "exit_status": 12, "wall_s": 13, "user_s": 14, "cpu_s": 36, "mem_gbs": 37, "io_gb": 38}


def read_accounting(spark: SparkSession, paths: Paths, last: int | None = None) -> DataFrame:
    """SRC14: accounting rows, split at colons; optionally the last n of each file."""
    rows = _numbered(spark, paths).where("trim(line) <> '' and line not like '#%'").withColumn("f", F.split("line", ":"))
    if last:
        ends = rows.groupBy("file").agg(F.max("line_no").alias("end"))
        rows = rows.join(ends, "file").where(F.col("line_no") > F.col("end") - last)
    col = lambda k: F.try_element_at("f", F.lit(k + 1))
    return rows.select("file", col(ACCOUNTING["job"]).alias("clust_job"), *(col(k).try_cast("double").alias(n) for n, k in ACCOUNTING.items() if n != "job"))


def read_eval_indices(spark: SparkSession, path: Paths) -> DataFrame:
    """SRC15: ids of the evaluation set."""
    return spark.read.option("header", True).csv(path).select(F.col("val_ind").cast("long").alias("val_ind"))


def read_wig_targets(spark: SparkSession, paths: Paths) -> DataFrame:
    """SRC16: rows (file, contig, pos, value) of variableStep tracks."""
    lines = _numbered(spark, paths)
    chrom = F.when(F.col("line").startswith("variableStep"), F.regexp_extract("line", r"chrom=(\S+)", 1))
    rows = carry_forward(lines, chrom, ["file"], "line_no", "contig").where(F.col("line").rlike(r"^\d"))
    f = F.split("line", r"\s+")
    return rows.select("file", "contig", F.try_element_at(f, F.lit(1)).cast("int").alias("pos"), F.try_element_at(f, F.lit(2)).cast("double").alias("value"))


def read_path_list(spark: SparkSession, path: str) -> list[str]:
    """SRC17: the paths a list file names (also relative to it), or the file itself if it is FASTA. Lists are short."""
    head = spark.read.text(path).where("trim(value) <> ''")
    first = head.first()
    if first is None or first.value.startswith(">"):
        return [path]
    folder = path.rstrip("/").rsplit("/", 1)[0] if "/" in path.rstrip("/") else "."
    return [p if p.startswith("/") or "://" in p else f"{folder}/{p}" for p in (r.value.strip() for r in head.collect())]


def folder_params(df: DataFrame, file: str = "file", names: tuple[str, ...] = ()) -> DataFrame:
    """Named folders of a path, counted from its end."""
    return df.withColumns({n: path_part(file, k - len(names) - 1) for k, n in enumerate(names)})
