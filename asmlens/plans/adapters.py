"""Domain tables derived from the driver's tables.

Each view is one SQL text with ``{table}`` places, valid in Spark and in DuckDB,
so a query and its twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIG_LENGTH = 1049

VIEWS = {
    # alignments of one match operation each
    "aln": """
      SELECT l_suppkey AS contig, l_orderkey AS okey, CAST(l_partkey % 1000 AS INT) AS pos, CAST(l_quantity AS INT) AS mlen, CAST(l_linenumber AS INT) AS ln,
        CAST(1 + CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END + CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 8 ELSE 0 END
          + CASE WHEN l_orderkey % 2 = 1 THEN 16 ELSE 0 END + CASE WHEN l_partkey % 2 = 1 THEN 32 ELSE 0 END
          + CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END + CASE WHEN l_linenumber = 6 THEN 2048 ELSE 0 END AS INT) AS flag,
        CAST(round(l_discount * 400) AS INT) AS mapq, CAST(-round(l_tax * 1000) AS INT) AS as_score,
        CAST(CAST(floor(l_extendedprice) AS BIGINT) % 700 + 50 AS INT) AS tlen
      FROM {lineitem}""",
    # misassembly records of the contigs (the start of a stretch depends on the contig, its length on the nation)
    "mis": """
      SELECT s_suppkey AS contig, CAST(1 + (s_suppkey * 37) % 900 AS INT) AS "start", CAST(41 + (s_suppkey * 37) % 900 + s_nationkey AS INT) AS "end",
        CASE s_nationkey % 4 WHEN 0 THEN 'relocation' WHEN 1 THEN 'translocation' WHEN 2 THEN 'inversion' ELSE 'interspecies translocation' END AS type,
        CAST(s_nationkey AS INT) AS ord
      FROM {supplier} WHERE s_nationkey % 3 = 0""",
    # contig metadata
    "meta": """
      SELECT doc_id AS contig, CAST(n_chars AS INT) AS length, (doc_id % 40) / 2.0 AS avg_coverage, source AS file,
        CAST(CASE WHEN doc_id % 3 = 0 AND n_chars > 300 THEN 1 ELSE 0 END AS INT) AS misassembly_cnt,
        CAST(floor(n_chars / 3.0) AS INT) AS lo, CAST(floor(n_chars / 3.0) + doc_id % 50 AS INT) AS hi
      FROM {documents}""",
    # predictions with labels
    "preds": """
      SELECT d.doc_id AS contig, CAST(d.n_chars AS INT) AS length, (d.n_chars % 1000) / 1000.0 AS score, CAST(1 - l.quality AS INT) AS label, d.source AS grp
      FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # chunk scores in order
    "chunks": """
      SELECT user_id AS contig, ts, event_id, value / (value + 20.0) AS score, CAST(4000 + (user_id * 37) % 3000 AS INT) AS length,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS chunk,
        CAST(CASE WHEN user_id % 8 = 0 THEN 1 ELSE 0 END + CASE WHEN avg(value) OVER (PARTITION BY user_id) > 49 THEN 1 ELSE 0 END AS INT) % 2 AS label
      FROM {events}""",
    # alignment hits
    "paf": "SELECT l_orderkey AS query, CAST(l_quantity AS INT) AS hit_len, CAST(l_linenumber AS INT) AS nm, l_discount * 10 AS identity, l_tax * 12.5 AS query_cov, l_quantity / 50.0 AS target_cov FROM {lineitem}",
    # genome metadata
    "genomes": """
      SELECT p_partkey AS accession, p_name AS name, p_brand AS genus, p_type AS species, CAST(p_size AS INT) AS contigs, p_retailprice AS completeness,
        CAST(p_partkey % 5 AS INT) AS dataset, concat('d__', substr(p_brand, 1, 5), ';p__', p_brand, ';c__', p_type, ';o__o', ';f__', p_brand, ';g__', p_type, ';s__', p_name) AS taxonomy
      FROM {part}""",
    # runs of a study
    "runs": "SELECT o_orderkey AS run_id, o_custkey AS sample, o_orderpriority AS sim_run, o_orderstatus AS status, o_totalprice AS s, o_totalprice / 2 AS cpu_time, o_totalprice / 100 AS max_vms FROM {orders}",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The driver's tables and the domain views over them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace('"', "`")
        return self.spark.sql(text, **{t: self[t] for t in TABLES if "{" + t + "}" in text})

    def alignments(self) -> DataFrame:
        """The full alignment schema over ``aln``."""
        a = self.view("aln")
        return a.withColumns(
            {
                "read_id": F.col("okey"),
                "cigar": F.concat(F.col("mlen").cast("string"), F.lit("M")),
                "seq": F.substring(F.repeat(F.lit("ACGT"), F.lit(14)), (F.col("okey") % 4 + 1).cast("int"), F.col("mlen")),
                "qual": F.repeat(F.when(F.col("ln") % 3 == 0, "&").otherwise("J"), F.col("mlen")),
            }
        )

    def contigs(self) -> DataFrame:
        """A sequence for each contig that has alignments: base k is ACGT[(7 contig + 3 k) mod 4]."""
        ids = self["lineitem"].select(F.col("l_suppkey").alias("contig")).distinct()
        first = (4 - F.col("contig") * 7 % 4) % 4
        return ids.select("contig", F.substring(F.repeat(F.lit("ATGC"), F.lit(264)), (first + 1).cast("int"), F.lit(CONTIG_LENGTH)).alias("seq"), F.lit(CONTIG_LENGTH).alias("length"))

    def sequences(self) -> DataFrame:
        """Sequences out of the documents' letters."""
        letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
        rows = self["documents"].repartition("doc_id")  # one small file would be one task
        return rows.select(F.col("doc_id").alias("contig"), F.col("source").alias("file"), F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))

    def breakpoints(self) -> DataFrame:
        """``meta`` with its breakpoints as an array."""
        b = F.array(F.struct("lo", "hi"))
        return self.view("meta").withColumn("breakpoints", F.when(F.col("misassembly_cnt") > 0, b).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))).drop("lo", "hi")


SEQS = """SELECT doc_id AS contig, source AS file, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'),
  'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents"""
EXPANDED = """SELECT contig, flag, mapq, tlen, as_score, ln, pos + k AS position, substr('ACGT', CAST((okey + k) % 4 AS INT) + 1, 1) AS base,
  substr('ACGT', CAST((contig * 7 + (pos + k) * 3) % 4 AS INT) + 1, 1) AS ref_base
  FROM (SELECT *, unnest(range(0, mlen)) AS k FROM aln)"""


def duck(body: str, *views: str) -> str:
    """A DuckDB query over the views it names."""
    names = {t: t for t in TABLES}
    texts = [f"{v} AS ({VIEWS[v].format(**names) if v in VIEWS else {'seqs': SEQS, 'expanded': EXPANDED}[v]})" for v in views]
    return ("WITH " + ", ".join(texts) + " " if texts else "") + body
