"""Registered queries over alignments as mappers write them: several operations a read, two samples, contigs of 1 to 30,000 bases.

A read has, by its key, a soft clip, matches, an insertion, a deletion or a skip, more matches and an insertion at its
end. The twins lay positions out from the operations' own numbers and never see a CIGAR text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.operators import misassembly as M
from asmlens.operators import pileup as P
from asmlens.plans.adapters import Tables
from asmlens.plans.features import breakpoint_chunks, extract_features
from asmlens.plans.registry import query

LENGTH = "CAST(1 + (contig * 7919) % 30000 AS INT)"
# one text for both engines
READS = f"""SELECT * FROM (SELECT *, {LENGTH} AS contig_length, CAST(((place % 40) * 577 + okey % 30) % {LENGTH} AS INT) AS pos, CAST(clip + m1 + ins + m2 + m3 + tail AS INT) AS bases,
    CAST(m1 + m2 + del + skip + m3 AS INT) AS span FROM (
  SELECT concat('s', CAST(l_orderkey % 2 AS VARCHAR(1))) AS sample, l_suppkey AS contig, l_orderkey AS okey, l_partkey AS place, CAST(l_linenumber AS INT) AS ln, CAST(l_linenumber % 3 AS INT) AS clip,
    CAST(5 + l_quantity AS INT) AS m1, CAST(CASE WHEN l_partkey % 5 IN (1, 4) THEN 1 + l_suppkey % 3 ELSE 0 END AS INT) AS ins,
    CAST(CASE WHEN l_partkey % 5 IN (1, 4) THEN 3 + l_orderkey % 7 ELSE 0 END AS INT) AS m2, CAST(CASE WHEN l_partkey % 5 IN (2, 4) THEN 1 + l_orderkey % 4 ELSE 0 END AS INT) AS del,
    CAST(CASE WHEN l_partkey % 5 = 3 THEN 20 ELSE 0 END AS INT) AS skip, CAST(CASE WHEN l_partkey % 5 >= 2 THEN 4 + l_suppkey % 5 ELSE 0 END AS INT) AS m3,
    CAST(CASE WHEN l_partkey % 5 = 4 THEN 2 ELSE 0 END AS INT) AS tail,
    CAST(1 + CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END + CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 8 ELSE 0 END AS INT) AS flag,
    CAST(round(l_discount * 400) AS INT) AS mapq, CAST(-round(l_tax * 1000) AS INT) AS as_score, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 700 + 50 AS INT) AS tlen
  FROM {{lineitem}})) WHERE pos + span <= contig_length"""
OPERATIONS = (("clip", "S"), ("m1", "M"), ("ins", "I"), ("m2", "M"), ("del", "D"), ("skip", "N"), ("m3", "M"), ("tail", "I"))

_POSITIONS = f"""WITH reads AS ({READS.format(lineitem="lineitem")}),
  runs AS (SELECT *, unnest([{{'op': 'M', 'n': m1, 'r': 0, 'q': clip}}, {{'op': 'M', 'n': m2, 'r': m1, 'q': clip + m1 + ins}}, {{'op': 'D', 'n': del, 'r': m1 + m2, 'q': 0}}, {{'op': 'N', 'n': skip, 'r': m1 + m2 + del, 'q': 0}},
    {{'op': 'M', 'n': m3, 'r': m1 + m2 + del + skip, 'q': clip + m1 + ins + m2}}]) AS o FROM reads),
  laid AS (SELECT *, unnest(range(0, o.n)) AS k FROM runs),
  expanded AS (SELECT sample, contig, contig_length, pos + o.r + k AS position, flag, mapq, tlen, as_score, o.op AS op, (okey + o.q + k) % 4 AS letter, (ln + o.q + k) % 5 <> 0 AS good,
    substr('ACGT', CAST((contig * 7 + (pos + o.r + k) * 3) % 4 AS INT) + 1, 1) AS ref_base FROM laid),
  bases AS (SELECT *, CASE op WHEN 'M' THEN substr('ACGT', CAST(letter AS INT) + 1, 1) WHEN 'D' THEN '-' ELSE 'N' END AS base FROM expanded)"""


def _reads(t: Tables) -> DataFrame:
    rows = t.spark.sql(READS.replace("AS VARCHAR(1)", "AS STRING"), lineitem=t["lineitem"])
    part = lambda n, op: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(op))).otherwise("")
    return rows.select(
        "sample", "contig", F.col("okey").alias("read_id"), "pos", "flag", "mapq", "tlen", "as_score",
        F.concat(*(part(n, op) for n, op in OPERATIONS)).alias("cigar"),
        F.substring(F.repeat(F.lit("ACGT"), F.lit(40)), (F.col("okey") % 4 + 1).cast("int"), F.col("bases")).alias("seq"),
        F.substring(F.repeat(F.lit("&JJJJ"), F.lit(40)), F.col("ln") % 5 + 1, F.col("bases")).alias("qual"),
    )


def _contigs(t: Tables) -> DataFrame:
    """A sequence for each sample and supplier: base k is ACGT[(7 contig + 3 k) mod 4]."""
    ids = t["supplier"].select(F.col("s_suppkey").alias("contig"), F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("sample")).withColumn("length", F.expr(LENGTH))
    first = (4 - F.col("contig") * 7 % 4) % 4
    return ids.select("sample", "contig", F.substring(F.repeat(F.lit("ATGC"), F.lit(7502)), (first + 1).cast("int"), F.col("length")).alias("seq"), "length")


def _expanded(t: Tables) -> DataFrame:
    return P.expand_alignments(_reads(t), _contigs(t))


query("pil1_expand_cigars", _POSITIONS + " SELECT sample, contig, position // 500 AS bin, base, count(*) AS n, sum(position)::BIGINT AS places, count_if(base = ref_base) AS matches FROM bases GROUP BY ALL")(
    lambda t: _expanded(t).groupBy("sample", "contig", F.floor(F.col("position") / 500).alias("bin"), "base").agg(F.count("*").alias("n"), F.sum("position").alias("places"), F.count_if("is_match").alias("matches"))
)
_HIT = "base = ref_base"


def _four(value: str, name: str) -> str:
    x = f"CASE WHEN {_HIT} THEN {value} END"
    return f"min({x}) AS min_{name}, avg({x}) AS mean_{name}, stddev_samp({x}) AS stdev_{name}, max({x}) AS max_{name}"


_PILE = (
    _POSITIONS
    + f""", pile AS (SELECT sample, contig, position, count(*) AS coverage, {", ".join(f"count_if(base = '{b}' AND good) AS num_query_{b}" for b in "ACGT")},
    count_if(base IN ('A', 'C', 'G', 'T') AND base <> ref_base AND good) AS num_SNPs, count_if(flag & 2 = 0 AND flag & 8 = 0) AS num_discordant, count_if(flag & 2 = 0 AND flag & 8 = 0 AND {_HIT}) AS num_discordant_Match,
    count_if(flag & 2 = 2 AND flag & 8 = 0 AND {_HIT}) AS num_proper_Match, count_if(flag & 2 = 2 AND flag & 8 = 0 AND NOT {_HIT}) AS num_proper_SNP, count_if(flag & 8 = 8 AND {_HIT}) AS num_orphans_Match,
    {_four("tlen", "insert_size_Match")}, {_four("mapq", "mapq_Match")}, {_four("greatest(-128, as_score)", "al_score_Match")} FROM bases GROUP BY ALL)"""
)
_SUMS = [*("coverage", *P.COUNTS), *(f"{k}_{f}_Match" for f in ("insert_size", "mapq", "al_score") for k in ("min", "mean", "stdev", "max"))]
query("pil12_pileup_cigars", _PILE + " SELECT sample, contig, position // 1000 AS bin, count(*) AS n, " + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in _SUMS) + " FROM pile GROUP BY ALL", " ".join(_SUMS))(
    lambda t: P.pileup(_expanded(t)).groupBy("sample", "contig", F.floor(F.col("position") / 1000).alias("bin")).agg(F.count("*").alias("n"), *(F.sum(c).cast("double").alias(c) for c in _SUMS))
)

# Records of the contigs, from one base to the whole contig.
_RECORDS = f"""SELECT contig, type, "start", least({LENGTH}, "start" + width) AS "end" FROM (SELECT s_suppkey AS contig, CASE s_nationkey % 4 WHEN 0 THEN 'relocation' WHEN 1 THEN 'translocation' WHEN 2 THEN 'inversion' ELSE 'interspecies translocation' END AS type,
    CAST(1 + (s_suppkey * 37) % (1 + (s_suppkey * 7919) % 30000) AS INT) AS "start", CAST(CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 2500 ELSE 40000 END AS INT) AS width FROM {{supplier}}
  UNION ALL SELECT s_suppkey, 'inversion', 1, CAST(s_suppkey % 700 AS INT) FROM {{supplier}} WHERE s_suppkey % 2 = 0)"""


def _records(t: Tables) -> DataFrame:
    return t.spark.sql(_RECORDS.replace('"', "`"), supplier=t["supplier"])


query(
    "mis3_label_cigars",
    _POSITIONS + f""", records AS ({_RECORDS.format(supplier="supplier")}), spots AS (SELECT DISTINCT sample, contig, position FROM bases),
      labelled AS (SELECT s.sample, s.contig, s.position, coalesce(string_agg(DISTINCT r.type, ',' ORDER BY r.type), 'None') AS by_pos FROM spots s LEFT JOIN records r ON r.contig = s.contig AND s.position + 1 BETWEEN r."start" AND r."end" GROUP BY ALL)
      SELECT sample, contig, by_pos, count(*) AS n, sum(position)::BIGINT AS places FROM labelled GROUP BY ALL""",
)(lambda t: M.label_positions(_expanded(t).select("sample", "contig", "position").distinct(), _records(t)).groupBy("sample", "contig", "by_pos").agg(F.count("*").alias("n"), F.sum("position").alias("places")))

_DENSE = _PILE + f""", records AS ({_RECORDS.format(supplier="supplier")}), spine AS (SELECT sample, s_suppkey AS contig, unnest(range(0, CAST(1 + (s_suppkey * 7919) % 30000 AS INT))) AS position FROM supplier, (SELECT unnest(['s0', 's1']) AS sample)),
  rows AS (SELECT s.sample, s.contig, s.position, coalesce(p.coverage, 0) AS coverage, coalesce(p.num_SNPs, 0) AS num_SNPs, p.mean_mapq_Match, count(r.contig) > 0 AS bad FROM spine s LEFT JOIN pile p ON p.sample = s.sample AND p.contig = s.contig AND p.position = s.position
    LEFT JOIN records r ON r.contig = s.contig AND s.position + 1 BETWEEN r."start" AND r."end" GROUP BY ALL)
  SELECT sample, contig, count(*) AS length, sum(coverage)::BIGINT AS coverage, sum(num_SNPs)::BIGINT AS num_SNPs, sum(mean_mapq_Match)::DOUBLE AS mapq, count_if(bad) AS bad FROM rows GROUP BY ALL"""
query("extract_features_cigars", _DENSE, "mapq")(
    lambda t: extract_features(_reads(t), _contigs(t), _records(t), max_coverage=None)
    .groupBy("sample", "contig")
    .agg(F.count("*").alias("length"), F.sum("coverage").alias("coverage"), F.sum("num_SNPs").alias("num_SNPs"), F.sum("mean_mapq_Match").alias("mapq"), F.count_if(F.col("Extensive_misassembly_by_pos") != "None").alias("bad"))
)

_DRAW = "(('0x' || substr(md5(sample || '/' || contig || '/0#3'), 1, 8))::BIGINT & 2147483647)"
query(
    "extract_breakpoint_chunks",
    _PILE + f""", points AS (SELECT sample, s_suppkey AS contig, CAST(1 + (s_suppkey * 7919) % 30000 AS INT) AS length, CASE WHEN s_suppkey % 3 = 0 THEN CAST((s_suppkey * 37) % (1 + (s_suppkey * 7919) % 30000) AS INT) END AS lo FROM supplier, (SELECT unnest(['s0', 's1']) AS sample)),
      chunks AS (SELECT *, CASE WHEN length <= 500 THEN 0 WHEN lo IS NULL THEN {_DRAW} % greatest(length - 499, 1) ELSE least(least(greatest(0, lo - (50 + {_DRAW} % 401)), lo), length - 500) END::INT AS low FROM points)
      SELECT c.sample, c.contig, 0 AS ord, c.low AS chunk_start, least(c.length, c.low + 500)::INT AS chunk_end, c.lo - c.low AS lo, count(p.position) AS n, sum(p.position - c.low)::BIGINT AS places, sum(p.coverage)::BIGINT AS coverage
      FROM chunks c JOIN pile p ON p.sample = c.sample AND p.contig = c.contig AND p.position >= c.low AND p.position < least(c.length, c.low + 500) GROUP BY ALL""",
)(
    lambda t: breakpoint_chunks(
        P.pileup(_expanded(t), "short").select("sample", "contig", "position", "coverage"),
        _contigs(t).drop("seq"),
        _contigs(t).where("contig % 3 = 0").select("sample", "contig", ((F.col("contig") * 37) % F.col("length")).cast("int").alias("break_start")).withColumn("break_end", F.col("break_start")),
        seed=3,
    )
    .groupBy("sample", "contig", "ord", "chunk_start", "chunk_end", "lo")
    .agg(F.count("*").alias("n"), F.sum("position").alias("places"), F.sum("coverage").alias("coverage"))
)
