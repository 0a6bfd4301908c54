"""Registered queries: pileup features, sequences, labels, statistics; and feature extraction as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asmlens.operators import misassembly as M
from asmlens.operators import pileup as P
from asmlens.operators import relational as R
from asmlens.operators import sampling as S
from asmlens.operators import sequence as Q
from asmlens.operators import stats as N
from asmlens.plans.adapters import Tables, duck
from asmlens.plans.registry import query


def extract_features(alignments: DataFrame, contigs: DataFrame, records: DataFrame | None = None, window: int = 6, max_coverage: float | None = 20, max_insert: int = 30000, seed: int = 8192, profile: str = "standard", ties: tuple = ()) -> DataFrame:
    """Alignments and contigs to the position table: coverage cap, pileup, all positions, sequence windows, labels.

    All that lies on a contig is a stretch: reads, the contig itself (op S), labels (op L). Stretches are dealt once, by piece of a
    contig, and laid out and added up there; neither positions nor whole reads move again.
    """
    keys, own = [k for k in P.KEYS if k in contigs.columns], ("flag", "mapq", "tlen", "as_score")
    sizes = contigs.select(*keys, F.octet_length(F.col("seq").cast("binary")).alias("length"))
    also, capped = (), alignments
    if max_coverage is not None:
        limits = S.coverage_cut(alignments, contigs, max_coverage, max_insert, seed, ties=ties)
        contigs = contigs.join(limits, [k for k in keys if k in limits.columns], "left")
        also, capped = ("limit",), alignments.where(F.abs("tlen") <= max_insert).withColumn("read_order", S.read_order(alignments, seed, ties=ties))
    ordered = ("read_order",) if also else ()
    stretches = P.aligned_stretches(capped, (*own, *ordered)).dropna(subset=[k for k in keys if k in alignments.columns])
    spine = sizes.where("length > 0").select(*keys, F.lit("S").alias("op"), F.lit(0).alias("start"), F.col("length").alias("n"))
    if records is not None:
        flags = records.select(*[k for k in keys if k in records.columns]).distinct().withColumn("misassembled", F.lit(1))
        spine = spine.join(flags, [k for k in keys if k in records.columns], "left")
        labels, names = M.contig_label_stretches(sizes, records)
        spine = spine.unionByName(labels.withColumn("op", F.lit("L")), allowMissingColumns=True)
    marks = [c for c in ("misassembled", "label", "mask") if c in spine.columns]
    rows = P.meet_sequence(P.cut_pieces(stretches.unionByName(spine, allowMissingColumns=True), keys, P.PIECE), contigs, keys, P.PIECE, window, also)
    is_read = ~F.col("op").isin("S", "L")
    if also:
        rows = rows.where(~is_read | F.col("limit").isNull() | (F.col("read_order") < F.col("limit")))
    rows = P.lay_out(rows, keys, (*own, *marks, "op", "near", "w", "low", "total"))
    rows = rows.withColumn("win", Q.window_letters("near", "low", "w", "total"))
    found = rows.withColumns({f"_{b}": Q.letter_count("win", b) for b in "ACGT"}).groupBy(*keys, "piece", "position")
    found = found.agg(*P.features(profile, reads=is_read), F.count_if(F.col("op") == "S").alias("_own"), *(F.max(c).alias(c) for c in (*marks, *(f"_{b}" for b in "ACGT")))).where("_own > 0")
    entropy, gc = Q.window_stats([F.col(f"_{b}") for b in "ACGT"])
    known = [c for c in found.columns if c not in (*keys, "piece", "position", *marks, "_own", *(f"_{b}" for b in "ACGT"))]
    out = found.withColumn("num_SNPs", P.num_snps()).select(*keys, "position", entropy.alias("seq_window_entropy"), gc.alias("seq_window_perc_gc"), *known, "num_SNPs", *marks)
    if records is not None:
        out = out.join(F.broadcast(names), "label", "left").drop("label")  # as many rows as there are combinations of types
        out = out.withColumns({"by_pos": F.coalesce("by_pos", F.lit("None")), "mask": F.coalesce("mask", F.lit(0)), "misassembled": F.coalesce("misassembled", F.lit(0))})
        out = out.select(*[c for c in out.columns if c not in ("by_pos", "mask", "misassembled")], F.col("by_pos").alias("Extensive_misassembly_by_pos"), "mask", F.col("misassembled").alias("Extensive_misassembly"))
    return out


def breakpoint_chunks(features: DataFrame, contigs: DataFrame, records: DataFrame, chunk_size: int = 500, margin: int = 50, seed: int = 8192) -> DataFrame:
    """The rows of ``features`` in one chunk around each breakpoint, and in a random one of each clean contig.

    ``records`` have break_start and break_end. Adds ord, chunk_start, chunk_end, lo and hi (from the chunk's start); position counts
    from the chunk's start too. Chunks meet positions by the interval join, so they need no order.
    """
    keys = [k for k in P.KEYS if k in contigs.columns]
    points = records.groupBy(*[k for k in keys if k in records.columns]).agg(F.array_sort(F.collect_list(F.struct(F.col("break_start").alias("lo"), F.col("break_end").alias("hi")))).alias("breakpoints"))
    chunks = M.select_breakpoint_chunk(contigs.select(*keys, "length").join(points, [k for k in keys if k in records.columns], "left"), chunk_size, margin, seed)
    spans = chunks.withColumns({"start": F.col("chunk_start") + 1, "end": F.col("chunk_end")})
    rows = M.interval_join(features, spans)
    return rows.drop("start", "end").withColumn("position", F.col("position") - F.col("chunk_start"))


def recompute_meta(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contig metadata and sufficient statistics of a position table."""
    return N.recompute_meta(features, []), N.sufficient_stats(features, [])


# --- pileup

_MATCH = "(base = ref_base)"
_FOUR = "min({x}) AS min_{n}, avg({x}) AS mean_{n}, stddev_samp({x}) AS stdev_{n}, max({x}) AS max_{n}"


def _four(value: str, name: str, when: str) -> str:
    return _FOUR.format(x=f"CASE WHEN {when} THEN {value} END", n=name)


def _expanded(t: Tables) -> DataFrame:
    return P.expand_alignments(t.alignments(), t.contigs(), keep=("flag", "mapq", "tlen", "as_score"))


def _agg(columns: Callable[[Column], list[Column]]) -> Callable[[Tables], DataFrame]:
    """A builder of position aggregates; ``columns`` gets the match flag."""
    return lambda t: _expanded(t).groupBy("contig", "piece", "position").agg(*columns(F.col("is_match"))).drop("piece")


@query("pil1_expand_alignments", duck("SELECT contig, position, base, count(*) AS n FROM expanded GROUP BY ALL", "aln", "expanded"))
def _(t):
    return P.expand_alignments(t.alignments(), keep=()).groupBy("contig", "piece", "position", "base").agg(F.count("*").alias("n")).drop("piece")


@query("pil2_match_flag", duck("SELECT contig, ref_base, count_if(base = ref_base) AS n_match, count_if(base <> ref_base) AS n_snp FROM expanded GROUP BY ALL", "aln", "expanded"))
def _(t):
    return _expanded(t).groupBy("contig", "ref_base").agg(F.count_if("is_match").alias("n_match"), F.count_if(~F.col("is_match")).alias("n_snp"))


_PAIR = f"""count_if(flag & 1 = 1 AND flag & 2 = 0 AND flag & 8 = 0) AS num_discordant,
  count_if(flag & 1 = 1 AND flag & 2 = 0 AND flag & 8 = 0 AND {_MATCH}) AS num_discordant_Match,
  count_if(flag & 2 = 2 AND flag & 8 = 0 AND {_MATCH}) AS num_proper_Match, count_if(flag & 2 = 2 AND flag & 8 = 0 AND NOT {_MATCH}) AS num_proper_SNP,
  count_if(flag & 8 = 8 AND {_MATCH}) AS num_orphans_Match"""


def _pos(columns: str) -> str:
    return duck(f"SELECT contig, position, {columns} FROM expanded GROUP BY contig, position", "aln", "expanded")


query("pil3_pair_class_counts", _pos(_PAIR))(_agg(P.pair_class_counts))
query("pil4_coverage", _pos("count(*) AS coverage"))(_agg(lambda m: [F.count("*").alias("coverage")]))
_BASES = ", ".join(f"count_if(base = '{b}' AND ln % 3 <> 0) AS num_query_{b}" for b in "ACGT")
query("pil5_base_counts", _pos(_BASES))(_agg(lambda m: P.base_counts()))
query("pil6_num_snps", _pos("count_if(base <> ref_base AND ln % 3 <> 0) AS num_SNPs"))(lambda t: P.pileup(_expanded(t), "short").select("contig", "position", F.col("num_SNPs").cast("long").alias("num_SNPs")))
query("pil7_insert_size_stats", _pos(_four("tlen", "insert_size_Match", _MATCH)), "mean_insert_size_Match stdev_insert_size_Match")(_agg(P.insert_size_stats))
query("pil8_mapq_stats", _pos(_four("mapq", "mapq_Match", _MATCH)), "mean_mapq_Match stdev_mapq_Match")(_agg(P.mapq_stats))
query("pil9_al_score_stats", _pos(_four("greatest(-128, least(127, as_score))", "al_score_Match", _MATCH)), "mean_al_score_Match stdev_al_score_Match")(_agg(P.al_score_stats))
query("pil10_supp_secondary_counts", _pos(f"count_if(flag & 2048 > 0 AND {_MATCH}) AS num_supplementary_Match, count_if(flag & 256 > 0 AND {_MATCH}) AS num_secondary_Match"))(_agg(P.supp_secondary_counts))
query(
    "pil11_snp_side_stats",
    _pos(f"{_four('tlen', 'insert_size_SNP', 'base <> ref_base')}, {_four('mapq', 'mapq_SNP', 'base <> ref_base')}, count_if(flag & 2 = 0 AND flag & 8 = 0 AND NOT {_MATCH}) AS num_discordant_SNP, "
         f"count_if(flag & 8 = 8 AND NOT {_MATCH}) AS num_orphans_SNP, count_if(flag & 2048 > 0 AND NOT {_MATCH}) AS num_supplementary_SNP, count_if(flag & 256 > 0 AND NOT {_MATCH}) AS num_secondary_SNP"),
    "mean_insert_size_SNP stdev_insert_size_SNP mean_mapq_SNP stdev_mapq_SNP",
)(_agg(lambda m: P.snp_side_stats()))

_DENSE = duck(
    """SELECT c.contig, p.position, substr('ACGT', CAST((c.contig * 7 + p.position * 3) % 4 AS INT) + 1, 1) AS ref_base, coalesce(e.coverage, 0) AS coverage, e.max_mapq AS max_mapq_Match
    FROM (SELECT DISTINCT contig FROM aln) c CROSS JOIN (SELECT unnest(range(0, 1049)) AS position) p
    LEFT JOIN (SELECT contig, position, count(*) AS coverage, max(CASE WHEN base = ref_base THEN mapq END) AS max_mapq FROM expanded GROUP BY ALL) e ON e.contig = c.contig AND e.position = p.position""",
    "aln", "expanded",
)
query("pil12_dense_positions", _DENSE)(lambda t: P.dense_positions(P.pileup(_expanded(t)), t.contigs()).select("contig", "position", "ref_base", "coverage", "max_mapq_Match"))
query("pil13_ratio_normalize", _pos("count_if(base = 'A' AND ln % 3 <> 0) / count(*) AS num_query_A, CAST(floor(count_if(base = 'C' AND ln % 3 <> 0) * 10000.0 / count(*)) AS INT) AS num_query_C"), "num_query_A")(
    lambda t: P.ratio_normalize(P.ratio_normalize(P.pileup(_expanded(t), "short"), ("num_query_A",)), ("num_query_C",), True).select("contig", "position", "num_query_A", "num_query_C")
)
query("pil14_contig_len_check", "SELECT s_suppkey AS contig, CAST(1049 + s_suppkey % 2 AS INT) AS header_length, CASE WHEN c IS NULL THEN NULL ELSE 1049 END::INT AS length, CASE WHEN c IS NULL THEN 'unknown contig' ELSE 'length differs' END AS problem FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey AS c FROM lineitem) ON s_suppkey = c WHERE c IS NULL OR s_suppkey % 2 = 1")(
    lambda t: P.contig_len_check(t["supplier"].select(F.col("s_suppkey").alias("contig"), (F.col("s_suppkey") % 2 + 1049).cast("int").alias("length")), t.contigs())
)
query("pil15_binned_coverage", duck("SELECT contig, CAST(position // 50 AS BIGINT) AS bin, avg(n) AS mean_depth FROM (SELECT contig, position, count(*) AS n FROM expanded GROUP BY ALL) GROUP BY ALL", "aln", "expanded"), "mean_depth")(
    lambda t: P.binned_coverage(P.expand_alignments(t.alignments(), keep=()).groupBy("contig", "piece", "position").agg(F.count("*").alias("coverage")))
)
query("pil16_pileup_text", _pos("count(*) AS depth, string_agg(base, '' ORDER BY base) AS bases"))(lambda t: P.pileup_text(_expanded(t)))

# --- sequences

_COUNT = "(length(win) - length(replace(win, '{b}', '')))::DOUBLE"
_ENT = " + ".join(f"CASE WHEN {b} > 0 THEN -({b} / (a + c + g + t)) * log2({b} / (a + c + g + t)) ELSE 0 END" for b in "acgt")
query(
    "seq1_sequence_window",
    duck(f"""SELECT contig, position, CASE WHEN a + c + g + t > 0 THEN {_ENT} ELSE 0 END AS seq_window_entropy, CASE WHEN a + c + g + t > 0 THEN (c + g) / (a + c + g + t) ELSE 0 END AS seq_window_perc_gc
      FROM (SELECT contig, position, {", ".join(_COUNT.format(b=b.upper()) + f" AS {b}" for b in "acgt")} FROM (
        SELECT contig, position, substr(seq, CAST(CASE WHEN position < n // 2 OR n = 1 THEN position ELSE position - w + 1 END AS INT) + 1, w) AS win FROM (
          SELECT contig, seq, n, greatest(1, least(6, n // 2))::INT AS w, unnest(range(0, n)) AS position FROM (SELECT contig, seq, length(seq) AS n FROM seqs))))""", "seqs"),
    "seq_window_entropy seq_window_perc_gc",
)(lambda t: Q.sequence_window(t.sequences().select("contig", "seq"), 6))
query("seq2_one_hot_base", duck("SELECT contig, position, (base = 'A')::INT AS ref_base_A, (base = 'C')::INT AS ref_base_C, (base = 'G')::INT AS ref_base_G, (base = 'T')::INT AS ref_base_T FROM (SELECT DISTINCT contig, position, ref_base AS base FROM expanded)", "aln", "expanded"))(
    lambda t: Q.one_hot_base(_expanded(t).select("contig", "position", "ref_base").distinct()).drop("ref_base")
)
query(
    "seq3_seq_stats",
    duck("""SELECT file, count(*) AS num_seqs, sum(n)::BIGINT AS sum_len, min(n)::INT AS min_len, avg(n) AS avg_len, max(n)::INT AS max_len, quantile_cont(n::DOUBLE, 0.25) AS q1, quantile_cont(n::DOUBLE, 0.5) AS q2,
      quantile_cont(n::DOUBLE, 0.75) AS q3, 100.0 * sum(gc) / nullif(sum(n), 0) AS gc_percent, max(n50)::INT AS n50 FROM (
        SELECT file, n, gc, CASE WHEN 2 * sum(n) OVER (PARTITION BY file ORDER BY n DESC) >= sum(n) OVER (PARTITION BY file) THEN n END AS n50
        FROM (SELECT file, length(seq) AS n, length(seq) - length(translate(seq, 'GC', '')) AS gc FROM seqs)) GROUP BY file""", "seqs"),
    "avg_len q1 q2 q3 gc_percent",
)(lambda t: Q.seq_stats(t.sequences(), ["file"]))

# --- labels

_LINE = """concat('Extensive misassembly ( ', type, ' ) between ', CAST(CASE WHEN ord % 2 = 0 THEN "start" ELSE "end" END AS VARCHAR), ' ', CAST(CASE WHEN ord % 2 = 0 THEN "end" ELSE "start" END AS VARCHAR), ' and ', CAST("end" + contig % 90 AS VARCHAR), ' ', CAST("end" + contig % 90 + 200 AS VARCHAR))"""


def _report_lines(t: Tables) -> DataFrame:
    m = t.view("mis")
    text = F.concat(F.lit("Extensive misassembly ( "), "type", F.lit(" ) between "), F.when(F.col("ord") % 2 == 0, F.col("start")).otherwise(F.col("end")).cast("string"), F.lit(" "), F.when(F.col("ord") % 2 == 0, F.col("end")).otherwise(F.col("start")).cast("string"), F.lit(" and "), (F.col("end") + F.col("contig") % 90).cast("string"), F.lit(" "), (F.col("end") + F.col("contig") % 90 + 200).cast("string"))
    return m.select("contig", "ord", text.alias("line"))


query(
    "mis1_parse_misassembly",
    duck("""SELECT contig, ord, 0 AS part, type, "start" AS "start", CASE WHEN type = 'inversion' AND ord % 2 = 1 THEN "end" ELSE "end" + contig % 90 + 200 END::INT AS "end",
        "end" AS break_start, ("end" + contig % 90)::INT AS break_end FROM mis WHERE contig % 90 < 50 AND NOT (type = 'inversion' AND ord % 2 = 0)
      UNION ALL SELECT contig, ord, 0, type, ("end" + contig % 90)::INT, ("end" + contig % 90 + 200)::INT, "end", ("end" + contig % 90)::INT FROM mis WHERE contig % 90 < 50 AND type = 'inversion' AND ord % 2 = 0
      UNION ALL SELECT contig, ord, 0, type, "start", "end", "end", "end" FROM mis WHERE contig % 90 >= 50 AND NOT (type = 'inversion' AND ord % 2 = 0)
      UNION ALL SELECT contig, ord, CASE WHEN type = 'inversion' THEN 0 ELSE 1 END, type, ("end" + contig % 90)::INT, ("end" + contig % 90 + 200)::INT, ("end" + contig % 90)::INT, ("end" + contig % 90)::INT FROM mis WHERE contig % 90 >= 50 AND NOT (type = 'inversion' AND ord % 2 = 1)""", "mis"),
)(lambda t: M.parse_misassembly(_report_lines(t)))
query("mis2_types_per_contig", duck("SELECT contig % 50 AS contig, string_agg(replace(type, ' ', '_'), ';' ORDER BY contig, ord) AS types FROM mis GROUP BY contig % 50", "mis"))(
    lambda t: M.misassembly_types_per_contig(t.view("mis").withColumn("real", F.col("contig")).withColumn("contig", F.col("contig") % 50), ["real", "ord"])
)
_LABEL = """SELECT p.contig, p.position, coalesce(string_agg(DISTINCT m.type, ',' ORDER BY m.type), 'None') AS by_pos,
  coalesce(bit_or(CASE m.type WHEN 'relocation' THEN 1 WHEN 'translocation' THEN 2 WHEN 'inversion' THEN 4 WHEN 'interspecies translocation' THEN 8 END), 0)::INT AS mask, CASE WHEN p.contig IN (SELECT contig FROM mis) THEN 1 ELSE 0 END::INT AS misassembled
  FROM (SELECT c.contig, position FROM (SELECT DISTINCT contig FROM aln) c CROSS JOIN (SELECT unnest(range(0, 1049)) AS position)) p
  LEFT JOIN (SELECT contig, type, "start", "end" FROM mis UNION ALL SELECT contig + 1, type, "start" + 10, "end" + 10 FROM mis) m ON m.contig = p.contig AND p.position + 1 BETWEEN m."start" AND m."end" GROUP BY p.contig, p.position"""


def _two(t: Tables) -> DataFrame:
    m = t.view("mis").select("contig", "type", "start", "end")
    return m.unionByName(m.select((F.col("contig") + 1).alias("contig"), "type", (F.col("start") + 10).alias("start"), (F.col("end") + 10).alias("end")))


query("mis3_label_positions", duck(_LABEL.replace("contig IN (SELECT contig FROM mis)", "contig IN (SELECT contig FROM mis UNION SELECT contig + 1 FROM mis)"), "aln", "mis"))(
    lambda t: M.label_positions(t.contigs().select("contig", F.explode(F.sequence(F.lit(0), F.lit(1048))).alias("position")), _two(t))
)
query("jn7_interval_join", duck('SELECT p.contig, p.position, m.type, m."start" FROM (SELECT DISTINCT contig, position FROM expanded) p JOIN mis m ON m.contig = p.contig AND p.position + 1 BETWEEN m."start" AND m."end"', "aln", "expanded", "mis"))(
    lambda t: M.interval_join(P.expand_alignments(t.alignments(), keep=()).select("contig", "position").distinct(), t.view("mis").select("contig", "type", "start", "end")).select("contig", "position", "type", "start")
)
query("mis4_mirror_interval", duck('SELECT contig, ord, CASE WHEN ord % 2 = 0 THEN 1049 - ("end" - 1) ELSE "start" END::INT AS "start", CASE WHEN ord % 2 = 0 THEN 1049 - ("start" - 1) ELSE "end" END::INT AS "end" FROM mis WHERE contig IN (SELECT contig FROM aln)', "aln", "mis"))(
    lambda t: M.mirror_interval(t.view("mis").select("contig", "ord", F.when(F.col("ord") % 2 == 0, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(F.col("ord") % 2 == 0, F.col("start")).otherwise(F.col("end")).alias("end")), t.contigs()).select("contig", "ord", "start", "end")
)
query("mis5_contig_label", duck("SELECT s_suppkey AS contig, count(m.contig) AS misassembly_cnt, (count(m.contig) > 0)::INT AS label FROM supplier LEFT JOIN mis m ON m.contig = s_suppkey GROUP BY s_suppkey", "mis"))(
    lambda t: M.contig_label(t["supplier"].select(F.col("s_suppkey").alias("contig")), t.view("mis"))
)
query(
    "mis6_breakpoint_histograms",
    duck("""WITH b AS (SELECT length, unnest([(lo + hi) // 2, length - (lo + hi) // 2]) AS mid FROM meta WHERE misassembly_cnt > 0),
      bins AS (SELECT 'end' AS kind, least(49, floor(least(mid, length - mid) / 200.0))::INT AS bin FROM b UNION ALL SELECT 'relative', greatest(0, least(19, floor(20.0 * mid / length)))::INT FROM b),
      spine AS (SELECT 'end' AS kind, unnest(range(0, 50))::INT AS bin UNION ALL SELECT 'relative', unnest(range(0, 20))::INT)
      SELECT s.kind, s.bin, count(bins.bin) AS n FROM spine s LEFT JOIN bins USING (kind, bin) GROUP BY ALL""", "meta").replace(" WITH b AS", ", b AS", 1),
)(lambda t: M.breakpoint_histograms(t.view("meta").where("misassembly_cnt > 0")))
_R0 = "(('0x' || substr(md5(contig || '/0#0'), 1, 8))::BIGINT & 2147483647)"
query(
    "mis7_breakpoint_chunks",
    duck(f"""SELECT contig, 0 AS ord, s AS chunk_start, least(length, s + 500)::INT AS chunk_end, CASE WHEN misassembly_cnt > 0 THEN lo - s END::INT AS lo, CASE WHEN misassembly_cnt > 0 THEN hi - s END::INT AS hi FROM (
      SELECT *, CASE WHEN length <= 500 THEN 0 WHEN misassembly_cnt > 0 THEN least(least(greatest(0, (lo + hi) // 2 - (50 + ({_R0}) % 401)), lo), length - 500) ELSE ({_R0}) % greatest(length - 499, 1) END::INT AS s FROM meta)""", "meta"),
)(lambda t: M.select_breakpoint_chunk(t.breakpoints()))
query("mis8_type_counts", duck("SELECT g, type, count(DISTINCT contig) AS n FROM (SELECT contig, contig % 3 AS g, unnest(['relocation', type]) AS type FROM mis) GROUP BY ALL", "mis"))(
    lambda t: M.misassembly_type_counts(t.view("mis").select("contig", (F.col("contig") % 3).alias("g"), F.concat(F.lit("relocation inconsistency = 5,"), F.col("type")).alias("by_pos")), ["g"])
)
query("mis9_max_types", duck("SELECT g, max(n)::INT AS max_types FROM (SELECT contig % 7 AS g, CASE WHEN ord % 2 = 0 THEN 2 ELSE 0 END AS n FROM mis) GROUP BY g", "mis"))(
    lambda t: M.max_types_per_position(t.view("mis").select((F.col("contig") % 7).alias("g"), F.when(F.col("ord") % 2 == 0, F.concat(F.col("type"), F.lit(",inversion"))).otherwise("None").alias("by_pos")), ["g"])
)

# --- statistics

_COLS = ("mean_mapq_Match", "stdev_mapq_Match", "coverage")
POSITIONS = "(SELECT contig, position, count(*) AS coverage, avg(CASE WHEN base = ref_base THEN mapq END) AS mean_mapq_Match, stddev_samp(CASE WHEN base = ref_base THEN mapq END) AS stdev_mapq_Match, avg(CASE WHEN base = ref_base THEN tlen END) AS mean_insert_size_Match FROM expanded GROUP BY ALL)"


def position_features(t: Tables) -> DataFrame:
    return P.pileup(_expanded(t))


query(
    "nrm1_sufficient_stats",
    duck("SELECT contig % 4 AS file, count(*) AS all_count, count(mean_mapq_Match) AS mean_cnt, count(stdev_mapq_Match) AS stdev_cnt, " + ", ".join(f"count({c}) AS {c}_n, sum({c})::DOUBLE AS {c}_sum, sum({c} * {c})::DOUBLE AS {c}_sum2" for c in _COLS) + f" FROM {POSITIONS} GROUP BY contig % 4", "aln", "expanded"),
    " ".join(f"{c}_sum {c}_sum2" for c in _COLS),
)(lambda t: N.sufficient_stats(position_features(t).withColumn("file", F.col("contig") % 4), ["file"], _COLS))
query(
    "nrm2_merge_stats",
    duck("SELECT " + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_stdev" for c in _COLS) + f" FROM {POSITIONS}", "aln", "expanded"),
    " ".join(f"{c}_mean {c}_stdev" for c in _COLS),
)(lambda t: N.merge_stats(N.sufficient_stats(position_features(t).withColumn("file", F.col("contig") % 4), ["file"], _COLS), _COLS))
query(
    "nrm3_zscore",
    duck(f"SELECT contig, position, coalesce((f.mean_mapq_Match - m) / s, 0) AS mean_mapq_Match, (coverage - cm) / cs AS coverage FROM {POSITIONS} f CROSS JOIN (SELECT avg(mean_mapq_Match) AS m, stddev_pop(mean_mapq_Match) AS s, avg(coverage) AS cm, stddev_pop(coverage) AS cs FROM {POSITIONS})", "aln", "expanded"),
    "mean_mapq_Match coverage",
)(lambda t: (lambda f: N.zscore(f, N.merge_stats(N.sufficient_stats(f, [], _COLS), _COLS), ("mean_mapq_Match", "coverage")).select("contig", "position", "mean_mapq_Match", "coverage"))(position_features(t)))
query("nrm4_recompute_meta", duck(f"SELECT contig, count(*) AS length, round(avg(coverage), 5) AS avg_coverage FROM {POSITIONS} GROUP BY contig", "aln", "expanded"), "avg_coverage")(lambda t: N.recompute_meta(position_features(t), []))
query(
    "nrm5_insert_size_gate",
    duck(f"SELECT *, CASE WHEN q04 >= 117 AND q96 <= 493 THEN 'safe' WHEN q05 >= 117 AND q95 <= 493 THEN 'borderline' ELSE 'reject' END AS verdict FROM (SELECT {', '.join(f'quantile_cont(mean_insert_size_Match, {q}) AS q{n}' for q, n in ((.04, '04'), (.05, '05'), (.95, '95'), (.96, '96')))} FROM {POSITIONS})", "aln", "expanded"),
    "q04 q05 q95 q96",
)(lambda t: N.insert_size_gate(position_features(t)))
query("ag2_contig_means", duck(f"SELECT contig, avg(coverage) AS coverage, avg(mean_mapq_Match) AS mean_mapq_Match, max(position)::INT AS length FROM {POSITIONS} GROUP BY contig", "aln", "expanded"), "coverage mean_mapq_Match")(
    lambda t: R.group_means(position_features(t), ["contig"], ["coverage", "mean_mapq_Match"], "position")
)
# every column of the workflow, its coverage cap included: alignments in hash order up to 20-fold
_CAPPED = """capped AS (SELECT * FROM (SELECT *, sum(mlen) OVER (PARTITION BY contig ORDER BY ('0x' || substr(md5(okey || '#8192'), 1, 8))::BIGINT & 2147483647, pos, ln, mlen, tlen ROWS UNBOUNDED PRECEDING) / 1049.0 AS cov FROM aln WHERE tlen <= 30000) WHERE cov < 20),
  laid AS (SELECT contig, flag, mapq, tlen, as_score, ln, pos + k AS position, substr('ACGT', CAST((okey + k) % 4 AS INT) + 1, 1) AS base, substr('ACGT', CAST((contig * 7 + (pos + k) * 3) % 4 AS INT) + 1, 1) AS ref_base FROM (SELECT *, unnest(range(0, mlen)) AS k FROM capped)),"""
_SPINE = """spine AS (SELECT contig, position, substr('ACGT', CAST((contig * 7 + position * 3) % 4 AS INT) + 1, 1) AS ref_base,
    list_transform(range(0, 6), lambda i: substr('ACGT', CAST((contig * 7 + (CASE WHEN position < 524 THEN position ELSE position - 5 END + i) * 3) % 4 AS INT) + 1, 1)) AS win
    FROM (SELECT DISTINCT contig FROM aln) CROSS JOIN (SELECT unnest(range(0, 1049))::INT AS position)),"""
_ALL_COUNTS = ("coverage", "num_query_A", "num_query_C", "num_query_G", "num_query_T", "num_discordant", "num_discordant_Match", "num_proper_Match", "num_proper_SNP", "num_orphans_Match", "num_SNPs")
_ALL_STATS = tuple(f"{k}_{f}_Match" for f in ("insert_size", "mapq", "al_score") for k in ("min", "mean", "stdev", "max"))
_TYPE_BITS = "CASE m.type WHEN 'relocation' THEN 1 WHEN 'translocation' THEN 2 WHEN 'inversion' THEN 4 WHEN 'interspecies translocation' THEN 8 END"
_HAS = "len(list_filter(win, lambda x: x = '{b}'))"
_EXTRACTED = duck(
    f"""found AS (SELECT contig, position, count(*) AS coverage, {_BASES}, {_PAIR}, count_if(base <> ref_base AND ln % 3 <> 0) AS num_SNPs,
      {_four("tlen", "insert_size_Match", _MATCH)}, {_four("mapq", "mapq_Match", _MATCH)}, {_four("greatest(-128, least(127, as_score))", "al_score_Match", _MATCH)} FROM laid GROUP BY contig, position),
    labels AS (SELECT s.contig, s.position, string_agg(DISTINCT m.type, ',' ORDER BY m.type) AS by_pos, bit_or({_TYPE_BITS})::INT AS mask FROM spine s JOIN mis m ON m.contig = s.contig AND s.position + 1 BETWEEN m."start" AND m."end" GROUP BY ALL)
    SELECT s.contig, s.position, s.ref_base, {", ".join(f"coalesce(f.{c}, 0)::BIGINT AS {c}" for c in _ALL_COUNTS)}, {", ".join(f"f.{c}" for c in _ALL_STATS)},
      -list_sum(list_transform(list_filter([{", ".join(_HAS.format(b=b) for b in "ACGT")}], lambda n: n > 0), lambda n: n / 6.0 * log2(n / 6.0))) AS seq_window_entropy, ({_HAS.format(b="C")} + {_HAS.format(b="G")}) / 6.0 AS seq_window_perc_gc,
      coalesce(l.by_pos, 'None') AS Extensive_misassembly_by_pos, coalesce(l.mask, 0)::INT AS mask, (s.contig IN (SELECT contig FROM mis))::INT AS Extensive_misassembly
    FROM spine s LEFT JOIN found f USING (contig, position) LEFT JOIN labels l USING (contig, position)""",
    "aln", "mis",
).replace(") found AS", ") , " + _CAPPED + _SPINE + " found AS", 1)
query("extract_features", _EXTRACTED, " ".join(c for c in (*_ALL_STATS, "seq_window_entropy", "seq_window_perc_gc") if not c.startswith(("min", "max"))))(
    lambda t: (lambda df: df.withColumns({c: F.col(c).cast("long") for c in _ALL_COUNTS}))(extract_features(t.alignments(), t.contigs(), t.view("mis"), ties=("pos", "ln", "mlen", "tlen")))
)
