"""Per-position features of read alignments (PIL1-PIL16).

Alignments have one row a read: sample, read_id, flag, contig, pos (0-based),
mapq, cigar, mate_pos, tlen, seq, qual, as_score. Everything is Spark SQL.

A read becomes its aligned stretches, cut at the borders of pieces of contigs and
dealt once, by piece, so that deep or long contigs spread over tasks and a stretch
meets its piece of the sequence only. Sequences are binary there, where a base is
found in one step. Positions are laid out last; the aggregate by piece and position
needs no other exchange, and one aggregate serves all features.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asmlens.functions.columns import chunk_starts

# Bits of the alignment flag.
PAIRED, PROPER, MATE_UNMAPPED, UNMAPPED, REVERSE, MATE_REVERSE, SECONDARY, SUPPLEMENTARY = 1, 2, 8, 4, 16, 32, 256, 2048
KEYS = ("sample", "contig")
LEAST_QUALITY = 13
# Names of the count features.
COUNTS = ("num_query_A", "num_query_C", "num_query_G", "num_query_T", "num_SNPs", "num_discordant", "num_proper_Match", "num_orphans_Match", "num_discordant_Match", "num_proper_SNP")
CHUNK = 10_000
TASK = 1 << 20  # positions of a task
PIECE = 1_000  # positions that are dealt together; a very deep piece is one task
OTHER_LETTERS = "BDEFHIJKLMOPQRSVWXYZ=.*-"


def has(flag: int, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(F.lit(flag)) != 0


def base_class(column: str | Column) -> Column:
    """A, C, G, T (U counts as T) for each base of a sequence; any other letter is N."""
    upper = F.upper(F.col(column) if isinstance(column, str) else column)
    return F.translate(upper, "U" + OTHER_LETTERS, "T" + "N" * len(OTHER_LETTERS))


def cigar_ops(cigar: str = "cigar") -> Column:
    """Array of (n, op, ref0, query0): each operation with the reference and query bases consumed before it."""
    tokens = F.regexp_extract_all(F.col(cigar), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    ops = F.transform(tokens, lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("n"), F.right(t, F.lit(1)).alias("op")))
    start = F.expr("named_struct('done', cast(array() as array<struct<n:int,op:string,ref0:int,query0:int>>), 'r', 0, 'q', 0)")

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["n"].alias("n"), x["op"].alias("op"), acc["r"].alias("ref0"), acc["q"].alias("query0"))
        ref = F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(0)
        query = F.when(x["op"].isin("M", "=", "X", "I", "S"), x["n"]).otherwise(0)
        return F.struct(F.concat(acc["done"], F.array(here)).alias("done"), (acc["r"] + ref).alias("r"), (acc["q"] + query).alias("q"))

    return F.aggregate(ops, start, step, lambda acc: acc["done"])


def _bytes(column: str, start: Column, n: Column) -> Column:
    """Bytes ``start`` (from 0) on of a binary column."""
    return F.substring(F.col(column), start + 1, n)


def _letter(column: str, k: Column) -> Column:
    return _bytes(column, k, F.lit(1)).cast("string")


def aligned_stretches(aln: DataFrame, keep: tuple[str, ...] = (), min_mapq: int = 0, exclude_flags: int = 0) -> DataFrame:
    """Rows (keys, keep, op, start, n, bases, quals): a row for each run of reference positions of a read.

    ``op`` is M, D or N; ``bases`` and their qualities are binary, and null but for M.
    Unmapped reads are left out; all other reads count unless asked otherwise.
    """
    # not as a filter, which Spark would push into whatever makes the reads, and make them twice; no operations are no rows
    rows = aln.withColumn("cigar", F.when(~has(UNMAPPED), F.col("cigar")))
    if min_mapq:
        rows = rows.where(F.col("mapq") >= min_mapq)
    if exclude_flags:
        rows = rows.where(F.col("flag").bitwiseAND(F.lit(exclude_flags)) == 0)
    keys = [k for k in KEYS if k in aln.columns]
    whole = {"_bases": F.col("seq").cast("binary"), "_quals": F.when(F.col("qual") != "*", F.col("qual")).cast("binary")}
    # outer, as Spark would else add a filter that finds the operations again; the condition drops the nulls
    rows = rows.select(*keys, *keep, "pos", *(c.alias(n) for n, c in whole.items()), F.explode_outer(cigar_ops()).alias("o")).where(F.col("o.op").isin("M", "=", "X", "D", "N") & (F.col("o.n") > 0))
    aligned = F.col("o.op").isin("M", "=", "X")
    part = lambda c: F.when(aligned, _bytes(c, F.col("o.query0"), F.col("o.n")))
    return rows.select(*keys, *keep, F.when(aligned, "M").otherwise(F.col("o.op")).alias("op"), (F.col("pos") + F.col("o.ref0")).alias("start"), F.col("o.n").alias("n"), part("_bases").alias("bases"), part("_quals").alias("quals"))


def contig_chunks(contigs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (keys, bin, low, size, part): the sequence in binary pieces of ``chunk`` bases."""
    keys = [k for k in KEYS if k in contigs.columns]
    rows = contigs.select(*keys, F.col("seq").cast("binary").alias("_seq")).withColumn("n", F.octet_length("_seq"))
    rows = rows.select(*keys, "n", "_seq", F.explode(chunk_starts("n", chunk)).alias("low"))
    return rows.select(*keys, (F.col("low") / chunk).cast("int").alias("bin"), "low", F.least(F.lit(chunk), F.col("n") - F.col("low")).alias("size"), _bytes("_seq", F.col("low"), F.lit(chunk)).alias("part"))


def _classes(column: str) -> Column:
    """Binary classes of binary bases; most have no other letters than the classes."""
    text = F.col(column).cast("string")
    return F.when(text.rlike("^[ACGTN]*$"), F.col(column)).otherwise(base_class(text).cast("binary"))


def _piece(keys: list[str]) -> Column:
    """The number that deals a piece: a hash of its contig and ``bin``, so null names are names."""
    return F.xxhash64(*keys, "bin")


def cut_pieces(stretches: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Stretches cut at the borders of pieces, with bin and piece."""
    last = (F.col("start") + F.col("n") - 1) / width
    rows = stretches.withColumn("bin", F.explode_outer(F.sequence((F.col("start") / width).cast("int"), last.cast("int"))))
    inner = F.greatest(F.col("start"), F.col("bin") * width)
    rows = rows.withColumns({"_at": inner - F.col("start"), "n": F.least(F.col("start") + F.col("n"), (F.col("bin") + 1) * width) - inner, "start": inner})
    return rows.withColumns({c: F.substring(F.col(c), F.col("_at") + 1, F.col("n")) for c in ("bases", "quals") if c in rows.columns}).withColumn("piece", _piece(keys)).drop("_at")


def meet_sequence(stretches: DataFrame, contigs: DataFrame, keys: list[str], width: int, window: int = 0, also: tuple[str, ...] = ()) -> DataFrame:
    """Stretches with their part of the sequence, ``ref``, and with what ``also`` names of their contig.

    With a ``window``, rows whose ``op`` is S have the letters around their piece too: near, its first place low, the
    window w, and the contig's length total. Both sides are dealt by piece and merged: a sequence is far larger than Spark supposes, and must not be broadcast.
    """
    rows = contigs.select(*keys, *also, F.col("seq").cast("binary").alias("_seq")).withColumn("total", F.octet_length("_seq"))
    rows = rows.withColumn("w", F.greatest(F.lit(1), F.least(F.lit(window), F.floor(F.col("total") / 2).cast("int"))) if window else F.lit(0))
    rows = rows.select("*", F.explode_outer(chunk_starts("total", width)).alias("_low")).where("_low is not null").withColumn("low", F.greatest(F.lit(0), F.col("_low") - F.col("w")))
    rows = rows.withColumns({"bin": (F.col("_low") / width).cast("int"), "_part": _bytes("_seq", F.col("low"), width + 2 * F.col("w"))}).withColumn("_piece", _piece(keys))
    rows = rows.select("_piece", *(F.col(k).alias(f"_{k}") for k in [*keys, "bin"]), *also, "total", "w", "low", "_part")
    # positions are laid out after the exchange, which Spark does not foresee when it chooses the number of tasks
    tasks = max(int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(contigs.agg(F.sum(F.octet_length("seq"))).first()[0] or 0) // TASK))
    stretches, rows = stretches.repartition(tasks, "piece"), rows.repartition(tasks, "_piece")
    # not as equalities, which would be keys of the join too
    same = [F.coalesce(F.col(k) == F.col(f"_{k}"), F.col(k).isNull() & F.col(f"_{k}").isNull()) for k in [*keys, "bin"]]
    out = stretches.join(rows.hint("merge"), F.col("piece") == F.col("_piece")).where(reduce(and_, same))
    out = out.withColumn("ref", _bytes("_part", F.col("start") - F.col("low"), F.col("n")))
    if window:
        out = out.withColumn("near", F.when(F.col("op") == "S", _classes("_part")))
    return out.drop("_piece", "_part", "_bin", *(f"_{k}" for k in keys), *(() if window else ("total", "w", "low")))


def lay_out(rows: DataFrame, keys: list[str], keep: tuple[str, ...]) -> DataFrame:
    """A row for each position of the stretches."""
    known = "ref" in rows.columns
    rows = rows.withColumn("classes", _classes("bases"))
    rows = rows.withColumn("ref_classes", _classes("ref")) if known else rows
    rows = rows.withColumn("k", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)))
    k, aligned = F.col("k"), F.col("op") == "M"
    base_class_here = F.when(aligned, _letter("classes", k)).otherwise("N")
    columns = [
        (F.col("start") + k).alias("position"),
        F.when(aligned, _letter("bases", k)).when(F.col("op") == "D", "-").otherwise("N").alias("base"),
        base_class_here.alias("base_class"),
        F.when(aligned, F.ascii(_letter("quals", k)) - 33).alias("base_quality"),
    ]
    if known:
        ref = _letter("ref_classes", k)
        match = base_class_here == F.when(ref == "", "N").otherwise(ref)
        columns += [_letter("ref", k).alias("ref_base"), F.when(F.col("op").isin("M", "D", "N"), match).alias("is_match")]
    return rows.select(*keys, "piece", *keep, *columns)


def expand_alignments(aln: DataFrame, contigs: DataFrame | None = None, keep: tuple[str, ...] = ("flag", "mapq", "tlen", "as_score"), min_mapq: int = 0, exclude_flags: int = 0, width: int = PIECE) -> DataFrame:
    """PIL1 (and PIL2 with ``contigs``): a row for each read and reference position.

    Columns: sample, contig, piece, position, base (``-`` in a deletion, ``N`` in a skip), base_class, base_quality (null if
    missing), and with contigs ref_base and is_match. Positions outside the sequence have an empty ref_base. Rows are dealt
    by ``piece``, a number of contig and stretch of ``width`` positions: aggregates by it and more need no other exchange.
    """
    keys = [k for k in KEYS if k in aln.columns]
    rows = cut_pieces(aligned_stretches(aln, keep, min_mapq, exclude_flags), keys, width)
    if contigs is None:
        return lay_out(rows.repartition("piece"), keys, keep)
    return lay_out(meet_sequence(rows.dropna(subset=keys), contigs, keys, width), keys, keep)


def pair_class_counts(match: Column) -> list[Column]:
    """PIL3."""
    unmapped = has(MATE_UNMAPPED)
    discordant = has(PAIRED) & ~has(PROPER) & ~unmapped
    return [
        F.count_if(discordant).alias("num_discordant"),
        F.count_if(discordant & match).alias("num_discordant_Match"),
        F.count_if(has(PROPER) & ~unmapped & match).alias("num_proper_Match"),
        F.count_if(has(PROPER) & ~unmapped & ~match).alias("num_proper_SNP"),
        F.count_if(unmapped & match).alias("num_orphans_Match"),
    ]


def base_counts(least_quality: int = LEAST_QUALITY) -> list[Column]:
    """PIL5: bases of enough quality; a missing quality passes."""
    good = F.col("base_quality").isNull() | (F.col("base_quality") >= least_quality)
    return [F.count_if((F.col("base_class") == b) & good).alias(f"num_query_{b}") for b in "ACGT"]


def num_snps(ref_base: str = "ref_base") -> Column:
    """PIL6: base counts of bases other than the reference's."""
    return sum((F.when(base_class(ref_base) == b, 0).otherwise(F.col(f"num_query_{b}")) for b in "ACGT"), F.lit(0))


def four_stats(value: Column, name: str, when: Column) -> list[Column]:
    """Minimum, mean, sample deviation and maximum of whole numbers over the rows that hold, from their sums and sums of squares."""
    v = F.when(when, value).cast("double")
    n, s, q = F.count(v), F.sum(v), F.sum(v * v)
    deviation = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), n * q - s * s) / (n * (n - 1))))
    return [F.min(F.when(when, value)).alias(f"min_{name}"), (s / n).alias(f"mean_{name}"), deviation.alias(f"stdev_{name}"), F.max(F.when(when, value)).alias(f"max_{name}")]


def insert_size_stats(when: Column, side: str = "Match") -> list[Column]:
    """PIL7."""
    return four_stats(F.abs(F.col("tlen")), f"insert_size_{side}", when)


def mapq_stats(when: Column, side: str = "Match") -> list[Column]:
    """PIL8."""
    return four_stats(F.col("mapq"), f"mapq_{side}", when)


def al_score_stats(when: Column, side: str = "Match") -> list[Column]:
    """PIL9: the whole score is clamped to a signed byte; a missing score is 0."""
    return four_stats(F.greatest(F.lit(-128), F.least(F.lit(127), F.coalesce(F.col("as_score"), F.lit(0)))), f"al_score_{side}", when)


def supp_secondary_counts(when: Column, side: str = "Match") -> list[Column]:
    """PIL10."""
    return [F.count_if(when & has(SUPPLEMENTARY)).alias(f"num_supplementary_{side}"), F.count_if(when & has(SECONDARY)).alias(f"num_secondary_{side}")]


def snp_side_stats() -> list[Column]:
    """PIL11: the statistics of mismatching reads; insert sizes of paired reads only."""
    other = ~F.col("is_match")
    unmapped = has(MATE_UNMAPPED)
    discordant = has(PAIRED) & ~has(PROPER) & ~unmapped
    return [
        *insert_size_stats(other & has(PAIRED), "SNP"),
        *mapq_stats(other, "SNP"),
        F.count_if(discordant & other).alias("num_discordant_SNP"),
        F.count_if(unmapped & other).alias("num_orphans_SNP"),
        *supp_secondary_counts(other, "SNP"),
    ]


def diff_strand_count(when: Column, side: str = "Match") -> Column:
    """Extended profile: both mates mapped, on opposite strands."""
    return F.count_if(when & has(PAIRED) & ~has(MATE_UNMAPPED) & (has(REVERSE) != has(MATE_REVERSE))).alias(f"num_diff_strand_{side}")


def features(profile: str = "standard", least_quality: int = LEAST_QUALITY, reads: Column | None = None) -> list[Column]:
    """The aggregates of a profile over expanded alignments with matches, but num_SNPs; ``reads`` tells their rows from others."""
    match = F.col("is_match")
    # as a number, so that the aggregate hashes and need not sort the positions
    code = F.max(F.ascii("ref_base"))
    coverage = F.count("*") if reads is None else F.count_if(reads)
    columns = [F.when(code > 0, F.char(code)).otherwise("").alias("ref_base"), coverage.alias("coverage"), *base_counts(least_quality), *pair_class_counts(match)]
    if profile not in ("short", "standard", "extended"):
        raise ValueError(f"unknown profile {profile!r}")
    if profile != "short":
        columns += [*insert_size_stats(match), *mapq_stats(match), *al_score_stats(match)]
    if profile == "extended":
        columns += [*supp_secondary_counts(match), *snp_side_stats(), diff_strand_count(match), diff_strand_count(~match, "SNP")]
    return columns


def pileup(expanded: DataFrame, profile: str = "standard", least_quality: int = LEAST_QUALITY) -> DataFrame:
    """PIL3-PIL11 in one aggregate over expanded alignments with matches: a row for each covered position."""
    keys = [k for k in (*KEYS, "piece") if k in expanded.columns]
    out = expanded.groupBy(*keys, "position").agg(*features(profile, least_quality)).drop("piece")
    return out.withColumn("num_SNPs", num_snps())


def dense_positions(features: DataFrame, contigs: DataFrame, chunk: int = CHUNK, spine: DataFrame | None = None) -> DataFrame:
    """PIL12: every position of every contig; counts are 0 and statistics null where nothing aligns.

    Contigs are cut into chunks before positions are laid out, so one long contig is spread over tasks.
    ``spine`` gives the positions ready, with their ``own_base`` and whatever else is known of them.
    """
    keys = [k for k in KEYS if k in features.columns]
    if spine is not None:
        pass
    elif "seq" in contigs.columns:
        pieces = contig_chunks(contigs, chunk)
    else:
        pieces = contigs.select(*keys, "length", F.explode(chunk_starts("length", chunk)).alias("low")).withColumns({"size": F.least(F.lit(chunk), F.col("length") - F.col("low")), "part": F.lit(None).cast("binary")})
    if spine is None:
        spine = pieces.select(*keys, "low", "part", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k"))
        spine = spine.select(*keys, (F.col("low") + F.col("k")).alias("position"), _letter("part", F.col("k")).alias("own_base"))
    out = spine.join(features, [*keys, "position"], "left")
    whole = [c for c in features.columns if c == "coverage" or c.startswith("num_")]
    out = out.fillna(0, whole)
    if "ref_base" in features.columns:
        out = out.withColumn("ref_base", F.coalesce("own_base", "ref_base"))
    return out.drop("own_base")


def ratio_normalize(features: DataFrame, columns: tuple[str, ...] | None = None, as_fixed: bool = False) -> DataFrame:
    """PIL13: counts over coverage (over 1 where nothing covers); ``as_fixed`` gives ten-thousandths, cut off."""
    columns = columns or tuple(c for c in COUNTS if c in features.columns)
    ratio = lambda c: F.col(c) / F.greatest(F.col("coverage"), F.lit(1))
    return features.withColumns({c: F.floor(F.col(c) * 10000 / F.greatest(F.col("coverage"), F.lit(1))).cast("int") if as_fixed else ratio(c) for c in columns})


def contig_len_check(headers: DataFrame, contigs: DataFrame) -> DataFrame:
    """PIL14: rows (contig, header_length, length, problem) of contigs unknown or of another length."""
    keys = [k for k in KEYS if k in headers.columns and k in contigs.columns]
    both = headers.select(*keys, F.col("length").alias("header_length")).join(contigs.select(*keys, "length"), keys, "left")
    problem = F.when(F.col("length").isNull(), "unknown contig").when(F.col("length") != F.col("header_length"), "length differs")
    return both.withColumn("problem", problem).where("problem is not null")


def binned_coverage(features: DataFrame, width: int = 50) -> DataFrame:
    """PIL15: mean depth of bins of ``width`` positions."""
    keys = [k for k in KEYS if k in features.columns]
    return features.groupBy(*keys, F.floor(F.col("position") / width).cast("long").alias("bin")).agg(F.avg("coverage").alias("mean_depth"))


def pileup_text(expanded: DataFrame) -> DataFrame:
    """PIL16: depth and the sorted bases of each position; positions whose reference is N are dropped."""
    keys = [k for k in KEYS if k in expanded.columns]
    counted = expanded.where(base_class("ref_base") != "N").groupBy(*keys, "position", "base").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "n"))), lambda x: F.repeat(x["base"], x["n"].cast("int"))), "")
    return counted.groupBy(*keys, "position").agg(F.sum("n").alias("depth"), text.alias("bases"))
