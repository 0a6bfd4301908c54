"""Registered queries: sampling, filtering, training sets, scores, metrics; and the evaluation and filter workflows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.functions.columns import random_int
from asmlens.functions.storage import shared_folder
from asmlens.operators import metrics as E
from asmlens.operators import sampling as S
from asmlens.operators import scoring as C
from asmlens.operators import stats as N
from asmlens.operators import training as R
from asmlens.operators.pileup import KEYS
from asmlens.plans.adapters import Tables, duck
from asmlens.plans.features import POSITIONS, position_features
from asmlens.plans.registry import query
from asmlens.plans.training import train


def evaluate(
    meta: DataFrame,
    features: DataFrame,
    model: Callable,
    columns: list[str],
    normalizer: DataFrame | None = None,
    max_len: int = 20000,
    min_len: int = 1000,
    min_avg_coverage: float = 1.0,
    method: str = "max",
    verify_percent: float | None = None,
    embeddings: int | None = None,
    eval_ids: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """Contig scores: metadata filter, z-scores, a matrix of positions a chunk, model, one score a contig.

    ``normalizer`` is the row of stored statistics (``merge_stats``). ``model`` maps batches of chunks, whose columns
    are arrays over positions, to the same rows with ``score``. With ``verify_percent`` the insert sizes of so many
    percent of the contigs are checked first, and data that the gate rejects raise an error.

    ``eval_ids`` restricts the contigs to a list. ``embeddings`` takes that many random contigs instead, of a model that
    also returns an ``embedding`` a chunk: each contig then has the mean of its chunks' vectors, joined by ``|``, beside its
    score and the least, mean, deviation and greatest of its chunks' scores.
    """
    if verify_percent is not None:
        some = features.where(random_int("contig", 1) < int(verify_percent / 100 * (1 << 31)))
        if (gate := N.insert_size_gate(some).first()).verdict == "reject":
            raise ValueError(f"insert sizes lie outside the model's range: {gate.asDict()}")
    keys = [k for k in KEYS if k in meta.columns and k in features.columns]
    chosen = S.contig_meta_filter(meta, min_len, min_avg_coverage)
    if eval_ids is not None:
        chosen = chosen.join(eval_ids.select(*keys).distinct(), keys, "left_semi")
    elif embeddings is not None:
        chosen = C.sample_for_embeddings(chosen, embeddings, keys, seed)
    chunks = C.evaluation_chunks(chosen, max_len).select(*keys, "chunk", "chunk_start", "chunk_end")
    rows = features if normalizer is None else N.zscore(features, normalizer, tuple(columns))
    matrices = C.chunk_matrices(rows, chunks, columns, max(250, max_len - 500))
    scored = C.score_chunks(matrices, model, embeddings is not None)
    out = C.group_scores(scored, keys, method, ["chunk"])
    if embeddings is None:
        return out
    s = F.col("score")
    spread = scored.groupBy(*keys).agg(F.min(s).alias("min"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.max(s).alias("max"))
    return out.join(spread, keys).join(C.group_embeddings(scored, keys), keys)


def filter_contigs(contigs: DataFrame, predictions: DataFrame, score_cutoff: float = 0.8, **options) -> tuple[DataFrame, DataFrame]:
    """Kept contigs with their scores, and the counts."""
    judged = S.filter_contigs_by_score(contigs, predictions, score_cutoff, **options)
    return judged.where("kept"), S.filter_counts(judged)


def build_training_set(meta: DataFrame, frac_neg: float, max_len: int, epoch: int = 0, translations: int = 1, weight_factor: float = 0, seed: int = 0) -> DataFrame:
    """Training rows of one epoch: classes balanced, windows chosen, weights set."""
    rows = R.class_downsample(meta.withColumn("label", (F.col("misassembly_cnt") > 0).cast("int")), frac_neg, translations=translations, epoch=epoch)
    return R.select_training_interval(rows, max_len, seed=seed).withColumn("weight", R.length_weight("length", weight_factor))


def rand(key: str, seed: int = 0) -> str:
    """``random_int`` in SQL."""
    return f"(('0x' || substr(md5(({key})::VARCHAR || '#{seed}'), 1, 8))::BIGINT & 2147483647)"


# --- sampling

_TIES = ("pos", "ln", "mlen", "tlen", "mapq")
query(
    "smp1_cap_coverage",
    duck(f"SELECT contig, okey, pos, ln, mlen, cov FROM (SELECT *, sum(mlen) OVER (PARTITION BY contig ORDER BY {rand('okey', 3)}, pos, ln, mlen, tlen, mapq ROWS UNBOUNDED PRECEDING) / 1049.0 AS cov FROM aln WHERE tlen <= 600) WHERE cov < 5", "aln"),
    "cov",
)(lambda t: S.cap_coverage(t.alignments(), t.contigs(), 5, 600, 3, ties=_TIES, read_length="mlen").select("contig", "okey", "pos", "ln", "mlen", "cov"))
query("smp1_coverage_report", duck(f"SELECT contig, max(cov) AS coverage FROM (SELECT *, sum(mlen) OVER (PARTITION BY contig ORDER BY {rand('okey', 3)}, pos, ln, mlen, tlen, mapq ROWS UNBOUNDED PRECEDING) / 1049.0 AS cov FROM aln WHERE tlen <= 600) WHERE cov < 8 GROUP BY contig", "aln"), "coverage")(
    lambda t: S.coverage_report(S.cap_coverage(t.alignments(), t.contigs(), 8, 600, 3, ties=_TIES, read_length="mlen"))
)
query("smp2_contig_frac", duck(f"SELECT contig, length FROM meta WHERE {rand('contig', 5)} < {int(0.3 * 2147483648)}", "meta"))(lambda t: S.contig_frac(t.view("meta"), 0.3, seed=5).select("contig", "length"))
query("smp3_sample_n_reads", duck(f"SELECT DISTINCT okey FROM (SELECT okey FROM (SELECT DISTINCT okey FROM aln) ORDER BY {rand('okey', 2)}, okey LIMIT 100)", "aln"))(
    lambda t: S.sample_n_reads(t.view("aln").select("okey").distinct(), 100, 2, "okey")
)
query("flt1_min_contig_length", duck("SELECT contig, length FROM meta WHERE length >= 1000", "meta"))(lambda t: S.min_contig_length(t.view("meta"), 1000).select("contig", "length"))
query(
    "flt2_contig_meta_filter",
    duck("SELECT count(*) AS n_all, count_if(k) AS n_kept, count_if(NOT k) AS n_excluded, count_if(misassembly_cnt > 0) AS misassembled_all, count_if(misassembly_cnt > 0 AND k) AS misassembled_kept, sum(CASE WHEN k THEN length END)::BIGINT AS total_length, quantile_cont(CASE WHEN k THEN length END::DOUBLE, 0.5) AS median_length FROM (SELECT *, length >= 1000 AND avg_coverage >= 1 AS k FROM meta)", "meta"),
    "median_length",
)(lambda t: S.contig_meta_summary(t.view("meta")))
_JUDGED = "(SELECT m.contig, m.length, coalesce(p.score, 0) AS score, p.contig IS NOT NULL AS matched, coalesce(p.score, 0) < 0.8 OR m.length < 500 AS kept FROM meta m LEFT JOIN preds p ON p.contig = m.contig)"
query("flt3_filter_contigs", duck(f"SELECT * FROM {_JUDGED}", "meta", "preds"), "score")(lambda t: S.filter_contigs_by_score(t.view("meta").select("contig", "length"), t.view("preds"), 0.8, 500).select("contig", "length", "score", "matched", "kept"))
query("flt3_filter_counts", duck(f"SELECT count(*) AS total, count_if(kept) AS kept, count_if(NOT kept) AS filtered, count_if(matched) AS matched FROM {_JUDGED}", "meta", "preds"))(
    lambda t: filter_contigs(t.view("meta").select("contig", "length"), t.view("preds"), 0.8, min_length=500)[1]
)
query("flt4_prediction_summary", duck('SELECT count(*) AS n, round(min(score::DOUBLE), 2) AS "min", round(avg(score::DOUBLE), 2) AS mean, round(max(score::DOUBLE), 2) AS "max" FROM preds', "preds"))(
    lambda t: S.prediction_summary(t.view("preds").withColumn("score", F.col("score").cast("double")))
)
query("flt5_score_cutoffs", duck("SELECT contig, score, 'score cutoff outside [0, 1]' AS warning FROM (SELECT contig, score * 2 AS score FROM preds) WHERE score > 1", "preds"), "score")(
    lambda t: S.score_cutoff_check(t.view("preds").select("contig", (F.col("score") * 2).alias("score")), "score")
)
query("ren1_sanitize_name", "SELECT p_partkey, regexp_replace(p_name || ':' || p_type, '[^A-Za-z0-9_]+', '_', 'g') AS name FROM part")(lambda t: S.rename_sanitized(t["part"].select("p_partkey", F.concat("p_name", F.lit(":"), "p_type").alias("name")), "name"))
query(
    "ren2_number_contigs",
    duck("SELECT contig, 'c_' || file || '_CONTIG' || (row_number() OVER (PARTITION BY file ORDER BY contig) - 1) AS new_name FROM meta WHERE length >= 500", "meta"),
)(lambda t: S.number_contigs(t.view("meta").withColumn("header", F.concat(F.lit("c "), "file")), 500, order="contig").select("contig", "new_name"))
query("ren3_strip_non_ascii", "SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')) AS line FROM documents")(
    lambda t: S.strip_non_ascii(t["documents"].select("doc_id", F.col("text").alias("line"))).withColumn("line", F.md5("line"))
)
query("ren3_non_ascii_report", "SELECT line_no, char, count(*) AS n FROM (SELECT doc_id AS line_no, unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS char FROM documents) GROUP BY ALL")(
    lambda t: S.non_ascii_report(t["documents"].select(F.col("doc_id").alias("line_no"), F.col("text").alias("line")))
)
_PATH = "'feat/' || (o_orderkey % 5) / 10.0 || '/' || o_orderpriority || '/' || o_orderkey % 3 || '/150/' || o_custkey || '/megahit/' || o_orderkey % 7 || '/features.tsv.gz'"
query(
    "ren4_extract_path_params",
    "SELECT o_orderkey, (o_orderkey % 5) / 10.0 AS richness, (o_orderkey % 3)::INT AS rep, o_custkey::INT AS read_depth, 'megahit' AS assembler, (o_orderkey % 7)::DOUBLE AS contig_frac, o_orderpriority AS abundance_distribution FROM orders",
    "richness contig_frac",
)(
    lambda t: S.extract_path_params(t["orders"].select("o_orderkey", F.concat(F.lit("feat/"), (F.col("o_orderkey") % 5 / 10).cast("string"), F.lit("/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey") % 3, F.lit("/150/"), "o_custkey", F.lit("/megahit/"), F.col("o_orderkey") % 7, F.lit("/features.tsv.gz")).alias("path"))).select(
        "o_orderkey", "richness", "rep", "read_depth", "assembler", "contig_frac", "abundance_distribution"
    )
)

# --- training sets

query("trn1_train_eval_split", duck(f"SELECT contig, CASE WHEN ({rand('contig', 1)}) % 100 < 10 THEN 'eval' ELSE 'train' END AS split FROM meta", "meta"))(lambda t: R.train_eval_split(t.view("meta").select("contig"), seed=1))
query("trn1_split_by_ids", duck("SELECT contig, CASE WHEN contig IN (SELECT contig FROM preds) THEN 'eval' ELSE 'train' END AS split FROM meta", "meta", "preds"))(
    lambda t: R.train_eval_split(t.view("meta").select("contig"), eval_ids=t.view("preds"))
)
query(
    "trn2_class_downsample",
    duck(f"SELECT contig, misassembly_cnt, unnest(range(1, 3))::INT AS translation FROM (SELECT *, row_number() OVER (PARTITION BY misassembly_cnt ORDER BY {rand('contig', 4)}, contig) AS r, count(*) OVER (PARTITION BY misassembly_cnt) AS n FROM meta) WHERE misassembly_cnt = 1 OR r <= floor(n * 0.25)", "meta"),
)(lambda t: R.class_downsample(t.view("meta").select("contig", "misassembly_cnt"), 0.25, label="misassembly_cnt", translations=2, epoch=4))
_LOW, _HIGH = "greatest(0, hi - 1500 + 50)", "least(length - 1500, lo - 50)"
query(
    "trn3_training_interval",
    duck(f"""SELECT contig, s::INT AS start_idx, CASE WHEN length > 1500 THEN least(s + 1500, length) ELSE length END::INT AS end_idx FROM (SELECT *, CASE
      WHEN length > 1500 AND misassembly_cnt > 0 THEN {_LOW} + ({rand('contig')}) % greatest({_HIGH} - {_LOW}, 1)
      WHEN length > 1500 THEN ({rand('contig')}) % greatest(length - 1500 + 1, 1)
      WHEN misassembly_cnt > 0 THEN ({rand('contig')}) % greatest(least(11, greatest(1, lo - 50)), 1) ELSE ({rand('contig')}) % 11 END AS s FROM meta)""", "meta"),
)(lambda t: R.select_training_interval(t.breakpoints(), 1500).select("contig", "start_idx", "end_idx"))
query("trn4_slice_features", "SELECT vec_id, 10 AS mask_len, list_sum(list_slice(embedding, 6, 15))::DOUBLE AS total, 20 AS n FROM embeddings", "total")(
    lambda t: R.slice_features(t["embeddings"].select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.lit(5).alias("start_idx"), F.lit(15).alias("end_idx")), ["x"], 20).select("vec_id", "mask_len", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("x").alias("n"))
)
query("trn5_length_weight", duck("SELECT contig, least(1.0, pow(length / 4000.0, 2)) AS weight FROM meta", "meta"), "weight")(lambda t: t.view("meta").select("contig", R.length_weight("length", 4000).alias("weight")))
query("trn6_batch_assign", duck("SELECT contig, CAST((row_number() OVER (PARTITION BY file ORDER BY length, contig) - 1) // 7 AS BIGINT) AS batch FROM meta", "meta"))(lambda t: R.batch_assign(t.view("meta"), 7, ["length", "contig"], ["file"]).select("contig", "batch"))
query("trn7_random_labels", duck(f"SELECT contig, CAST(floor(({rand('contig', 9)}) / 65536) AS BIGINT) % 2 AS label FROM meta", "meta"))(lambda t: R.random_labels(t.view("meta").select("contig"), seed=9).withColumn("label", F.col("label").cast("long")))
_LAYERS = [{"kernel": 10}, {"kernel": 5, "stride": 2}, {"kernel": 1, "stride": 2}, {"kernel": 5, "stride": 2, "padding": "same"}]
query("trn8_conv_output_length", duck("SELECT contig, 1 + (1 + ((1 + (length - 10)) - 5) // 2 - 5) // 2 AS unpadded, ceil(ceil((length - 9 - 4) / 2.0) / 2.0)::BIGINT AS padded FROM meta WHERE length > 100", "meta"))(
    lambda t: t.view("meta").where("length > 100").select("contig", R.conv_output_length("length", _LAYERS, False).cast("long").alias("unpadded"), R.conv_output_length("length", _LAYERS, True).cast("long").alias("padded"))
)
query(
    "build_training_set",
    duck(f"""SELECT contig, misassembly_cnt, s::INT AS start_idx, CASE WHEN length > 1500 THEN least(s + 1500, length) ELSE length END::INT AS end_idx, least(1.0, pow(length / 4000.0, 2)) AS weight FROM (SELECT *, CASE
      WHEN length > 1500 AND misassembly_cnt > 0 THEN {_LOW} + ({rand('contig')}) % greatest({_HIGH} - {_LOW}, 1)
      WHEN length > 1500 THEN ({rand('contig')}) % greatest(length - 1500 + 1, 1)
      WHEN misassembly_cnt > 0 THEN ({rand('contig')}) % greatest(least(11, greatest(1, lo - 50)), 1) ELSE ({rand('contig')}) % 11 END AS s
      FROM (SELECT *, row_number() OVER (PARTITION BY misassembly_cnt ORDER BY {rand('contig', 0)}, contig) AS r, count(*) OVER (PARTITION BY misassembly_cnt) AS n FROM meta) WHERE misassembly_cnt = 1 OR r <= floor(n * 0.5))""", "meta"),
    "weight",
)(lambda t: build_training_set(t.breakpoints(), 0.5, 1500, weight_factor=4000).select("contig", "misassembly_cnt", "start_idx", "end_idx", "weight"))

# --- chunks and scores

query("chk1_chunk_count", duck("SELECT contig, (1 + greatest(0, ceil((length - 500) / 300.0)))::INT AS n FROM meta", "meta"))(lambda t: t.view("meta").select("contig", C.chunk_count("length", 500, 300).alias("n")))
query(
    "chk2_sliding_chunks",
    duck("SELECT contig, chunk, s::INT AS chunk_start, least(length, s + 6000)::INT AS chunk_end FROM (SELECT contig, length, chunk, CASE WHEN length > 6000 AND length - chunk * 5500 < 5000 THEN length - 5000 ELSE chunk * 5500 END AS s FROM (SELECT contig, length, unnest(range(0, 1 + greatest(0, ceil((length - 6000) / 5500.0))::INT))::INT AS chunk FROM meta))", "meta"),
)(lambda t: C.evaluation_chunks(t.view("meta"), 6000).select("contig", "chunk", "chunk_start", "chunk_end"))
query(
    "chk3_memory_batches",
    duck("""rows AS (SELECT contig, file, (1 + greatest(0, ceil((length - 500) / 300.0)))::INT AS n_chunks, row_number() OVER (PARTITION BY file ORDER BY contig) AS r FROM meta),
      packed AS (SELECT file, contig, n_chunks, r, 0 AS batch, 1 AS members, n_chunks::BIGINT AS chunks FROM rows WHERE r = 1
        UNION ALL SELECT n.file, n.contig, n.n_chunks, n.r, p.batch + f::INT, CASE WHEN f THEN 1 ELSE p.members + 1 END, CASE WHEN f THEN n.n_chunks ELSE p.chunks + n.n_chunks END
          FROM (SELECT p.*, n.contig AS c2, n.n_chunks AS n2, p.members > 20 OR (p.chunks + n.n_chunks) * 13000 > 2000000 AS f FROM packed p JOIN rows n ON n.file = p.file AND n.r = p.r + 1) p JOIN rows n ON n.file = p.file AND n.r = p.r + 1)
      SELECT contig, file, n_chunks, batch::BIGINT AS batch FROM packed""", "meta").replace("WITH meta", "WITH RECURSIVE meta", 1).replace(") rows AS", "), rows AS", 1),
)(lambda t: C.memory_batches(t.view("meta").select("contig", "file", C.chunk_count("length", 500, 300).alias("n_chunks")), 2_000_000, 20, 500, 4, "file", ["contig"]))


def _logit(t: Tables) -> DataFrame:
    return t.view("chunks").select("contig", "chunk", F.col("score").alias("x"), (F.col("length") / 1000).alias("y"))


query("scr1_score_chunks", duck("SELECT contig, chunk, 1 / (1 + exp(-(2 * score - 0.1 * length / 1000.0 - 0.5))) AS score FROM chunks", "chunks"), "score")(
    lambda t: C.score_chunks(_logit(t), C.linear_logistic({"x": 2.0, "y": -0.1}, -0.5)).select("contig", "chunk", "score")
)


@query("scr2_fit_scorer")
def _(t):
    rows = t.view("chunks").groupBy("contig", "label").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").cast("double").alias("n"))
    split = R.train_eval_split(rows, eval_percent=30)
    model, _ = C.fit_scorer(split.where("split = 'train'"), split.where("split = 'eval'"), ["mean", "std", "n"])
    return model.transform(split.where("split = 'eval'").fillna(0)).select("contig", "label", F.col("prediction"))


_METHODS = {"max": "max(score)", "min": "min(score)", "mean": "avg(score)", "std": "stddev_pop(score)", "noisy_or": "1 - product(1 - score)"}
for _name, _sql in _METHODS.items():
    query(f"scr3_group_scores_{_name}", duck(f"SELECT contig, {_sql} AS score FROM chunks GROUP BY contig", "chunks"), "score")(lambda t, m=_name: C.group_scores(t.view("chunks"), ["contig"], m))
query("scr3_group_scores_sma", duck("SELECT contig, CASE WHEN count(*) <= 2 THEN avg(score) ELSE max((score + nxt) / 2) END AS score FROM (SELECT *, lead(score) OVER (PARTITION BY contig ORDER BY chunk) AS nxt FROM chunks) GROUP BY contig", "chunks"), "score")(
    lambda t: C.group_scores(t.view("chunks"), ["contig"], "sma", ["chunk"])
)
query("scr3_group_scores_list", duck("SELECT contig, string_agg(chunk::VARCHAR, ',' ORDER BY chunk) AS score FROM chunks GROUP BY contig", "chunks"))(
    lambda t: C.group_scores(t.view("chunks").withColumn("s", F.col("chunk").cast("string")), ["contig"], "list", ["chunk"], "s").withColumn("score", F.array_join("score", ","))
)
query("udx1_custom_method", duck("SELECT contig, quantile_cont(score, 0.9) AS score FROM chunks GROUP BY contig", "chunks"), "score")(lambda t: C.group_scores(t.view("chunks"), ["contig"], lambda s: F.percentile(s, F.lit(0.9))))
query("scr4_chunk_score_profile", duck('SELECT contig, min(score) AS "min", avg(score) AS mean, stddev_pop(score) AS std, max(score) AS "max", ' + ", ".join(f"quantile_cont(score, {k / 10}) AS p{10 * k}" for k in range(1, 10)) + " FROM chunks GROUP BY contig", "chunks"), '"min" mean std "max" ' .replace('"', "") + " ".join(f"p{10 * k}" for k in range(1, 10)))(
    lambda t: C.chunk_score_profile(t.view("chunks"), ["contig"])
)
query("scr5_first_chunk_rule", duck("SELECT contig, chunk FROM chunks WHERE length < 5000 OR length > 6000 OR chunk = 0", "chunks"))(lambda t: C.first_chunk_rule(t.view("chunks")).select("contig", "chunk"))
query("scr6_group_embeddings", "SELECT label, string_agg(printf('%.3f', m), '|' ORDER BY i) AS embedding FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label")(
    lambda t: C.group_embeddings(t["embeddings"], ["label"], decimals=3)
)
query("scr7_isotonic_calibration")(lambda t: C.isotonic_calibration(t.view("chunks")))
query("scr8_sample_for_embeddings", duck(f"SELECT contig FROM meta ORDER BY {rand('contig', 6)}, contig LIMIT 50", "meta"))(lambda t: C.sample_for_embeddings(t.view("meta").select("contig"), 50, seed=6))


_SCORED = """SELECT contig, max(score) AS score FROM (SELECT contig, chunk, 1 / (1 + exp(-(avg({z}) + {bias}))) AS score
  FROM ({features}) f JOIN (SELECT chunk, chunk * {step} AS s, least(1049, chunk * {step} + {width}) AS e FROM (SELECT unnest(range(0, {n})) AS chunk)) ON position >= s AND position < e GROUP BY contig, chunk) GROUP BY contig"""
_Z = f"(SELECT contig, position, coalesce((mean_mapq_Match - m) / sd, 0) AS zm, (coverage - cm) / csd AS zc FROM {POSITIONS} CROSS JOIN (SELECT avg(mean_mapq_Match) AS m, stddev_pop(mean_mapq_Match) AS sd, avg(coverage) AS cm, stddev_pop(coverage) AS csd FROM {POSITIONS}))"


def _meta_1049(t: Tables) -> DataFrame:
    return t.view("aln").select("contig").distinct().withColumns({"length": F.lit(1049), "avg_coverage": F.lit(2.0)})


@query("evaluate_contigs", duck(_SCORED.format(z="0.5 * zm - 0.2 * zc", bias="0.1", features="SELECT * FROM " + _Z, step=250, width=600, n=3), "aln", "expanded"), "score")
def _(t):
    """The evaluation workflow: stored statistics, z-scores, several chunks a contig, a model over positions."""
    features, columns = position_features(t), ["mean_mapq_Match", "coverage"]
    normalizer = N.merge_stats(N.sufficient_stats(features, [], tuple(columns)), tuple(columns))
    return evaluate(_meta_1049(t), features, C.mean_logistic({"mean_mapq_Match": 0.5, "coverage": -0.2}, 0.1), columns, normalizer, max_len=600, verify_percent=None)


_SOME = f"(SELECT contig FROM (SELECT DISTINCT contig FROM aln) ORDER BY {rand('contig', 4)}, contig LIMIT 20)"
_CHUNK_MEANS = f"""SELECT contig, chunk, avg(0.5 * zm) AS a, avg(-0.2 * zc) AS b FROM {_Z} f JOIN (SELECT chunk, chunk * 250 AS s, least(1049, chunk * 250 + 600) AS e FROM (SELECT unnest(range(0, 3)) AS chunk)) ON position >= s AND position < e
  WHERE contig IN {_SOME} GROUP BY contig, chunk"""


@query(
    "evaluate_embeddings",
    duck(f"""SELECT contig, max(score) AS score, min(score) AS "min", avg(score) AS mean, stddev_pop(score) AS std, max(score) AS "max", printf('%.6f|%.6f', avg(a), avg(b)) AS embedding
      FROM (SELECT contig, a, b, 1 / (1 + exp(-(a + b + 0.1))) AS score FROM ({_CHUNK_MEANS})) GROUP BY contig""", "aln", "expanded"),
    "score min mean std max",
)
def _(t):
    """Evaluation of some contigs with their embeddings, under fixed weights."""
    features, columns = position_features(t), ["mean_mapq_Match", "coverage"]
    normalizer = N.merge_stats(N.sufficient_stats(features, [], tuple(columns)), tuple(columns))
    model = C.mean_logistic({"mean_mapq_Match": 0.5, "coverage": -0.2}, 0.1, embed=True)
    return evaluate(_meta_1049(t), features, model, columns, normalizer, max_len=600, embeddings=20, seed=4)


@query("train_epochs")
def _(t):
    """Training on the pileup of all contigs, labelled by the records."""
    columns, folder = ["coverage", "mean_mapq_Match", "stdev_mapq_Match", "mean_insert_size_Match"], shared_folder(t.spark)
    position_features(t).select("contig", "position", *columns).write.parquet(folder)
    features = t.spark.read.parquet(folder)
    normalizer = N.merge_stats(N.sufficient_stats(features, [], tuple(columns)), tuple(columns))
    points = t.view("mis").groupBy("contig").agg(F.collect_list(F.struct(F.col("start").alias("lo"), F.col("end").alias("hi"))).alias("breakpoints"))
    meta = _meta_1049(t).join(points, "contig", "left").withColumn("misassembly_cnt", F.when(F.col("breakpoints").isNull(), 0).otherwise(F.size("breakpoints")))
    return train(meta, N.zscore(features, normalizer, tuple(columns)), columns, n_epochs=4, max_len=600, translations=2, max_translation=20, eval_percent=30)[1]


query("evaluate_scores", duck(_SCORED.format(z="0.01 * coverage", bias="0", features=f"SELECT * FROM {POSITIONS}", step=19500, width=20000, n=1), "aln", "expanded"), "score")(
    lambda t: evaluate(_meta_1049(t), position_features(t), C.mean_logistic({"coverage": 0.01}), ["coverage"])
)

# --- metrics

_STEPS = """(SELECT {by} score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER a AS pos, sum(n) OVER a AS neg FROM (SELECT {by} score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM preds GROUP BY ALL)
  WINDOW w AS ({part} ORDER BY score DESC), a AS ({part}))"""


def steps(by: str = "") -> str:
    return _STEPS.format(by=by and by + ",", part=by and f"PARTITION BY {by}")


query("evl1_recall_by_class", duck("SELECT grp, count_if(label = 1 AND score > 0.5) / nullif(count_if(label = 1), 0) AS recall_1, count_if(label = 0 AND score <= 0.5) / nullif(count_if(label = 0), 0) AS recall_0 FROM preds GROUP BY grp", "preds"), "recall_1 recall_0")(
    lambda t: E.recall_by_class(t.view("preds"), by=["grp"])
)
query("evl2_average_precision", duck(f"SELECT sum((tp - coalesce(lag_tp, 0)) / nullif(pos, 0) * tp / (tp + fp)) AS average_precision FROM (SELECT *, lag(tp) OVER (ORDER BY score DESC) AS lag_tp FROM {steps()})", "preds"), "average_precision")(
    lambda t: E.average_precision(t.view("preds"))
)
query("evl3_pr_curve", duck(f"SELECT score AS threshold, tp / pos AS recall, tp / (tp + fp) AS precision FROM {steps()}", "preds"), "threshold recall precision")(lambda t: E.pr_curve(t.view("preds")))
query("evl3_pr_area_by_group", duck(f'SELECT grp, sum((r - coalesce(lag_r, 0)) * (pr + coalesce(lag_pr, 1)) / 2) AS pr_area FROM (SELECT grp, r, pr, lag(r) OVER v AS lag_r, lag(pr) OVER v AS lag_pr FROM (SELECT grp, score, tp / nullif(pos, 0) AS r, tp / (tp + fp) AS pr FROM {steps("grp")}) WINDOW v AS (PARTITION BY grp ORDER BY score DESC)) GROUP BY grp', "preds"), "pr_area")(
    lambda t: E.pr_area(t.view("preds"), ["grp"])
)
_LOGGED = "d / s + (tp0 - (tp0 + fp0) / s) / s * ln(1 + s * d / nullif(tp0 + fp0, 0))"
query(
    "evl3_pr_area_interpolated",
    duck(f"""SELECT grp, sum(CASE WHEN d = 0 THEN 0 WHEN tp0 + fp0 = 0 THEN d / s ELSE {_LOGGED} END / nullif(pos, 0)) AS pr_area FROM (SELECT *, 1 + (fp - fp0) / nullif(d, 0) AS s FROM (SELECT *, tp - tp0 AS d FROM (
      SELECT grp, tp, fp, pos, coalesce(lag(tp) OVER v, 0) AS tp0, coalesce(lag(fp) OVER v, 0) AS fp0 FROM {steps("grp")} WINDOW v AS (PARTITION BY grp ORDER BY score DESC)))) GROUP BY grp""", "preds"),
    "pr_area",
)(lambda t: E.pr_area(t.view("preds"), ["grp"], interpolate=True))
query("evl4_roc_curve", duck(f"SELECT score AS threshold, fp / neg AS fpr, tp / pos AS tpr FROM {steps()}", "preds"), "threshold fpr tpr")(lambda t: E.roc_curve(t.view("preds")))
query("evl4_roc_auc", duck("SELECT (sum(r) FILTER (label = 1) - count_if(label = 1) * (count_if(label = 1) + 1) / 2) / (count_if(label = 1) * count_if(label = 0)) AS roc_auc FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM preds)", "preds"), "roc_auc")(
    lambda t: E.roc_auc(t.view("preds"))
)
_CONF = "count_if(label = 1 AND score >= cut) AS tp, count_if(label = 0 AND score < cut) AS tn, count_if(label = 0 AND score >= cut) AS fp, count_if(label = 1 AND score < cut) AS fn"
query("evl5_confusion_fixed", duck(f"SELECT grp, {_CONF} FROM (SELECT *, 0.8 AS cut FROM preds) GROUP BY grp", "preds"))(lambda t: E.confusion_counts(t.view("preds"), ["grp"], 0.8))
query("evl5_confusion_quantile", duck(f"SELECT grp, {_CONF} FROM (SELECT p.*, cut FROM preds p JOIN (SELECT grp, quantile_cont(score::DOUBLE, 0.9) AS cut FROM preds GROUP BY grp) USING (grp)) GROUP BY grp", "preds"))(
    lambda t: E.confusion_counts(t.view("preds").withColumn("score", F.col("score").cast("double")), ["grp"], quantile=0.9)
)
query("evl6_accuracy", duck(f"SELECT *, (tp + tn) / nullif(tp + tn + fp + fn, 0) AS accuracy FROM (SELECT grp, {_CONF} FROM (SELECT *, 0.8 AS cut FROM preds) GROUP BY grp)", "preds"), "accuracy")(
    lambda t: E.accuracy(E.confusion_counts(t.view("preds"), ["grp"], 0.8))
)
query("evl7_score_truth_join", duck("SELECT m.contig, m.length, coalesce(p.score, 0) AS score, m.misassembly_cnt FROM preds p RIGHT JOIN meta m ON p.contig = m.contig AND p.length = m.length", "preds", "meta"), "score")(
    lambda t: E.score_truth_join(t.view("preds").select("contig", "length", "score"), t.view("meta").select("contig", "length", "misassembly_cnt"), ["contig", "length"])
)
query("evl8_split_by_truth_list", duck('SELECT label = 1 AS listed, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd, min(score) AS "min", max(score) AS "max", avg(label) AS error_rate FROM preds GROUP BY 1', "preds"), "mean sd min max error_rate")(
    lambda t: E.split_by_truth_list(t.view("preds"), t.view("preds").where("label = 1"))
)
query("evl9_before_after_ratio", """SELECT "sample", metric, b AS "before", a AS "after", a / nullif(b, 0) AS ratio FROM (SELECT o_custkey AS "sample", o_orderpriority AS metric, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS b, max(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END) AS a FROM orders GROUP BY ALL)""", "before after ratio")(
    lambda t: E.before_after_ratio(t["orders"].select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("metric"), F.when(F.col("o_orderstatus") == "O", "before").otherwise("after").alias("stage"), F.col("o_totalprice").alias("value")), ["sample"])
)
query(
    "evl10_rank_sum_test",
    duck("""SELECT w, z, least(1.0, 2 * exp(-z * z / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))) AS p_value FROM (SELECT w, z, 1 / (1 + 0.2316419 * abs(z)) AS k FROM (
      SELECT w, (w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM (
        SELECT sum(r) FILTER (label = 1) - count_if(label = 1) * (count_if(label = 1) + 1) / 2 AS w, count(*)::DOUBLE AS n, count_if(label = 1)::DOUBLE AS n1, count_if(label = 0)::DOUBLE AS n2, sum(c * c - 1)::DOUBLE AS ties
        FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY score) AS c FROM preds))))""", "preds"),
    "w z p_value",
)(lambda t: E.rank_sum_test(t.view("preds").withColumn("g", F.col("label").cast("string")).withColumnRenamed("score", "value"), "g", "1"))
query(
    "evl11_best_epoch",
    duck("SELECT contig, arg_max(chunk, score * 1000000 - chunk * 0.000001) AS best_epoch, max(score) AS best_ap, 0.001 * pow(0.8, count_if(score < prev AND chunk > 10)) AS final_rate FROM (SELECT *, lag(score) OVER (PARTITION BY contig ORDER BY chunk) AS prev FROM chunks) GROUP BY contig", "chunks"),
    "best_ap final_rate",
)(lambda t: E.best_epoch(t.view("chunks"), ["contig"], "chunk", "score"))
