"""The training workflow: from contig metadata and position features to a scorer and a table of epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.functions.storage import shared_folder
from asmlens.operators import metrics as E
from asmlens.operators import scoring as C
from asmlens.operators import training as R
from asmlens.operators.modelling import Scorer, fit_pass, pooled, vector_scale
from asmlens.operators.pileup import KEYS

EPOCH = "epoch int, rate double, ap double, recall_1 double, recall_0 double, mean_score double, rows long, best boolean"


def training_rows(meta: DataFrame, frac_neg: float, max_len: int, epoch: int = 0, translations: int = 1, max_translation: int = 0, weight_factor: float = 0, seed: int = 0, key: str = "contig") -> DataFrame:
    """TRN2, TRN3 and TRN5 of one epoch: classes balanced, a window for every translation, weights."""
    rows = R.class_downsample(meta.withColumn("label", (F.col("misassembly_cnt") > 0).cast("int")), frac_neg, key=key, translations=translations, epoch=epoch)
    # each translation draws a window of its own
    rows = rows.withColumn("_draw", F.concat_ws("/", F.col(key).cast("string"), "translation"))
    rows = R.select_training_interval(rows, max_len, max_translation=max_translation, seed=seed + 2 * epoch, key="_draw").drop("_draw")
    return rows.withColumn("weight", R.length_weight("length", weight_factor))


def window_vectors(features: DataFrame, windows: DataFrame, columns: list[str], step: int) -> DataFrame:
    """A pooled vector for each window (keys, chunk, chunk_start, chunk_end, and what else it carries)."""
    keys = [k for k in KEYS if k in windows.columns and k in features.columns]
    vectors = pooled(C.chunk_matrices(features, windows, columns, step).select(*keys, "chunk", *columns), columns)
    return vectors.join(windows.drop("chunk_start", "chunk_end"), [*keys, "chunk"])


def train(
    meta: DataFrame,
    features: DataFrame,
    columns: list[str],
    n_epochs: int = 20,
    max_len: int = 5000,
    frac_neg: float = 1.0,
    translations: int = 1,
    max_translation: int = 0,
    weight_factor: float = 0,
    eval_percent: int = 10,
    eval_ids: DataFrame | None = None,
    hidden: int = 16,
    rate: float = 0.05,
    batch_size: int = 64,
    passes: int = 2,
    tasks: int = 8,
    seed: int = 0,
) -> tuple[Scorer, DataFrame]:
    """The scorer of best average precision on held-out contigs, and one row of ``EPOCH`` a validation.

    ``meta``: sample?, contig, length, misassembly_cnt, breakpoints; ``features``: sample?, contig, position and ``columns``
    (normalised, see ``zscore``). Each round draws classes and windows anew, makes ``passes`` passes over them and scores the
    held-out contigs chunk by chunk as evaluation does. After epoch 10 the rate falls to 0.8 of itself when the precision
    has fallen (EVL11). Vectors are written to the shared folder, so a lost executor repeats a task and not a round.
    """
    spark = meta.sparkSession
    folder, step = shared_folder(spark), max(250, max_len - 500)
    keys = [k for k in KEYS if k in meta.columns and k in features.columns]
    identified = meta.withColumn("_id", F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    if eval_ids is None:
        split = R.train_eval_split(identified, "_id", eval_percent, seed)
    else:
        held = eval_ids.select(*keys).distinct().withColumn("_held", F.lit(True))
        split = identified.join(held, keys, "left").withColumn("split", F.when(F.col("_held"), "eval").otherwise("train")).drop("_held")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    truth = split.where("split = 'eval'").withColumn("label", (F.col("misassembly_cnt") > 0).cast("int"))
    chunks = C.sliding_chunks(truth, max_len, max_len - 500 if max_len > 500 else max_len).select(*keys, "label", "chunk", "chunk_start", "chunk_end")
    judged = kept(window_vectors(features, chunks, columns, step), "eval")

    scorer, best, best_ap, before, log = None, None, -1.0, 0.0, []
    for number in range(-(-n_epochs // passes)):
        drawn = training_rows(split.where("split = 'train'").drop("split"), frac_neg, max_len, number, translations, max_translation, weight_factor, seed, "_id")
        windows = drawn.select(*keys, "label", "weight", F.col("translation").alias("chunk"), F.col("start_idx").alias("chunk_start"), F.col("end_idx").alias("chunk_end"))
        rows = kept(window_vectors(features, windows, columns, step), f"epoch-{number}")
        if scorer is None:
            scorer = Scorer.start(columns, *vector_scale(rows), hidden, seed)
        for k in range(passes):
            scorer = fit_pass(scorer, rows, [*keys, "chunk"], rate, batch_size, tasks, passes * number + k)
        epoch = passes * (number + 1)
        scored = C.group_scores(scorer.score_vectors(judged), [*keys, "label"], "max")
        scored = kept(scored, f"scores-{number}")
        ap = round(E.average_precision(scored).first().average_precision or 0.0, 12)  # its last bits follow the order of a sum
        recall = E.recall_by_class(scored).first()
        mean = scored.agg(F.round(F.avg("score"), 9)).first()[0]
        log.append((epoch, rate, ap, recall.recall_1, recall.recall_0, mean, rows.count()))
        if epoch > 10 and ap < before:
            rate *= 0.8
        before = ap
        if ap > best_ap:
            best, best_ap = scorer, ap
    at = max(range(len(log)), key=lambda k: (log[k][2], -k)) if log else None
    return best, spark.createDataFrame([(*row, k == at) for k, row in enumerate(log)], EPOCH)
