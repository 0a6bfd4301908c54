"""Chunking, scoring and aggregation of scores (CHK1-3, SCR1-8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asmlens.functions.columns import count_to, random_int
from asmlens.functions.storage import shared_folder
from asmlens.operators.ordered import exact_quantiles, running_sums, with_group_values

TAIL = 5000


def chunk_count(length: str | Column, window: int, step: int) -> Column:
    """CHK1."""
    n = F.col(length) if isinstance(length, str) else length
    return (1 + F.greatest(F.lit(0), F.ceil((n - window) / step))).cast("int")


def sliding_chunks(meta: DataFrame, window: int, step: int) -> DataFrame:
    """CHK2: rows (…, chunk, chunk_start, chunk_end). A short last chunk of a long contig moves back to its last 5000 bases."""
    n = F.col("length")
    rows = meta.withColumn("chunk", F.explode(count_to(chunk_count("length", window, step)))).withColumn("chunk_start", F.col("chunk") * step)
    moved = (n > window) & (n - F.col("chunk_start") < TAIL) & F.lit(window > TAIL)
    start = F.when(moved, n - TAIL).otherwise(F.col("chunk_start"))
    return rows.withColumn("chunk_start", start.cast("int")).withColumn("chunk_end", F.least(n, F.col("chunk_start") + window).cast("int"))


def evaluation_chunks(meta: DataFrame, max_len: int = 20000) -> DataFrame:
    """CHK2 with the step that evaluation uses."""
    return sliding_chunks(meta, max_len, max(250, max_len - 500))


def memory_batches(meta: DataFrame, total_bytes: int, batch_size: int, window: int, n_features: int, shard: str, order: list[str], stream: int = 1 << 20) -> DataFrame:
    """CHK3: ordered greedy packing within each shard (its metadata only); needs column ``n_chunks``.

    Shards of up to ``stream`` rows are sorted within partitions and packed as a stream. In a longer one every row finds
    the row that a batch begun there leaves to the next batch, and cuts are followed from the first row in doubling steps,
    so that many tasks pack one shard. Both ways give the same batches.
    """
    counts = meta.groupBy(shard).agg((F.count("*") > stream).alias("_long"))
    row_bytes = window * (10 + 4 * n_features)
    dealt = with_group_values(meta, counts, [shard])
    short = _packed_stream(dealt.where("not _long").drop("_long"), total_bytes, batch_size, row_bytes, shard, order)
    if counts.where("_long").isEmpty():
        return short
    return short.unionByName(_packed_by_cuts(dealt.where("_long").drop("_long"), total_bytes // row_bytes, batch_size, shard, order))


def _packed_by_cuts(meta: DataFrame, most_chunks: int, batch_size: int, shard: str, order: list[str]) -> DataFrame:
    """``memory_batches`` of long shards."""
    spark, folder, steps = meta.sparkSession, shared_folder(meta.sparkSession), iter(range(10_000))

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(steps)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    same = lambda a, b: F.col(f"{a}.{shard}").eqNullSafe(F.col(f"{b}.{shard}"))
    rows = running_sums(meta.withColumn("_one", F.lit(1).cast("long")), [shard], order, {"_place": "_one", "_upto": "n_chunks"})
    rows = kept(rows.drop("_one"))
    # the chunks before a batch and those it may hold: the first row whose sum goes beyond begins the next batch
    ends = rows.select(shard, F.col("_upto").alias("_sum"), F.lit(0).alias("_asks"), F.lit(1).alias("_row"), F.lit(None).cast("long").alias("_place"))
    asks = rows.select(shard, (F.col("_upto") - F.col("n_chunks") + most_chunks).alias("_sum"), F.lit(1).alias("_asks"), F.lit(0).alias("_row"), "_place")
    found = running_sums(ends.unionByName(asks), [shard], ["_sum", "_asks"], {"_within": "_row"}).where("_asks = 1")
    cut = F.least(F.greatest(F.col("_within"), F.col("_place")) + 1, F.col("_place") + batch_size + 1)
    last = rows.groupBy(shard).agg(F.max("_place").alias("_last"))
    jump = kept(with_group_values(found.select(shard, "_place", cut.alias("_next")), last, [shard]).where("_next <= _last").select(shard, "_place", "_next"))
    starts = kept(last.select(shard, F.lit(1).cast("long").alias("_place")))
    while True:  # after k rounds the first 2^k starts of each shard are known, and jumps pass over 2^k batches
        more = kept(starts.alias("s").join(jump.alias("j"), same("s", "j") & (F.col("s._place") == F.col("j._place"))).select(F.col(f"s.{shard}").alias(shard), F.col("j._next").alias("_place")))
        if more.isEmpty():
            break
        starts = starts.unionByName(more)
        jump = kept(jump.alias("a").join(jump.alias("b"), same("a", "b") & (F.col("a._next") == F.col("b._place"))).select(F.col(f"a.{shard}").alias(shard), F.col("a._place").alias("_place"), F.col("b._next").alias("_next")))
    marked = starts.select(F.col(shard).alias("_shard"), F.col("_place").alias("_start"))
    rows = rows.join(marked, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("_place") == F.col("_start")), "left").withColumn("_begins", F.col("_start").isNotNull().cast("long"))
    numbered = running_sums(rows.drop("_shard", "_start"), [shard], ["_place"], {"_batch": "_begins"})
    return numbered.withColumn("batch", F.col("_batch") - 1).drop("_place", "_upto", "_begins", "_batch")


def _packed_stream(meta: DataFrame, total_bytes: int, batch_size: int, row_bytes: int, shard: str, order: list[str]) -> DataFrame:
    """``memory_batches`` of shards that one task can pack."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started, batch, contigs, chunks = None, False, 0, 0, 0
        for pdf in batches:
            out = []
            for s, n in zip(pdf[shard].where(pdf[shard].notna(), None), pdf["n_chunks"]):
                if not started or s != now:
                    now, started, batch, contigs, chunks = s, True, 0, 0, 0
                elif contigs > batch_size or (chunks + n) * row_bytes > total_bytes:
                    batch, contigs, chunks = batch + 1, 0, 0
                contigs, chunks = contigs + 1, chunks + n
                out.append(batch)
            yield pdf.assign(batch=pd.Series(out, index=pdf.index, dtype="int64"))

    return meta.repartition(shard).sortWithinPartitions(shard, *order).mapInPandas(pack, meta.withColumn("batch", F.lit(0).cast("long")).schema)


def chunk_matrices(features: DataFrame, chunks: DataFrame, columns: list[str], step: int) -> DataFrame:
    """Rows (sample, contig, chunk, mask_len, columns): for each chunk the arrays of its positions' values, in order.

    Positions meet chunks by bins of ``step`` bases, so a position meets the few chunks that can hold it. An array has
    at most as many elements as a chunk has positions.
    """
    keys = [k for k in ("sample", "contig") if k in features.columns and k in chunks.columns]
    bins = F.explode(F.sequence(F.floor(F.col("chunk_start") / step), F.floor((F.col("chunk_end") - 1) / step)))
    spans = chunks.where(F.col("chunk_end") > F.col("chunk_start")).select(*keys, "chunk", "chunk_start", "chunk_end", bins.alias("_bin"))
    rows = features.select(*keys, "position", *columns, F.floor(F.col("position") / step).alias("_bin")).join(spans, [*keys, "_bin"])
    rows = rows.where((F.col("position") >= F.col("chunk_start")) & (F.col("position") < F.col("chunk_end")))
    listed = F.array_sort(F.collect_list(F.struct("position", *columns)))
    out = rows.groupBy(*keys, "chunk").agg(listed.alias("_rows"))
    return out.select(*keys, "chunk", F.size("_rows").alias("mask_len"), *(F.col("_rows").getField(c).cast("array<double>").alias(c) for c in columns))


def mean_logistic(weights: dict[str, float], bias: float = 0.0, embed: bool = False) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A model over matrices of positions: the logistic of a weighted sum, averaged over the positions of a chunk.

    With ``embed`` the weighted means of the columns are the chunk's embedding.
    """
    import numpy as np

    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [pdf[c].map(lambda x: float(np.mean(np.asarray(x, float)))) * w for c, w in weights.items()]
            more = {"embedding": [list(v) for v in zip(*parts)]} if embed else {}
            yield pdf.assign(score=1 / (1 + np.exp(-sum(parts, bias))), **more)

    return model


def linear_logistic(weights: dict[str, float], bias: float = 0.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A model for ``score_chunks``: the logistic of a weighted sum."""
    import numpy as np

    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = sum((pdf[c].fillna(0.0) * w for c, w in weights.items()), bias)
            yield pdf.assign(score=1 / (1 + np.exp(-z)))

    return model


def score_chunks(chunks: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], embeddings: bool = False) -> DataFrame:
    """SCR1: ``model`` maps batches of rows to the same rows with ``score``, and ``embedding`` if asked; Arrow batches bound the memory."""
    names = [*chunks.columns, "score", *(["embedding"] if embeddings else [])]
    extra = chunks.withColumn("score", F.lit(0.0)).withColumn("embedding", F.array(F.lit(0.0))).select(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in model(batches):
            yield pdf[names]

    return chunks.mapInPandas(run, extra.schema)


def fit_scorer(train: DataFrame, evaluation: DataFrame, columns: list[str], label: str = "label", weight: str | None = None, candidates: list | None = None):
    """SCR2: fits candidate classifiers and returns the pipeline of best average precision, and each one's."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    more = {"weightCol": weight} if weight else {}
    candidates = candidates or [LogisticRegression(labelCol=label, **more), GBTClassifier(labelCol=label, maxIter=10, seed=1, **more)]
    judge, found = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR"), []
    for one in candidates:
        model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), one]).fit(train.fillna(0, columns))
        found.append((judge.evaluate(model.transform(evaluation.fillna(0, columns))), model))
    return max(found, key=lambda x: x[0])[1], [ap for ap, _ in found]


def _sma(scores: Column) -> Column:
    """Greatest mean of two neighbours; the mean if there are at most two."""
    pairs = F.zip_with(F.slice(scores, 1, F.greatest(F.lit(1), F.size(scores) - 1)), F.slice(scores, 2, F.greatest(F.lit(1), F.size(scores) - 1)), lambda a, b: (a + b) / 2)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) <= 2, mean).otherwise(F.array_max(pairs))


METHODS: dict[str, Callable[[Column], Column]] = {
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    "std": F.stddev_pop,
    "noisy_or": lambda s: 1 - F.product(1 - s),
}


def group_scores(chunks: DataFrame, by: list[str], method: str | Callable[[Column], Column] = "max", order: list[str] | None = None, score: str = "score") -> DataFrame:
    """SCR3 (UDX1): one score a contig: max, min, mean, std, list, sma, noisy_or, or any aggregate of a column."""
    s = F.col(score)
    if method in ("list", "sma"):
        listed = F.transform(F.array_sort(F.collect_list(F.struct(*(order or []), s.alias("s")))), lambda x: x["s"])
        return chunks.groupBy(*by).agg((listed if method == "list" else _sma(listed)).alias("score"))
    return chunks.groupBy(*by).agg((METHODS[method] if isinstance(method, str) else method)(s).alias("score"))


def chunk_score_profile(chunks: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """SCR4."""
    s, tenths = F.col(score), [k / 10 for k in range(1, 10)]
    out = chunks.groupBy(*by).agg(F.min(s).alias("min"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.max(s).alias("max"))
    out = with_group_values(out, exact_quantiles(chunks, score, tenths, by, "p"), by)
    return out.select(*by, "min", "mean", "std", "max", *(F.col("p")[k].alias(f"p{10 * (k + 1)}") for k in range(9)))


def first_chunk_rule(chunks: DataFrame, low: int = 5000, high: int = 6000) -> DataFrame:
    """SCR5: contigs of 5000 to 6000 bases keep their first chunk only."""
    return chunks.where(~F.col("length").between(low, high) | (F.col("chunk") == 0))


def group_embeddings(chunks: DataFrame, by: list[str], vector: str = "embedding", decimals: int = 6) -> DataFrame:
    """SCR6: element-wise mean, joined by ``|``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = chunks.where(F.col(vector).isNotNull()).select(*by, array_to_vector(F.col(vector)).alias("_vector"))
    mean = rows.groupBy(*by).agg(Summarizer.mean(F.col("_vector")).alias("_mean")).withColumn("_mean", vector_to_array("_mean"))
    return mean.select(*by, F.array_join(F.transform("_mean", lambda v: F.format_string(f"%.{decimals}f", v)), "|").alias("embedding"))


def isotonic_calibration(chunks: DataFrame, key: str = "contig", label: str = "label", score: str = "score", most_length: int = 20000, seed: int = 0) -> DataFrame:
    """SCR7: fits on a random half of the contigs below ``most_length``; calibrated scores of the others, clipped to [0, 1], then noisy-or."""
    from pyspark.ml.regression import IsotonicRegression

    half = F.pmod(random_int(key, seed), F.lit(2)) == 0
    short = F.col("length") < most_length
    model = IsotonicRegression(featuresCol=score, labelCol="y", predictionCol="raw").fit(chunks.where(half & short).withColumn("y", F.col(label).cast("double")))
    rest = model.transform(chunks.where(~(half & short))).withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw"))))
    return group_scores(rest, [key, label], "noisy_or", score="calibrated")


def sample_for_embeddings(contigs: DataFrame, n: int, key: str | list[str] = "contig", seed: int = 0) -> DataFrame:
    """SCR8: n contigs in hash order."""
    keys = [key] if isinstance(key, str) else key
    whole = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    return contigs.orderBy(random_int(whole, seed), *keys).limit(n)
