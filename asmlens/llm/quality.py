"""Quality rules: text statistics and n-gram perplexity bands.

The language model is a modified Kneser-Ney model of order 4 over UTF-16 units,
that is over the characters as they are; an n-gram of four units is exactly one
64-bit number. Every language with at least ``least_texts`` texts has a model of
its own. Spark counts the n-grams of every whole text, continuation counts of
the lower orders, counts of counts, discounts, context totals, back-off weights
and the probability of every n-gram. N-grams counted once are pruned: their
probability goes to the lower order. No other n-gram is: the models grow with the
corpus. The ``MOST`` most frequent n-grams of each order are collected and
broadcast, as sorted arrays of hashes with log probabilities, and of context
hashes with back-off weights (12 bytes each); texts are scored by search there.
Where an order has more, the whole models stay in tables as well. The n-grams of
a text that the arrays lack are then counted by text and joined to the tables,
and the sum of their log probabilities is added, so every text gets the score
that arrays without bound would give.

A text is rejected if a base rule fails, or if its perplexity lies outside the
band of its language. Bands are quartile bands of the log perplexity a unit over
the texts that pass the base rules: ``median - low * iqr`` to ``median + high *
iqr``. Texts of languages with too few texts for a model are judged by the base
rules only.

Cases: a null or empty text has no words, fails the base rules and has a null
perplexity. A null language is a language of its own. Repeated rows are judged
alike. Texts of any length are read whole. An empty table gives an empty table.
Columns of the input that have the name of the output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asmlens.llm import _text as X
from asmlens.llm._spark import dropped, fresh, stage, written

BITS, ORDER = 16, 4
EDGE = 0xFFFF  # not a character
MOST, FLUSH = 1 << 20, 1 << 20
LEAST_TEXTS = 100
LOW, HIGH = 5.0, 6.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("model", T.IntegerType()),
        T.StructField("log_perplexity", T.DoubleType()),
    ]
)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each UTF-16 unit, as a 64-bit number, and the texts' offsets in units; a text begins after three edge symbols."""
    units = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-16-le"), np.uint16)
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80).view(np.int8) + (data >= 0xF0).view(np.int8), out=wide[1:])
    ends = wide[offsets]
    lead = ORDER - 1
    place = np.arange(len(units)) + lead * np.repeat(np.arange(1, len(ends)), np.diff(ends))
    padded = np.full(len(units) + lead * len(ends), EDGE, np.uint64)
    padded[place] = units
    out = padded[place]
    for back in range(1, ORDER):
        out |= padded[place - back] << np.uint64(BITS * back)
    return out, ends


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    start, end, first = X.words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    solid = ~X.SPACE[data]
    h = X.RangeHash(data)
    out = {
        "n_words": np.diff(first),
        "word_chars": X.per_text(solid & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": X.per_text(SYMBOLS[data], offsets),
    }
    salt = X.mix(np.arange(1, len(offsets), dtype=np.uint64))
    # lines: they begin at a text's start and after each \n
    breaks = np.flatnonzero(data == 10)
    begins = np.concatenate([offsets[:-1], breaks + 1])
    begins = begins[np.argsort(begins, kind="stable")]
    of = np.searchsorted(offsets, begins, side="right") - 1
    # a line after a text's last \n may begin where the next text does: those are empty and go
    inside = (begins < len(data)) & (of < len(offsets) - 1)
    begins, of = np.unique(begins[inside]), None
    of = np.searchsorted(offsets, begins, side="right") - 1
    ends = np.concatenate([begins[1:], [len(data)]]) if len(begins) else begins
    ends = np.minimum(ends, offsets[of + 1]) if len(begins) else ends
    ends = ends - ((ends > begins) & (data[np.maximum(ends - 1, 0)] == 10)) if len(begins) else ends
    filled = np.concatenate([[0], np.cumsum(solid)])
    kept = filled[ends] > filled[begins] if len(begins) else np.zeros(0, bool)
    begins, ends, of = begins[kept], ends[kept], of[kept]
    again, _ = X.repeats(h(begins, ends) + salt[of])
    out["n_dup_lines"] = np.bincount(of[again], minlength=len(offsets) - 1)
    # windows of three words
    w = h(start, end)
    marked = np.zeros(len(w) + 2, bool)
    if len(w) >= 3:
        whole = np.flatnonzero(text[2:] == text[:-2])
        window = X.mix(w[whole] * np.uint64(3) + X.mix(w[whole + 1]) * np.uint64(5) + X.mix(X.mix(w[whole + 2])) * np.uint64(7))
        _, shared = X.repeats(window + salt[text[whole]])
        hit = whole[shared]
        for k in range(3):
            marked[hit + k] = True
    out["n_repeat_words"] = np.bincount(text[marked[: len(w)]], minlength=len(offsets) - 1)
    return out


def _lower(code: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` units of n-grams."""
    return code & np.uint64((1 << (BITS * order)) - 1) if order < ORDER else code


def _find(keys: np.ndarray, values: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams are known, and the values of those."""
    if not len(keys):
        return np.zeros(len(code), bool), values[:0]
    wanted = X.mix(code)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = keys[at] == wanted
    return known, values[at[known]]


@dataclass
class KneserNey:
    """One language's model, or the most frequent n-grams of one.

    ``grams[o]`` are the sorted hashes of the n-grams of order ``o`` and ``logs[o]`` their log probabilities, lower
    orders included; ``contexts[o]`` are the sorted hashes of the contexts before them and ``backs[o]`` the logs of
    the weights of the lower order there. A context that is not known leaves all to the lower order.
    """

    alphabet: int
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backs: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, order: int, code: np.ndarray, log: np.ndarray, context: np.ndarray, back: np.ndarray) -> None:
        """The n-grams of an order with their log probabilities, and the contexts with the logs of their weights of the lower order."""
        rank = np.argsort(X.mix(context))
        self.contexts[order], self.backs[order] = X.mix(context)[rank], back[rank].astype(np.float32)
        rank = np.argsort(X.mix(code))
        self.grams[order], self.logs[order] = X.mix(code)[rank], log[rank].astype(np.float32)

    def back(self, order: int, code: np.ndarray) -> np.ndarray:
        """Log weight of the lower order after the contexts of n-grams of ``order``."""
        out = np.zeros(len(code))
        known, values = _find(self.contexts[order], self.backs[order], code >> np.uint64(BITS))
        out[known] = values
        return out

    def score(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last unit of each n-gram after the others, by a whole model."""
        if not order:
            return np.full(len(code), -np.log(self.alphabet))
        out = np.empty(len(code))
        known, values = _find(self.grams[order], self.logs[order], code)
        out[known] = values
        rest = code[~known]
        if len(rest):
            out[~known] = self.back(order, rest) + self.score(_lower(rest, order - 1), order - 1)
        return out

    def known(self, code: np.ndarray) -> np.ndarray:
        """Log probability of the last unit of each n-gram of the highest order; 0 where the arrays lack it."""
        out = np.zeros(len(code))
        known, values = _find(self.grams[ORDER], self.logs[ORDER], code)
        out[known] = values
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, text) to rows (m, code, n); what is held is merged, and handed on where it grows large."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*parts))
        rank = np.argsort(code, kind="stable")
        code, n = code[rank], n[rank]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[first], np.add.reduceat(n, first)

    def rows(m: int, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), m, np.int32)), pa.array(code.view(np.int64)), pa.array(n)], names=["m", "code", "n"])

    for batch in batches:
        model = np.asarray(batch.column(0))
        for row, offsets, data in X.texts(batch.column(1)):
            code, ends = codes(data, offsets)
            of = model[row : row + len(offsets) - 1]
            for m in np.unique(of).tolist():
                own = np.sort(code if (of == m).all() else code[np.repeat(of == m, np.diff(ends))])
                if not len(own):
                    continue
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                parts = held.setdefault(m, [])
                parts.append((own[first], np.diff(np.append(first, len(own)))))
                if len(parts) >= 8:
                    held[m] = parts = [merged(parts)]
            # all languages together stay below the limit; the largest is handed on first
            size = {m: sum(len(c) for c, _ in parts) for m, parts in held.items()}
            while sum(size.values()) > FLUSH:
                most = max(size, key=size.get)
                size.pop(most)
                yield rows(most, *merged(held.pop(most)))
    for m, parts in held.items():
        if parts:
            yield rows(m, *merged(parts))


def _language(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _part(code: Column, order: int) -> Column:
    """The last ``order`` units of n-grams."""
    return code if order == ORDER else code.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


class PerplexityModels:
    """Models by number, and the numbers of the languages.

    ``scores`` (order, m, code, log) and ``weights`` (order, m, context, back) hold all n-grams and contexts where
    ``models`` have the most frequent n-grams only, and are None where those are whole. Order 0 is the uniform one.
    """

    def __init__(self, names: DataFrame, models: dict[int, KneserNey], scores: DataFrame | None = None, weights: DataFrame | None = None):
        self.names, self.models, self.scores, self.weights = names, models, scores, weights

    def looked_up(self, wanted: DataFrame) -> DataFrame:
        """Distinct (m, code) to rows (m, code, log): log probabilities from the tables, of n-grams that no text had too."""
        open_, parts = wanted.select("m", "code", F.lit(0.0).alias("back")), []
        for order in range(ORDER, -1, -1):
            found = self.scores.where(F.col("order") == order).select("m", F.col("code").alias("part"), "log")
            tried = open_.withColumn("part", _part(F.col("code"), order)).join(found, ["m", "part"], "left")
            if order == ORDER:
                tried = written(tried, "looked-up")  # all n-grams of the texts that the models are of
            parts.append(tried.where("log is not null").select("m", "code", (F.col("back") + F.col("log")).alias("log")))
            if order:
                left = self.weights.where(F.col("order") == order).select("m", "context", F.col("back").alias("more"))
                tried = tried.where("log is null").withColumn("context", F.shiftrightunsigned("part", BITS)).join(left, ["m", "context"], "left")
                open_ = tried.select("m", "code", (F.col("back") + F.coalesce("more", F.lit(0.0))).alias("back"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def numbered(self, docs: DataFrame, lang: str, into: str) -> DataFrame:
        """``docs`` with the number of its language's model, null where it has none."""
        key = fresh(docs, "model_name")
        names = self.names.select(F.col("name").alias(key), F.col("m").alias(into))
        return docs.join(F.broadcast(names), _language(lang) == F.col(key), "left").drop(key)  # one row a language with enough texts


def _orders(counted: DataFrame) -> DataFrame:
    """Rows (order, m, code, n): counts of the highest order, and of the others how many different units stand before an n-gram."""
    level = counted.select(F.lit(ORDER).alias("order"), "m", "code", "n")
    out = level
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy("m", F.col("code").bitwiseAND(F.lit((1 << (BITS * order)) - 1)).alias("code")).agg(F.count("*").alias("n")).select(F.lit(order).alias("order"), "m", "code", "n")
        out = out.unionByName(level)
    return out


def _discounts(once: list[float]) -> list[float]:
    """What is taken from counts of one, two, and three or more, by the numbers of n-grams counted once to four times."""
    cut = [0.5, 0.5, 0.5]
    if all(once):
        y = once[0] / (once[0] + 2 * once[1])
        cut = [k - (k + 1) * y * once[k] / once[k - 1] for k in (1, 2, 3)]
    return np.clip(cut, 0.05, [0.95, 1.9, 2.85]).tolist()


def fit_models(docs: DataFrame, text: str = "text", lang: str = "lang", least_texts: int = LEAST_TEXTS, most: int = MOST, least_count: int = 2) -> PerplexityModels:
    """Count the n-grams of all texts and fit a model for each language with ``least_texts`` texts that aren't empty.

    Collected are at most ``most`` n-grams and contexts of each order, over all languages together, and a few numbers a
    model. N-grams below ``least_count`` are pruned; of the others those that aren't collected stay in tables.
    """
    spark = docs.sparkSession
    some = docs.where(F.length(text) > 0)
    names = some.groupBy(_language(lang).alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least_texts).orderBy("name").collect()
    names = spark.createDataFrame([(r.name, k) for k, r in enumerate(names)], "name string, m int")
    out = PerplexityModels(names, {})
    pairs = out.numbered(some.select(F.col(text).alias("text"), F.col(lang).alias("lang")), "lang", "m").where("m is not null").select("m", "text")
    counted = written(pairs.mapInArrow(_count, "m int, code long, n long").groupBy("m", "code").agg(F.sum("n").alias("n")), "counts")
    ngrams = written(_orders(counted), "ngrams")
    dropped(counted)
    grams = ngrams.withColumn("size", F.floor(16 * F.log2("n")).cast("int"))

    # the least count that is collected, by order: sizes are sixteenths of powers of two
    keep = (F.col("order") == 1) | (F.col("n") >= least_count)
    sizes = grams.where(keep).groupBy("order", "size").agg(F.count("*").alias("n")).collect()
    least, whole = {}, True
    for order in range(1, ORDER + 1):
        own, kept = sorted(((r["size"], r["n"]) for r in sizes if r["order"] == order), reverse=True), 0
        least[order] = 0
        for size, n in own:
            kept += n
            if kept > most:
                least[order], whole = size + 1, False
                break
    seen = grams.groupBy("order", "m").agg(F.count("*").alias("units"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()
    cuts = spark.createDataFrame([(r["order"], r["m"], _discounts([r.n1, r.n2, r.n3, r.n4])) for r in seen], "order int, m int, cut array<double>")
    own = Window.partitionBy("order", "m", "context")  # at most one row a unit
    shares = grams.withColumns({"context": F.shiftrightunsigned("code", BITS), "keep": keep}).withColumn("total", F.sum("n").over(own)).join(F.broadcast(cuts), ["order", "m"])
    shares = shares.withColumn("p", F.when(F.col("keep"), (F.col("n") - F.get("cut", (F.least("n", F.lit(3)) - 1).cast("int"))) / F.col("total")).otherwise(0.0))
    shares = shares.withColumn("back", F.greatest(F.lit(1e-9), F.least(F.lit(1.0), 1 - F.sum("p").over(own))))
    shares = written(shares.select("order", "m", "code", "context", "size", "keep", "p", "back"), "shares")

    # an n-gram's share, and what its context leaves of the probability of its last units: all of those are n-grams here too
    alphabet = {r["m"]: r.units + 1 for r in seen if r["order"] == 1}  # all units of the language, and any other
    out.models = {k: KneserNey(n) for k, n in alphabet.items()}
    lower = spark.createDataFrame([(0, k, 0, float(-np.log(n))) for k, n in alphabet.items()], "order int, m int, code long, log double")
    scored = [lower]
    for order in range(1, ORDER + 1):
        below = scored[-1].select("m", F.col("code").alias("lower"), F.col("log").alias("below"))
        rows = shares.where(F.col("order") == order).withColumn("lower", _part(F.col("code"), order - 1)).join(below, ["m", "lower"])
        rows = written(rows.select("order", "m", "code", "context", "size", "keep", F.log(F.col("p") + F.col("back") * F.exp("below")).alias("log"), F.log("back").alias("back")), "scores")
        scored.append(rows)
        head = rows.where(F.col("keep") & (F.col("size") >= least[order]))
        found, left = head.select("m", "code", "log").toArrow(), head.select("m", "context", "back").distinct().toArrow()
        m, code, log = (found.column(k).to_numpy() for k in range(3))
        bm, context, back = (left.column(k).to_numpy() for k in range(3))
        for k, model in out.models.items():
            own, of = m == k, bm == k
            model.add(order, code[own].view(np.uint64), log[own], context[of].view(np.uint64), back[of])
    if not whole:
        for rows in scored[1:]:
            lower = lower.unionByName(rows.select("order", "m", "code", "log"))
        out.scores = lower
        weights = [rows.where("keep").select("order", "m", "context", "back") for rows in scored[1:]]
        for rows in weights[1:]:
            weights[0] = weights[0].unionByName(rows)
        out.weights = weights[0].distinct()
    dropped(ngrams, shares, *(scored[1:] if whole else []))
    return out


def _missed(models: dict[int, KneserNey], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, key, text) to rows (m, key, code, times, units): the n-grams that the arrays lack, and the text's length in units."""
    for batch in batches:
        model = np.asarray(batch.column(0))
        for row, offsets, data in X.texts(batch.column(2)):
            code, ends = codes(data, offsets)
            units = np.diff(ends)
            text = np.repeat(np.arange(len(units)), units)
            number = model[row : row + len(units)]
            lacking = np.zeros(len(code), bool)
            for m in np.unique(number).tolist():
                own = number[text] == m
                lacking[own] = ~_find(models[m].grams[ORDER], models[m].logs[ORDER], code[own])[0]
            code, text = code[lacking], text[lacking]
            rank = np.lexsort((code, text))
            code, text = code[rank], text[rank]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])) if len(code) else np.zeros(0, np.int64)
            of = text[first]
            arrays = [pa.array(number[of]), batch.column(1).take(pa.array(row + of)), pa.array(code[first].view(np.int64))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.diff(np.append(first, len(code)))), pa.array(units[of])], names=["m", "key", "code", "times", "units"])


def _completed(reports: DataFrame, models: PerplexityModels, text: str, into: str, key: str) -> DataFrame:
    """``reports`` of the arrays alone, with the n-grams that those lack; equal texts (``key``) lack the same ones."""
    arrays = reports.sparkSession.sparkContext.broadcast(models.models)
    q = F.col(into)
    rows = reports.where(q["model"].isNotNull() & (F.length(text) > 0)).select(q["model"].alias("m"), F.col(key).alias("key"), F.col(text).alias("text"))
    lacking = rows.mapInArrow(lambda batches: _missed(arrays.value, batches), "m int, key string, code long, times long, units long")
    lacking = written(lacking.dropDuplicates(["m", "key", "code"]), "lacking")
    found = models.looked_up(lacking.select("m", "code").distinct())
    # whole numbers, so that the order of the rows does not matter
    total = lacking.join(found, ["m", "code"]).groupBy("m", "key").agg((F.sum(F.col("times") * F.round(F.col("log") * 2.0**24).cast("long")) / 2.0**24 / F.first("units")).alias("more"))
    total = written(total, "lacking-sums")
    dropped(lacking)
    names = {n: fresh(reports, n) for n in ("lacking_m", "lacking_key", "lacking_more")}
    m, of, more = names.values()
    total = total.select(F.col("m").alias(m), F.col("key").alias(of), F.col("more").alias(more))
    out = reports.join(total, (q["model"] == F.col(m)) & (F.col(key) == F.col(of)), "left")
    return out.withColumn(into, q.withField("log_perplexity", q["log_perplexity"] - F.coalesce(F.col(more), F.lit(0.0)))).drop(m, of, more, key)


def report(docs: DataFrame, models: PerplexityModels, text: str = "text", lang: str = "lang", into: str = "quality", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with a struct column of statistics, base verdict, the model's number and the log perplexity a unit."""
    docs = docs.drop(into) if into.lower() in {c.lower() for c in docs.columns} else docs
    whole, key = models.scores is None, fresh(docs, "text_key")
    docs = docs if whole else docs.withColumn(key, F.md5(text))
    index = fresh(docs, "model_index")
    shared = docs.sparkSession.sparkContext.broadcast(models.models)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, REPORT)])
    at = docs.columns.index(text)
    fields = [f.name for f in schema.fields]
    kinds = REPORT.names

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(batch.num_columns - 1)
            model = np.asarray(number.fill_null(-1))
            for row, offsets, data in X.texts(batch.column(at)):
                part, of = statistics(data, offsets), model[row : row + len(offsets) - 1]
                code, ends = codes(data, offsets)
                logs = np.full(len(code), np.nan)
                for m in np.unique(of).tolist():
                    if m in shared.value:
                        own = np.repeat(of == m, np.diff(ends))
                        logs[own] = shared.value[m].score(code[own]) if whole else shared.value[m].known(code[own])
                sums, units = np.concatenate([[0.0], np.cumsum(np.nan_to_num(logs))]), np.diff(ends)
                part["log_perplexity"] = np.where((units > 0) & (of >= 0), -(sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(units, 1), np.nan)
                words = part["n_words"]
                part["base_failed"] = (words < min_words) | (100 * part["n_repeat_words"] > max_repeat_percent * words)
                arrays = []
                for k in kinds:
                    if k == "model":
                        arrays.append(number.slice(row, len(of)))
                    elif k == "log_perplexity":
                        arrays.append(pa.array(part[k], mask=np.isnan(part[k])))
                    else:
                        arrays.append(pa.array(part[k] if k == "base_failed" else part[k].astype(np.int64)))
                columns = [batch.column(i).slice(row, len(of)) for i in range(batch.num_columns - 1)] + [pa.StructArray.from_arrays(arrays, names=kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    out = models.numbered(docs, lang, index).mapInArrow(judge, schema)
    return out if whole else _completed(out, models, text, into, key)


def fit_bands(reports: DataFrame, into: str = "quality", low: float = LOW, high: float = HIGH, least: float = 0.02) -> DataFrame:
    """Rows (m, low, high): least and greatest log perplexity of each model's language; quartiles count as ``least`` apart at the least."""
    q = F.col(into)
    rows = reports.where(~q["base_failed"] & q["log_perplexity"].isNotNull()).groupBy(q["model"].alias("m")).agg(F.percentile_approx(q["log_perplexity"], [0.25, 0.5, 0.75], 10000).alias("q"))
    wide = F.greatest(F.lit(least), F.col("q")[2] - F.col("q")[0])
    return written(rows.select("m", (F.col("q")[1] - low * wide).alias("low"), (F.col("q")[1] + high * wide).alias("high")), "bands")  # a row a model


def judged(reports: DataFrame, bands: DataFrame, kept: str, into: str = "quality") -> DataFrame:
    """``reports`` with column ``kept``: passes the base rules and lies inside its language's band, if that has one."""
    q, m, low, high = F.col(into), *(fresh(reports, n) for n in ("band_model", "band_low", "band_high"))
    named = bands.select(F.col("m").alias(m), F.col("low").alias(low), F.col("high").alias(high))
    rows = reports.join(F.broadcast(named), q["model"] == F.col(m), "left")
    return rows.withColumn(kept, ~q["base_failed"] & F.coalesce(q["log_perplexity"].between(F.col(low), F.col(high)), F.lit(True))).drop(m, low, high)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", into: str = "quality") -> DataFrame:
    """Fit on all of ``docs``, report on all of it; adds ``into`` (struct) with ``kept`` in it.

    The rows with their reports are written once; bands and verdicts are read from there.
    """
    scored = written(report(docs, fit_models(docs, text, lang), text, lang, into), "quality")
    kept = fresh(scored, "kept")
    return judged(scored, fit_bands(scored, into), kept, into).withColumn(into, F.col(into).withField("kept", F.col(kept))).drop(kept)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its statistics and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    scores = written(report(docs, fit_models(docs)).select("doc_id", "quality"), "quality")
    q = F.col("quality")
    return judged(scores, fit_bands(scores), "kept").select(
        "doc_id",
        *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
        "kept",
        F.exp(q["log_perplexity"]).alias("perplexity"),
    )


@stage
def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that pass, with the columns of ``docs``."""
    into = fresh(docs, "quality")
    return quality(docs, into=into).where(F.col(into)["kept"]).select(*docs.columns)
