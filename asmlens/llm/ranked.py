"""Ranked lexical search over a length-stratified index.

Documents of one normaliser m (a whole number made of a document's length and
the mean length) form a stratum. The index holds, a block of a stratum, the
documents and for each term its postings by tf: all documents of a stratum in
which a term occurs equally often get the same impact, which is computed once.

A search knows from the greatest tf of each term in each stratum what any
document there can score at most. Strata are visited in the order of these
bounds: first the best few of each item, which give a score that ten documents
reach, then every stratum whose bound is not below it. What is left out cannot
change the ten.

Terms are digests of 64 bits. A block is bounded by ``BLOCK`` terms or one
document, so strata of any size spread over tasks. Items are searched for in
groups of ``ITEMS``; only a group's terms go to the executors.

Cases: a null text has no term, and a document without terms is in no stratum.
An item without terms, or whose terms no document holds, has no rows. Rows that
repeat are documents of their own; equal scores are ordered by document id, a
null id last. An item id that repeats, null too, joins its rows' terms into one item.
Texts of any length are read whole; a block holds one long text at least. An
empty table of documents or items gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asmlens.llm import _text as X
from asmlens.llm._spark import dropped, written

BLOCK = 1 << 18  # terms in a block, with repeats
ITEMS = 256  # items that are searched for at once
FIRST = 3  # strata of each item that are visited first
TOP = 10
LENGTH_PERCENT = 75  # how much of the normaliser follows the length
NOBODY = np.iinfo(np.int64).max  # stands for a null id

#: Bytes that separate terms: ASCII but letters and digits.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of whole texts: first row, number of texts, the digest of each term, and the text's number in the run."""
    for row, offsets, data in X.texts(column):
        data = LOWER[data]
        start, end, first = X.words(data, offsets, GAP)
        counts = np.diff(first)
        yield row, len(counts), X.RangeHash(data)(start, end).view(np.int64), np.repeat(np.arange(len(counts)), counts)


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``n``, the number of terms; documents without terms are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, size, _, owner in _terms(batch.column(1)):
                n = np.bincount(owner, minlength=size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(row, size).columns, pa.array(n)], names=["doc_id", "text", "n"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, text string, n long")


INDEX = "m long, docs array<long>, terms array<long>, tfs array<long>, ends array<int>, members array<int>"
_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _postings(owner: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the terms of numbered documents: for each (term, tf) in order the term, tf and where its documents end, and the documents."""
    order = np.lexsort((owner, terms))
    owner, terms = owner[order], terms[order]
    new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])]))
    tf = np.diff(np.append(new, len(terms)))
    owner, terms = owner[new], terms[new]
    order = np.lexsort((owner, tf, terms))
    owner, terms, tf = owner[order], terms[order], tf[order]
    new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (tf[1:] != tf[:-1])]))
    return terms[new], tf[new], np.append(new[1:], len(terms)).astype(np.int32), owner.astype(np.int32)


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The index of ``docs`` (doc_id, text), written; and the number of documents in it."""
    rows = sized(docs)
    lengths = written(rows.groupBy("n").count(), "lengths")
    n_docs, n_terms = lengths.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("count")), F.lit(0))).first()  # one row
    share = F.expr(f"{LENGTH_PERCENT} * n * {n_docs}L div {max(n_terms, 1)}L")
    m = (100 - LENGTH_PERCENT + share).cast("long")
    blocks = lengths.groupBy(m.alias("m")).agg(F.ceil(F.sum(F.col("n") * F.col("count")) / BLOCK).alias("blocks"))
    dealt = rows.withColumn("m", m).join(blocks, "m").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.col("blocks")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        terms: list[np.ndarray] = []
        n = size = 0

        def close() -> pa.RecordBatch:
            group, tf, ends, members = _postings(np.concatenate(owners), np.concatenate(terms))
            columns = (np.concatenate(ids), group, tf.astype(np.int64), ends, members)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), *lists], names=_INDEX_NAMES)

        for batch in batches:
            strata, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (strata[1:] != strata[:-1]) | (blocks[1:] != blocks[:-1])])) if len(strata) else np.zeros(0, int)
            for low, high in zip(edges, [*edges[1:], len(strata)]):
                here = (strata[low], blocks[low])
                part = batch.slice(low, high - low)
                who = part.column(2).fill_null(NOBODY).to_numpy()
                for row, count, term, owner in _terms(part.column(3)):
                    if n and (here != now or size >= 2 * BLOCK):
                        yield close()
                        ids, owners, terms, n, size = [], [], [], 0, 0
                    now = here
                    ids.append(who[row : row + count])
                    owners.append(owner + n)
                    terms.append(term)
                    n, size = n + count, size + len(term)
        if n:
            yield close()

    sorted_ = dealt.repartition("m", "block").sortWithinPartitions("m", "block").select("m", "block", "doc_id", "text")
    index = written(sorted_.mapInArrow(build, INDEX), "index")
    dropped(lengths)
    return index, n_docs


def wanted(items: DataFrame) -> DataFrame:
    """Rows (item_id, term, q): the terms of each item and how often it has them. The null id is ``NOBODY``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, term, owner in _terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + owner]), pa.array(term)], names=["item_id", "term"])

    rows = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NOBODY)).alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(emit, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("q"))


def _impact(tf, m):
    """The part of a score that tf and the stratum make, for numbers and for columns alike."""
    if isinstance(tf, np.ndarray):
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 8L * {m})")


def _held(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """Rows (m, term, df, tf) for the sorted ``terms`` that a block holds: documents with the term, and its greatest tf."""
    names = ["m", "term", "df", "tf"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                group, tf, ends = (batch.column(c)[k].values.to_numpy() for c in (1, 2, 3))
                low, high = np.searchsorted(group, terms, "left"), np.searchsorted(group, terms, "right")
                found = np.flatnonzero(high > low)
                low, high = low[found], high[found]
                df = ends[high - 1].astype(np.int64) - np.where(low > 0, ends[low - 1], 0)
                m = np.full(len(found), batch.column(0)[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(terms[found]), pa.array(df), pa.array(tf[high - 1])], names=names)

    return index.select("m", "terms", "tfs", "ends").mapInArrow(count, "m long, term long, df long, tf long").groupBy("m", "term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"))


HIT = "item_id long, doc_id long, score long"


def _visit(index: DataFrame, visits: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], terms: np.ndarray, top: int) -> DataFrame:
    """Rows of ``HIT``: each task's best ``top`` documents of each item.

    ``visits`` (m, item_id, least): strata to visit for an item, and the score below which nothing counts.
    ``queries``: for each item the places of its terms in ``terms``, and their weights.
    """

    def merge(best: tuple | None, docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if best is not None:
            docs, scores = np.concatenate([best[0], docs]), np.concatenate([best[1], scores])
        order = np.lexsort((docs, -scores))[:top]
        return docs[order], scores[order]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                m = batch.column(0)[k].as_py()
                docs, group, tf, ends, members = (batch.column(c)[k].values.to_numpy() for c in range(1, 6))
                low, high = np.searchsorted(group, terms, "left"), np.searchsorted(group, terms, "right")
                each, place = np.unique(tf, return_inverse=True)
                impacts = _impact(each, m)  # once per tf
                starts = np.concatenate([[0], ends])
                per_member = np.repeat(impacts[place], np.diff(starts))
                there = high > low
                most = np.where(there, impacts[place[np.maximum(high, 1) - 1]], 0)
                first, last = starts[low], starts[high]
                for visit in batch.column(6)[k].as_py():
                    item, least = visit["item_id"], visit["least"]
                    if item in best and len(best[item][1]) == top:
                        least = max(least, int(best[item][1][-1]))
                    at, weights = queries[item]
                    if int((most[at] * weights).sum()) < least:
                        continue
                    scores = np.zeros(len(docs), np.int64)
                    for t, w in zip(at.tolist(), weights.tolist()):
                        if there[t]:
                            scores[members[first[t] : last[t]]] += w * per_member[first[t] : last[t]]
                    reached = np.flatnonzero(scores >= least)
                    if len(reached) > top:
                        cut = np.partition(scores[reached], len(reached) - top)[len(reached) - top]
                        reached = reached[scores[reached] >= cut]
                    if len(reached):
                        best[item] = merge(best.get(item), docs[reached], scores[reached])
        for item, (docs, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item)), pa.array(docs), pa.array(scores)], names=["item_id", "doc_id", "score"])

    lists = visits.groupBy("m").agg(F.collect_list(F.struct("item_id", "least")).alias("visits"))  # at most the items of a group
    # written, so that Spark knows its size and sends it to the index where it is small
    lists = written(lists, "visits")
    return index.join(lists, "m").select("m", "docs", "terms", "tfs", "ends", "members", "visits").mapInArrow(search, HIT)


def search(index: DataFrame, n_docs: int, items: DataFrame, top: int = TOP, at_once: int = ITEMS, first: int = FIRST) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    spark = index.sparkSession
    asked = written(wanted(items), "asked")
    n_groups = max(1, -(-asked.select("item_id").distinct().count() // at_once))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best_first = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    for g in range(n_groups):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == g).select("item_id", "term", "q")
        terms = np.array(sorted(r.term for r in mine.select("term").distinct().collect()), np.int64)  # a group's terms
        held = written(_held(index, terms), "held")
        weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        weighed = mine.join(held.groupBy("term").agg(F.sum("df").alias("df")), "term").select("item_id", "term", (F.col("q") * weight).alias("weight"))
        weighed = written(weighed, "weighed")
        queries: dict[int, tuple[list, list]] = {}
        for r in weighed.collect():  # a group's terms
            at, weights = queries.setdefault(r.item_id, ([], []))
            at.append(int(np.searchsorted(terms, r.term)))
            weights.append(r.weight)
        packed = {k: (np.array(a, np.int64), np.array(w, np.int64)) for k, (a, w) in queries.items()}
        bounds = held.join(weighed, "term").groupBy("item_id", "m").agg(F.sum(F.col("weight") * _impact("tf", "m")).alias("bound")).where("bound > 0")
        turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "m"))
        bounds = written(bounds.withColumn("turn", turn), "bounds")
        early = written(_visit(index, bounds.where(F.col("turn") <= first).select("m", "item_id", F.lit(1).cast("long").alias("least")), packed, terms, top), "early")
        tenth = early.withColumn("place", F.row_number().over(best_first)).where(F.col("place") == top).select("item_id", F.col("score").alias("least"))
        rest = bounds.where(F.col("turn") > first).join(tenth, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).where("bound >= least").select("m", "item_id", "least")
        late = _visit(index, rest, packed, terms, top)
        ranked = early.unionByName(late).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top)
        done = written(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        dropped(held, weighed, bounds, early)
        found = found.unionByName(done)
    dropped(asked)
    nobody = lambda c: F.when(F.col(c) != NOBODY, F.col(c)).alias(c)
    return found.select(nobody("item_id"), "rank", nobody("doc_id"), "score")


def op12_length_strata(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    index, n_docs = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = search(index, n_docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    dropped(index)
    return found


_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: DuckDB SQL for the query's rows.
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SPLIT} AS terms FROM documents),
  sized AS (SELECT *, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
  strata AS (SELECT k, doc_id, terms, 25 + (75 * n * n_docs) // n_terms AS m FROM sized, total),
  postings AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM strata) GROUP BY ALL),
  asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY ALL),
  weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term, n_docs),
  scores AS (SELECT item_id, k, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN strata USING (k) GROUP BY ALL),
  ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores JOIN strata USING (k) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
