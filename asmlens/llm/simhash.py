"""SimHash near-duplicates by pivot distance tables.

Fingerprints are compared once each, however many documents have them. The
pivot table is computed once: for every distinct fingerprint the Hamming distances
to many reference fingerprints. References come in pairs: the second equals the
first within one small group of bits and is its complement outside, so the sum of
both distances depends on that group only. Two fingerprints that differ in at most
``radius`` bits agree on the sums of all but ``radius`` of the groups; they meet
in the bucket of the sums that they share. Within a bucket, sorted by the first
coordinate, pairs whose coordinates differ by more than ``radius`` are discarded,
one coordinate of the table after the other; survivors are verified on the
fingerprints. Buckets emit a star of links, not all pairs. Buckets go by large
groups of bits first; oversized ones are dealt again by the small groups, so none
is capped.

Cases: texts without words (null, empty) have the zero fingerprint and are
linked like any other. Rows that repeat share a fingerprint. A null id never
becomes a component's id unless all ids of the component are null. An empty
table gives an empty table. Only the named columns are read; the result has
its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.llm import _text as X
from asmlens.llm import similar
from asmlens.llm._spark import dropped, fresh, stage, written
from asmlens.llm.components import connected_components

SEED, SHINGLE, RADIUS = 42, 3, 2
GROUPS, PAIRS, CARRIED = 5, 6, 8
SPLIT_ABOVE = 1000
FULL = (1 << 64) - 1

#: Bits of the ten small groups; a large group is two of them.
_EDGES = [round(64 * k / (2 * GROUPS)) for k in range(2 * GROUPS + 1)]
MASKS = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(_EDGES, _EDGES[1:])]


def _references() -> np.ndarray:
    """For each small group ``PAIRS`` references and their twins."""
    first = X.mix(np.arange(1, len(MASKS) * PAIRS + 1, dtype=np.uint64) * np.uint64(1000)).reshape(len(MASKS), PAIRS)
    twin = first ^ np.array([FULL ^ m for m in MASKS], np.uint64)[:, None]
    return np.stack([first, twin], 2)


REFERENCES = _references()


def pivot_distances(fp: np.ndarray) -> np.ndarray:
    """Rows of the pivot table: a byte for each reference, in the order group, pair, reference and twin."""
    return np.stack([np.bitwise_count(fp ^ r) for r in REFERENCES.ravel()], 1).astype(np.uint8)


def fingerprint(text: bytes) -> int:
    """The contract's fingerprint of one text's UTF-8 bytes."""
    words = text.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n < 2:
        h = [digest(line, SEED)]
    else:
        cuts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(cuts[: n - 1] + 1).tolist()]
        ends = [*cuts[SHINGLE - 1 :].tolist(), len(line)]
        h = [digest(line[a:b], SEED) for a, b in zip(starts, ends)]
    hashes = np.array(h, np.uint64)
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        set_ += np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """``docs`` with a long column ``into`` (it replaces one of that name)."""
    docs = docs.drop(into) if into.lower() in {c.lower() for c in docs.columns} else docs
    at, names = docs.columns.index(text), [*docs.columns, into]

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for row, offsets, data in X.texts(batch.column(at)):
                raw = data.tobytes()
                for k in range(len(offsets) - 1):
                    out[row + k] = fingerprint(raw[offsets[k] : offsets[k + 1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=names)

    return docs.mapInArrow(stamp, docs.select("*", F.lit(0).cast("long").alias(into)).schema)


TABLE = "fp long, distances binary, salt long"


def _tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp) to rows of ``TABLE``."""
    for batch in batches:
        rows = pivot_distances(np.asarray(batch.column(0)).view(np.uint64))
        cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), cells, pa.array(np.zeros(len(rows), np.int64))], names=["fp", "distances", "salt"])


def _dealer(small: bool):
    """Rows of ``TABLE`` to rows (key, fp, near): a bucket key for every choice of groups that a close pair can agree on.

    ``near`` are the first ``CARRIED`` coordinates that the bucket compares, a byte each.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, salt = batch.column(0), np.asarray(batch.column(2)).view(np.uint64)
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(fp), len(MASKS), PAIRS, 2)
            near = np.ascontiguousarray(table[:, :CARRIED, 0, 0]).view(np.int64).ravel()
            sums = table.sum(3, dtype=np.uint64)
            hashes = np.zeros((len(fp), len(MASKS)), np.uint64)
            for k in range(PAIRS):
                hashes = X.mix(hashes + sums[:, :, k] + np.uint64(1))
            if not small:
                hashes = X.mix(hashes[:, ::2] + X.mix(hashes[:, 1::2]))
            for n, chosen in enumerate(combinations(range(hashes.shape[1]), hashes.shape[1] - RADIUS)):
                key = X.mix(salt + np.uint64(n + 1))
                for g in chosen:
                    key = X.mix(key + hashes[:, g])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), fp, pa.array(near)], names=["key", "fp", "near"])

    return deal


def _pairs(bucket: np.ndarray, fp: np.ndarray, near: np.ndarray, radius: int, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of verified pairs within buckets."""
    table = near.view(np.int8).reshape(-1, CARRIED)
    order = np.lexsort((table[:, 0], bucket))
    bucket, fp, table = bucket[order], fp[order], table[order]
    _, rank = np.unique(bucket, return_inverse=True)
    line = rank * 128 + table[:, 0]
    reach = np.searchsorted(line, line + radius, side="right") - np.arange(len(line)) - 1
    steps = np.concatenate([[0], np.cumsum(reach)])
    at = 0
    while at < len(line):
        stop = max(at + 1, int(np.searchsorted(steps, steps[at] + chunk, side="right")) - 1)
        left = np.repeat(np.arange(at, stop), reach[at:stop])
        right = left + 1 + np.arange(len(left)) - np.repeat(steps[at:stop] - steps[at], reach[at:stop])
        for k in range(1, CARRIED):  # discard by the largest coordinate difference, one coordinate after the other
            close = np.abs(table[left, k] - table[right, k]) <= radius
            left, right = left[close], right[close]
        close = np.bitwise_count(fp[left] ^ fp[right]) <= radius
        yield order[left[close]], order[right[close]]
        at = stop


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``n`` nodes over links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, near) sorted by key; a bucket may go on in the next batch."""
    kept = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

    def linked(key: np.ndarray, fp: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        found = list(_pairs(key, fp, near, RADIUS)) if len(key) > 1 else []
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        ends, at = np.unique(fp, return_inverse=True)
        label = stars(len(ends), at[a], at[b])
        child = np.flatnonzero(label != np.arange(len(ends)))
        return pa.RecordBatch.from_arrays([pa.array(ends[child].view(np.int64)), pa.array(ends[label[child]].view(np.int64))], names=["a", "b"])

    parts = [kept]  # of the last bucket, joined once it ends
    for batch in batches:
        new = [np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2))]
        if not batch.num_rows:
            continue
        last = int(np.searchsorted(new[0], new[0][-1]))
        if last or (len(parts[-1][0]) and parts[-1][0][-1] != new[0][0]):
            yield linked(*(np.concatenate(x) for x in zip(*parts, [x[:last] for x in new])))
            parts = []
        parts.append([x[last:] for x in new])
    yield linked(*(np.concatenate(x) for x in zip(*parts)))


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Rows (a, b) of close fingerprints that connect all of them as all close pairs would."""
    dealt = "key long, fp long, near long"
    table = written(distinct.select(F.col(fp).alias("fp")).mapInArrow(_tabulate, TABLE), "pivot-table")
    keyed = table.mapInArrow(_dealer(False), dealt)
    hot = keyed.groupBy("key").count().where(F.col("count") > SPLIT_ABOVE).select("key")
    # of the small groups that a bucket leaves open at least all but RADIUS agree
    open_ = keyed.join(hot, "key", "left_semi").select("fp", F.col("key").alias("salt"))
    again = open_.join(table.drop("salt"), "fp").select("fp", "distances", "salt").mapInArrow(_dealer(True), dealt)
    dealt_out = keyed.join(hot, "key", "left_anti").select("key", "fp", "near").unionByName(again)
    return dealt_out.repartition("key").sortWithinPartitions("key").mapInArrow(_link, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component, component_id): every document with its fingerprint, its component and the least id in it.

    ``component`` tells components apart; ``component_id`` may be null, or one for several where ids repeat.
    """
    stamped = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "fingerprints")
    classes = stamped.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = connected_components(links(classes))
    classes = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return stamped.join(classes.join(named, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "fp", "component", "component_id")


def op2_simhash_pivots(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@stage
def keep_one(spark, docs: DataFrame, sf_dir: str, words: int = similar.WORDS, least: float = similar.LEAST) -> DataFrame:
    """Pipeline stage: one document of each set of near copies stays, the one with the least id.

    Near copies share ``least`` of their shingles of ``words`` words. They are
    found by a pivot table of wider fingerprints (``similar``); the constants
    above bind the contract query only.
    """
    tid, key, no_id = (fresh(docs, n) for n in ("text_key", "doc_key", "no_id"))
    rows = docs.select("doc_id", "text")
    stamped = written(similar._stamped(rows, words), "fingerprints")
    classes = written(stamped.groupBy("tid", *similar.LANE_NAMES).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("r")), "classes")
    dropped(stamped)
    joined = similar.similar_components(classes, similar.keyed(rows, "text", "tid").select("tid", "text"), words, least)
    named_classes = classes.join(joined, F.col("tid") == F.col("node"), "left").select(F.coalesce("component", "tid").alias("component"), F.struct("r.no_id", "r.doc_id", "tid").alias("r"))
    first = named_classes.groupBy("component").agg(F.min("r").alias("r"))
    # null ids get a key of their own, so that both sides are dealt by the same plain columns
    named = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    first = first.select(named(F.col("r.doc_id")).alias(key), F.col("r.doc_id").isNull().alias(no_id), F.col("r.tid").alias(tid))
    marked = similar.keyed(docs, "text", tid).withColumns({key: named(F.col("doc_id")), no_id: F.col("doc_id").isNull()})
    kept = marked.join(first, [key, no_id, tid], "left_semi").dropDuplicates([key, no_id, tid])  # one exchange of the texts serves both
    return kept.select(*docs.columns)
