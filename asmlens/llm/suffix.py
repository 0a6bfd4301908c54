"""Repeated-passage removal by longest previous factors, partitioned by anchors.

A passage is a string of ``least`` bytes. Each window of that length has one
anchor: the leftmost k-gram of least hash in it. Equal windows have equal
anchors at the same place, so windows meet by their anchor's hash. Neighbouring
windows with the same anchor form one piece of text, and only pieces whose
anchor occurs again somewhere are moved.

The suffixes of an anchor's pieces are put in suffix order (prefix doubling to
the depth of a passage), with the common prefixes of neighbours. In that order
the previous and the next smaller position give each suffix its longest previous
factor, cut off at a passage's length; where it reaches that length, the suffix
begins a passage that occurs earlier. The same search over mirrored positions
finds later matches. ``keep="first"`` removes what has an earlier match,
``keep="none"`` what has any other.

Texts that repeat are worked on once. The suffixes of anchors with more than
``HOT`` pieces don't go to one task: they are dealt by a hash of their first
passage. All suffixes of one such key share a passage, so there the smaller
positions reduce to the least one, a minimum that combines before the shuffle.

Cases: null text counts as empty. Shorter texts are never cut. Rows with the
same id and text are one document, kept or removed alike under ``keep="first"``;
under ``keep="none"`` they are copies of each other. Null ids come last in
order. An empty table gives an empty table. Other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.llm import _text as X
from asmlens.llm._spark import fresh, stage, written

LEAST, GRAM, HOT = 200, 32, 20_000
PLACE = np.uint64((1 << 24) - 1)
STEP = 1 << 20
SLICE = 2500


def pieces(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, text, first window and number of windows of every piece."""
    span = least - GRAM + 1
    for base in range(0, max(len(data) - least + 1, 0), STEP):
        part = data[base : base + STEP + least - 1]
        sums = X.RangeHash(part)
        gram = X.mix((sums.sums[GRAM:] - sums.sums[:-GRAM]) * sums.down[: len(part) - GRAM + 1])
        low = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        place = (low & PLACE).astype(np.int64)
        at = np.arange(base, base + len(place))
        of = np.searchsorted(offsets, at[[0, -1]], side="right") - 1
        whole = np.zeros(len(place) + 1, np.int8)  # windows that lie inside one text
        for_ = np.arange(of[0], of[1] + 1)
        first, last = np.maximum(offsets[for_] - base, 0), np.minimum(offsets[for_ + 1] - least + 1 - base, len(place))
        real = last > first
        np.add.at(whole, first[real], 1)
        np.add.at(whole, last[real], -1)
        whole = np.cumsum(whole[:-1]) > 0
        cut = np.ones(len(place), bool)
        cut[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1])
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(place)))
        begin, size = begin[whole[begin]], size[whole[begin]]
        text = np.searchsorted(offsets, begin + base, side="right") - 1
        yield gram[place[begin]].view(np.int64), text, begin + base - offsets[text], size


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, ord, text) to (h, k1, k2, ord, at); at = first window * 256 + windows."""
    for batch in batches:
        k1, k2, ord_ = (np.asarray(batch.column(i)) for i in range(3))
        for row, offsets, data in X.texts(batch.column(3)):
            for h, text, first, size in pieces(data, offsets):
                rows = row + text
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k1[rows]), pa.array(k2[rows]), pa.array(ord_[rows]), pa.array(first * 256 + size)], names=["h", "k1", "k2", "ord", "at"])


CUT = "h long, c long, k1 long, k2 long, ord long, at long, piece binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, ord, n, text, found: [(h, at)]) to pieces; c hashes a piece's bytes."""
    names = [x.split()[0] for x in CUT.split(", ")]
    for batch in batches:
        k1, k2, ord_ = (np.asarray(batch.column(i)) for i in range(3))
        found = batch.column(5)
        ends, flat = found.offsets.to_numpy(), found.flatten()
        h, at = (flat.field(i).to_numpy() for i in range(2))
        ends = ends - ends[0]
        for row, offsets, data in X.texts(batch.column(4)):
            own = slice(ends[row], ends[row + len(offsets) - 1])
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(ends[row : row + len(offsets)]))
            begin = offsets[text] + (at[own] >> 8)
            end = begin + (at[own] & 255) + LEAST - 1
            content = X.RangeHash(data)(begin, end).view(np.int64)
            raw = data.tobytes()
            cut = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            rows = row + text
            yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(content), pa.array(k1[rows]), pa.array(k2[rows]), pa.array(ord_[rows]), pa.array(at[own]), pa.array(cut, pa.binary())], names=names)


def _rank(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    return np.unique(high * (low.max() + 1) + low, return_inverse=True)[1]


class Suffixes:
    """Order and common prefixes of the suffixes of ``data``, to ``depth`` bytes (16 at least)."""

    def __init__(self, data: np.ndarray, depth: int = LEAST):
        padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
        self.word = np.zeros(len(data) + depth, np.uint64)
        for k in range(8):
            self.word = (self.word << np.uint64(8)) | padded[k : k + len(self.word)]
        self.depth, known, rank = depth, 8, np.unique(self.word, return_inverse=True)[1]
        self.levels = [(known, rank)]
        while known < depth:
            step = min(known, depth - known)
            n = len(rank) - step
            rank = _rank(rank[:n], rank[step:])
            known += step
            self.levels.append((known, rank))
        #: Rank of the suffix at each position; equal prefixes of ``depth`` bytes have equal ranks.
        self.rank = rank[: len(data)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, at most ``depth``."""
        out = np.where(self.rank[a] == self.rank[b], self.depth, 0)
        open_ = np.flatnonzero(out == 0)
        a, b = a[open_], b[open_]
        for size, rank in self.levels[-2::-1]:
            same = rank[a] == rank[b]
            out[open_[same]] += size
            a, b = a + size * same, b + size * same
        apart = self.word[a] ^ self.word[b]  # never zero: the last level is that of whole words
        for k in range(1, 8):
            out[open_] += apart >> np.uint64(64 - 8 * k) == 0
        return np.minimum(out, self.depth)


def _previous(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """In suffix order, the common prefix of each suffix with the nearest one before it that has a smaller position; 0 if none.

    ``common``: that of each suffix with its predecessor. A tree of minima is climbed from every suffix
    to the first left neighbour that holds a smaller position, and descended to its last one.
    """
    n = len(position)
    high = max(n - 1, 1).bit_length()
    least, shared = [np.full(1 << high, np.iinfo(np.int64).max)], [np.full(1 << high, np.iinfo(np.int64).max)]
    least[0][:n], shared[0][:n] = position, common
    for _ in range(high):
        least.append(np.minimum(least[-1][::2], least[-1][1::2]))
        shared.append(np.minimum(shared[-1][::2], shared[-1][1::2]))
    out, found = np.zeros(n, np.int64), []
    who, acc = np.arange(n), common.astype(np.int64)
    for level in range(high):
        side = who >> level
        right = side & 1 == 1
        hit = right.copy()
        hit[right] = least[level][side[right] - 1] < position[who[right]]
        found.append((who[hit], side[hit] - 1, acc[hit]))
        skip = right & ~hit
        acc[skip] = np.minimum(acc[skip], shared[level][side[skip] - 1])
        go = ~hit & (acc > 0)
        who, acc = who[go], acc[go]
    who, node, acc = (np.zeros(0, np.int64),) * 3
    for level in range(high - 1, -1, -1):
        who, node, acc = (np.concatenate(x) for x in zip((who, node, acc), found[level]))
        if level == 0:
            break
        node = 2 * node + 1
        skip = least[level - 1][node] >= position[who]
        acc[skip] = np.minimum(acc[skip], shared[level - 1][node[skip]])
        node -= skip
    out[who] = acc
    return out


def longest_previous_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order: the longest match with one at a smaller position.

    It is the better of the matches with the previous and the next smaller position in that order.
    """
    if not len(position):
        return np.zeros(0, np.int64)
    back = np.concatenate([[0], common[:0:-1]])
    return np.maximum(_previous(position, common), _previous(position[::-1], back)[::-1])


def _match(first: bool):
    """Pieces sorted by (h, c) to flagged window ranges (k1, k2, start, stop)."""

    def found(table: pa.Table) -> pa.RecordBatch:
        h, c, k1, k2, ord_, at = (table.column(i).to_numpy() for i in range(6))
        order = np.lexsort((at, k2, k1, ord_, c, h))
        h, c, k1, k2, at, ord_ = h[order], c[order], k1[order], k2[order], at[order], ord_[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        lead = np.flatnonzero(new)  # of the rows with one content the first in text order
        content = np.cumsum(new) - 1
        copies = np.diff(np.append(lead, len(h)))
        group = h[lead]
        several = np.zeros(len(lead), bool)
        if len(lead) > 1:
            several[1:] |= group[1:] == group[:-1]
            several[:-1] |= group[1:] == group[:-1]
        windows = (at[lead] & 255).astype(np.int64)
        # whole contents that repeat
        whole_from, whole_to = np.zeros(len(h), np.int64), (at & 255).astype(np.int64)
        flagged = ~new if first else copies[content] > 1
        rows = [np.flatnonzero(flagged)]
        lo, hi = [whole_from[flagged]], [whole_to[flagged]]
        look = np.flatnonzero(several if first else several)
        if len(look):
            look = look[np.lexsort((at[lead[look]], k2[lead[look]], k1[lead[look]], ord_[lead[look]]))]  # text order
            _, offsets, data = next(X.texts(table.column(6).take(pa.array(order[lead[look]])).combine_chunks(), 1 << 62))
            place = np.repeat(offsets[:-1], windows[look]) + np.arange(windows[look].sum()) - np.repeat(np.cumsum(windows[look]) - windows[look], windows[look])
            piece = np.repeat(np.arange(len(look)), windows[look])
            order_ = Suffixes(data)
            anchor = np.unique(group[look], return_inverse=True)[1][piece]
            suffix = np.lexsort((place, order_.rank[place], anchor))
            at_ = place[suffix]
            common = np.zeros(len(suffix), np.int64)
            common[1:] = np.where(anchor[suffix[1:]] == anchor[suffix[:-1]], order_.common(at_[1:], at_[:-1]), 0)
            factor = longest_previous_factors(at_, common)
            if not first:  # a match at a larger position is one of the mirrored positions
                factor = np.maximum(factor, longest_previous_factors(-at_, common))
            hit = np.zeros(len(place), bool)
            hit[suffix] = factor >= LEAST
            if not first:
                hit &= ~(copies[look] > 1)[piece]  # already whole
            edge = np.diff(np.concatenate([[0], (hit * (piece + 1)), [0]]))
            starts = np.flatnonzero(hit & (edge[:-1] != 0))
            stops = np.flatnonzero(hit & (edge[1:] != 0))
            rows.append(lead[look[piece[starts]]])
            lo.append(place[starts] - offsets[piece[starts]])
            hi.append(place[stops] - offsets[piece[stops]] + 1)
        rows = np.concatenate(rows)
        begin = (at >> 8)[rows]
        return pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(k2[rows]), pa.array(begin + np.concatenate(lo)), pa.array(begin + np.concatenate(hi))], names=["k1", "k2", "start", "stop"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            h = batch.column(0).to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            if last:
                held.append(batch.slice(0, last))
                yield found(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield found(pa.Table.from_batches(held))

    return match


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, n, piece) of hot anchors to one row a window, with a hash of its bytes."""
    for batch in batches:
        h, c, n = (batch.column(i).to_numpy() for i in range(3))
        for row, offsets, data in X.texts(batch.column(3)):
            sizes = np.diff(offsets) - LEAST + 1
            piece = np.repeat(np.arange(len(sizes)), sizes)
            off = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin = offsets[piece] + off
            w = X.RangeHash(data)(begin, begin + LEAST).view(np.int64)
            rows = row + piece
            yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(c[rows]), pa.array(n[rows]), pa.array(off), pa.array(w)], names=["h", "c", "n", "off", "w"])


def _hot_matches(cut: DataFrame, first: bool) -> DataFrame:
    """The result of ``_match`` for anchors with too many pieces for one task."""
    place = F.struct("ord", "k1", "k2", "at")
    contents = cut.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("lead"), F.first("piece").alias("piece"))
    windows = contents.select("h", "c", "n", "piece").mapInArrow(_windows, "h long, c long, n long, off long, w long")
    windows = windows.join(contents.select("h", "c", "lead"), ["h", "c"])
    rank = F.struct("lead", "off")
    shared = windows.groupBy("h", "w").agg(F.sum("n").alias("total"), F.min(rank).alias("least")).where("total > 1")
    hit = windows.join(shared, ["h", "w"])
    hit = hit.where(rank > F.col("least")) if first else hit.where("n = 1")
    offs = hit.groupBy("h", "c").agg(F.collect_set("off").alias("offs"))  # at most the windows of one piece
    some = cut.select("h", "c", "k1", "k2", "ord", "at").join(contents.select("h", "c", "n", "lead"), ["h", "c"])
    begin, size = F.shiftright("at", 8), F.col("at").bitwiseAND(F.lit(255))
    whole = some.where(place > F.col("lead")) if first else some.where("n > 1")
    parts = some.where(place == F.col("lead")) if first else some.where("n = 1")
    parts = parts.join(offs, ["h", "c"]).select("k1", "k2", "at", F.explode("offs").alias("off")).select("k1", "k2", (begin + F.col("off")).alias("start"))
    return whole.select("k1", "k2", begin.alias("start"), (begin + size).alias("stop")).unionByName(parts.withColumn("stop", F.col("start") + 1))


def _apply(first: bool, with_text: bool):
    """Rows (k1, k2, ord, n, text, spans) to what is left of each text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, n = batch.column(0), batch.column(1), np.asarray(batch.column(3))
            spans = batch.column(5)
            ends, flat = spans.offsets.to_numpy(), spans.flatten()
            ends = ends - ends[0]
            start, stop = (flat.field(i).to_numpy() for i in range(2))
            missing = spans.is_null().to_numpy(zero_copy_only=False)
            removed, parts, digests, kept = [], [], [], []
            for row, offsets, data in X.texts(batch.column(4)):
                for k in range(len(offsets) - 1):
                    own, r = data[offsets[k] : offsets[k + 1]], row + k
                    gone = np.zeros(len(own) + 1, np.int32)
                    if n[r] > 1 and not first and len(own) >= LEAST:
                        gone[0], gone[-1] = 1, -1
                    elif not missing[r]:
                        a, b = start[ends[r] : ends[r + 1]], stop[ends[r] : ends[r + 1]]
                        np.add.at(gone, a, 1)
                        np.add.at(gone, b + LEAST - 1, -1)
                    out = np.cumsum(gone[:-1]) > 0
                    removed.append(int(out.sum()))
                    parts.append(int((out & ~np.concatenate([[False], out[:-1]])).sum()) if len(out) else 0)
                    digests.append(hashlib.sha256(own[~out].tobytes()).hexdigest())
                    if with_text:
                        # a character that lies partly outside stays whole
                        lead = np.flatnonzero((own & 0xC0) != 0x80)
                        if len(lead):
                            whole = np.logical_and.reduceat(out, lead)
                            out = np.repeat(whole, np.diff(np.append(lead, len(own))))
                        kept.append(own[~out].tobytes().decode("utf-8", "replace"))
            columns = [k1, k2, batch.column(2), pa.array(removed, pa.int64()), pa.array(parts, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.string())] if with_text else [])], names=LEFT[: 6 + with_text])

    return apply


LEFT = ["k1", "k2", "first", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "none", with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """What repeated passages leave of each distinct text of ``LEAST`` bytes or more.

    Returns rows (k1, k2, first, n_removed, n_spans, kept_sha256[, kept_text]) and ``docs``
    with the key (k1, k2) of its text, for joining; ``first`` is the least id with that
    text under ``keep="first"``.
    """
    first = keep == "first"
    body = F.coalesce(F.col(text), F.lit(""))
    key = [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")]
    order = F.coalesce(F.col(doc_id), F.lit((1 << 63) - 1))
    long_ = docs.select(*key, (order if first else F.lit(0).cast("long")).alias("ord"), body.alias("text")).where(F.octet_length("text") >= LEAST)
    anchors = written(long_.mapInArrow(_anchors, "h long, k1 long, k2 long, ord long, at long"), "anchors")
    place = F.xxhash64("k1", "k2", "at")
    again = anchors.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b").select("h", "n")
    again = written(again, "repeated-anchors")

    texts = long_.groupBy("k1", "k2").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.first("text").alias("text"))

    def cut(some: DataFrame) -> DataFrame:
        rows = anchors.join(some.select("h"), "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "at")).alias("found"))
        return texts.join(rows, ["k1", "k2"]).select("k1", "k2", "ord", "n", "text", "found").mapInArrow(_cut, CUT)

    few = cut(again.where(F.col("n") <= HOT)).repartition("h").sortWithinPartitions("h", "c").mapInArrow(_match(first), "k1 long, k2 long, start long, stop long")
    hot = again.where(F.col("n") > HOT)
    flagged = few if hot.isEmpty() else few.unionByName(_hot_matches(cut(hot), first))
    spans = flagged.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    schema = "k1 long, k2 long, first long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    left = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "ord", "n", "text", "spans").mapInArrow(_apply(first, with_text), schema)
    return left, docs.select("*", *key)


def op4_suffix_lpf(spark, sf_dir: str) -> DataFrame:
    """Every document with what repeated passages leave of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left, keyed = passages(docs)
    left = written(left, "left")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = keyed.select("doc_id", "k1", "k2", F.octet_length(body).cast("long").alias("n_bytes"), F.when(F.octet_length(body) < LEAST, F.sha2(body.cast("binary"), 256)).alias("whole"))
    return rows.join(left, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


@stage
def cut_later_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages that occur earlier (in order of id) are cut from the texts; every row stays."""
    names = docs.columns
    left, keyed = passages(docs, keep="first", with_text=True)
    short, out = fresh(docs, "short_text"), fresh(docs, "left")
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    body = F.coalesce(F.col("text"), F.lit(""))
    # only texts that nothing can be cut from travel with their rows; the others come once, from what is left
    rows = docs.withColumns({k1: F.xxhash64(body), k2: F.xxhash64(F.lit(1), body), short: F.when(F.octet_length(body) < LEAST, F.col("text"))}).drop("text")
    left = left.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.struct("first", "kept_text").alias(out))
    rows = rows.join(left, [k1, k2], "left")
    later = F.coalesce("doc_id", F.lit((1 << 63) - 1)) > F.col(out)["first"]
    text = F.when(F.col(out).isNull(), F.col(short)).when(later, F.lit("")).otherwise(F.col(out)["kept_text"])
    return rows.withColumn("text", text).select(*names)
