"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into blocks of few
dimensions. Vectors with cosine ``c`` or more have a squared distance of at
most ``2 - 2c``; so in at least one block their squared distance is at most
that block's share of it. Each block is range-joined over cells of its space: a
vector has one home cell, and visits the later cells that its budget's ball
reaches, so each pair meets once in a block. A pair counts in the first block that
holds it, and is verified on the vectors as given, in double precision.

Cells are boxes of a tree of median splits, fitted to a sample of at most about
``SAMPLE`` distinct vectors so that a cell holds about ``CROWD`` homes; every
vector is placed by it. Crowded places get smaller cells. A cell that nevertheless
holds more than ``4 * CROWD`` homes is dealt to several tasks: homes by a hash,
visitors to all of them. Equal vectors are compared once. Cells give counts and
stars of links, not pairs.

Cost: a ball is about as wide as one dimension of unrelated vectors spreads, so
each further split of a cell adds visits; shuffle grows somewhat faster than the
number of vectors, and the comparisons with its square over the number of cells.

Cases: vectors that are null, zero, or hold null or non-finite parts link with
nothing. A table with vectors of several lengths compares those of one length.
Rows that repeat are vectors of their own that link with each other. Null ids
are never a component's id unless all its ids are null. An empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.llm import _text as X
from asmlens.llm._spark import written
from asmlens.llm.components import connected_components
from asmlens.llm.simhash import stars

COSINE, BLOCK, CROWD, SAMPLE, LARGE = 0.95, 16, 8192, 20_000, 2048
SLACK = 1e-6  # float error of the block distances


def rotation(n: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def blocks(n: int, cosine: float) -> list[tuple[slice, float]]:
    """Dimensions and squared-distance budget of each block."""
    total = (2 - 2 * cosine) * (1 + SLACK) + SLACK
    count = max(1, round(n / BLOCK))
    edges = [round(n * k / count) for k in range(count + 1)]
    return [(slice(a, b), total * (b - a) / n) for a, b in zip(edges, edges[1:])]


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, so that no square overflows or vanishes, and their lengths."""
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x
    return scaled, np.linalg.norm(scaled, axis=1)


@dataclass
class Cells:
    """A tree of splits of one block: at each inner node a dimension, a value, and the nodes below and above it; leaves are cells."""

    dimension: np.ndarray
    value: np.ndarray
    children: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, most: float) -> Cells:
        """Median splits along the widest dimension until at most ``most`` points are left, or they can't be parted."""
        nodes: list[list] = []

        def grow(part: np.ndarray) -> int:
            nodes.append([-1, 0.0, -1, -1])
            at = len(nodes) - 1
            if len(part) <= max(most, 1):
                return at
            low, high = np.quantile(part, [0.1, 0.9], axis=0)
            d = int(np.argmax(high - low))
            v = float(np.median(part[:, d]))
            above = part[:, d] >= v
            if above.all() or not above.any():
                return at
            nodes[at][:2] = d, v
            nodes[at][2:] = grow(part[~above]), grow(part[above])
            return at

        grow(points)
        columns = list(zip(*nodes))
        return cls(np.array(columns[0]), np.array(columns[1]), np.array(columns[2:]).T)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), np.int64)
        while (open_ := np.flatnonzero(self.dimension[at] >= 0)).size:
            node = at[open_]
            at[open_] = self.children[node, (points[open_, self.dimension[node]] >= self.value[node]).astype(np.int64)]
        return at

    def visits(self, points: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, int]]:
        """(points, cell): the cells within a squared distance of ``budget`` of points that aren't at home there."""
        todo = [(0, np.arange(len(points)), np.zeros_like(points), np.ones(len(points), bool))]
        while todo:
            node, who, gap, inside = todo.pop()
            d = self.dimension[node]
            if d < 0:
                if not inside.all():
                    yield who[~inside], node
                continue
            away = points[who, d] - self.value[node]
            for child, there in zip(self.children[node], (away < 0, away >= 0)):
                step = gap.copy()
                step[:, d] = np.where(there, step[:, d], np.maximum(step[:, d], np.abs(away)))
                near = (step**2).sum(1) <= budget
                if near.any():
                    todo.append((int(child), who[near], step[near], (inside & there)[near]))


def _key(size: int, block: int, cell: np.ndarray) -> np.ndarray:
    return X.mix(np.asarray(cell, np.uint64) + X.mix(np.array([size * 1000 + block], np.uint64))[0]).view(np.int64)


def _by_size(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """Size, rows, vectors and their matrix, for each length of vectors in a column."""
    sizes = np.diff(vectors.offsets.to_numpy())
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        lists = vectors.take(pa.array(own))
        yield int(size), own, lists, lists.flatten().to_numpy().reshape(len(own), size).astype(np.float64)


def fit_cells(distinct: DataFrame, cosine: float) -> dict[tuple[int, int], Cells]:
    """The cells of each (vector length, block), from a sample of the distinct vectors."""
    n = distinct.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = distinct.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20))).select("e").toArrow().column(0)
    out = {}
    for size, _, _, x in _by_size(sample.combine_chunks()) if len(sample) else ():
        scaled, norm = unit(x)
        turned = (scaled / norm[:, None]) @ rotation(size)
        for b, (dims, _) in enumerate(blocks(size, cosine)):
            out[size, b] = Cells.fit(turned[:, dims], CROWD * share)
    return out


ONE_CELL = Cells(np.array([-1]), np.array([0.0]), np.array([[-1, -1]]))


def _homes(cosine: float, cells: dict[tuple[int, int], Cells]):
    """Rows (vector) to the cells that are homes: (cell)."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, _, x in _by_size(batch.column(0)):
                scaled, norm = unit(x)
                turned = (scaled / norm[:, None]) @ rotation(size)
                for b, (dims, _) in enumerate(blocks(size, cosine)):
                    yield pa.RecordBatch.from_arrays([pa.array(_key(size, b, cells.get((size, b), ONE_CELL).home(turned[:, dims])))], names=["cell"])

    return homes


def _deal(cosine: float, cells: dict[tuple[int, int], Cells]):
    """Rows (node, n, vector) to rows (cell, home, node, n, block, vector)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for size, own, lists, x in _by_size(batch.column(2)):
                scaled, norm = unit(x)
                turned = (scaled / norm[:, None]) @ rotation(size)
                for b, (dims, budget) in enumerate(blocks(size, cosine)):
                    tree, part = cells.get((size, b), ONE_CELL), turned[:, dims]
                    home = tree.home(part)
                    found = [(np.arange(len(part)), home, True)]
                    for who, cell in tree.visits(part, budget):
                        who = who[home[who] < cell]  # the pair meets in the later of both homes
                        found.append((who, np.full(len(who), cell), False))
                    for who, cell, at_home in found:
                        if len(who):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(_key(size, b, cell)), pa.array(np.full(len(who), at_home)), pa.array(node[own][who]), pa.array(copies[own][who]), pa.array(np.full(len(who), b, np.int32)), lists.take(pa.array(who))],
                                names=["cell", "home", "node", "n", "block", "vector"],
                            )

    return deal


def _compare(cosine: float, chunk: int = 1 << 20):
    """Rows of cells, sorted by cell and part, to link counts (node, links) and stars (node, root)."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, part, home, node, n, block = (t.column(c).to_numpy() for c in ("cell", "part", "home", "node", "n", "block"))
        lists = t.column("vector").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        links, linked = np.zeros(len(cell), np.int64), []
        group = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])) - 1
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x, norm = unit(lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), size).astype(np.float64))
            turned = (x / norm[:, None]) @ rotation(int(size))
            parts = blocks(int(size), cosine)
            # the dimensions of each row's own block, which most pairs fail
            narrow = np.zeros((len(own), max(dims.stop - dims.start for dims, _ in parts)))
            for nth, (dims, _) in enumerate(parts):
                rows = np.flatnonzero(block[own] == nth)
                narrow[rows, : dims.stop - dims.start] = turned[rows, dims]
            budgets = np.array([budget for _, budget in parts])[block[own]]
            # visitors meet homes; homes meet the homes after them
            order = np.lexsort((~home[own], group[own]))
            g, h = group[own][order], home[own][order]
            heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            n_home = np.add.reduceat(h.astype(np.int64), heads) if len(heads) else heads
            at = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(g))))
            place = np.arange(len(g)) - heads[at]
            reach = np.where(h, np.maximum(n_home[at] - place - 1, 0), n_home[at])
            from_ = np.where(h, np.arange(len(g)) + 1, heads[at])
            def settle(a: np.ndarray, b: np.ndarray) -> None:
                """Count and link the pairs (indices into ``own``) that their block may count."""
                step = narrow[a]
                step -= narrow[b]
                keep = np.einsum("ij,ij->i", step, step) <= budgets[a]
                a, b = a[keep], b[keep]
                apart = (turned[a] - turned[b]) ** 2
                keep = node[own[a]] != node[own[b]]
                for nth, (dims, budget) in enumerate(parts[:-1]):  # the first block that holds the pair counts it
                    keep &= (block[own[a]] <= nth) | (apart[:, dims].sum(1) > budget)
                a, b = a[keep], b[keep]
                sure = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= cosine
                a, b = own[a[sure]], own[b[sure]]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                if len(a):
                    linked.append(np.stack([a, b]))

            # larger cells: distances of a few homes to all rows by a matrix product, with room for its rounding
            counts = np.diff(np.append(heads, len(g)))
            large = n_home * counts > LARGE
            for c in np.flatnonzero(large):
                rows = order[heads[c] : heads[c] + counts[c]]
                p = narrow[rows].astype(np.float32)
                square = np.einsum("ij,ij->i", p, p)
                limit = np.float32(budgets[rows[0]] * 1.0001 + 1e-5)
                for low in range(0, n_home[c], max(1, chunk // counts[c])):
                    high = min(n_home[c], low + max(1, chunk // counts[c]))
                    gap = p[low:high] @ p[low:].T
                    gap *= -2
                    gap += square[low:high, None]
                    gap += square[None, low:]
                    i, j = np.nonzero(gap <= limit)
                    later = j > i
                    settle(rows[low + i[later]], rows[low + j[later]])
            reach = np.where(large[at], 0, reach)
            steps = np.concatenate([[0], np.cumsum(reach)])
            k = 0
            while k < len(g):
                stop = max(k + 1, int(np.searchsorted(steps, steps[k] + chunk, side="right")) - 1)
                i = np.repeat(np.arange(k, stop), reach[k:stop])
                j = np.repeat(from_[k:stop], reach[k:stop]) + np.arange(len(i)) - np.repeat(steps[k:stop] - steps[k], reach[k:stop])
                settle(order[i], order[j])
                k = stop
        ends, index = np.unique(node, return_inverse=True)
        total = np.bincount(index, weights=links, minlength=len(ends)).astype(np.int64)
        pairs = np.concatenate(linked, 1) if linked else np.zeros((2, 0), np.int64)
        root = stars(len(ends), index[pairs[0]], index[pairs[1]])
        some = np.flatnonzero((total > 0) | (root != np.arange(len(ends))))
        yield pa.RecordBatch.from_arrays([pa.array(ends[some]), pa.array(total[some]), pa.array(ends[root[some]])], names=["node", "links", "root"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = (cell == cell[-1]) & (part == part[-1])
            last = int(np.flatnonzero(same)[0])
            if last:
                held.append(batch.slice(0, last))
                yield from found(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from found(pa.Table.from_batches(held))

    return compare


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one a vector."""
    e = F.col("e")
    kind = "float" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "double"
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("e"))
    good = e.isNotNull() & F.forall(e, finite) & F.exists(e, lambda v: v != 0)
    zero = F.transform(e, lambda v: v + F.lit(0.0).cast(kind))  # -0 counts as 0
    rows = rows.select("vec_id", F.when(good, zero).alias("e")).withColumn("node", F.when(F.col("e").isNotNull(), F.xxhash64("e")))
    distinct = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("e").alias("e"))
    distinct = written(distinct, "vectors")
    cells = fit_cells(distinct, cosine)
    dealt = distinct.select("node", "n", "e").mapInArrow(_deal(cosine, cells), f"cell long, home boolean, node long, n long, block int, vector array<{kind}>").withColumn("part", F.lit(0))
    homes = distinct.select("e").mapInArrow(_homes(cosine, cells), "cell long").groupBy("cell").count()
    crowds = written(homes.where(F.col("count") > 4 * CROWD).select("cell", F.ceil(F.col("count") / CROWD).cast("int").alias("parts")), "crowds")
    if not crowds.isEmpty():
        # in a crowded cell a home stays in its part and visits the parts after it
        dealt = dealt.join(crowds, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own, last = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"), F.col("parts") - 1
        spread = dealt.withColumn("own", own).withColumn("part", F.explode(F.when(F.col("home"), F.sequence("own", last)).otherwise(F.sequence(F.lit(0), last))))
        dealt = spread.withColumn("home", F.col("home") & (F.col("part") == F.col("own")))
    dealt = dealt.select("cell", "part", "home", "node", "n", "block", "vector")
    out = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_compare(cosine), "node long, links long, root long")
    out = written(out, "links")
    links = out.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(out.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = distinct.select("node", "n", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left")
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    result = rows.select("vec_id", "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op6_subspace_pigeonhole(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links and component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
