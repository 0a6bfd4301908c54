"""Prefix trie of conversations by truncation peeling.

A conversation is a path of turn keys; the key of depth d stands for its first
d turns. From the greatest depth down, conversations that end there merge with
the nodes that survived from below, the last turn is stripped, and what is left
is grouped again; the sums of a subtree travel along, so a node is complete
once its depth is done.

Depths down to a shallow border are peeled by Spark, one grouping a depth, which
combines before it shuffles: a turn that very many conversations share costs no
task more. Below the border the paths that share a prefix of that length are
sorted and peeled in one streaming pass with a stack as deep as the longest of
them. The border is ``BORDER`` turns, and doubles for prefixes that more than
``STREAM`` different conversations share, so that no task streams a hot prefix.

Cases: turns with the same number are ordered by role, then text; null turns
come first; a null role or text is empty; rows that repeat are turns of their
own. Rows whose conversation id is null belong to no conversation and are left
out. Texts of any length are read whole, and only their digests move. An empty
table has no conversation and gives no node. Other columns are not read. One
conversation's turns are read in order by one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asmlens.llm._spark import dropped, written

WIDE = 16  # bytes of a key
BORDER = 8
STREAM = 1 << 18
LINE = 4096  # ids in one piece of a list that is digested


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, at, turn_key, n_bytes): turns counted from 0, a digest of role and text, and the text's UTF-8 bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDE))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), at.cast("long").alias("at"), key.alias("turn_key"), F.octet_length("text").cast("long").alias("n_bytes"))


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (conv_id, depth, path, sizes) for each id: ``path`` joins the keys of its prefixes, ``sizes`` the bytes of each turn's text.

    ``turns`` as from ``numbered_turns``; ids without turns have an empty path.
    """
    schema = "conv_id long, depth long, path binary, sizes array<long>"
    names = ["conv_id", "depth", "path", "sizes"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        path, sizes, key = [], [], b""

        def close(done: list) -> None:
            if started:
                done.append((now, len(path), b"".join(path), sizes))

        def batch_of(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=names)

        for batch in batches:
            done: list[tuple] = []
            for conv, turn, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not started or conv != now:
                    close(done)
                    now, started, path, sizes, key = conv, True, [], [], b""
                if turn is not None:
                    key = hashlib.sha256(key + turn).digest()[:WIDE]
                    path.append(key)
                    sizes.append(size)
            if done:
                yield batch_of(done)
        last: list[tuple] = []
        close(last)
        if last:
            yield batch_of(last)

    none = ids.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("n_bytes"))
    rows = turns.select("conv_id", "at", "turn_key", "n_bytes").unionByName(none).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return rows.select("conv_id", "turn_key", "n_bytes").mapInArrow(fold, schema)


def _prefix(depth: Column | int) -> Column:
    """The key of the first ``depth`` turns; empty for none."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth > 0, F.col("path").substr((depth.cast("int") - 1) * WIDE + 1, F.lit(WIDE))).otherwise(F.lit(b""))


NODE = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]
_NODE_KINDS = (pa.binary(), pa.binary(), *(pa.int64(),) * 6)


def _deep_nodes(sequences: DataFrame) -> DataFrame:
    """Rows of ``NODE`` for the depths beyond each row's ``border``, and one of depth ``border`` (n_convs of it counts deeper ends only) with null ``parent``."""

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # open nodes: key, smallest conversation, conversations, children, leaves, saved bytes, bytes of the last text
        bottom = 0  # depth of the lowest node in the stack
        out: list[tuple] = []

        def strip() -> None:
            """Close the deepest node; its parent survives with its sums."""
            key, conv, n, children, leaves, saved, size = stack.pop()
            depth = bottom + len(stack)
            if not stack:
                out.append((key, None, depth, conv, n, children, leaves, saved))
                return
            saved += (n - 1) * size
            up = stack[-1]
            out.append((key, up[0], depth, conv, n, children, max(leaves, 1), saved))
            up[1], up[2], up[3], up[4], up[5] = min(up[1], conv), up[2] + n, up[3] + 1, up[4] + max(leaves, 1), up[5] + saved

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NODE_KINDS)], names=_NODE_NAMES)
            out.clear()
            return batch

        for batch in batches:
            for border, path, sizes, conv, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                depth = len(path) // WIDE
                keys = [path[WIDE * k : WIDE * (k + 1)] for k in range(border - 1, depth)]
                if stack and stack[0][0] != keys[0]:
                    while stack:
                        strip()
                if stack:
                    same = 1
                    while same < min(len(stack), len(keys)) and stack[same][0] == keys[same]:
                        same += 1
                    while len(stack) > same:
                        strip()
                else:
                    same, bottom = 0, border
                stack.extend([key, conv, 0, 0, 0, 0, sizes[border - 1 + same + k]] for k, key in enumerate(keys[same:]))
                end = stack[-1]
                end[1], end[2] = min(end[1], conv), end[2] + n
                if len(out) >= LINE:
                    yield flush()
        while stack:
            strip()
        if out:
            yield flush()

    rows = sequences.withColumn("border_key", _prefix(F.col("border"))).repartition("border_key").sortWithinPartitions("border_key", "path")
    return rows.select("border", "path", "sizes", "conv_id", "n").mapInArrow(peel, NODE)


def _with_borders(sequences: DataFrame, border: int, stream: int) -> DataFrame:
    """``sequences`` with ``border``: the depth from which on a row is peeled as a stream."""
    rows = sequences.withColumn("border", F.lit(border))
    while True:
        reached = F.col("border") == border
        full = rows.where(reached & (F.col("depth") > border)).groupBy(_prefix(border).alias("hot")).count().where(F.col("count") > stream).select("hot")
        if full.isEmpty():
            return rows
        rows = rows.join(full, reached & (_prefix(border) == F.col("hot")), "left")
        rows = rows.withColumn("border", F.when(F.col("hot").isNotNull(), 2 * border).otherwise(F.col("border"))).drop("hot")
        border *= 2


def _end_digests(ends: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256) from (key, conv_id): ids in ascending order, joined by commas.

    Ranges of keys and ids, which split the list of a hot node, write pieces of lists; only the pieces of a node meet in one task, as a stream.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "line"])
        for batch in batches:
            done = []
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == LINE):
                    done.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(conv)
            if done:
                yield make(done)
        if ids:
            yield make([(key, ids[0], ",".join(map(str, ids)))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
        for batch in batches:
            done = []
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sha is None or k != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(line.encode())
                else:
                    sha.update(b"," + line.encode())
            if done:
                yield make(done)
        if sha is not None:
            yield make([(key, sha.hexdigest())])

    listed = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id").mapInArrow(pieces, "key binary, first long, line string")
    return listed.repartition("key").sortWithinPartitions("key", "first").select("key", "line").mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, border: int = BORDER, stream: int = STREAM) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` as from ``numbered_turns``, ``ids`` every conversation's id once, those without turns too.
    """
    convs = written(paths(turns, ids), "paths")
    alike = convs.groupBy("depth", _prefix(F.col("depth")).alias("key")).agg(F.min_by("path", "conv_id").alias("path"), F.min_by("sizes", "conv_id").alias("sizes"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    sequences = written(_with_borders(alike.drop("key"), border, stream), "sequences")
    deep = written(_deep_nodes(sequences.where("depth > border")), "deep")

    zero = F.lit(0).cast("long")
    ended = sequences.where("depth <= border").select("path", "sizes", "depth", "conv_id", F.col("n").alias("n_convs"), *(zero.alias(c) for c in ("children", "leaves", "saved")))
    # the survivors of the streams carry the path of a conversation they hold
    held = sequences.where("depth > border").groupBy(_prefix(F.col("border")).alias("key")).agg(F.min_by(F.struct(F.col("path").substr(F.lit(1), F.col("border") * WIDE).alias("path"), F.expr("slice(sizes, 1, border)").alias("sizes")), "conv_id").alias("held"))
    risen = deep.where("parent is null").join(held, "key").select("held.path", "held.sizes", "depth", "conv_id", "n_convs", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    deepest = max((r.border for r in sequences.select("border").distinct().collect()), default=0)  # a few powers of two

    tables, below = [], None
    nodes = deep.where("parent is not null")
    for depth in range(deepest, -1, -1):
        here = ended.unionByName(risen).where(F.col("depth") == depth)
        here = here if below is None else here.unionByName(below)
        size = F.coalesce(F.try_element_at("sizes", F.lit(max(depth, 1))), zero) if depth else zero
        sums = here.groupBy(_prefix(depth).alias("key")).agg(
            F.min_by(F.struct("path", "sizes"), "conv_id").alias("held"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "children", "leaves", "saved"))
        )
        done = sums.select("key", "held.path", "held.sizes", F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs", "children", "leaves", "saved")
        done = done.withColumn("leaves", F.greatest("leaves", F.lit(1).cast("long"))).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * size)
        done = written(done.withColumn("parent", _prefix(depth - 1) if depth else F.lit(None).cast("binary")), f"depth-{depth}")
        tables.append(done)
        nodes = nodes.unionByName(done.select("key", "parent", "depth", "conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
        if depth:  # strip the last turn
            below = done.select(F.col("path").substr(F.lit(1), F.lit((depth - 1) * WIDE)).alias("path"), F.expr(f"slice(sizes, 1, {depth - 1})").alias("sizes"), (F.col("depth") - 1).alias("depth"), "conv_id", "n_convs", F.lit(1).cast("long").alias("children"), "leaves", "saved")

    digests = _end_digests(convs.select(_prefix(F.col("depth")).alias("key"), "conv_id"))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "parent", "left").join(digests, "key", "left")
    result = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    result = written(result, "trie")
    dropped(convs, sequences, deep, *tables)
    return result


GROUP, MOST = 5, 9  # conversations of a group share their first one's head, of fewer than MOST turns


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids after a change of heads: conversation c takes its first h turns from c - c % 5, its own from there on; h = crc32(c) % 9."""
    turns = written(numbered_turns(conversations), "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    ids = turns.select("conv_id").distinct().withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    own = turns.where(F.col("at") >= head)
    lent = turns.where(F.col("at") < MOST).withColumnRenamed("conv_id", "base").join(ids, "base").where("at < h")
    return own.unionByName(lent.select(*own.columns)), ids.select("conv_id")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations with changed heads."""
    return prefix_trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


#: DuckDB SQL for the query's rows; the list of two lambdas is CRC-32 bit by bit.
ORACLE = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
    strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS head FROM (SELECT DISTINCT conv_id FROM t)),
  rebuilt AS (SELECT t.* FROM t JOIN ids USING (conv_id) WHERE place >= head UNION ALL SELECT i.conv_id, t.place, t.h, t.n_bytes FROM ids i JOIN t ON t.conv_id = i.base WHERE t.place < i.head),
  numbered AS (SELECT *, row_number() OVER w AS depth, sum(n_bytes) OVER w AS upto, string_agg(h, '' ORDER BY place) OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
  keyed AS (SELECT conv_id, depth, n_bytes, sha256(path) AS key, coalesce(lag(sha256(path)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM numbered UNION ALL SELECT conv_id, 0, 0, '', NULL FROM ids),
  ending AS (SELECT conv_id, max(depth) AS depth, arg_max(key, depth) AS key FROM keyed GROUP BY conv_id),
  node AS (SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(n_bytes) AS n_bytes FROM keyed GROUP BY key, depth),
  kids AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
  below AS (SELECT a.key, count_if(k.key IS NULL) AS n_leaves, sum((v.n - 1) * v.n_bytes) AS saved FROM node v LEFT JOIN kids k ON k.key = v.key JOIN keyed a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.key),
  ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM ending GROUP BY key)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM node v LEFT JOIN node p ON p.key = v.parent LEFT JOIN kids k ON k.key = v.key JOIN below b ON b.key = v.key LEFT JOIN ends e ON e.key = v.key"""
