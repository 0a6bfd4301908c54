"""Sharding by extendible hashing. DataFrame and SQL functions only.

A directory over prefixes of a row's hash says which shard it goes to. Byte
sums by prefix come from one aggregate. From the top, a bucket above the limit,
and only such a bucket, is split on one more bit until it fits or holds a single
row; each round takes a few bits and the open buckets only, so no key gathers
more than the prefixes of one round. Splits deeper than the histogram look again
at the rows of open buckets.

The hash covers the id and the text, so documents with one id spread. Rows that
are equal in both cannot be parted by any hash: they share a shard, which then
may exceed the limit.

Cases: null text has no bytes; a null id is hashed like a value of its own. A
text above the limit is a shard of its own. An
empty table gives an empty table. Columns with the names of the outputs are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.llm._spark import dropped, fresh, written
from asmlens.llm.mixing import uniform

WIDTH, LIMIT, STEP, SMALL = 60, 1 << 20, 8, 100_000


def _hash(doc_id: str, text: str) -> F.Column:
    return uniform(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))


def _descend(rows: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """Rows (u, bytes, rows) to rows (prefix, depth, shard_bytes, shard_rows) of ``bits`` bits; depth from ``low`` on, null where still too large.

    At most ``bits - low + 1`` depths, so a bucket gathers at most 2 ** STEP prefixes.
    """
    histogram = rows.groupBy(F.shiftright("u", WIDTH - bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    steps = histogram.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(bits)))).withColumn("bucket", F.expr(f"shiftright(prefix, {bits} - depth)"))
    buckets = steps.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1) | (F.col("depth") == WIDTH)
    found = steps.select("prefix", "depth", "bucket").join(buckets, ["depth", "bucket"]).groupBy("prefix").agg(F.min(F.when(fits, F.struct("depth", "shard_bytes", "shard_rows"))).alias("s"))
    return found.select("prefix", "s.depth", "s.shard_bytes", "s.shard_rows")


def directory(sized: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """``sized``: rows (u, bytes). A list of bits and rows (prefix, depth, shard_bytes, shard_rows) of that many bits.

    From the top, ``STEP`` bits a round, and only below buckets that are still too large. A histogram as fine as
    a usual shard stands for the rows down to its own bits; below it, rows of open buckets are looked at.
    """
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    fine = min(WIDTH, max(4, math.ceil(math.log2(max(total / limit, 1))) + 3))
    prefix = F.shiftright("u", WIDTH - fine)
    histogram = written(sized.groupBy(F.shiftleft(prefix, WIDTH - fine).alias("u")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "histogram")
    rows, low, bits, rounds = histogram, 0, min(STEP, fine), []
    while True:
        found = written(_descend(rows, low, bits, limit), "directory")
        rounds.append((bits, found))
        open_ = found.where("depth is null").select("prefix")
        if bits == WIDTH or open_.isEmpty():
            break
        below = sized.groupBy("u").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")) if bits == fine else rows
        rows = below.withColumn("prefix", F.shiftright("u", WIDTH - bits)).join(open_, "prefix", "left_semi").drop("prefix")
        low, bits = bits + 1, min(WIDTH if bits >= fine else fine, bits + STEP)
    # the rounds within the histogram become one table of its prefixes
    upper = []
    for bits, found in (r for r in rounds if r[0] <= fine):
        placed = histogram.select(prefix.alias("fine"), F.shiftright("u", WIDTH - bits).alias("prefix"))
        upper.append(placed.join(found.where("depth is not null"), "prefix").select(F.col("fine").alias("prefix"), "depth", "shard_bytes", "shard_rows"))
    one = upper[0]
    for more in upper[1:]:
        one = one.unionByName(more)
    whole = written(one, "directory")
    dropped(histogram, *(found for bits, found in rounds if bits <= fine))
    return [(fine, whole), *((bits, found.where("depth is not null")) for bits, found in rounds if bits > fine)]


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, into: str = "shard") -> DataFrame:
    """``docs`` with a struct column: name (the prefix bits), depth, bytes (the row's), shard_bytes, shard_rows."""
    docs = docs.drop(into) if into.lower() in [c.lower() for c in docs.columns] else docs
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    sized = written(docs.select(_hash(doc_id, text).alias("u"), size.alias("bytes")), "sizes")
    u, found = fresh(docs, "u"), fresh(docs, "found")
    out = docs.withColumns({u: _hash(doc_id, text), found: F.lit(None).cast("struct<depth:int,shard_bytes:bigint,shard_rows:bigint>")})
    for bits, table in directory(sized, limit):
        key = fresh(out, "prefix")
        table = table.select(F.col("prefix").alias(key), F.struct(F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows").alias("hit"))
        if table.count() <= SMALL:
            table = F.broadcast(table)
        out = out.join(table, F.shiftright(F.col(u), WIDTH - bits) == F.col(key), "left")
        out = out.withColumn(found, F.coalesce(found, "hit")).drop(key, "hit")
    name = F.when(F.col(found)["depth"] > 0, F.lpad(F.conv(F.expr(f"shiftright({u}, {WIDTH} - {found}.depth)").cast("string"), 10, 2), F.col(found)["depth"], F.lit("0"))).otherwise("")
    made = F.struct(name.alias("name"), F.col(found)["depth"].alias("depth"), size.alias("bytes"), F.col(found)["shard_bytes"].alias("shard_bytes"), F.col(found)["shard_rows"].alias("shard_rows"))
    return out.select(*(out[c] for c in docs.columns), made.alias(into))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """``docs`` as Parquet folders, one a shard."""
    placed = shard(docs, **options)
    into = options.get("into", "shard")
    placed.withColumn(into, F.concat(F.lit("b"), F.col(into)["name"])).repartition(into).write.partitionBy(into).parquet(path)


def op10_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = F.col("shard")
    return shard(docs).select("doc_id", s["name"].alias("shard"), s["depth"].alias("depth"), s["bytes"].alias("n_bytes"), s["shard_bytes"].alias("shard_bytes"), s["shard_rows"].alias("shard_rows"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS u
  FROM documents),
levels AS (SELECT d.*, unnest(range(0, 41)) AS depth FROM d),
placed AS (SELECT *, u >> ({WIDTH} - depth)::INT AS bucket FROM levels),
sums AS (SELECT depth, bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM placed GROUP BY ALL),
fits AS (
  SELECT p.doc_id, p.n_bytes, p.u, p.depth, s.shard_bytes, s.shard_rows,
    row_number() OVER (PARTITION BY p.doc_id, p.u, p.n_bytes ORDER BY p.depth) AS k
  FROM placed p JOIN sums s USING (depth, bucket)
  WHERE s.shard_bytes <= {LIMIT} OR s.shard_rows <= 1)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(u >> ({WIDTH} - depth)::INT), depth::INT, '0') END AS shard,
  depth::INT AS depth, n_bytes, shard_bytes, shard_rows
FROM fits WHERE k = 1
"""
