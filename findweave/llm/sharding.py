"""Sharding by extendible hashing.

A directory indexed by the leading bits of a key's hash; only buckets over the byte limit split
on another bit, until every shard fits or holds a single row. Bytes and rows are summed once per
directory cell (a few bits deeper than the data needs on average) and the tree of splits is read
off those sums, so the texts are read for their length alone and only narrow rows are shuffled.
DataFrame functions only.

Defined results: a null text has 0 bytes; a null key counts as the empty one; equal keys share all
bits, so a key heavier than the limit is split further by bits of the hash of a number that each of
its rows gets once, in a written table; a single row over the limit, however long, is alone in a
shard with ``fits`` false; repeated rows are placed each; an empty table has no shards; other
columns never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.session import materialize

#: Bits of a key's hash: 15 hexadecimal digits of its MD5.
KEY_BITS = 60
#: Bits by which a directory cell is finer than an average shard.
SLACK_BITS = 4
#: Bytes of text in a shard at most: a Parquet file of a training set.
SHARD_BYTES = 16 * 1024 * 1024
#: The limit of the query: a read block, small enough that tables of every size are split many times.
BLOCK_BYTES = 128 * 1024


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(KEY_BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, limit: int, depth: int) -> DataFrame:
    """(group, cell, depth, prefix, bytes, n) - the leaf of each cell of ``depth`` bits.

    ``cells``: group, cell, bytes, n. A leaf is the shallowest bucket that fits or holds one row;
    a cell that does neither is its own.
    """
    each = cells.select("group", "cell", "bytes", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    at = lambda d: F.call_function("shiftright", F.col("cell"), (F.lit(depth) - d).cast("int"))
    sums = each.groupBy("group", "d", at(F.col("d")).alias("prefix")).agg(F.sum("bytes").alias("sum_bytes"), F.sum("n").alias("sum_n"))
    leaf = sums.where((F.col("sum_bytes") <= limit) | (F.col("sum_n") == 1) | (F.col("d") == depth))
    met = each.select("group", "cell", "d", at(F.col("d")).alias("prefix")).join(leaf, ["group", "d", "prefix"])
    found = met.groupBy("group", "cell").agg(F.min_by(F.struct("d", "prefix", "sum_bytes", "sum_n"), "d").alias("leaf"))
    return found.select("group", "cell", F.col("leaf.d").alias("depth"), F.col("leaf.prefix").alias("prefix"), F.col("leaf.sum_bytes").alias("bytes"), F.col("leaf.sum_n").alias("n"))


def _depth_for(sizes: DataFrame, limit: int) -> int:
    """Bits that the heaviest group needs if its hashes are spread evenly, and a few more."""
    total = sizes.groupBy("group").agg(F.sum("n_bytes").alias("n")).agg(F.max("n")).first()[0] or 0
    return min(KEY_BITS, max(0, (total // max(1, limit)).bit_length()) + SLACK_BITS)


def _placed(docs: DataFrame, key: str, text_col: str, limit: int, carried: Column) -> DataFrame:
    """carried, n_bytes, shard, shard_bytes of each row.

    The first pass goes as deep as an even spread of keys needs. Buckets that are still too
    large there go on through all bits of the key; equal keys that are, through bits of their
    rows' numbers, which are written before they are used.
    """
    rows = docs.select(
        carried.alias("carried"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        key_hash(F.col(key)).alias("h"), F.lit("").alias("group"),
    )
    done, deepest = [], (False, True, False, True)
    for number, deep in enumerate(deepest):
        if number == 2:
            rows = materialize(rows.withColumn("h", key_hash(F.monotonically_increasing_id())), "heavy")
        depth = KEY_BITS if deep else _depth_for(rows, limit)
        cell = _prefix(F.col("h"), depth)
        cells = rows.groupBy("group", cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        leaves = _leaves(cells, limit, depth)
        bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0")))
        placed = rows.withColumn("cell", cell).join(leaves.withColumnRenamed("bytes", "shard_bytes"), ["group", "cell"]).withColumn("shard", F.concat("group", bits))
        heavy = (F.col("shard_bytes") > limit) & (F.col("n") > 1)
        if number == len(deepest) - 1 or leaves.where((F.col("bytes") > limit) & (F.col("n") > 1)).isEmpty():
            done.append(placed)
            break
        done.append(placed.where(~heavy))
        # all bits of equal keys are used up after the second pass
        group = F.concat(F.col("shard"), F.lit("-")) if number == 1 else F.col("group")
        rows = placed.where(heavy).select("carried", "n_bytes", "h", group.alias("group"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("carried", "n_bytes", "shard", "shard_bytes")


def assign_shards(docs: DataFrame, key: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES, id_col: str = "doc_id") -> DataFrame:
    """Shard of each row: doc_id, n_bytes, shard (its bits; "" is the whole table), depth, shard_bytes, fits."""
    out = _placed(docs, key, text_col, limit, F.col(id_col)).withColumnRenamed("carried", "doc_id")
    return out.select("doc_id", "n_bytes", "shard", F.length(F.regexp_replace("shard", "-", "")).alias("depth"), "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> str:
    """Write ``docs`` as one Parquet folder per shard, each row once; equal keys may fill several shards.

    Returns the name of the folders' column: ``shard``, with underscores after it where ``docs``
    has such a column.
    """
    taken, name = {c.lower() for c in docs.columns}, "shard"
    while name in taken:
        name += "_"
    placed = _placed(docs, key, text_col, limit, F.struct("*")).select("carried.*", F.col("shard").alias(name))
    placed.repartition(name).write.partitionBy(name).parquet(path)
    return name


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit=BLOCK_BYTES)


#: Keys are unique in the table, so no key is heavier than a single row.
ORACLE = f"""
WITH s AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT s.*, d, h >> ({KEY_BITS} - d) AS prefix FROM s, (SELECT unnest(range(0, {KEY_BITS + 1}))::INT AS d) AS x),
b AS (SELECT d, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT doc_id, n_bytes, h, min(d) AS depth FROM t JOIN b USING (d, prefix) WHERE shard_bytes <= {BLOCK_BYTES} OR n = 1 GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h >> ({KEY_BITS} - depth)), {KEY_BITS}, '0'), depth) END AS shard, depth, b.shard_bytes,
    b.shard_bytes <= {BLOCK_BYTES} AS fits
FROM f JOIN b ON b.d = depth AND b.prefix = h >> ({KEY_BITS} - depth)
"""
