"""Running values over sorted rows of any key size.

A window needs all rows of a key in one task. Here rows are dealt out by ranges of key and order,
so that one key may fill many partitions; each partition is scanned by itself, and what its last
key leaves behind is carried over to the next partitions through a table of one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.session import materialize

KEY, PART, NUMBER = "scan_key", "scan_part", "scan_n"


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` in one global order by key and ``order``, with scan_key, scan_part and scan_n.

    ``order`` must be total within a key for the numbers to be the same in every run. Null keys are one key.
    """
    packed = rows.withColumn(KEY, F.struct(*keys))
    ordered = packed.orderBy(KEY, *order).withColumns({PART: F.spark_partition_id(), NUMBER: F.monotonically_increasing_id()})
    return materialize(ordered, "scan")


def _carried(rows: DataFrame, value: Column) -> DataFrame:
    """(scan_part, carry_key, carry): the last value that the partitions before have for the key a partition begins with."""
    groups = rows.groupBy(PART, KEY).agg(F.min(NUMBER).alias("low"), F.max(NUMBER).alias("high"), F.max_by(value, F.when(value.isNotNull(), F.col(NUMBER))).alias("left"))
    # one row per partition from here on
    parts = groups.groupBy(PART).agg(F.min_by(KEY, "low").alias("first"), F.max_by(F.struct(F.col(KEY).alias("key"), "left"), "high").alias("last"))
    by = Window.orderBy(PART)
    before = F.lag("last").over(by)
    goes_on = before.isNotNull() & F.col("first").eqNullSafe(before["key"])
    parts = parts.withColumns({"goes_on": goes_on, "before": before})
    # a run of partitions that hold one key only, after the one in which it begins
    run = F.sum((~(F.col("goes_on") & F.col("first").eqNullSafe(F.col("last.key")))).cast("int")).over(by)
    parts = parts.withColumn("run", run)
    kept = F.last("last.left", ignorenulls=True).over(Window.partitionBy("run").orderBy(PART))
    parts = parts.withColumn("kept", kept)
    return parts.withColumn("carry", F.when(F.col("goes_on"), F.lag("kept").over(by))).select(PART, F.col("first").alias("carry_key"), "carry").where("carry IS NOT NULL")


def last_before(rows: DataFrame, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """``rows`` (from ``numbered``) with ``name``: the last non-null ``value`` of the rows of the key before (or at) each."""
    frame = Window.partitionBy(PART, KEY).orderBy(NUMBER).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    held = rows.withColumn("scan_value", value)
    inside = held.withColumn(name, F.last("scan_value", ignorenulls=True).over(frame))
    carried = _carried(held, F.col("scan_value"))
    met = inside.join(carried, PART, "left")
    return met.withColumn(name, F.coalesce(name, F.when(F.col(KEY).eqNullSafe(F.col("carry_key")), F.col("carry")))).drop("scan_value", "carry_key", "carry")


def running_sum(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` (with the columns of ``numbered``) with ``name``: the sum of ``value`` over the rows of the key up to each."""
    frame = Window.partitionBy(PART, KEY).orderBy(NUMBER).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("scan_value", value)
    sums = held.groupBy(PART, KEY).agg(F.sum("scan_value").alias("scan_sum"))
    # one row per key and partition
    before = F.sum("scan_sum").over(Window.partitionBy(KEY).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select(PART, F.col(KEY).alias("carry_key"), F.coalesce(before, F.lit(0)).alias("carry"))
    met = held.withColumn(name, F.coalesce(F.sum("scan_value").over(frame), F.lit(0))).alias("a").join(carried.alias("b"), (F.col(f"a.{PART}") == F.col(f"b.{PART}")) & F.col(KEY).eqNullSafe(F.col("carry_key")))
    return met.select("a.*", "carry").withColumn(name, F.col(name) + F.col("carry")).drop("scan_value", "carry")


def reached(nodes: DataFrame, node: str, following: str, first: str) -> DataFrame:
    """(node): the nodes that ``first`` ones reach by following pointers, themselves included.

    ``following`` is null at a chain's end. Pointers double in every round, so the rounds grow with
    the logarithm of the longest chain. Finished nodes leave the table, and nodes that nothing points
    at never enter it.
    """
    state = nodes.select(F.col(node).alias("at"), F.col(following).alias("jump"), F.col(first).alias("kept"))
    aimed = state.where("jump IS NOT NULL").select(F.col("jump").alias("at")).distinct()
    state = materialize(state.join(aimed.withColumn("aimed", F.lit(True)), "at", "left").where("kept OR aimed").drop("aimed"), "chain")
    done = []
    while True:
        over = F.col("kept") & F.col("jump").isNull()
        done.append(state.where(over).select("at"))
        open_ = state.where(~over)
        if open_.where("kept").isEmpty():
            break
        hit = open_.where("kept").select(F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        ahead = state.select(F.col("at").alias("jump"), F.col("jump").alias("far"))
        moved = open_.join(ahead, "jump", "left").select("at", F.col("far").alias("jump"), "kept").join(hit, "at", "left")
        state = materialize(moved.select("at", "jump", (F.col("kept") | F.coalesce("hit", F.lit(False))).alias("kept")), "chain")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("at", node)
