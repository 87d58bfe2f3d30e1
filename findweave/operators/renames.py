"""Where files went over a chain of commits: renames and deletions composed, and symbol continuity on the new paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.operators import snapshots
from findweave.session import materialize


def _departures(changes: DataFrame) -> DataFrame:
    """(source, seq, target): a file leaves ``source`` in commit ``seq``, for ``target`` or, deleted, for null.

    A path that one commit both renames and deletes was renamed; of several targets the smallest counts.
    """
    gone = F.col("change") == "D"
    left = changes.where(gone | ((F.col("change") == "R") & F.col("previous_path").isNotNull()))
    return left.groupBy(F.when(gone, F.col("path")).otherwise(F.col("previous_path")).alias("source"), "seq").agg(F.min(F.when(~gone, F.col("path"))).alias("target"))


def effective_paths(changes: DataFrame) -> DataFrame:
    """(path, effective_path, deleted) of each path that a file left: where it is after the last commit.

    ``changes``: seq (the commit's place in the chain), change (A, M, D, R), path, previous_path. A
    file leaves a path once; what is later created there is another file. Files may swap names in
    one commit: a departure is followed by the first one of a later commit from its target.
    Departures point at the next, and pointers are doubled until each has its last.
    """
    left = _departures(changes)
    came = left.where("target IS NOT NULL").select(F.col("target").alias("at"), "seq", F.lit(None).cast("long").alias("leaves"), "source")
    both = came.unionByName(left.select(F.col("source").alias("at"), "seq", F.col("seq").cast("long").alias("leaves"), F.lit(None).cast("string").alias("source")))
    later = Window.partitionBy("at").orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    nexts = both.withColumn("next_seq", F.min("leaves").over(later)).where("source IS NOT NULL").select("source", "seq", "next_seq")
    hops = left.join(nexts, ["source", "seq"], "left").withColumn("next", F.when(F.col("next_seq").isNotNull(), F.col("target"))).select("source", "seq", "target", "next", "next_seq")
    hops = materialize(hops, "hops")
    while not hops.where("next IS NOT NULL").isEmpty():
        ahead = hops.select(F.col("source").alias("next"), F.col("seq").cast("long").alias("next_seq"), F.col("target").alias("t"), F.col("next").alias("n"), F.col("next_seq").alias("ns"), F.lit(True).alias("met"))
        joined = hops.join(ahead, ["next", "next_seq"], "left")
        hops = materialize(joined.select("source", "seq", F.when(F.col("met"), F.col("t")).otherwise(F.col("target")).alias("target"), F.col("n").alias("next"), F.col("ns").alias("next_seq")), "hops")
    first = hops.groupBy("source").agg(F.min_by(F.struct("target"), "seq").alias("last"))
    return first.select(F.col("source").alias("path"), F.col("last.target").alias("effective_path"), F.col("last.target").isNull().alias("deleted"))


def continuity_over(previous: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """(prev_id, cur_id, status, reason): ``snapshots.continuity`` on the paths that files have after the changes.

    Symbols of deleted files are deleted, whatever stands at their path now; reason tells these apart.
    """
    moved = previous.join(effective_paths(changes), "path", "left")
    gone = moved.where("deleted").select(F.col("id").alias("prev_id"), F.lit(None).cast(current.schema["id"].dataType).alias("cur_id"), F.lit("deleted").alias("status"), F.lit("file_deleted").alias("reason"))
    there = moved.where("deleted IS NULL OR NOT deleted").withColumn("path", F.coalesce("effective_path", "path")).select(previous.columns)
    return snapshots.continuity(there, current).withColumn("reason", F.concat(F.lit("symbol_"), F.col("status"))).unionByName(gone)
