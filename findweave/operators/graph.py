"""Graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.operators.ranking import capped
from findweave.session import drop_materialized, materialize, materialized


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a_id", b: str = "b_id") -> DataFrame:
    """(node, root): the smallest id of each node's component.

    Labels spread along edges and then jump to their label's label, so the number of rounds grows
    with the logarithm of a component's diameter; rounds go on until no label changes. Each round is
    written to the shared folder, and the one before it dropped; at the end the edges are, too.
    """
    spark, first = edges.sparkSession, materialized(edges.sparkSession)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(both.union(both.select("v", "u")).distinct(), "edges")
    touched = both.select(F.col("u").alias(node)).distinct()
    labels = touched.withColumn("root", F.col(node))
    changed = True
    while changed:
        low = both.join(labels.select(F.col(node).alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("low"))
        near = labels.join(low.withColumnRenamed("u", node), node, "left").select(node, F.least("root", F.coalesce("low", "root")).alias("next"), F.col("root").alias("old"))
        jump = near.select(F.col(node).alias("next"), F.col("next").alias("far"))
        after = near.join(jump, "next", "left").select(node, F.coalesce("far", "next").alias("root"), "old")
        after = materialize(after, "labels")
        drop_materialized(spark, first + 1, keep=1)
        changed = not after.where("root <> old").isEmpty()
        labels = after.select(node, "root")
    drop_materialized(spark, first, keep=1)
    return nodes.select(node).join(labels, node, "left").select(node, F.coalesce("root", node).alias("root"))


def neighbours_within_two(edges: DataFrame, src: str, dst: str, roots: int) -> DataFrame:
    """(source, target, distance): direct targets, and targets of the first ``roots`` of them.

    Direct targets are left out of the second ring; the source itself is not.
    """
    one = edges.select(F.col(src).alias("source"), F.col(dst).alias("target")).distinct()
    first = capped(one, ["source"], [F.col("target")], roots)
    two = first.select("source", F.col("target").alias("via")).join(one.select(F.col("source").alias("via"), "target"), "via").select("source", "target").distinct().join(one, ["source", "target"], "left_anti")
    return one.withColumn("distance", F.lit(1)).unionByName(two.withColumn("distance", F.lit(2)))


def code_edges(contains: DataFrame, imports: DataFrame, calls: DataFrame, tests: DataFrame) -> DataFrame:
    """One edge table of four sources; calls made at module level are left out.

    Each input has src_file, src_symbol, dst_file, dst_symbol, reason as far as it knows them.
    """
    columns: Sequence[str] = ("src_file", "src_symbol", "dst_file", "dst_symbol", "reason")

    def edge(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])

    called = calls.where("src_symbol IS NOT NULL AND dst_symbol IS NOT NULL")
    return edge(contains, "file_contains_symbol").unionByName(edge(imports, "file_imports_file")).unionByName(edge(called, "symbol_calls_symbol")).unionByName(edge(tests, "file_tests_file"))
