"""Merging of findings that several analyzers report for one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.functions.ranks import CONFIDENCES, SEVERITIES, rank
from findweave.functions.text import fingerprint
from findweave.operators.graph import components
from findweave.operators.intervals import innermost, overlap_pairs, touched


def duplicate_pairs(findings: DataFrame) -> DataFrame:
    """(a_id, b_id): same file and category, overlapping lines, not two rules of one analyzer, not in two known symbols."""
    pairs = overlap_pairs(findings, ["file_path", "category"], "id", "start_line", "end_line", keep=("source_analyzer", "rule_id", "symbol_id"))
    c = F.col
    two_rules = (c("a_source_analyzer") == c("b_source_analyzer")) & (c("a_rule_id") != c("b_rule_id"))
    apart = c("a_symbol_id").isNotNull() & c("b_symbol_id").isNotNull() & (c("a_symbol_id") != c("b_symbol_id"))
    return pairs.where(~two_rules & ~apart).select("a_id", "b_id")


def merge(findings: DataFrame) -> DataFrame:
    """Findings with ``group_id``, ``is_primary`` and ``n_sources``.

    Groups are the connected components of the duplicate pairs. The primary one is the first by
    severity, confidence (lowest rank first), analyzer and id; all members stay as provenance.
    """
    roots = components(findings, duplicate_pairs(findings)).select("id", F.col("root").alias("group_id"))
    order = F.struct(rank(F.col("severity"), SEVERITIES), rank(F.col("confidence"), CONFIDENCES), "source_analyzer", "id")
    grouped = findings.join(roots, "id")
    head = grouped.groupBy("group_id").agg(F.min_by("id", order).alias("primary_id"), F.count("*").alias("n_sources"))
    return grouped.join(head, "group_id").withColumn("is_primary", F.col("id") == F.col("primary_id")).drop("primary_id")


def enrich(findings: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings with symbol, fingerprint and the flags for changed lines and changed symbols.

    ``symbols``: path, id, name, start, end; ``changed``: path, line.
    """
    f = findings.withColumnRenamed("file_path", "path")
    placed = innermost(f, symbols.withColumnRenamed("id", "symbol_key"), ["path"], "id", "start_line", "symbol_key", "start", "end")
    placed = placed.withColumnRenamed("innermost_id", "symbol_id")
    names = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"))
    hit = touched(symbols.withColumnRenamed("id", "symbol_id").select("path", "symbol_id", "start", "end"), changed, ["path"], "symbol_id", "start", "end", "line", "in_changed").select("symbol_id", "in_changed")
    on = touched(f.select("path", F.col("id").alias("finding"), "start_line", "end_line"), changed, ["path"], "finding", "start_line", "end_line", "line", "on_changed").select(F.col("finding").alias("id"), "on_changed")
    out = placed.join(names, "symbol_id", "left").join(hit, "symbol_id", "left").join(on, "id", "left")
    anchor = F.coalesce("symbol_name", F.concat(F.lit("line:"), F.col("start_line").cast("string")))
    return out.select("*", F.coalesce("on_changed", F.lit(False)).alias("is_on_changed_line"), F.coalesce("in_changed", F.lit(False)).alias("is_in_changed_symbol"), fingerprint(F.col("source_analyzer"), F.col("rule_id"), F.col("path"), anchor).alias("fingerprint")).drop("on_changed", "in_changed").withColumnRenamed("path", "file_path")
