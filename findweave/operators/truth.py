"""Matching of predictions to labelled expectations, and what follows from the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.functions.ranks import SEVERITIES, rank, rate
from findweave.functions.text import normalized
from findweave.operators import metrics


def line_window(line: Column, line_end: Column, tolerance: Column) -> tuple[Column, Column]:
    """First and last line at which an expectation may be found; null where it names no line."""
    return line - tolerance, F.coalesce(line_end, line) + tolerance


def same_symbol(expected: Column, found: Column) -> Column:
    """Is the expected symbol the found one, or its last part or parts? None expected fits all, none found only that."""
    tail = found.endswith(F.concat(F.lit("."), expected)) | found.endswith(F.concat(F.lit("::"), expected))
    return expected.isNull() | F.coalesce((found == expected) | tail, F.lit(False))


def truth_matches(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case_id, exp_ord, pred_idx) of predictions that an expectation allows.

    ``expected``: case_id, exp_ord, file, category, symbol, line, line_end, line_tolerance, evidence;
    ``predicted``: case_id, pred_idx, file, category, symbol, start, end, evidence_text, message. File
    and category are equal; what an expectation leaves null allows everything.
    """
    low, high = line_window(F.col("line"), F.col("line_end"), F.col("line_tolerance"))
    e = expected.select("case_id", "file", "category", "exp_ord", F.col("symbol").alias("exp_symbol"), low.alias("low"), high.alias("high"), "evidence")
    j = e.join(predicted, ["case_id", "file", "category"])
    near = F.col("low").isNull() | ((F.col("end") >= F.col("low")) & (F.col("start") <= F.col("high")))
    told = normalized(F.concat_ws(" ", F.coalesce("evidence_text", F.lit("")), F.coalesce("message", F.lit(""))))
    quoted = F.col("evidence").isNull() | F.contains(told, normalized(F.col("evidence")))
    return j.where(near & same_symbol(F.col("exp_symbol"), F.col("symbol")) & quoted).select("case_id", "exp_ord", "pred_idx")


def overall_rates(cases: DataFrame) -> DataFrame:
    """Rates over all cases without an error.

    ``cases``: is_error, false_positive, duplicate, unsupported, predictions, candidates.
    """
    of = lambda c: F.sum(F.when(~F.col("is_error"), F.col(c)).otherwise(0))
    valid = F.count_if(~F.col("is_error"))
    return cases.agg(
        valid.alias("cases"), F.count_if("is_error").alias("error_cases"), rate(of("false_positive"), valid, 0.0).alias("fp_per_case"),
        (rate(of("false_positive"), of("candidates"), 0.0) * 100).alias("fp_per_100_candidates"),
        rate(of("duplicate"), of("predictions"), 0.0).alias("duplicate_rate"), rate(of("unsupported"), of("predictions"), 0.0).alias("unsupported_rate"),
    )


def by_group(outcomes: DataFrame, missed: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Support, precision, recall and f1 of each group that has cases, and its place in ``order``."""
    scored = metrics.scores(metrics.confusion(outcomes, missed, [key]))
    return scored.withColumn("support", F.col("true_positive") + F.col("missed")).withColumn("place", rank(F.col(key), order)).select(key, "place", "support", "precision", "recall", "f1")


def severity_counts(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """(severity, n) for every severity, 0 included, the highest first by ``place``."""
    spark = findings.sparkSession
    scale = spark.createDataFrame([(s, len(SEVERITIES) - 1 - k) for k, s in enumerate(SEVERITIES)], "severity string, place int")
    counts = findings.groupBy(F.col(severity).alias("severity")).agg(F.count("*").alias("n"))
    return scale.join(counts, "severity", "left").select("severity", "place", F.coalesce("n", F.lit(0)).alias("n"))


def presented(findings: DataFrame, group: list[str]) -> DataFrame:
    """``findings`` with their place in the summary: by path, line, falling severity, fingerprint."""
    order = Window.partitionBy(*group).orderBy("path", "line", F.desc(rank(F.col("severity"), SEVERITIES)), "fingerprint")
    return findings.withColumn("place", F.row_number().over(order))


def in_order_of_use(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """(keys, names): the distinct names of each key in the order in which they first occur."""
    first = rows.groupBy(*keys, name).agg(F.min(order).alias("first"))
    listed = F.sort_array(F.collect_list(F.struct("first", F.col(name).alias("name"))))
    return first.groupBy(*keys).agg(listed.alias("l")).select(*keys, F.col("l.name").alias("names"))


def events_ingested(summaries: DataFrame, counters: list[str]) -> DataFrame:
    """The sum of all event counters of the summaries."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counters), F.lit(0).cast("long"))
    return summaries.agg(F.coalesce(F.sum(total), F.lit(0)).alias("events_ingested"))
