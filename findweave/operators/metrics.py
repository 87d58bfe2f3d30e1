"""Scoring of predictions against labelled ground truth, and comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.functions.ranks import f1, rate

OUTCOMES = ("true_positive", "false_positive", "duplicate", "unsupported", "out_of_scope")


def confusion(outcomes: DataFrame, missed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, duplicate, unsupported, out_of_scope of predictions and missed of expectations, per key."""
    counts = outcomes.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    lost = missed.groupBy(*keys).agg(F.count("*").alias("missed"))
    joined = counts.join(lost, list(keys), "full_outer") if keys else counts.crossJoin(lost)  # one row each without keys
    return joined.fillna(0)


def scores(df: DataFrame, tp: str = "true_positive", fp: str = "false_positive", missed: str = "missed") -> DataFrame:
    """precision, recall and f1; nothing predicted is precision 1, nothing expected recall 1."""
    t = F.col(tp)
    out = df.withColumn("precision", rate(t, t + F.col(fp), 1.0)).withColumn("recall", rate(t, t + F.col(missed), 1.0))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def calibration(pairs: DataFrame, expected: str, found: str) -> DataFrame:
    """Shares of exact, near, over- and understated ranks of matched pairs."""
    d = F.col(found) - F.col(expected)
    n = F.count("*")
    return pairs.agg(n.alias("n"), rate(F.count_if(d == 0), n, 1.0).alias("exact"), rate(F.count_if(F.abs(d) <= 1), n, 1.0).alias("within_one"), rate(F.count_if(d > 0), n, 0.0).alias("over"), rate(F.count_if(d < 0), n, 0.0).alias("under"))


def clean_cases(cases: DataFrame, wrong: str, case: str, order: str) -> DataFrame:
    """Pass rate, mean of wrong findings, and the first case with the most of them (null if none)."""
    worst = F.min_by(F.col(case), F.struct(-F.col(wrong), F.col(order)))
    return cases.agg(F.count("*").alias("n_cases"), rate(F.count_if(F.col(wrong) == 0), F.count("*"), 1.0).alias("pass_rate"), F.coalesce(F.avg(wrong), F.lit(0.0)).alias("mean_wrong"), F.when(F.max(wrong) > 0, worst).alias("worst_case"))


def source_overlap(rows: DataFrame, keys: Sequence[str], source: str, one: Sequence[str], two: Sequence[str]) -> DataFrame:
    """How many keys were seen by the first sources only, the second only, both or neither."""
    seen = rows.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col(source).isin(*one)), F.lit(False)).alias("a"), F.coalesce(F.bool_or(F.col(source).isin(*two)), F.lit(False)).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), F.lit("both")).when(F.col("a"), F.lit("first_only")).when(F.col("b"), F.lit("second_only")).otherwise(F.lit("missed"))
    return seen.groupBy(kind.alias("overlap")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, key: str, status: str, statuses: Sequence[str], measure: str) -> DataFrame:
    """Per key a count of each status and the sum of a measure."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses], F.count("*").alias("n_all"), F.sum(measure).alias("total"))


def worst(rows: DataFrame, measure: str, order: str, n: int = 10) -> DataFrame:
    return rows.where(F.col(measure) > 0).orderBy(F.desc(measure), order).limit(n)


def compare_runs(baseline: DataFrame, current: DataFrame, identity: Sequence[str], checks: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """(check_name, change, threshold, verdict) of two one-row metric frames.

    ``checks``: name, column over b_* and c_* that must not exceed the threshold. Where an identity
    column differs the runs can't be compared, and every verdict says so.
    """
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in baseline.columns])
    c = current.select(*[F.col(x).alias(f"c_{x}") for x in current.columns])
    same = F.lit(True)
    for name in identity:
        same = same & F.col(f"b_{name}").eqNullSafe(F.col(f"c_{name}"))
    entries = F.array(*[F.struct(F.lit(n).alias("check_name"), e.cast("double").alias("change"), F.lit(float(t)).alias("threshold")) for n, e, t in checks])
    rows = b.crossJoin(c).select(same.alias("same"), F.explode(entries).alias("e"))  # one row by one row
    return rows.select("e.*", F.when(~F.col("same"), F.lit("not comparable")).when(F.col("e.change") <= F.col("e.threshold") + 1e-12, F.lit("passed")).otherwise(F.lit("failed")).alias("verdict"))


def validation_errors(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, error) for every rule that a row breaks; a row may break several."""
    broken = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()]))
    return rows.select(key, F.explode(broken).alias("error"))


def truth_problems(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, exp_ord, error) for labelled findings that can't be right.

    ``expected``: case_id, exp_ord, id, file, symbol, category, line, line_end, line_tolerance,
    severity, max_justified_severity; ``files``: case_id, path, line_count, text. Of repeated ids and
    places the first stands.
    """
    from pyspark.sql.window import Window

    from findweave.functions.ranks import SEVERITIES, rank

    c = F.col
    again = lambda *keys: F.row_number().over(Window.partitionBy("case_id", *keys).orderBy("exp_ord")) > 1
    j = expected.withColumn("repeated_id", again("id")).withColumn("repeated_place", again("file", "symbol", "category", "line"))
    j = j.join(files.withColumnRenamed("path", "file"), ["case_id", "file"], "left")
    last = F.coalesce("line_end", "line")
    rules = {
        "repeated_id": c("repeated_id"), "repeated_place": c("repeated_place"), "missing_file": c("line_count").isNull(),
        "bad_line_range": (c("line") < 1) | (last < c("line")) | (last > c("line_count")), "negative_tolerance": c("line_tolerance") < 0,
        "unknown_symbol": ~F.contains(c("text"), F.substring_index("symbol", ".", -1)), "severity_over_maximum": rank(c("severity"), SEVERITIES) > rank(c("max_justified_severity"), SEVERITIES),
    }
    broken = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()]))
    return j.select("case_id", "exp_ord", F.explode(broken).alias("error"))
