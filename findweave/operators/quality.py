"""Measures that judge a review run as a whole: wording of findings, regressions, hallucinations, feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.functions.ranks import SEVERITIES, rank, rate
from findweave.functions.text import contains_any

#: What has to be the same in two runs before they are compared (fixed values).
IDENTITY = (
    "evaluation_benchmark_version", "evaluation_engine_version", "review_engine_version", "review_prompt_version",
    "review_policy_version", "incremental_review_engine_version", "review_memory_version", "mode",
)
#: How much worse a run may be than its baseline (fixed values).
THRESHOLDS = {"precision": 0.03, "recall": 0.10, "clean_case_pass_rate": 0.05, "unsupported_accepted_findings": 0.0, "duplicate_rate": 0.02, "unsafe_carry_forward": 0.0}


def _said(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))


def _claims(text: str, claims: str) -> Column:
    """Whether the lower-cased text holds one of the row's own claims."""
    return F.coalesce(F.exists(claims, lambda p: F.contains(F.lower(text), p)), F.lit(False))


def security_rates(pairs: DataFrame, generic: Sequence[str], absolute: Sequence[str], hedges: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rates over findings that hit their expectation, each over the pairs it applies to.

    ``pairs``: message, reasoning, fix, impact, severity, confidence of the finding, and remediation,
    impact_concept, max_severity, forbidden_claims of its expectation. A null or blank text counts as
    not said; where a rate applies to no pair it is 1 for what should be there and 0 for faults.
    """
    c = F.col
    none = F.lit(False)
    exaggerated = _claims("impact", "forbidden_claims")
    advice = F.coalesce(contains_any(c("message"), generic), none) | F.coalesce(contains_any(c("reasoning"), generic), none) | F.coalesce(contains_any(c("fix"), generic), none)
    told = F.concat(F.coalesce("message", F.lit("")), F.lit(" "), F.coalesce("reasoning", F.lit("")))
    overclaimed = contains_any(told, absolute) & ~contains_any(told, hedges)
    overstated = rank(c("severity"), SEVERITIES) > rank(c("max_severity"), SEVERITIES)
    n, fixes, impacts, bounded, unsure = F.count("*"), c("remediation").isNotNull(), c("impact_concept").isNotNull(), c("max_severity").isNotNull(), F.coalesce(c("confidence").isin("low", "medium"), none)
    part = lambda holds, of, empty: rate(F.count_if(of & holds), F.count_if(of), empty)
    return pairs.groupBy(*keys).agg(
        n.alias("true_positives_scored"), rate(F.count_if(_said("message")), n, 1.0).alias("identification_present_rate"), rate(F.count_if(_said("reasoning")), n, 1.0).alias("root_cause_present_rate"),
        part(_said("fix"), fixes, 1.0).alias("actionable_fix_present_rate"), F.count_if(fixes).alias("actionable_fix_expected_count"),
        part(_said("impact") & ~exaggerated, impacts, 1.0).alias("impact_grounded_rate"), F.count_if(impacts).alias("impact_expected_count"),
        part(overstated, bounded, 0.0).alias("severity_overstatement_rate"), F.count_if(bounded).alias("severity_checked_count"),
        part(exaggerated, _said("impact"), 0.0).alias("unsupported_impact_rate"), rate(F.count_if(advice), n, 0.0).alias("generic_advice_rate"),
        part(overclaimed, unsure, 0.0).alias("low_confidence_overclaim_rate"), F.count_if(unsure).alias("low_or_medium_confidence_count"),
    )


def regression_checks(pairs: DataFrame, keys: Sequence[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """(keys, check_name, change, threshold, verdict, differs, exit_code): six checks of each pair of runs.

    ``pairs``: keys and the structs ``baseline`` and ``current`` with the columns of ``IDENTITY``
    and precision, recall, clean_pass_rate, unsupported, duplicate_rate, unsafe_carry_forward.
    ``exit_code`` is that of the pair: 0 passed, 1 a check failed, 2 the runs can't be compared,
    ``differs`` then names the first identity that differs. No unsafe_carry_forward counts as 0.
    """
    limits = THRESHOLDS | (thresholds or {})
    c = F.col
    b, now = lambda name: c(f"baseline.{name}"), lambda name: c(f"current.{name}")
    differs = F.coalesce(*[F.when(~b(name).eqNullSafe(now(name)), F.lit(name)) for name in IDENTITY])
    changes = {
        "precision": b("precision") - now("precision"), "recall": b("recall") - now("recall"), "clean_case_pass_rate": b("clean_pass_rate") - now("clean_pass_rate"), "unsupported_accepted_findings": now("unsupported") - b("unsupported"),
        "duplicate_rate": now("duplicate_rate") - b("duplicate_rate"), "unsafe_carry_forward": F.coalesce(now("unsafe_carry_forward"), F.lit(0)),
    }
    checks = F.array(*[F.struct(F.lit(name).alias("check_name"), change.cast("double").alias("change"), F.lit(float(limits[name])).alias("threshold")) for name, change in changes.items()])
    j = pairs.select(*keys, differs.alias("differs"), checks.alias("checks"))
    failed = F.exists("checks", lambda x: x["change"] > x["threshold"])
    j = j.withColumn("exit_code", F.when(c("differs").isNotNull(), 2).when(failed, 1).otherwise(0)).withColumn("x", F.explode("checks"))
    verdict = F.when(c("differs").isNotNull(), F.lit("not comparable")).when(c("x.change") <= c("x.threshold"), F.lit("passed")).otherwise(F.lit("failed"))
    return j.select(*keys, "x.*", verdict.alias("verdict"), "differs", "exit_code")


def unsupported_reason(n_lines: Column, start: Column, end: Column) -> Column:
    """Why a cited place can't exist; null if it can. ``n_lines`` is null for a file that isn't there."""
    return F.when(n_lines.isNull(), F.lit("file_absent")).when(end > n_lines, F.lit("past_end")).when((start < 1) | (end < start), F.lit("bad_range"))


def hallucination_rates(proposals: DataFrame, files: DataFrame, accepted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: proposals that cite no real place before validation, and unsupported findings after it.

    ``proposals``: keys, file, start, end; ``files``: file, n_lines; ``accepted``: keys, outcome.
    A key that only one side has gets zeros and a rate of 0 for the other.
    """
    reason = unsupported_reason(F.col("n_lines"), F.col("start"), F.col("end"))
    before = proposals.join(files.select("file", "n_lines"), "file", "left").groupBy(*keys).agg(F.count("*").alias("proposals"), F.count_if(reason.isNotNull()).alias("unsupported_before"))
    after = accepted.groupBy(*keys).agg(F.count("*").alias("accepted"), F.count_if(F.col("outcome") == "unsupported").alias("unsupported_after"))
    j = before.join(after, list(keys), "full_outer").fillna(0, ["proposals", "unsupported_before", "accepted", "unsupported_after"])
    return j.withColumns({"rate_before": rate(F.col("unsupported_before"), F.col("proposals"), 0.0), "rate_after": rate(F.col("unsupported_after"), F.col("accepted"), 0.0)})


def feedback_totals(assessments: DataFrame, unattributed: DataFrame) -> DataFrame:
    """One row over all assessed findings; those without a confidence count as ``confidence_none``."""
    c, n = F.col, F.count("*")
    kinds = ("positive_reactions", "negative_reactions", "developer_replies", "explicit_useful", "explicit_false_positive", "explicit_fixed", "explicit_ignore")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    shade = F.coalesce("confidence", F.lit("none"))
    row = assessments.agg(
        total(sum((c(k) for k in kinds[1:]), c(kinds[0]))).alias("events_ingested"), n.alias("findings"), rate(F.count_if(c("usefulness") == "positive"), n, 0.0).alias("positive_rate"),
        rate(F.count_if(c("usefulness") == "negative"), n, 0.0).alias("negative_rate"), *[total(k).alias(k) for k in kinds[3:6]], rate(F.count_if("engaged"), n, 0.0).alias("engagement_rate"),
        *[F.count_if(shade == s).alias(f"confidence_{s}") for s in ("strong", "medium", "weak", "none")],
    )
    return row.crossJoin(unattributed.agg(n.alias("unattributed")))  # one row each


def feedback_bands(assessments: DataFrame, findings: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(band, value, findings, positive_rate, negative_rate, false_positives) of the findings that are still known."""
    bands = F.explode(F.array(*[F.struct(F.lit(d).alias("band"), F.col(f"f_{d}").cast("string").alias("value")) for d in dimensions]))
    known = findings.select("finding_id", *[F.col(d).alias(f"f_{d}") for d in dimensions])
    j = assessments.join(known, "finding_id").select("usefulness", "explicit_false_positive", bands.alias("b"))
    n = F.count("*")
    return j.groupBy("b.band", "b.value").agg(
        n.alias("findings"), rate(F.count_if(F.col("usefulness") == "positive"), n, 0.0).alias("positive_rate"), rate(F.count_if(F.col("usefulness") == "negative"), n, 0.0).alias("negative_rate"),
        F.count_if(F.col("explicit_false_positive") > 0).alias("false_positives"),
    )


def claim_problems(expected: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, place, error) of blank claims of expectations and of rules that forbid nothing or say no reason.

    ``expected``: case_id, exp_ord, forbidden_claims; ``rules``: case_id, rule_ord, category,
    issue_family, reason. A null reason is a missing one.
    """
    blank = F.exists("forbidden_claims", lambda x: ~x.rlike(r"\S"))
    claims = expected.where(blank).select("case_id", F.col("exp_ord").cast("string").alias("place"), F.lit("blank_claim").alias("error"))
    errors = F.array_compact(F.array(F.when(F.col("category").isNull() & F.col("issue_family").isNull(), F.lit("no_target")), F.when(~_said("reason"), F.lit("no_reason"))))
    return claims.unionByName(rules.select("case_id", F.col("rule_ord").cast("string").alias("place"), F.explode(errors).alias("error")))


def with_sides(predictions: DataFrame, candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """Predictions with the symbol of their candidate and the severity their expectation asks for; null where there is none."""
    symbols = candidates.select("candidate_id", F.col("name").alias("symbol"))
    severities = expected.select("case_id", F.col("exp_ord").alias("matched"), F.col("severity").alias("expected_severity"))
    return predictions.join(symbols, "candidate_id", "left").join(severities, ["case_id", "matched"], "left")


def incremental_totals(previous: DataFrame, current: DataFrame, selected: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key what an incremental plan saves, and why candidates could be skipped.

    ``previous``, ``current``, ``selected``: candidates (keys, candidate_id; current with symbol_id);
    ``decisions``: keys, disposition, reason, symbol_id. A skipped candidate whose symbol carries a
    confirmed finding forward is skipped by that evidence, any other because it is free of findings.
    """
    c, keys = F.col, list(keys)
    kept = decisions.where("disposition = 'carry_forward' AND symbol_id IS NOT NULL").select(*keys, "symbol_id").distinct().withColumn("__confirmed", F.lit(True))
    chosen = selected.select(*keys, "candidate_id").distinct().withColumn("__selected", F.lit(True))
    j = current.join(chosen, [*keys, "candidate_id"], "left").join(kept, [*keys, "symbol_id"], "left")
    skipped, confirmed = c("__selected").isNull(), c("__confirmed").isNotNull()
    now = j.groupBy(*keys).agg(
        F.count("*").alias("current_candidates"), F.count_if(~skipped).alias("incremental_candidates"), F.count_if(skipped).alias("skipped"), F.count_if(skipped & ~confirmed).alias("skipped_finding_free"),
        F.count_if(skipped & confirmed).alias("skipped_evidence_confirmed"),
    )
    was = previous.groupBy(*keys).agg(F.count("*").alias("previous_candidates"))
    told = decisions.groupBy(*keys).agg(
        F.count_if(c("disposition") == "carry_forward").alias("carried_forward"), F.count_if(c("disposition") == "resolved_immediately").alias("resolved"),
        F.count_if((c("disposition") == "needs_recheck") & (c("reason") == "ambiguous_symbol_match")).alias("ambiguous"),
    )
    return now.join(was, keys, "full_outer").join(told, keys, "full_outer").fillna(0)
