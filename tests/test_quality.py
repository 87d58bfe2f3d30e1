"""Whole-run measures on small tables: limits, defaults and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from findweave.functions.output import CUT, summary_bodies
from findweave.operators import quality
from findweave.plans.evaluation import ABSOLUTE, GENERIC, HEDGES

RUN = ", ".join(f"{name}: string" for name in quality.IDENTITY) + ", precision: double, recall: double, clean_pass_rate: double, unsupported: int, duplicate_rate: double, unsafe_carry_forward: int"
PAIR = "message string, reasoning string, fix string, impact string, severity string, confidence string, remediation string, impact_concept string, max_severity string, forbidden_claims array<string>"


def run(mode="full", precision=0.9, recall=0.9, clean=1.0, unsupported=0, duplicate=0.0, unsafe=None):
    return (*["1"] * (len(quality.IDENTITY) - 1), mode, precision, recall, clean, unsupported, duplicate, unsafe)


@pytest.mark.parametrize(
    ("current", "failed", "code"),
    [
        (run(), set(), 0), (run(precision=0.88, recall=0.81), set(), 0), (run(precision=0.86), {"precision"}, 1), (run(recall=0.79), {"recall"}, 1), (run(clean=0.94), {"clean_case_pass_rate"}, 1),
        (run(unsupported=1), {"unsupported_accepted_findings"}, 1), (run(duplicate=0.03), {"duplicate_rate"}, 1), (run(unsafe=1), {"unsafe_carry_forward"}, 1), (run(precision=1.0, recall=1.0, unsafe=0), set(), 0), (run(mode="static", precision=0.0), None, 2),
    ],
)
def test_regression_verdicts(spark, current, failed, code):
    df = spark.createDataFrame([(1, run(), current)], f"id int, baseline struct<{RUN}>, current struct<{RUN}>")
    rows = quality.regression_checks(df, ["id"]).collect()
    assert len(rows) == 6 and {r["exit_code"] for r in rows} == {code}
    if failed is None:
        assert {(r["verdict"], r["differs"]) for r in rows} == {("not comparable", "mode")}
    else:
        assert {r["check_name"] for r in rows if r["verdict"] == "failed"} == failed


def test_thresholds_can_be_set(spark):
    df = spark.createDataFrame([(1, run(), run(precision=0.5))], f"id int, baseline struct<{RUN}>, current struct<{RUN}>")
    assert {r["exit_code"] for r in quality.regression_checks(df, ["id"], {"precision": 0.5}).collect()} == {0}


def test_security_rates_of_nothing_are_their_defaults(spark):
    got = quality.security_rates(spark.createDataFrame([], PAIR), GENERIC, ABSOLUTE, HEDGES).first().asDict()
    ones = {"identification_present_rate", "root_cause_present_rate", "actionable_fix_present_rate", "impact_grounded_rate"}
    assert got == {name: 1.0 if name in ones else 0 for name in got} and len(got) == 13


def test_security_rates(spark):
    rows = [
        ("This allows reading", "Follow security best practices", " ", "Full TAKEOVER", "high", "low", "x", "y", "low", ["takeover"]), ("This allows reading, if set", "", "escape it", "reads a file", "low", "medium", "x", None, "high", ["takeover"]),
        (None, None, None, None, None, None, None, "y", None, None), ("", "x", "y", "TAKEOVER", "info", "high", None, None, None, ["TAKEOVER"]),
    ]
    got = quality.security_rates(spark.createDataFrame(rows, PAIR), GENERIC, ABSOLUTE, HEDGES).first().asDict()
    assert got == {
        "true_positives_scored": 4, "identification_present_rate": 0.5, "root_cause_present_rate": 0.5, "actionable_fix_present_rate": 0.5, "actionable_fix_expected_count": 2, "impact_grounded_rate": 0.0, "impact_expected_count": 2,
        "severity_overstatement_rate": 0.5, "severity_checked_count": 2, "unsupported_impact_rate": 1 / 3, "generic_advice_rate": 0.25, "low_confidence_overclaim_rate": 0.5, "low_or_medium_confidence_count": 2,
    }


def test_hallucinations_of_one_sided_cases(spark):
    proposals = spark.createDataFrame([("a", "f", 1, 3), ("a", "f", 1, 4), ("a", "g", 1, 1), ("a", "f", 0, 1), ("a", "f", 3, 2)], "case_id string, file string, start int, end int")
    files = spark.createDataFrame([("f", 3)], "file string, n_lines int")
    accepted = spark.createDataFrame([("b", "unsupported"), ("b", "true_positive")], "case_id string, outcome string")
    got = {r["case_id"]: tuple(r)[1:] for r in quality.hallucination_rates(proposals, files, accepted, ["case_id"]).collect()}
    assert got == {"a": (5, 4, 0, 0, 0.8, 0.0), "b": (0, 0, 2, 1, 0.0, 0.5)}


def test_claims_and_rules(spark):
    expected = spark.createDataFrame([("c", 1, ["a", " "]), ("c", 2, ["a"]), ("c", 3, []), ("c", 4, None)], "case_id string, exp_ord int, forbidden_claims array<string>")
    rules = spark.createDataFrame([("c", 1, None, None, "r"), ("c", 2, "x", None, None), ("c", 3, None, "f", "r"), ("c", 4, None, None, "\t")], "case_id string, rule_ord int, category string, issue_family string, reason string")
    got = sorted((r["place"], r["error"]) for r in quality.claim_problems(expected, rules).collect())
    assert got == [("1", "blank_claim"), ("1", "no_target"), ("2", "no_reason"), ("4", "no_reason"), ("4", "no_target")]


def test_incremental_totals(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    current = frame([(1, "a", "s"), (1, "b", "t"), (1, "c", None), (1, "d", "s")], "run int, candidate_id string, symbol_id string")
    decisions = frame([(1, "carry_forward", "x", "s"), (1, "carry_forward", "x", None), (1, "needs_recheck", "ambiguous_symbol_match", "t"), (1, "resolved_immediately", "x", "t")], "run int, disposition string, reason string, symbol_id string")
    got = quality.incremental_totals(current.limit(0), current, current.where("candidate_id = 'd'"), decisions, ["run"]).first().asDict()
    assert got == {"run": 1, "current_candidates": 4, "incremental_candidates": 1, "skipped": 3, "skipped_finding_free": 2, "skipped_evidence_confirmed": 1, "previous_candidates": 0, "carried_forward": 2, "resolved": 1, "ambiguous": 1}


@pytest.mark.parametrize("limit", [80, 10_000])
def test_summaries_keep_their_marker(spark, limit):
    rows = [(1, i, "inline" if i < 3 else "omitted", "high" if i else "low", "f.py", i, " t --> ") for i in range(5)]
    df = spark.createDataFrame(rows, "run_id int, place int, disposition string, severity string, path string, line int, title string")
    body, cut = summary_bodies(df, F.lit("<!-- m -->"), "Heading", limit).select("body", "truncated").first()
    assert body.endswith("\n\n<!-- m -->") and len(body) <= limit and body.count("-->") == 1 and cut == (limit == 80)
    assert CUT in body if cut else body.startswith("## Heading\n\n**Findings:** 4 high, 1 low\n") and "*2 additional finding(s) omitted.*" in body
