"""The read API: named lookups over the tables of the data model.

A lookup filters one table by equality (or membership, for lists) on its parameters, orders it
totally, and may take the first rows. Filters and columns reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.operators import events as feedback


@dataclass(frozen=True)
class Lookup:
    table: str
    by: tuple[str, ...] = ()
    where: str | None = None
    order: tuple[str, ...] = ()
    first: int | None = None
    columns: tuple[str, ...] = ()


_LATEST = ("completed_at DESC", "id")
LOOKUPS = {
    "active_index": Lookup("repository_indexes", ("repository_id",), "is_active AND status = 'succeeded'", ("version DESC", "id"), 1),
    "file": Lookup("indexed_files", ("repository_index_id", "path")),
    "file_by_id": Lookup("indexed_files", ("id",)),
    "files_by_ids": Lookup("indexed_files", ("id",)),
    "languages": Lookup("indexed_files", ("repository_index_id",), "language IS NOT NULL", ("language",), None, ("language",)),
    "symbol_by_id": Lookup("symbols", ("id",)),
    "symbols_by_ids": Lookup("symbols", ("id",)),
    "symbols_in_file": Lookup("symbols", ("file_id",), None, ("start_line", "id")),
    "symbol_by_name": Lookup("symbols", ("repository_index_id", "name"), None, ("path", "start_line", "id")),
    "symbol_by_qualified_name": Lookup("symbols", ("repository_index_id", "qualified_name"), None, ("path", "start_line", "id")),
    "callers": Lookup("call_references", ("resolved_symbol_id",), None, ("file_id", "line", "id")),
    "callees": Lookup("call_references", ("caller_symbol_id",), None, ("file_id", "line", "id")),
    "imports_from_file": Lookup("import_references", ("file_id",), None, ("ord", "id")),
    "files_importing": Lookup("import_references", ("resolved_file_id",), None, ("file_id",), None, ("file_id",)),
    "edges_of_kind": Lookup("repository_edges", ("repository_index_id", "kind"), None, ("src_file", "dst_file", "id")),
    "likely_tests": Lookup("repository_edges", ("repository_index_id", "dst_file"), "kind = 'file_tests_file'", ("src_file", "id")),
    "analysis_run": Lookup("analysis_runs", ("id",)),
    "succeeded_analysis": Lookup("analysis_runs", ("repository_id", "commit_sha"), "status = 'succeeded'", _LATEST, 1),
    "findings_of_run": Lookup("findings", ("analysis_run_id",), None, ("file_path", "start_line", "id")),
    "findings_in_file": Lookup("findings", ("analysis_run_id", "file_path"), None, ("start_line", "id")),
    "findings_of_symbol": Lookup("findings", ("analysis_run_id", "symbol_id"), None, ("start_line", "id")),
    "findings_of_severity": Lookup("findings", ("analysis_run_id", "severity"), None, ("file_path", "start_line", "id")),
    "findings_of_analyzer": Lookup("findings", ("analysis_run_id", "source_analyzer"), None, ("file_path", "start_line", "id")),
    "findings_on_changed_lines": Lookup("findings", ("analysis_run_id",), "is_on_changed_line", ("file_path", "start_line", "id")),
    "findings_in_changed_symbols": Lookup("findings", ("analysis_run_id",), "is_in_changed_symbol", ("file_path", "start_line", "id")),
    "finding_sources": Lookup("finding_sources", ("finding_id",), None, ("analyzer", "id")),
    "executions": Lookup("analyzer_executions", ("analysis_run_id",), None, ("analyzer", "id")),
    "bundle": Lookup("context_bundles", ("id",)),
    "bundle_for_finding": Lookup("context_bundles", ("finding_id",), "status = 'succeeded'", _LATEST, 1),
    "bundle_for_symbol": Lookup("context_bundles", ("symbol_id",), "status = 'succeeded'", _LATEST, 1),
    "context_items": Lookup("context_items", ("bundle_id",), None, ("rank", "id")),
    "context_items_of_kind": Lookup("context_items", ("bundle_id", "kind"), None, ("rank", "id")),
    "review_run": Lookup("review_runs", ("id",)),
    "succeeded_review": Lookup("review_runs", ("pull_request_id",), "status = 'succeeded'", _LATEST, 1),
    "candidates": Lookup("review_candidates", ("review_run_id",), None, ("file_path", "start_line", "id")),
    "proposals": Lookup("ai_finding_proposals", ("review_run_id",), None, ("file_path", "start_line", "id")),
    "critic_verdict": Lookup("critic_verdicts", ("proposal_id",)),
    "ai_findings": Lookup("ai_findings", ("review_run_id",), None, ("file_path", "start_line", "id")),
    "memory_history": Lookup("review_generations", ("pull_request_id",), None, ("sequence_number", "id")),
    "generation": Lookup("review_generations", ("id",)),
    "generation_of_run": Lookup("review_generations", ("review_run_id",)),
    "latest_generation": Lookup("review_generations", ("pull_request_id",), None, ("sequence_number DESC", "id"), 1),
    "open_memory_findings": Lookup("review_memory_findings", ("pull_request_id",), "status NOT IN ('resolved', 'superseded')", ("file_path", "start_line", "id")),
    "transitions_of_finding": Lookup("review_memory_transitions", ("memory_finding_id",), None, ("occurred_at", "id")),
    "transitions_of_run": Lookup("review_memory_transitions", ("review_run_id",), None, ("occurred_at", "id")),
    "already_reported": Lookup("review_publication_comments", ("publication_id",), "finding_id IS NOT NULL", ("finding_id",), None, ("finding_id",)),
    "publication_comments": Lookup("review_publication_comments", ("publication_id",), None, ("path", "line", "id")),
    "feedback_of_finding": Lookup("feedback_events", ("finding_id",), None, ("occurred_at", "id")),
    "feedback_of_pull_request": Lookup("feedback_events", ("pull_request_id",), None, ("occurred_at", "id")),
    "feedback_of_review": Lookup("feedback_events", ("review_run_id",), None, ("occurred_at", "id")),
    "unattributed_feedback": Lookup("feedback_events", (), "finding_id IS NULL", ("occurred_at", "id")),
    "findings_with_feedback": Lookup("feedback_events", (), "finding_id IS NOT NULL", ("finding_id",), None, ("finding_id",)),
}


class Catalog:
    """Lookups over a mapping of table names to DataFrames."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def find(self, lookup: str, /, **params) -> DataFrame:
        spec = LOOKUPS[lookup]
        if set(params) != set(spec.by):
            raise TypeError(f"{lookup} needs {spec.by}")
        df = self.tables[spec.table]
        for column, value in params.items():
            df = df.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
        if spec.where:
            df = df.where(spec.where)
        if spec.columns:
            df = df.select(*spec.columns).distinct()
        if spec.order:
            df = df.orderBy(*[F.desc(o[:-5]) if o.endswith(" DESC") else F.col(o) for o in spec.order])
        return df.limit(spec.first) if spec.first else df

    def symbol_containing_line(self, file_id: str, line: int) -> DataFrame:
        s = self.tables["symbols"].where((F.col("file_id") == file_id) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
        return s.orderBy(F.col("end_line") - F.col("start_line"), "start_line", "id").limit(1)

    def event_summaries(self) -> DataFrame:
        """Assessment of every finding with feedback, from one scan of the log."""
        e = self.tables["feedback_events"].where("finding_id IS NOT NULL")
        item = F.coalesce(F.element_at("metadata", "reaction_id"), "external_event_id")
        return feedback.assess(e.select("finding_id", "event_type", item.alias("reaction_id"), F.col("normalized_signal").alias("signal"), F.col("signal_strength").alias("strength"), F.col("occurred_at").alias("at"), F.col("id").alias("seq")))

    def negative_findings(self) -> DataFrame:
        return self.event_summaries().where(feedback.false_positive_candidate())

    def positive_findings(self) -> DataFrame:
        return self.event_summaries().where(feedback.high_value_candidate())


def event_filters(events: DataFrame, positive: bool = False, negative: bool = False, explicit: bool = False, since=None) -> DataFrame:
    """Events as the command line selects them; signals given together are alternatives."""
    wanted = [*(["positive_hint", "useful", "fixed"] if positive else []), *(["negative_hint", "false-positive"] if negative else [])]
    if wanted:
        events = events.where(F.col("normalized_signal").isin(*wanted))
    if explicit:
        events = events.where("event_type = 'explicit_command'")
    return events if since is None else events.where(F.col("occurred_at") >= F.lit(since))


def case_filters(cases: DataFrame, ids=None, tags=None, language=None, difficulty=None) -> DataFrame:
    """Benchmark cases that meet every given filter; tags need one in common."""
    if ids:
        cases = cases.where(F.col("case_id").isin(*ids))
    if tags:
        cases = cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    for column, value in (("language", language), ("difficulty", difficulty)):
        if value:
            cases = cases.where(F.col(column) == value)
    return cases


def in_mode(expected: DataFrame, mode: str) -> DataFrame:
    """Ground truth in the scope of an evaluation mode."""
    scope = {"static_only": ("static_expected", "either"), "ai_only": ("ai_expected", "either")}.get(mode)
    return expected.where(F.col("ground_truth_source").isin(*scope)) if scope else expected


def usable_analyzers(analyzers: DataFrame, languages, disabled=()) -> DataFrame:
    """Analyzers that aren't disabled and share a language with the index."""
    return analyzers.where(~F.col("name").isin(*disabled) if disabled else F.lit(True)).where(F.arrays_overlap("languages", F.array(*map(F.lit, languages))))


def forbidden_reason(predictions: DataFrame, rules: DataFrame) -> DataFrame:
    """Predictions with the reason of the first forbidden rule of their case (any category, or their own).

    Rules: case_id, ord, reason, category; rules of an issue family alone are left out.
    """
    r = rules.where("category IS NOT NULL OR issue_family IS NULL").select(F.col("case_id"), "ord", "reason", F.col("category").alias("rule_category"))
    j = predictions.join(r, "case_id", "left").where(F.col("ord").isNull() | F.col("rule_category").isNull() | (F.col("rule_category") == F.col("category")))
    first = j.groupBy("case_id", "pred_idx").agg(F.min_by("reason", "ord").alias("forbidden_reason"))
    return predictions.join(first, ["case_id", "pred_idx"], "left")
