"""Tables of the review data model as Spark schemas (DDL)."""

from __future__ import annotations

from pyspark.sql import types as T

_EVIDENCE = "array<struct<file_path:string,start_line:int,end_line:int,quoted_text:string>>"
_SPAN = "file_path string, start_line int, end_line int"
DDL = {
    "repositories": "id string, github_repository_id long, full_name string",
    "pull_requests": "id string, repository_id string, number int, state string, base_sha string, head_sha string",
    "pull_request_ingestions": "id string, delivery_id string, pull_request_id string, status string",
    "repository_indexes": "id string, repository_id string, version int, commit_sha string, status string, is_active boolean, completed_at timestamp",
    "indexed_files": "id string, repository_index_id string, path string, language string, content_hash string, is_test boolean, is_generated boolean",
    "symbols": "id string, repository_index_id string, file_id string, path string, name string, qualified_name string, kind string, parent_symbol_id string, start_line int, end_line int, content_hash string",
    "import_references": "id string, repository_index_id string, file_id string, raw_text string, target string, ord int, resolved_file_id string",
    "call_references": "id string, repository_index_id string, file_id string, caller_symbol_id string, callee_name string, line int, resolved_symbol_id string, resolution_status string",
    "repository_edges": "id string, repository_index_id string, kind string, src_file string, src_symbol string, dst_file string, dst_symbol string, reason string",
    "parsed_file_cache": "content_hash string, language string, parser_version string, payload string",
    "analysis_runs": "id string, repository_id string, commit_sha string, identity string, status string, completed_at timestamp",
    "analyzer_executions": "id string, analysis_run_id string, analyzer string, status string, raw_findings_count int",
    "findings": f"id string, analysis_run_id string, rule_id string, category string, severity string, confidence string, message string, {_SPAN}, symbol_id string, source_analyzer string, fingerprint string, is_on_changed_line boolean, is_in_changed_symbol boolean",
    "finding_sources": "id string, finding_id string, analyzer string, rule_id string",
    "context_bundles": "id string, finding_id string, symbol_id string, identity string, status string, completed_at timestamp",
    "context_items": f"id string, bundle_id string, kind string, relationship string, rank int, score double, score_breakdown array<struct<label:string,value:double>>, content string, {_SPAN}",
    "review_runs": "id string, pull_request_id string, identity string, status string, completed_at timestamp",
    "review_candidates": f"id string, review_run_id string, symbol_id string, changed_lines array<int>, {_SPAN}",
    "ai_finding_proposals": f"id string, review_run_id string, candidate_id string, category string, severity string, confidence string, title string, message string, status string, evidence {_EVIDENCE}, {_SPAN}",
    "critic_verdicts": "id string, proposal_id string, decision string, downgraded_severity string, downgraded_confidence string",
    "ai_findings": f"id string, proposal_id string, review_run_id string, category string, severity string, confidence string, title string, message string, {_SPAN}",
    "review_publications": "id string, review_run_id string, status string, head_sha string, created_at timestamp",
    "review_publication_comments": "id string, publication_id string, finding_id string, path string, line int, side string, body_hash string",
    "review_generations": "id string, pull_request_id string, review_run_id string, sequence_number int, previous_generation_id string, head_sha string",
    "review_memory_findings": f"id string, pull_request_id string, current_finding_id string, symbol_id string, category string, severity string, message string, status string, exact_fingerprint string, semantic_family_fingerprint string, evidence {_EVIDENCE}, {_SPAN}",
    "review_memory_transitions": "id string, memory_finding_id string, review_run_id string, from_status string, to_status string, reason string, occurred_at timestamp",
    "feedback_events": "id string, source string, event_type string, external_event_id string, pull_request_id string, review_run_id string, finding_id string, raw_signal string, normalized_signal string, signal_strength string, occurred_at timestamp, metadata map<string,string>",
    "feedback_assessments": "id string, finding_id string, assessment_version string, usefulness string, correctness string, resolution string, engaged boolean, confidence string, reasons string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def violations(df, table: str, vocabularies: dict[str, tuple[str, ...]]):
    """Rows whose value of a column is outside its vocabulary."""
    from pyspark.sql import functions as F

    bad = F.lit(False)
    for column, allowed in vocabularies.items():
        bad = bad | (F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return df.select(*schema(table).names).where(bad)
