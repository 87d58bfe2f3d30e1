"""Analyzer reports and reviewer responses as rows of one findings schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.functions import rules
from findweave.functions.ranks import CONFIDENCES, SEVERITIES, looked_up

COLUMNS = ("run_id", "rule_id", "category", "severity", "confidence", "title", "message", "file_path", "start_line", "end_line", "start_column", "end_column", "source_analyzer", "cwe")

_RUFF = "array<struct<code:string,filename:string,message:string,name:string,url:string,location:struct<row:int,column:int>,end_location:struct<row:int,column:int>>>"
_SEMGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>,end:struct<line:int,col:int>,extra:struct<message:string,severity:string,metadata:struct<category:string,confidence:string,cwe:string>>>>>"
_SEMGREP_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
CATEGORIES = ("correctness", "security", "memory_safety", "resource_management", "concurrency", "performance", "maintainability", "style", "portability", "api_misuse", "undefined_behavior", "unknown")


def _finding(analyzer: str, **columns: Column) -> list[Column]:
    columns = {"source_analyzer": F.lit(analyzer), "cwe": F.lit(None).cast("string"), **columns}
    return [columns[c].alias(c) if c != "run_id" else F.col("run_id") for c in COLUMNS]


def ruff(reports: DataFrame) -> DataFrame:
    """``reports``: run_id, report. Entries without a code are dropped."""
    c = F.col
    rows = reports.select("run_id", F.inline(F.from_json("report", _RUFF))).where("code IS NOT NULL").withColumn("r", rules.ruff_rule(c("code")))
    return rows.select(*_finding(
        "ruff", rule_id=c("code"), category=c("r.category"), severity=c("r.severity"), confidence=c("r.confidence"), title=F.coalesce("name", "code"), message=c("message"), file_path=c("filename"),
        start_line=c("location.row"), end_line=F.coalesce("end_location.row", "location.row"), start_column=c("location.column"), end_column=F.coalesce("end_location.column", "location.column"),
    ))


def semgrep(reports: DataFrame) -> DataFrame:
    """The rule is the last dotted part of the check; a category outside the vocabulary is unknown."""
    c = F.col
    rows = reports.select("run_id", F.inline(F.from_json("report", _SEMGREP)["results"]))
    category = F.lower(c("extra.metadata.category"))
    confidence = F.lower(c("extra.metadata.confidence"))
    return rows.select(*_finding(
        "semgrep", rule_id=F.substring_index("check_id", ".", -1), category=F.when(category.isin(*CATEGORIES), category).otherwise(F.lit("unknown")),
        severity=looked_up(F.upper(c("extra.severity")), _SEMGREP_SEVERITY, "medium"), confidence=F.when(confidence.isin(*CONFIDENCES), confidence).otherwise(F.lit("medium")),
        title=F.substring_index("check_id", ".", -1), message=c("extra.message"), file_path=c("path"), start_line=c("start.line"), end_line=c("end.line"), start_column=c("start.col"), end_column=c("end.col"), cwe=c("extra.metadata.cwe"),
    ))


_CPPCHECK = "errors struct<error: array<struct<_id: string, _severity: string, _msg: string, _cwe: string, location: array<struct<_file: string, _line: int, _column: int>>>>>"


def cppcheck(reports: DataFrame) -> DataFrame:
    """XML reports (version 2): the first location of each error; errors without one are dropped.

    A report that isn't well-formed XML gives nothing.
    """
    c = F.col
    parsed = F.from_xml("report", _CPPCHECK, {"ignoreSurroundingSpaces": "false"})
    rows = reports.select("run_id", F.inline(parsed["errors"]["error"])).withColumn("l", F.get("location", F.lit(0))).where("l IS NOT NULL")
    column = F.coalesce("l._column", F.lit(0))
    return rows.select(*_finding(
        "cppcheck", rule_id=c("_id"), category=rules.cppcheck_category(c("_id")), severity=looked_up(c("_severity"), rules.CPPCHECK_SEVERITIES, "medium"),
        confidence=F.lit("medium"), title=c("_id"), message=c("_msg"), file_path=c("l._file"),
        start_line=c("l._line"), end_line=c("l._line"), start_column=column, end_column=column, cwe=c("_cwe"),
    ))


#: One diagnostic line: file, line, column, severity, message and, if named, the check.
DIAGNOSTIC = r"^(.+?):(\d+):(\d+): (error|warning): (.*?)(?: \[([\w,.\-]+)\])?$"


def clang_tidy(reports: DataFrame) -> DataFrame:
    """Diagnostics of error and warning lines; notes, source and caret lines don't match."""
    c = F.col
    rows = reports.select("run_id", F.explode(F.split(c("report"), "\r?\n")).alias("raw")).where(c("raw").rlike(DIAGNOSTIC))
    part = lambda n: F.regexp_extract("raw", DIAGNOSTIC, n)
    check = F.coalesce(F.nullif(part(6), F.lit("")), F.lit("clang-tidy"))
    line, column = part(2).cast("int"), part(3).cast("int")
    return rows.select(*_finding(
        "clang_tidy", rule_id=check, category=rules.clang_category(check), severity=looked_up(part(4), rules.CLANG_SEVERITIES, "medium"), confidence=F.lit("medium"), title=check, message=part(5), file_path=part(1),
        start_line=line, end_line=line, start_column=column, end_column=column,
    ))


#: Parsers by report format; further ones can be added.
PARSERS = {"ruff": ruff, "semgrep": semgrep, "cppcheck": cppcheck, "clang_tidy": clang_tidy}

_EVIDENCE = "array<struct<file_path:string,start_line:int,end_line:int,quoted_text:string>>"
_RESPONSE = f"struct<findings:array<struct<title:string,message:string,category:string,severity:string,confidence:string,file_path:string,start_line:int,end_line:int,evidence:{_EVIDENCE},reasoning_summary:string,suggested_fix:string,impact:string>>>"
REQUIRED = ("title", "message", "category", "severity", "confidence", "file_path", "start_line", "end_line", "reasoning_summary")


def reviewer_findings(responses: DataFrame) -> DataFrame:
    """``responses``: candidate_id, raw_json -> one row per well-formed finding.

    A response that isn't an object with a list of findings gives nothing; an entry that lacks a
    required field or uses a value outside the vocabularies is dropped alone.
    """
    c = F.col
    parsed = responses.withColumn("r", F.from_json("raw_json", _RESPONSE)).where(F.expr("r.findings IS NOT NULL"))
    rows = parsed.select("candidate_id", F.posexplode("r.findings").alias("finding_idx", "f")).where("f IS NOT NULL").select("candidate_id", "finding_idx", "f.*")
    for name in REQUIRED:
        rows = rows.where(c(name).isNotNull())
    rows = rows.where(c("category").isin(*CATEGORIES) & c("severity").isin(*SEVERITIES) & c("confidence").isin(*CONFIDENCES))
    empty_to_null = lambda n: F.nullif(F.trim(n), F.lit(""))
    return rows.withColumn("evidence", F.coalesce("evidence", F.array().cast(_EVIDENCE))).withColumn("suggested_fix", empty_to_null("suggested_fix")).withColumn("impact", empty_to_null("impact"))


def validity(findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """Findings with ``rejection``: the first check that fails, or null.

    ``contexts``: candidate_id, allowed_file_paths, context_text, diff_excerpt.
    """
    c = F.col
    j = findings.join(contexts, "candidate_id")
    source = F.concat(c("context_text"), F.lit("\n"), c("diff_excerpt"))
    wrong = F.transform("evidence", lambda e: F.when(~F.array_contains("allowed_file_paths", e["file_path"]), F.lit("evidence_path_out_of_scope")).when(~F.contains(source, F.trim(e["quoted_text"])) | (F.trim(e["quoted_text"]) == ""), F.lit("evidence_not_quoted")))
    first = F.get(F.filter(wrong, lambda r: r.isNotNull()), F.lit(0))
    rejection = (
        F.when((c("start_line") < 1) | (c("end_line") < c("start_line")), F.lit("bad_line_range")).when(~F.array_contains("allowed_file_paths", c("file_path")), F.lit("file_out_of_scope"))
        .when(F.trim("message") == "", F.lit("empty_message")).when(F.trim("reasoning_summary") == "", F.lit("empty_reasoning")).when(F.size("evidence") == 0, F.lit("no_evidence")).otherwise(first)
    )
    return j.withColumn("rejection", rejection)


def pull_request_events(payloads: DataFrame, column: str = "body", actions: tuple[str, ...] = ("opened", "synchronize", "reopened")) -> DataFrame:
    """Webhook bodies -> pull-request events of the handled actions; others and malformed ones drop out."""
    user = "struct<login:string>"
    ref = "struct<ref:string,sha:string>"
    schema = f"struct<action:string,number:int,pull_request:struct<number:int,title:string,body:string,state:string,html_url:string,user:{user},base:{ref},head:{ref}>,repository:struct<id:bigint,name:string,full_name:string,owner:{user}>,installation:struct<id:bigint>>"
    p = payloads.withColumn("p", F.from_json(column, schema)).where(F.col("p.action").isin(*actions) & F.col("p.pull_request.number").isNotNull() & F.col("p.repository.id").isNotNull())
    return p.select("*", F.col("p.action").alias("action"), F.col("p.pull_request.number").alias("number"), F.col("p.repository.id").alias("repository_id"), F.col("p.pull_request.base.sha").alias("base_sha"), F.col("p.pull_request.head.sha").alias("head_sha"), F.col("p.installation.id").alias("installation_id")).drop("p")
