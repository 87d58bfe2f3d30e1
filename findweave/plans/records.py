"""Queries on reports, responses, webhooks, scopes and stored records.

Surrogates: a part is an analyzer run with a report of its own, an order a candidate, a run or a
remembered finding, a line item one of its rows, an event a webhook or a feedback event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.functions.output import folder_fingerprint, remapped, rule_metadata
from findweave.functions.text import masked_url, qualified
from findweave.operators import code, lifecycle, matching, metrics
from findweave.operators.ranking import capped
from findweave.plans import lookup
from findweave.sources import reports

c = F.col


def _pick(number: Column, *values) -> Column:
    """One of the values by the number's remainder."""
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# reports and responses


def semgrep_findings(spark, d):
    k, line = c("p_partkey"), c("p_size").cast("string")
    report = F.concat(
        F.lit('{"results": [{"check_id": "lang.rules.r'), (k % 5).cast("string"), F.lit('", "path": "src/a.py", "start": {"line": '), line, F.lit(', "col": 2}, "end": {"line": '), line, F.lit(', "col": 9}, "extra": {"message": "said \\"no\\"", "severity": "'),
        _pick(k, "ERROR", "warning", "INFO", "OTHER"), F.lit('", "metadata": {"category": "'), _pick(k, "Security", "performance", "best-practice"), F.lit('", "confidence": "'), _pick(k, "HIGH", "low", "certain", "Medium", "LOW"), F.lit('", "cwe": "CWE-79"}}}]}'),
    )
    report = F.when(k % 7 == 0, F.lit('{"results": []}')).when(k % 11 == 0, F.lit("not json")).otherwise(report)
    found = reports.semgrep(_table(spark, d, "part").select(k.alias("run_id"), report.alias("report")))
    return found.select("run_id", "rule_id", "category", "severity", "confidence", "message", "start_line", "end_column", "cwe")


def cppcheck_findings(spark, d):
    k, line = c("p_partkey"), c("p_size").cast("string")
    first = F.concat(F.lit("<error id='"), _pick(k, "nullPointer", "memleak", "unusedFunction", "shiftTooMany", "odd"), F.lit("' severity=\""), _pick(k, "error", "warning", "style", "none"), F.lit('" msg="p &lt; q &amp;&amp; r" cwe="476"><location file="a&amp;b.c" line="'), line, F.lit('"'), F.when(k % 2 == 0, F.lit(' column="4"')).otherwise(F.lit("")), F.lit('/><location file="b.c" line="9"/></error>'))
    second = F.lit('<!-- <error id="nullPointer" severity="error" msg="gone"><location file="a.c" line="1"/></error> --><error id="note" severity="information" msg="nowhere"/>')
    report = F.concat(F.lit('<?xml version="1.0"?><results version="2"><cppcheck version="2"/><errors>'), first, second, F.lit("</errors></results>"))
    report = F.when(k % 13 == 0, F.lit("<results><errors>")).otherwise(report)
    found = reports.cppcheck(_table(spark, d, "part").select(k.alias("run_id"), report.alias("report")))
    return found.select("run_id", "rule_id", "category", "severity", "message", "file_path", "start_line", "start_column", "cwe")


def _entry(k: Column, title: str, category: Column, line: Column) -> Column:
    return F.struct(F.lit(title).alias("title"), F.lit("m").alias("message"), category.alias("category"), _pick(k, "high", "urgent", "low").alias("severity"), F.lit("medium").alias("confidence"), F.lit("a.py").alias("file_path"), line.alias("start_line"), F.lit(9).alias("end_line"), F.lit("because").alias("reasoning_summary"), _pick(k, "  ", "use x").alias("suggested_fix"))


def reviewer_responses(spark, d):
    k = c("p_partkey")
    both = F.struct(F.array(_entry(k, "first", F.lit("security"), F.lit(3)), _entry(k + 1, "second", _pick(k, "style", "taste"), F.when(k % 5 != 0, c("p_size")))).alias("findings"))
    raw = F.when(k % 9 == 0, F.lit("sorry")).when(k % 9 == 1, F.lit('{"findings": "none"}')).when(k % 9 == 2, F.lit('{"found": []}')).otherwise(F.to_json(both))
    found = reports.reviewer_findings(_table(spark, d, "part").select(k.alias("candidate_id"), raw.alias("raw_json")))
    return found.select("candidate_id", "finding_idx", "title", "severity", "start_line", "suggested_fix", F.size("evidence").alias("n_evidence"))


def proposal_validity(spark, d):
    """Proposals with the first reason to reject them; their contexts allow two files and quote two lines."""
    k, s, n = c("l_partkey"), c("l_suppkey"), c("l_linenumber")
    cited = lambda m: F.struct(_pick(m, "a.py", "b.py", "z.py").alias("file_path"), _pick(m, "x = 1", " y = 2 ", "", "unseen").alias("quoted_text"))
    evidence = F.when(k % 6 == 0, F.array().cast("array<struct<file_path:string,quoted_text:string>>")).otherwise(F.array(cited(k), cited(s)))
    rows = _table(spark, d, "lineitem").select(_line_id().alias("id"), c("l_orderkey").alias("candidate_id"), (n - 1).alias("start_line"), (n - 1 + k % 5 - 1).cast("int").alias("end_line"), _pick(s, "a.py", "b.py", "a.py", "c.py").alias("file_path"), _pick(k, "m", "m", "m", " ").alias("message"), _pick(s, "r", "r", "").alias("reasoning_summary"), evidence.alias("evidence"))
    contexts = _table(spark, d, "orders").select(c("o_orderkey").alias("candidate_id"), F.array(F.lit("a.py"), F.lit("b.py")).alias("allowed_file_paths"), F.lit("def f():\n  x = 1").alias("context_text"), F.when(c("o_orderkey") % 2 == 0, F.lit("+ y = 2")).otherwise(F.lit("")).alias("diff_excerpt"))
    return reports.validity(rows, contexts).select("id", "rejection")


def webhook_events(spark, d):
    k = c("event_id")
    action = F.when(c("event_type") == "view", F.lit("opened")).when(c("event_type") == "click", F.lit("synchronize")).when(c("event_type") == "error", F.lit("reopened")).otherwise(F.lit("closed"))
    number = F.when(k % 10 == 3, F.lit("null")).otherwise((k % 1000).cast("string"))
    body = F.concat(F.lit('{"action": "'), action, F.lit('", "number": '), number, F.lit(', "pull_request": {"number": '), number, F.lit(', "title": "t", "base": {"ref": "main", "sha": "b"}, "head": {"ref": "f", "sha": "h'), k.cast("string"), F.lit('"}}, "repository": {"id": '), c("user_id").cast("string"), F.lit(', "name": "n"}, "installation": {"id": 5}}'))
    events = _table(spark, d, "events").select(k, F.when(k % 17 == 0, F.lit("{broken")).otherwise(body).alias("body"))
    return reports.pull_request_events(events).select("event_id", "action", "number", "repository_id", "head_sha", "installation_id")


# scopes and filters


def event_selections(spark, d):
    k = c("event_id")
    e = _table(spark, d, "events").select(k, c("ts").alias("occurred_at"), _pick(k, "positive_hint", "useful", "fixed", "negative_hint", "false-positive", "ignore").alias("normalized_signal"), F.when(c("event_type") == "click", F.lit("explicit_command")).otherwise(c("event_type")).alias("event_type"))
    since = "2024-01-05 00:00:00"
    chosen = {"positive": lookup.event_filters(e, positive=True), "negative": lookup.event_filters(e, negative=True), "both_since": lookup.event_filters(e, True, True, since=since), "explicit": lookup.event_filters(e, explicit=True), "all": lookup.event_filters(e)}
    out = None
    for name, rows in chosen.items():
        one = rows.select(F.lit(name).alias("selection"), "event_id")
        out = one if out is None else out.unionByName(one)
    return out


def case_selections(spark, d):
    k = c("doc_id")
    cases = _table(spark, d, "documents").select(k.alias("case_id"), F.array(_pick(k, "a", "b", "c"), c("source")).alias("tags"), c("lang").alias("language"), _pick(k, "easy", "hard").alias("difficulty"))
    chosen = {"ids": lookup.case_filters(cases, ids=[1, 2, 3, 500]), "tags": lookup.case_filters(cases, tags=["a", "src1"]), "language": lookup.case_filters(cases, language="en", difficulty="hard"), "all": lookup.case_filters(cases)}
    out = None
    for name, rows in chosen.items():
        one = rows.select(F.lit(name).alias("selection"), "case_id")
        out = one if out is None else out.unionByName(one)
    return out


def mode_scopes(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", _pick(c("o_custkey"), "static_expected", "ai_expected", "either").alias("ground_truth_source"))
    out = None
    for mode in ("static_only", "ai_only", "hybrid"):
        one = lookup.in_mode(o, mode).select(F.lit(mode).alias("mode"), "o_orderkey")
        out = one if out is None else out.unionByName(one)
    return out


def usable_analyzers(spark, d):
    s = _table(spark, d, "supplier").select(c("s_name").alias("name"), F.array(_pick(c("s_suppkey"), "python", "c", "cpp", "go", "rust"), _pick(c("s_nationkey"), "java", "c", "sql")).alias("languages"))
    disabled = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000006"]
    return lookup.usable_analyzers(s, ["python", "c"], disabled).select("name")


def forbidden_reasons(spark, d):
    predictions = _table(spark, d, "lineitem").select(c("l_orderkey").alias("case_id"), _line_id().alias("pred_idx"), c("l_returnflag").alias("category"))
    o, k = _table(spark, d, "orders"), c("o_custkey")
    rule = lambda n, category, family: F.struct(F.lit(n).alias("ord"), F.concat(F.lit(f"r{n}-"), (k % 10).cast("string")).alias("reason"), category.alias("category"), family.alias("issue_family"))
    given = F.array(rule(1, F.when(k % 2 == 0, _pick(k, "A", "N", "R")), F.when(k % 4 == 1, F.lit("f"))), rule(2, _pick(k, "N", "R", "A", "X"), F.lit("f")))
    rules = o.where(k % 5 != 0).select(c("o_orderkey").alias("case_id"), F.inline(given))
    return lookup.forbidden_reason(predictions, rules).select("pred_idx", "forbidden_reason")


def tolerant_symbols(spark, d):
    k = c("p_partkey")
    rows = _table(spark, d, "part").select(k, F.when(k % 5 != 0, _pick(k, "run", "A.run", "un")).alias("e"), F.when(k % 7 != 0, _pick(k, "run", "A.run", "x::run", "ns::A.run")).alias("f"))
    return rows.select("p_partkey", code.symbol_matches(c("e"), c("f")).alias("matches"))


def truth_problems(spark, d):
    k, s, n = c("l_partkey"), c("l_suppkey"), c("l_linenumber")
    expected = _table(spark, d, "lineitem").select(
        c("l_orderkey").alias("case_id"), F.concat_ws("-", n, k, s).alias("exp_ord"), (n % 4).alias("id"), _pick(s, "a", "b", "none").alias("file"), F.when(k % 4 != 0, _pick(k, "run", "A.close")).alias("symbol"), c("l_returnflag").alias("category"), (k % 6).cast("int").alias("line"),
        F.when(s % 2 == 0, (s % 7).cast("int")).alias("line_end"), (s % 5 - 1).cast("int").alias("line_tolerance"), _pick(k, "low", "high").alias("severity"), F.when(s % 3 != 0, _pick(s, "info", "medium", "critical", "low")).alias("max_justified_severity"),
    )
    files = _table(spark, d, "orders").select(c("o_orderkey").alias("case_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("path"), (c("o_custkey") % 6 + 1).cast("int").alias("line_count"), F.lit("def close(): pass").alias("text"))
    return metrics.truth_problems(expected, files)


# resolution between files


def include_resolution(spark, d):
    """Pairs of headers share a name; includes name them alone, with their folder, or by a relative path."""
    k, n = c("l_partkey"), c("l_linenumber")
    files = _table(spark, d, "part").select(F.concat(F.lit("src/m"), (c("p_partkey") % 50).cast("string"), F.lit("/f"), F.floor(c("p_partkey") / 2).cast("string"), F.lit(".h")).alias("path"))
    header, folder = F.concat(F.lit("f"), F.floor(k / 2).cast("string"), F.lit(".h")), F.concat(F.lit("m"), (k % 50).cast("string"))
    target = F.when(n % 4 == 0, header).when(n % 4 == 1, F.concat(folder, F.lit("/"), header)).when(n % 4 == 2, F.concat(F.lit(".././../src/"), folder, F.lit("/"), header)).otherwise(F.concat(F.lit("../../../"), header))
    imports = _table(spark, d, "lineitem").select(_line_id().alias("id"), F.concat(F.lit("src/m"), (c("l_suppkey") % 50).cast("string"), F.lit("/x.c")).alias("path"), target.alias("target"))
    return code.resolve_includes(imports, files).select("id", "resolved_path")


def python_imports(spark, d):
    k, s, n = c("l_partkey"), c("l_suppkey"), c("l_linenumber")
    package = lambda x: F.concat(F.lit("pkg"), (x % 20).cast("string"))
    p = _table(spark, d, "part")
    files = p.select(F.concat(package(c("p_partkey")), F.lit("/m"), c("p_partkey").cast("string"), F.lit(".py")).alias("path")).union(p.select(F.concat(package(c("p_partkey")), F.lit("/__init__.py"))).distinct())
    module = F.concat(F.lit("m"), k.cast("string"))
    target = F.when(n % 5 == 0, F.concat(package(k), F.lit("."), module)).when(n % 5 == 1, F.concat(package(k), F.lit("."), module, F.lit(".name"))).when(n % 5 == 2, F.concat(F.lit("."), module)).when(n % 5 == 3, F.lit("os.path")).otherwise(F.concat(F.lit(".."), package(k), F.lit("."), module))
    imports = _table(spark, d, "lineitem").select(_line_id().alias("id"), n.alias("ord"), F.concat(package(s), F.lit("/user.py")).alias("path"), target.alias("target"))
    return code.resolve_python_imports(imports, files).select("id", "resolved_path")


def test_regions(spark, d):
    k = c("p_partkey")
    targets = _table(spark, d, "part").select(k.alias("target"), F.concat(F.lit("src/f"), (k % 100).cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("Run"), (k % 7).cast("string")).alias("name"))
    j = c("s_suppkey")
    tests = _table(spark, d, "supplier").select(F.concat(F.lit("t/"), j.cast("string"), F.lit(".py")).alias("test_path"), F.concat(F.lit("src/f"), (j % 100).cast("string"), F.lit(".py")).alias("source_path"))
    symbols = _table(spark, d, "supplier").where(j % 3 != 0).select(F.concat(F.lit("t/"), j.cast("string"), F.lit(".py")).alias("path"), F.posexplode(F.sequence(j % 4, j % 4 + 3)).alias("p", "x"))
    symbols = symbols.select("path", F.concat(F.lit("test_rUN"), c("x").cast("string")).alias("name"), (c("p") * 10 + 5).alias("start"), (c("p") * 10 + 9).alias("end"))
    return code.test_regions(targets, tests, symbols)


# stored records


def attributed_threads(spark, d):
    e = _table(spark, d, "events")
    threads = e.select(F.when(c("event_id") % 6 != 0, c("event_id")).alias("first_comment_id"), (c("event_type") == "click").alias("is_resolved"))
    comments = e.where("event_id % 2 = 0").select(c("event_id").alias("comment_id"), c("user_id").alias("finding_id"), c("ts").alias("published_at"))
    return matching.attributed_threads(threads, comments)


def upserted(spark, d):
    o = _table(spark, d, "orders")
    stored = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.lit("old").alias("version"))
    return matching.upsert(o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("version")), stored, ["o_orderkey"])


def natural_keys(spark, d):
    k = c("p_partkey")
    known = _table(spark, d, "part").where(k % 4 != 0).select(F.concat(F.lit("f"), (k % 90).cast("string")).alias("path"), c("p_brand").alias("qualified_name"), k.alias("symbol_id"))
    rows = _table(spark, d, "lineitem").select(_line_id().alias("id"), F.concat(F.lit("f"), (c("l_partkey") % 100).cast("string")).alias("path"), F.concat(F.lit("Brand#"), (c("l_suppkey") % 60).cast("string")).alias("qualified_name"))
    return matching.with_ids(rows, known, ["path", "qualified_name"], "symbol_id", "caller_id").select("id", "caller_id")


def current_findings(spark, d):
    findings = _table(spark, d, "lineitem").select(_line_id().alias("id"), c("l_orderkey").alias("candidate_id"))
    candidates = _table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(c("o_orderkey").alias("candidate_id"), c("o_custkey").alias("symbol_id"))
    symbols = _table(spark, d, "customer").where("c_custkey % 4 <> 0").select(c("c_custkey").alias("symbol_id"), (c("c_nationkey") + 2).alias("file_id"), c("c_name").alias("qualified_name"))
    files = _table(spark, d, "nation").select(c("n_nationkey").alias("file_id"), c("n_name").alias("path"))
    return matching.current_findings(findings, candidates, symbols, files).select("id", "qualified_name", "path")


def _candidates(spark, d: str) -> DataFrame:
    k = c("o_orderkey")
    return _table(spark, d, "orders").select(k, F.when(k % 3 != 0, c("o_custkey")).alias("symbol_id"), F.concat(F.lit("f"), (k % 40).cast("string")).alias("path"))


def _plan(spark, d: str) -> DataFrame:
    u = _table(spark, d, "customer")
    changes = u.select(_pick(c("c_custkey"), "modified", "added", "unchanged", "removed", "unchanged").alias("status"), c("c_custkey").alias("cur_id"))
    recheck = u.where("c_custkey % 7 = 0").select(c("c_custkey").alias("symbol_id"))
    files = _table(spark, d, "nation").select(F.concat(F.lit("f"), c("n_nationkey").cast("string")).alias("path"))
    return lifecycle.incremental_selection(_candidates(spark, d), changes, recheck, files)


def incremental_plan(spark, d):
    return _plan(spark, d).select("o_orderkey", "selected")


def incremental_counts(spark, d):
    full = lifecycle.incremental_selection(_candidates(spark, d), *[spark.createDataFrame([], "status string, cur_id long, symbol_id long, path string")] * 3, usable=False)
    return lifecycle.incremental_metrics(_plan(spark, d)).withColumn("plan", F.lit("incremental")).unionByName(lifecycle.incremental_metrics(full).withColumn("plan", F.lit("full")))


def memory_states(spark, d):
    k = c("l_partkey")
    rows = _table(spark, d, "lineitem").select(c("l_orderkey").alias("memory_id"), _pick(k, "open", "carried_forward", "resolved", "changed", "superseded").alias("to_status"), c("l_suppkey").cast("string").alias("finding_id"), F.concat(F.lit("e"), k.cast("string")).alias("evidence"), (c("l_suppkey") % 2 == 0).alias("reconfirmed"), c("l_shipdate").alias("occurred_at"), _line_id().alias("id"))
    return lifecycle.current_state(rows)


def _family(key: Column) -> Column:
    return F.concat(F.lit("fam"), key.cast("string"))


def finalized(spark, d):
    """The transitions of a run, and none of a run that is finalized already.

    A customer is a remembered finding of its own family; its orders' remainders are the findings.
    """
    u, o, k = _table(spark, d, "customer"), _table(spark, d, "orders"), c("c_custkey")
    live = u.select(F.concat(F.lit("m"), k.cast("string")).alias("memory_id"), _family(k).alias("family"))
    found = o.where("o_orderkey % 7 = 0").select(F.concat(F.lit("n"), c("o_orderkey").cast("string")).alias("finding_id"), _family(c("o_custkey")).alias("family"), c("o_orderkey").alias("ord"))
    matched = F.when(k % 3 != 2, F.concat(F.lit("n"), (k * 7).cast("string")))
    outcomes = u.where(k % 4 != 3).select(F.concat(F.lit("m"), k.cast("string")).alias("memory_id"), _pick(k, "carried_forward", "changed", "resolved").alias("state"), matched.alias("current_id"))
    done = spark.createDataFrame([("r1",)], "run_id string")
    again, now = (lifecycle.finalize(run, live, found, outcomes, done).withColumn("run", F.lit(run)) for run in ("r1", "r2"))
    return now.unionByName(again)


def reusable_runs(spark, d):
    runs = _table(spark, d, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 100).cast("string").alias("identity"), _pick(c("o_custkey") + c("o_orderkey"), "partial", "running", "succeeded", "failed").alias("status"), c("o_orderdate").alias("completed_at"))
    out = None
    for identity in ("3", "40", "77", "none"):
        one = lifecycle.reusable_run(runs, identity)
        out = one if out is None else out.unionByName(one)
    return out.select("identity", "id", "status")


def scenario_totals(spark, d):
    return lifecycle.scenario_rollup(_table(spark, d, "orders").select((c("o_orderstatus") == "F").alias("passed"), (c("o_custkey") % 9).alias("calls_avoided"), (c("o_orderkey") % 2).alias("unsafe_carry_forward")))


def ablation_variants(spark, d):
    li = _table(spark, d, "lineitem").select(_pick(c("l_linenumber"), "full", "no_callers", "diff_only").alias("variant"), c("l_partkey").alias("tokens"), c("l_suppkey").alias("hits"))
    return lifecycle.by_variant(li, "variant", ["tokens", "hits"])


def publication_plans(spark, d):
    """Each order is a review of its line items; the head of some has moved on since."""
    k = c("l_partkey")
    f = _table(spark, d, "lineitem").select("l_orderkey", _line_id().alias("id"), (k % 5).alias("rank"), F.when(k % 3 != 0, c("l_linenumber")).alias("line"), (c("l_suppkey") % 10 == 0).alias("already_reported"))
    moved = F.when(c("l_orderkey") % 3 == 0, F.lit("h2")).otherwise(F.lit("h1"))
    return lifecycle.publication_plan(f, [F.desc("rank"), c("id")], 1, 2, moved, "h1", ["l_orderkey"]).select("id", "disposition")


def capped_flags(spark, d):
    """The three dearest line items of each part, as a cap per rule would keep them."""
    return capped(_table(spark, d, "lineitem").select("l_partkey", _line_id().alias("id"), "l_extendedprice"), ["l_partkey"], [F.desc("l_extendedprice"), c("id")], 3).select("l_partkey", "id")


# texts


def masked_urls(spark, d):
    k = c("p_partkey")
    text = F.concat(F.lit("clone "), _pick(k, "https", "http", "ssh"), F.lit("://"), F.when(k % 2 == 0, F.concat(F.lit("u:tok"), k.cast("string"), F.lit("@"))).otherwise(F.lit("")), F.lit("host/r@v1 and https://x@y/z"))
    return _table(spark, d, "part").select(k, masked_url(text).alias("text"))


def qualified_names(spark, d):
    k = c("p_partkey")
    return _table(spark, d, "part").select(k, qualified(F.lit("pkg"), F.when(k % 2 == 0, c("p_brand")), c("p_name")).alias("dotted"), qualified(c("p_brand"), c("p_name"), separator="::").alias("scoped"))


def remapped_lines(spark, d):
    return _table(spark, d, "lineitem").select(_line_id().alias("id"), remapped(c("l_linenumber") + 20, c("l_suppkey"), c("l_partkey")).alias("line"))


def rule_notes(spark, d):
    table = {"S105": {"cwe": "CWE-259", "note": "hard-coded password"}, "S608": {"cwe": "CWE-89"}, "nullPointer": {"cwe": "CWE-476", "note": "null dereference"}}
    rule = _pick(c("p_partkey"), "S105", "S608", "nullPointer", "F401")
    return _table(spark, d, "part").select("p_partkey", rule_metadata(rule, table, "cwe").alias("cwe"), rule_metadata(rule, table, "note").alias("note"))


def folder_fingerprints(spark, d):
    return folder_fingerprint(_table(spark, d, "documents").select(F.concat(c("source"), F.lit("/"), c("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256")))


QUERIES = {
    "semgrep_findings": semgrep_findings, "cppcheck_findings": cppcheck_findings, "reviewer_responses": reviewer_responses, "proposal_validity": proposal_validity, "webhook_events": webhook_events,
    "event_selections": event_selections, "case_selections": case_selections, "mode_scopes": mode_scopes, "usable_analyzers": usable_analyzers, "forbidden_reasons": forbidden_reasons, "tolerant_symbols": tolerant_symbols, "truth_problems": truth_problems,
    "include_resolution": include_resolution, "python_imports": python_imports, "test_regions": test_regions,
    "attributed_threads": attributed_threads, "upserted": upserted, "natural_keys": natural_keys, "current_findings": current_findings,
    "incremental_plan": incremental_plan, "incremental_counts": incremental_counts, "memory_states": memory_states, "finalized": finalized, "reusable_runs": reusable_runs, "scenario_totals": scenario_totals, "ablation_variants": ablation_variants, "publication_plans": publication_plans, "capped_flags": capped_flags,
    "masked_urls": masked_urls, "qualified_names": qualified_names, "remapped_lines": remapped_lines, "rule_notes": rule_notes, "folder_fingerprints": folder_fingerprints,
}

_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id"
_TRUTH = """x AS (SELECT l_orderkey AS case_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS exp_ord, l_linenumber % 4 AS id, ['a', 'b', 'none'][l_suppkey % 3 + 1] AS file, CASE WHEN l_partkey % 4 <> 0 THEN ['run', 'A.close'][l_partkey % 2 + 1] END AS symbol, l_returnflag AS category, l_partkey % 6 AS line,
  CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey % 7 END AS line_end, l_suppkey % 5 - 1 AS tol, [1, 3][l_partkey % 2 + 1] AS sev, CASE WHEN l_suppkey % 3 <> 0 THEN [0, 2, 4, 1][l_suppkey % 4 + 1] END AS most FROM lineitem),
f AS (SELECT o_orderkey AS case_id, unnest(['a', 'b']) AS file, o_custkey % 6 + 1 AS n FROM orders),
j AS (SELECT x.*, f.n, coalesce(line_end, line) AS last, row_number() OVER (PARTITION BY x.case_id, id ORDER BY exp_ord) AS by_id, row_number() OVER (PARTITION BY x.case_id, x.file, symbol, category, line ORDER BY exp_ord) AS by_place FROM x LEFT JOIN f ON f.case_id = x.case_id AND f.file = x.file)"""
ORACLES = {
    "semgrep_findings": """SELECT p_partkey AS run_id, 'r' || (p_partkey % 5) AS rule_id, ['security', 'performance', 'unknown'][p_partkey % 3 + 1] AS category, ['high', 'medium', 'low', 'medium'][p_partkey % 4 + 1] AS severity, ['high', 'low', 'medium', 'medium', 'low'][p_partkey % 5 + 1] AS confidence, 'said "no"' AS message, p_size AS start_line, 9 AS end_column, 'CWE-79' AS cwe
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""",
    "cppcheck_findings": """SELECT p_partkey AS run_id, ['nullPointer', 'memleak', 'unusedFunction', 'shiftTooMany', 'odd'][p_partkey % 5 + 1] AS rule_id, ['memory_safety', 'resource_management', 'style', 'undefined_behavior', 'unknown'][p_partkey % 5 + 1] AS category, ['high', 'medium', 'info', 'medium'][p_partkey % 4 + 1] AS severity,
'p < q && r' AS message, 'a&b.c' AS file_path, p_size AS start_line, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END AS start_column, '476' AS cwe FROM part WHERE p_partkey % 13 <> 0""",
    "reviewer_responses": """WITH p AS (SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 9 > 2) SELECT k AS candidate_id, 0 AS finding_idx, 'first' AS title, ['high', 'urgent', 'low'][k % 3 + 1] AS severity, 3 AS start_line, CASE WHEN k % 2 = 1 THEN 'use x' END AS suggested_fix, 0 AS n_evidence FROM p WHERE k % 3 <> 1
UNION ALL SELECT k, 1, 'second', ['high', 'urgent', 'low'][(k + 1) % 3 + 1], p_size, CASE WHEN k % 2 = 0 THEN 'use x' END, 0 FROM p WHERE (k + 1) % 3 <> 1 AND k % 2 = 0 AND k % 5 <> 0""",
    "proposal_validity": f"""WITH x AS (SELECT {_ID}, l_partkey AS k, l_suppkey AS s, l_linenumber AS n, l_orderkey % 2 = 1 AS odd FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT id, CASE WHEN n < 2 OR k % 5 = 0 THEN 'bad_line_range' WHEN s % 4 = 3 THEN 'file_out_of_scope' WHEN k % 4 = 3 THEN 'empty_message' WHEN s % 3 = 2 THEN 'empty_reasoning' WHEN k % 6 = 0 THEN 'no_evidence'
WHEN k % 3 = 2 THEN 'evidence_path_out_of_scope' WHEN k % 4 >= 2 OR (k % 4 = 1 AND odd) THEN 'evidence_not_quoted' WHEN s % 3 = 2 THEN 'evidence_path_out_of_scope' WHEN s % 4 >= 2 OR (s % 4 = 1 AND odd) THEN 'evidence_not_quoted' END AS rejection FROM x""",
    "webhook_events": "SELECT event_id, CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'synchronize' ELSE 'reopened' END AS action, (event_id % 1000)::INT AS number, user_id AS repository_id, 'h' || event_id AS head_sha, 5::BIGINT AS installation_id FROM events WHERE event_type IN ('view', 'click', 'error') AND event_id % 10 <> 3 AND event_id % 17 <> 0",
    "event_selections": "SELECT 'positive' AS selection, event_id FROM events WHERE event_id % 6 < 3 UNION ALL SELECT 'negative', event_id FROM events WHERE event_id % 6 IN (3, 4) UNION ALL SELECT 'both_since', event_id FROM events WHERE event_id % 6 < 5 AND ts >= TIMESTAMP '2024-01-05' UNION ALL SELECT 'explicit', event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'all', event_id FROM events",
    "case_selections": "SELECT 'ids' AS selection, doc_id AS case_id FROM documents WHERE doc_id IN (1, 2, 3, 500) UNION ALL SELECT 'tags', doc_id FROM documents WHERE doc_id % 3 = 0 OR source IN ('a', 'src1') UNION ALL SELECT 'language', doc_id FROM documents WHERE lang = 'en' AND doc_id % 2 = 1 UNION ALL SELECT 'all', doc_id FROM documents",
    "mode_scopes": "SELECT 'static_only' AS mode, o_orderkey FROM orders WHERE o_custkey % 3 <> 1 UNION ALL SELECT 'ai_only', o_orderkey FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT 'hybrid', o_orderkey FROM orders",
    "usable_analyzers": "SELECT s_name AS name FROM supplier WHERE s_name NOT IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000006') AND (s_suppkey % 5 < 2 OR s_nationkey % 3 = 1)",
    "forbidden_reasons": """WITH x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pred_idx, l_returnflag AS cat, o_custkey AS k FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) SELECT pred_idx, CASE WHEN k % 5 = 0 THEN NULL WHEN (k % 2 = 0 AND cat = ['A', 'N', 'R'][k % 3 + 1]) OR k % 4 = 3 THEN 'r1-' || (k % 10) WHEN cat = ['N', 'R', 'A', 'X'][k % 4 + 1] THEN 'r2-' || (k % 10) END AS forbidden_reason FROM x""",
    "tolerant_symbols": "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN ['run', 'A.run', 'un'][p_partkey % 3 + 1] END AS e, CASE WHEN p_partkey % 7 <> 0 THEN ['run', 'A.run', 'x::run', 'ns::A.run'][p_partkey % 4 + 1] END AS f FROM part) SELECT p_partkey, CASE WHEN e IS NULL THEN true WHEN f IS NULL THEN false ELSE f = e OR ends_with(f, '.' || e) OR ends_with(f, '::' || e) END AS matches FROM x",
    "truth_problems": f"""WITH {_TRUTH} SELECT case_id, exp_ord, 'repeated_id' AS error FROM j WHERE by_id > 1 UNION ALL SELECT case_id, exp_ord, 'repeated_place' FROM j WHERE by_place > 1 UNION ALL SELECT case_id, exp_ord, 'missing_file' FROM j WHERE n IS NULL UNION ALL SELECT case_id, exp_ord, 'bad_line_range' FROM j WHERE line < 1 OR last < line OR last > n
UNION ALL SELECT case_id, exp_ord, 'negative_tolerance' FROM j WHERE tol < 0 UNION ALL SELECT case_id, exp_ord, 'unknown_symbol' FROM j WHERE n IS NOT NULL AND symbol = 'run' UNION ALL SELECT case_id, exp_ord, 'severity_over_maximum' FROM j WHERE sev > most""",
    "include_resolution": f"""WITH f AS (SELECT 'src/m' || (p_partkey % 50) || '/f' || (p_partkey // 2) || '.h' AS path, 'f' || (p_partkey // 2) || '.h' AS name FROM part), u AS (SELECT name, min(path) AS far FROM f GROUP BY 1 HAVING count(*) = 1),
i AS (SELECT {_ID}, l_linenumber % 4 AS t, 'f' || (l_partkey // 2) || '.h' AS name, 'src/m' || (l_partkey % 50) || '/f' || (l_partkey // 2) || '.h' AS own, 'src/m' || (l_suppkey % 50) || '/f' || (l_partkey // 2) || '.h' AS near FROM lineitem)
SELECT id, CASE t WHEN 0 THEN coalesce(n.path, u.far) WHEN 3 THEN NULL ELSE o.path END AS resolved_path FROM i LEFT JOIN f n ON n.path = i.near LEFT JOIN f o ON o.path = i.own LEFT JOIN u ON u.name = i.name""",
    "python_imports": f"""WITH i AS (SELECT {_ID}, l_linenumber % 5 AS t, 'pkg' || (l_partkey % 20) || '/m' || l_partkey || '.py' AS own, 'pkg' || (l_suppkey % 20) || '/__init__.py' AS pkg, l_partkey % 20 = l_suppkey % 20 AS near FROM lineitem) SELECT id, CASE WHEN t = 3 THEN NULL WHEN t = 2 AND NOT near THEN pkg ELSE own END AS resolved_path FROM i""",
    "test_regions": """WITH x AS (SELECT p_partkey AS target, s_suppkey AS j, CASE WHEN p_partkey % 7 BETWEEN s_suppkey % 4 AND s_suppkey % 4 + 3 THEN p_partkey % 7 - s_suppkey % 4 ELSE 0 END AS p FROM part JOIN supplier ON p_partkey % 100 = s_suppkey % 100) SELECT target, 't/' || j || '.py' AS test_path, CASE WHEN j % 3 <> 0 THEN 'test_rUN' || (j % 4 + p) END AS symbol, CASE WHEN j % 3 <> 0 THEN p * 10 + 5 ELSE 1 END::INT AS start, CASE WHEN j % 3 <> 0 THEN p * 10 + 9 ELSE 30 END::INT AS "end" FROM x""",
    "attributed_threads": "SELECT user_id AS finding_id, arg_max(event_type = 'click', (ts, event_id)) AS is_resolved FROM events WHERE event_id % 2 = 0 AND event_id % 6 <> 0 GROUP BY 1",
    "upserted": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0",
    "natural_keys": f"WITH k AS (SELECT 'f' || (p_partkey % 90) AS path, p_brand AS name, max(p_partkey) AS caller_id FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2), x AS (SELECT {_ID}, 'f' || (l_partkey % 100) AS path, 'Brand#' || (l_suppkey % 60) AS name FROM lineitem) SELECT id, caller_id FROM x LEFT JOIN k USING (path, name)",
    "current_findings": f"SELECT {_ID}, c_name AS qualified_name, coalesce(n_name, '') AS path FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 5 <> 0 LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0 LEFT JOIN nation ON n_nationkey = c_nationkey + 2",
    "incremental_plan": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 < 2 OR c_custkey % 7 = 0) ELSE o_orderkey % 40 IN (SELECT n_nationkey FROM nation) END AS selected FROM orders",
    "incremental_counts": "WITH x AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 < 2 OR c_custkey % 7 = 0) ELSE o_orderkey % 40 IN (SELECT n_nationkey FROM nation) END AS s FROM orders) SELECT 'incremental' AS plan, count(*) AS candidates, count(*) FILTER (s) AS selected, count(*) FILTER (NOT s) AS provider_calls_avoided FROM x UNION ALL SELECT 'full', count(*), count(*), 0 FROM x",
    "memory_states": f"""WITH x AS (SELECT l_orderkey AS memory_id, ['open', 'carried_forward', 'resolved', 'changed', 'superseded'][l_partkey % 5 + 1] AS st, l_suppkey::VARCHAR AS f, 'e' || l_partkey AS e, l_suppkey % 2 = 0 AS r, l_shipdate AS t, {_ID} FROM lineitem), g AS (SELECT memory_id, arg_max(st, (t, id)) AS status, arg_max(f, (t, id)) AS f, arg_max(e, (t, id)) AS e, arg_max(e, (t, id)) FILTER (r) AS kept FROM x GROUP BY 1)
SELECT memory_id, status, CASE WHEN status NOT IN ('resolved', 'superseded') THEN f END AS finding_id, coalesce(kept, e) AS evidence FROM g""",
    "finalized": """WITH oc AS (SELECT c_custkey AS k, ['carried_forward', 'changed', 'resolved'][c_custkey % 3 + 1] AS state, CASE WHEN c_custkey % 3 <> 2 THEN 'n' || (c_custkey * 7) END AS cur FROM customer WHERE c_custkey % 4 <> 3), fr AS (SELECT o_custkey AS fam, max(o_orderkey) AS o FROM orders WHERE o_orderkey % 7 = 0 AND 'n' || o_orderkey NOT IN (SELECT cur FROM oc WHERE cur IS NOT NULL) GROUP BY 1),
ov AS (SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM oc WHERE state = 'resolved') AND c_custkey IN (SELECT fam FROM fr)) SELECT 'm' || k AS memory_id, state AS to_status, CASE WHEN state <> 'resolved' THEN cur END AS finding_id, 'r2' AS run FROM oc WHERE k NOT IN (SELECT k FROM ov)
UNION ALL SELECT 'm' || k, 'superseded', NULL, 'r2' FROM ov UNION ALL SELECT sha256('r2' || chr(31) || 'fam' || fam), 'open', 'n' || o, 'r2' FROM fr""",
    "reusable_runs": "WITH x AS (SELECT o_orderkey AS id, (o_custkey % 100)::VARCHAR AS identity, ['partial', 'running', 'succeeded', 'failed'][(o_custkey + o_orderkey) % 4 + 1] AS status, o_orderdate FROM orders) SELECT identity, id, status FROM x WHERE identity IN ('3', '40', '77') AND status IN ('succeeded', 'running') QUALIFY row_number() OVER (PARTITION BY identity ORDER BY status = 'succeeded' DESC, o_orderdate DESC, id) = 1",
    "scenario_totals": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, sum(o_custkey % 9)::BIGINT AS calls_avoided, sum(o_orderkey % 2)::BIGINT AS unsafe_carry_forward FROM orders",
    "ablation_variants": "SELECT ['full', 'no_callers', 'diff_only'][l_linenumber % 3 + 1] AS variant, count(*) AS n, sum(l_partkey)::BIGINT AS tokens, sum(l_suppkey)::BIGINT AS hits FROM lineitem GROUP BY 1",
    "publication_plans": f"""WITH a AS (SELECT {_ID}, l_orderkey, l_partkey % 5 AS rk, l_partkey % 3 <> 0 AS mp, l_suppkey % 10 = 0 AS kn FROM lineitem), b AS (SELECT *, mp AND NOT kn AND row_number() OVER (PARTITION BY l_orderkey, kn, mp ORDER BY rk DESC, id) <= 1 AS inl FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kn, inl ORDER BY rk DESC, id) AS r FROM b)
SELECT id, CASE WHEN l_orderkey % 3 = 0 THEN 'stale' WHEN kn THEN 'already_reported' WHEN inl THEN 'inline' WHEN r <= 2 THEN 'summary' ELSE 'omitted' END AS disposition FROM c""",
    "capped_flags": f"SELECT l_partkey, {_ID} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, id) <= 3",
    "masked_urls": r"""WITH x AS (SELECT p_partkey, 'clone ' || ['https', 'http', 'ssh'][p_partkey % 3 + 1] || '://' || CASE WHEN p_partkey % 2 = 0 THEN 'u:tok' || p_partkey || '@' ELSE '' END || 'host/r@v1 and https://x@y/z' AS t FROM part) SELECT p_partkey, regexp_replace(t, '(https?://)[^/@\s]+@', '\1***@', 'g') AS text FROM x""",
    "qualified_names": "SELECT p_partkey, concat_ws('.', 'pkg', CASE WHEN p_partkey % 2 = 0 THEN p_brand END, p_name) AS dotted, concat_ws('::', p_brand, p_name) AS scoped FROM part",
    "remapped_lines": f"SELECT {_ID}, l_linenumber + 20 - l_suppkey + l_partkey AS line FROM lineitem",
    "rule_notes": "SELECT p_partkey, ['CWE-259', 'CWE-89', 'CWE-476', NULL][p_partkey % 4 + 1] AS cwe, ['hard-coded password', NULL, 'null dereference', NULL][p_partkey % 4 + 1] AS note FROM part",
    "folder_fingerprints": "WITH x AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents), b AS (SELECT substr(sha256(path), 1, 3) AS b, sha256(string_agg(concat_ws(chr(31), path, h), chr(10) ORDER BY path)) AS h FROM x GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint FROM b",
}
