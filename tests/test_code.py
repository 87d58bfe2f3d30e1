"""Import and call resolution, context regions, lifecycle state, lookups and output texts on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from findweave import schemas
from findweave.functions import output
from findweave.operators import code, dedupe, lifecycle
from findweave.plans import lookup
from findweave.sources import repository


def test_python_imports(spark):
    files = spark.createDataFrame([("pkg/__init__.py",), ("pkg/a.py",), ("pkg/sub/b.py",), ("x.c",)], "path string")
    imports = spark.createDataFrame([("pkg/sub/b.py", 1, "..a"), ("pkg/sub/b.py", 2, "pkg.a.thing"), ("pkg/a.py", 3, "os"), ("pkg/a.py", 4, "pkg"), ("pkg/a.py", 5, ".sub.b")], "path string, ord int, target string")
    got = {r["ord"]: r["resolved_path"] for r in code.resolve_python_imports(imports, files).collect()}
    assert got == {1: "pkg/a.py", 2: "pkg/a.py", 3: None, 4: "pkg/__init__.py", 5: "pkg/sub/b.py"}


def test_includes(spark):
    files = spark.createDataFrame([("src/a.c",), ("src/a.h",), ("inc/lib/z.h",), ("one/d.h",), ("two/d.h",)], "path string")
    imports = spark.createDataFrame([("src/a.c", 1, "a.h"), ("src/a.c", 2, "lib/z.h"), ("src/a.c", 3, "d.h"), ("src/a.c", 4, "../one/d.h"), ("src/a.c", 5, "../../x.h")], "path string, ord int, target string")
    got = {r["ord"]: r["resolved_path"] for r in code.resolve_includes(imports, files).collect()}
    assert got == {1: "src/a.h", 2: "inc/lib/z.h", 3: None, 4: "one/d.h", 5: None}


def test_symbol_matching_and_regions(spark):
    rows = spark.createDataFrame([(None, "x"), ("f", None), ("f", "f"), ("f", "A.f"), ("f", "N::f"), ("A.f", "f")], "e string, f string")
    assert [r[0] for r in rows.select(code.symbol_matches(F.col("e"), F.col("f"))).collect()] == [True, False, True, True, True, False]
    targets = spark.createDataFrame([(1, "a.py", "Run"), (2, "b.py", "x")], "target int, path string, name string")
    tests = spark.createDataFrame([("test_a.py", "a.py"), ("test_b.py", "b.py")], "test_path string, source_path string")
    symbols = spark.createDataFrame([("test_a.py", "setup", 1, 3), ("test_a.py", "test_run", 5, 9)], "path string, name string, start int, end int")
    got = {r["target"]: (r["symbol"], r["start"], r["end"]) for r in code.test_regions(targets, tests, symbols).collect()}
    assert got == {1: ("test_run", 5, 9), 2: (None, 1, 30)}


def test_regions_are_chosen_once_for_equal_targets(spark):
    """Two kinds of targets, many of each: symbols meet tests once a kind; one target may name two files."""
    targets = spark.range(200).selectExpr("id AS target", "'a.py' AS path", "IF(id % 2 = 0, 'Run', 'Stop') AS name").unionByName(spark.createDataFrame([(0, "b.py", "Stop")], "target long, path string, name string"))
    tests = spark.createDataFrame([("t1", "a.py"), ("t2", "a.py"), ("t2", "b.py")], "test_path string, source_path string")
    symbols = spark.createDataFrame([("t2", "stop_it", 1, 2), ("t2", "run_it", 3, 4)], "path string, name string, start int, end int")
    found = code.test_regions(targets, tests, symbols)
    got = {(r["target"], r["test_path"]): (r["symbol"], r["start"], r["end"]) for r in found.collect()}
    assert got == {**{(k, "t1"): (None, 1, 30) for k in range(200)}, **{(k, "t2"): ("stop_it", 1, 2) if k % 2 or k == 0 else ("run_it", 3, 4) for k in range(200)}}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [target" not in plan.split("Join")[0]  # no grouping of all pairs of targets and tests


def test_enrich_and_merge(spark):
    f = spark.createDataFrame([("1", "a.py", 3, 3, "bug", "ruff", "F1", "high", "high"), ("2", "a.py", 3, 4, "bug", "semgrep", "S1", "medium", "high"), ("3", "a.py", 3, 3, "bug", "ruff", "F2", "high", "high"), ("4", "b.py", 9, 9, "bug", "ruff", "F1", "low", "low")], "id string, file_path string, start_line int, end_line int, category string, source_analyzer string, rule_id string, severity string, confidence string")
    s = spark.createDataFrame([("a.py", "s1", "f", 1, 10), ("a.py", "s2", "g", 2, 5)], "path string, id string, name string, start int, end int")
    changed = spark.createDataFrame([("a.py", 4)], "path string, line int")
    rich = dedupe.enrich(f, s, changed)
    got = {r["id"]: (r["symbol_id"], r["symbol_name"], r["is_on_changed_line"], r["is_in_changed_symbol"]) for r in rich.collect()}
    assert got == {"1": ("s2", "g", False, True), "2": ("s2", "g", True, True), "3": ("s2", "g", False, True), "4": (None, None, False, False)}
    merged = {r["id"]: (r["group_id"], r["is_primary"], r["n_sources"]) for r in dedupe.merge(rich).collect()}
    # 1 and 3 are two rules of one analyzer, but both overlap 2
    assert merged == {"1": ("1", False, 3), "2": ("1", True, 3), "3": ("1", False, 3), "4": ("4", True, 1)}


def test_finalize_and_state(spark):
    live = spark.createDataFrame([("m1", "fam1"), ("m2", "fam2")], "memory_id string, family string")
    found = spark.createDataFrame([("f1", "fam1", 1), ("f2", "fam3", 2), ("f3", "fam3", 3)], "finding_id string, family string, ord int")
    outcomes = spark.createDataFrame([("m2", "carried_forward", None)], "memory_id string, state string, current_id string")
    done = spark.createDataFrame([("r0",)], "run_id string")
    got = {(r["to_status"], r["finding_id"]) for r in lifecycle.finalize("r1", live, found, outcomes, done).collect()}
    assert got == {("superseded", None), ("open", "f1"), ("open", "f3"), ("carried_forward", None)}
    assert lifecycle.finalize("r0", live, found, outcomes, done).count() == 0
    log = spark.createDataFrame([("m", 1, "open", "f1", "e1", True, 1), ("m", 2, "carried_forward", "f1", "e2", False, 2), ("n", 3, "resolved", "f9", "e", True, 3)], "memory_id string, id int, to_status string, finding_id string, evidence string, reconfirmed boolean, occurred_at int")
    assert {r["memory_id"]: tuple(r)[1:] for r in lifecycle.current_state(log).collect()} == {"m": ("carried_forward", "f1", "e1"), "n": ("resolved", None, "e")}
    runs = spark.createDataFrame([("a", "x", "partial", 9), ("b", "x", "running", 8), ("c", "x", "succeeded", 1)], "id string, identity string, status string, completed_at int")
    assert lifecycle.reusable_run(runs, "x").first()["id"] == "c" and lifecycle.reusable_run(runs, "y").count() == 0


def test_selection_and_plan(spark):
    cand = spark.createDataFrame([(1, "s1", "a"), (2, "s2", "a"), (3, None, "a"), (4, None, "b")], "id int, symbol_id string, path string")
    changes = spark.createDataFrame([("p", "s1", "modified")], "prev_id string, cur_id string, status string")
    recheck = spark.createDataFrame([("s9",)], "symbol_id string")
    files = spark.createDataFrame([("a",)], "path string")
    got = lifecycle.incremental_selection(cand, changes, recheck, files)
    assert {r["id"]: r["selected"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: False}
    assert tuple(lifecycle.incremental_metrics(got).first()) == (4, 2, 2)
    found = spark.createDataFrame([(1, 5, False), (2, None, False), (3, 7, True), (4, 1, False)], "id int, line int, already_reported boolean")
    plan = lambda head: {r["id"]: r["disposition"] for r in lifecycle.publication_plan(found, [F.col("id")], 1, 1, head, "h").collect()}
    assert plan("h") == {1: "inline", 2: "summary", 3: "already_reported", 4: "omitted"} and set(plan("x").values()) == {"stale"}
    s = spark.createDataFrame([(True, 2, 0), (False, 1, 1)], "passed boolean, calls_avoided int, unsafe_carry_forward int")
    assert tuple(lifecycle.scenario_rollup(s).first()) == (2, 1, 3, 1)
    assert {r["v"]: r["t"] for r in lifecycle.by_variant(spark.createDataFrame([("n", 1), ("n", 2), ("o", 5)], "v string, t int"), "v", ["t"]).collect()} == {"n": 3, "o": 5}


def test_lookups(spark):
    assert all(spec.table in schemas.DDL and set(spec.by) <= set(schemas.schema(spec.table).names) for spec in lookup.LOOKUPS.values())
    tables = {t: spark.createDataFrame([], schemas.schema(t)) for t in schemas.DDL}
    found = lookup.Catalog(tables)
    for name, spec in lookup.LOOKUPS.items():
        assert found.find(name, **{c: "x" for c in spec.by if c not in ("number",)}).count() == 0
    with pytest.raises(TypeError):
        found.find("file")
    assert found.negative_findings().count() == 0 and found.positive_findings().count() == 0
    runs = spark.createDataFrame([("a", "p", "i", "succeeded", None), ("b", "p", "i", "failed", None)], schemas.schema("review_runs"))
    assert [r["id"] for r in lookup.Catalog({"review_runs": runs}).find("succeeded_review", pull_request_id="p").collect()] == ["a"]
    cases = spark.createDataFrame([("c1", ["x"], "python", "easy"), ("c2", ["y"], "c", "hard")], "case_id string, tags array<string>, language string, difficulty string")
    assert [r["case_id"] for r in lookup.case_filters(cases, tags=["x", "z"], difficulty="easy").collect()] == ["c1"]
    events = spark.createDataFrame([("useful", "explicit_command", 5), ("negative_hint", "reaction_added", 9)], "normalized_signal string, event_type string, occurred_at int")
    assert lookup.event_filters(events, positive=True).count() == 1 and lookup.event_filters(events, positive=True, negative=True, since=6).count() == 1 and lookup.event_filters(events, explicit=True).count() == 1
    truth = spark.createDataFrame([("static_expected",), ("either",), ("ai_expected",)], "ground_truth_source string")
    assert [lookup.in_mode(truth, m).count() for m in ("static_only", "ai_only", "full")] == [2, 2, 3]
    tools = spark.createDataFrame([("ruff", ["python"]), ("cppcheck", ["c", "cpp"])], "name string, languages array<string>")
    assert [r["name"] for r in lookup.usable_analyzers(tools, ["c", "python"], ["ruff"]).collect()] == ["cppcheck"]
    pred = spark.createDataFrame([("c", 1, "style"), ("c", 2, "bug"), ("d", 1, "bug")], "case_id string, pred_idx int, category string")
    rules = spark.createDataFrame([("c", 1, "no style", "style", None), ("c", 2, "nothing", None, None), ("c", 0, "family", None, "fam")], "case_id string, ord int, reason string, category string, issue_family string")
    assert {(r["case_id"], r["pred_idx"]): r["forbidden_reason"] for r in lookup.forbidden_reason(pred, rules).collect()} == {("c", 1): "no style", ("c", 2): "nothing", ("d", 1): None}
    bad = schemas.violations(spark.createDataFrame([("1", "p", "analyzer", "odd", 0)], schemas.schema("analyzer_executions")), "analyzer_executions", {"status": ("succeeded", "failed")})
    assert bad.count() == 1


def test_output(spark, tmp_path):
    assert output.config_fingerprint({"b": 1, "a": 2}) == output.config_fingerprint({"a": 2, "b": 1})
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    assert output.folder_fingerprint(files).first() == output.folder_fingerprint(files.orderBy("path")).first()
    row = spark.range(1).select(output.remapped(F.lit(12), F.lit(10), F.lit(30)).alias("l"), output.rule_metadata(F.lit("S1"), {"S1": {"cwe": "CWE-1"}}, "cwe").alias("c")).first()
    assert tuple(row) == (32, "CWE-1")
    wanted = spark.createDataFrame([("c1", "a")], "commit string, relative_path string")
    tree = spark.createDataFrame([("c1", "a", "x"), ("c2", "a", "y")], "commit string, relative_path string, content string")
    assert [r["content"] for r in repository.at_commit(tree, wanted).collect()] == ["x"]


def test_cases_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "case.yaml").write_text("id: one\ntags: [a]\nexpected:\n- id: e\n")
    assert repository.load_cases(spark, str(tmp_path)).first()["case_id"] == "one"


def test_small_joins_and_truth(spark):
    from findweave.operators import matching, metrics, snapshots
    from findweave.sources import drops

    threads = spark.createDataFrame([(1, True), (2, False), (None, True)], "first_comment_id int, is_resolved boolean")
    comments = spark.createDataFrame([(1, "f", 1), (2, "f", 2)], "comment_id int, finding_id string, published_at int")
    assert [tuple(r) for r in matching.attributed_threads(threads, comments).collect()] == [("f", False)]
    known = spark.createDataFrame([("a", "f", 1), ("a", "f", 2)], "path string, name string, id int")
    rows = spark.createDataFrame([("a", "f"), ("a", "g")], "path string, name string")
    assert {r["name"]: r["symbol"] for r in matching.with_ids(rows, known, ["path", "name"], "id", "symbol").collect()} == {"f": 2, "g": None}
    got = matching.current_findings(spark.createDataFrame([(1, 1), (2, 9)], "id int, candidate_id int"), spark.createDataFrame([(1, "s")], "candidate_id int, symbol_id string"), spark.createDataFrame([("s", "x", "q")], "symbol_id string, file_id string, qualified_name string"), spark.createDataFrame([("x", "a.py")], "file_id string, path string"))
    assert {r["id"]: r["path"] for r in got.collect()} == {1: "a.py", 2: ""}
    cols = "case_id string, exp_ord int, id string, file string, symbol string, category string, line int, line_end int, line_tolerance int, severity string, max_justified_severity string"
    expected = spark.createDataFrame([("c", 1, "a", "f", "run", "bug", 1, None, 3, "low", "high"), ("c", 2, "a", "f", "run", "bug", 1, None, 3, "low", None), ("c", 3, "b", "g", None, "bug", 5, 4, -1, "high", "low"), ("c", 4, "d", "f", "A.gone", "bug", 9, 99, 0, None, None)], cols)
    files = spark.createDataFrame([("c", "f", 10, "def run(): pass")], "case_id string, path string, line_count int, text string")
    got = {(r["exp_ord"], r["error"]) for r in metrics.truth_problems(expected, files).collect()}
    assert got == {(2, "repeated_id"), (2, "repeated_place"), (3, "missing_file"), (3, "bad_line_range"), (3, "negative_tolerance"), (3, "severity_over_maximum"), (4, "bad_line_range"), (4, "unknown_symbol")}
    memory = spark.createDataFrame([(1, None, "a", True), (2, None, "b", True), (3, "s", "a", True)], "id int, symbol_id string, path string, evidence_holds boolean")
    changes = spark.createDataFrame([("s", "t", "moved")], "prev_id string, cur_id string, status string")
    out = snapshots.before_review(memory, changes, spark.createDataFrame([("a", "D")], "path string, change string"))
    assert {r["id"]: (r["disposition"], r["reason"]) for r in out.collect()} == {1: ("resolved", "file_deleted"), 2: ("recheck", "module_level"), 3: ("carry_forward", "symbol_moved")}
    pulls = spark.createDataFrame([(1, "closed", None, "2024-01-01"), (2, "open", None, None), (3, "closed", "2024-01-02", "2024-01-02")], "id int, state string, merged_at string, closed_at string")
    assert {r["pull_request_id"]: r["event_type"] for r in drops.lifecycle_of_pull_request(pulls).collect()} == {1: "pr_closed", 3: "pr_merged"}


def test_pages(spark, tmp_path):
    from findweave.sources import drops

    for n in (1, 2):
        (tmp_path / f"page-{n}.json").write_text(f'[{{"id": {n}, "path": "a", "original_line": 4, "body": "b", "actor_type": "User"}}, {{"id": {n}0, "in_reply_to_id": 1, "body": "c", "actor_type": "Bot"}}]')
    assert drops.read_pages(spark, str(tmp_path), "comments").count() == 4
    first = drops.read_pages(spark, str(tmp_path), "comments", 1)
    assert first.count() == 2 and drops.human(first).count() == 1
    assert [(r["id"], r["line"]) for r in drops.attributable(first).collect()] == [(1, 4)]


def test_reaction_stream(spark, tmp_path):
    from findweave.streaming import ingest

    cols = "comment_id long, polled_at timestamp, reaction_ids array<long>, actor_types array<string>"
    rows = spark.createDataFrame([(1, [5, 6], ["User", "Bot"], 0), (1, [7], ["User"], 60)], "comment_id long, reaction_ids array<long>, actor_types array<string>, s int")
    rows.select("comment_id", F.timestamp_seconds("s").alias("polled_at"), "reaction_ids", "actor_types").coalesce(1).write.parquet(f"{tmp_path}/in")
    q = ingest.reaction_changes(spark.readStream.schema(cols).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("reactions").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert [(r["reaction_id"], r["event_type"]) for r in spark.table("reactions").orderBy("polled_at", "event_type").collect()] == [(5, "reaction_added"), (7, "reaction_added"), (5, "reaction_removed")]
