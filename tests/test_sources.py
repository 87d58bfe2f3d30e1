"""Parsers on hand-written reports, and the streaming operators."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from findweave.sources import diff, export, reports, repository
from findweave.streaming import ingest


def test_patch_lines_and_errors(spark):
    files = spark.createDataFrame([("a", "@@ -3 +5,2 @@\n x\n+y\n-z\n\\ No newline at end of file"), ("b", "+early"), ("c", "@@ bad @@\n x"), ("d", "@@ -1 +1 @@\n?x"), ("e", None), ("f", "")], "path string, patch string")
    rows = diff.patch_lines(files).orderBy("path", "pos").collect()
    assert [(r["line_type"], r["old_line"], r["new_line"], r["content"]) for r in rows if r["path"] == "a"] == [("context", 3, 5, "x"), ("addition", None, 6, "y"), ("deletion", 4, None, "z")]
    assert {r["path"]: r["error"] for r in rows if r["error"]} == {"b": "content before first hunk", "c": "malformed hunk header", "d": "unknown marker"}


def test_semgrep_and_cppcheck(spark):
    report = {"results": [{"check_id": "python.lang.eval", "path": "a.py", "start": {"line": 3, "col": 1}, "end": {"line": 4, "col": 2}, "extra": {"message": "m", "severity": "ERROR", "metadata": {"category": "security", "confidence": "HIGH", "cwe": "CWE-95"}}},
                          {"check_id": "x", "path": "b.py", "start": {"line": 1, "col": 1}, "end": {"line": 1, "col": 2}, "extra": {"message": "m", "severity": "?", "metadata": {"category": "odd"}}}]}
    got = reports.semgrep(spark.createDataFrame([("r", json.dumps(report))], "run_id string, report string")).orderBy("file_path").collect()
    assert [(g["rule_id"], g["category"], g["severity"], g["confidence"], g["cwe"]) for g in got] == [("eval", "security", "high", "high", "CWE-95"), ("x", "unknown", "medium", "medium", None)]
    xml = '<results><errors><error id="nullPointer" severity="error" msg="p &lt; q" cwe="476"><location file="a.c" line="7" column="0"/><location file="b.c" line="9"/></error><error id="note" severity="information" msg="none"/></errors></results>'
    got = reports.cppcheck(spark.createDataFrame([("r", xml)], "run_id string, report string")).collect()
    assert [(g["rule_id"], g["category"], g["message"], g["file_path"], g["start_line"], g["cwe"]) for g in got] == [("nullPointer", "memory_safety", "p < q", "a.c", 7, "476")]


def test_reviewer_responses(spark):
    good = {"title": "t", "message": "m", "category": "security", "severity": "high", "confidence": "low", "file_path": "a", "start_line": 1, "end_line": 2, "reasoning_summary": "r", "evidence": [{"file_path": "a", "start_line": 1, "end_line": 1, "quoted_text": " x = 1 "}], "impact": ""}
    rows = [("c1", json.dumps({"findings": [good, {**good, "severity": "awful"}, {**good, "title": None}]})), ("c2", "not json"), ("c3", json.dumps({"findings": [{**good, "evidence": []}]}))]
    found = reports.reviewer_findings(spark.createDataFrame(rows, "candidate_id string, raw_json string"))
    contexts = spark.createDataFrame([("c1", ["a"], "x = 1", "d"), ("c3", ["a"], "y", "d")], "candidate_id string, allowed_file_paths array<string>, context_text string, diff_excerpt string")
    got = {r["candidate_id"]: (r["rejection"], r["impact"]) for r in reports.validity(found, contexts).collect()}
    assert got == {"c1": (None, None), "c3": ("no_evidence", None)}


def test_webhooks(spark):
    body = {"action": "opened", "pull_request": {"number": 4, "base": {"sha": "b"}, "head": {"sha": "h"}}, "repository": {"id": 9}}
    df = spark.createDataFrame([(json.dumps(body),), (json.dumps({**body, "action": "closed"}),), ("{",)], "body string")
    assert [(r["number"], r["repository_id"], r["head_sha"]) for r in reports.pull_request_events(df).collect()] == [(4, 9, "h")]


def test_repository(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\nclass A:\n    def f(self):\n        return g()\n")
    (tmp_path / "pkg" / "test_a.h").write_text("// DO NOT EDIT\nnamespace x {}\n")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "v.py").write_text("x = 1\n")
    tree = repository.read_tree(spark, f"file:{tmp_path}")
    got = {r["relative_path"]: (r["language"], r["is_test"], r["is_generated"]) for r in repository.inventory(tree).collect()}
    assert got == {"pkg/a.py": ("python", False, False), "pkg/test_a.h": ("cpp", True, True)}
    parsed = repository.parse_python(tree.where("relative_path = 'pkg/a.py'")).collect()
    assert {(r["entry"], r["name"], r["qualified_name"], r["parent"]) for r in parsed} == {("import", "os", None, None), ("symbol", "A", "A", None), ("symbol", "f", "A.f", "A"), ("call", "g", None, "A.f")}
    c = spark.createDataFrame([("a.c", bytearray(b"int x;\nstatic int add(int a) {\n  if (a) { return a; }\n}\n"))], "relative_path string, content binary")
    assert [(r["qualified_name"], r["start_line"]) for r in repository.c_functions(c).collect()] == [("add", 2)]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "me", "secret")], "b int, actor string, a string")
    line = json.loads(df.select(export.json_line(df, hashed=("a",), left_out=("actor",)).alias("l")).first()["l"])
    assert list(line) == ["a_sha256", "b"] and len(line["a_sha256"]) == 64
    export.write_jsonl(df, f"{tmp_path}/out")
    assert "# t" in export.markdown_report("t", df) and '"b": 1' in export.json_report({"s": df})


def test_streaming(spark, tmp_path):
    cols = "source string, event_type string, external_event_id string, ts timestamp, k string, state string"
    rows = spark.createDataFrame([("s", "e", "1", "k1", "open"), ("s", "e", "1", "k1", "open"), ("s", "e", "2", "k1", "resolved"), ("s", "e", "3", "k2", "resolved")], "source string, event_type string, external_event_id string, k string, state string")
    rows = rows.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).select("source", "event_type", "external_event_id", "ts", "k", "state")
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(cols).parquet(f"{tmp_path}/in")

    def settled(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(settled(ingest.deduplicated(ingest.timed(stream())), "deduped")) == 3
    assert {(r["k"], r["previous"], r["now"]) for r in settled(ingest.state_changes(stream(), "k", "state", "ts", "open"), "changes")} == {("k1", "open", "resolved"), ("k2", "open", "resolved")}
    for n in range(2):  # delivered twice, stored once
        ingest.append_absent(stream(), f"{tmp_path}/table", ingest.IDENTITY, f"{tmp_path}/cp{n}").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/table").count() == 3
    said = spark.createDataFrame([("/x useful",), ("thanks",)], "body string")
    assert sorted(r["event_type"] for r in ingest.commands_and_replies(said, "/x ").collect()) == ["comment_reply", "comment_reply", "explicit_command"]
    assert [r["event_type"] for r in ingest.lifecycle_events(spark.createDataFrame([("changed",), ("new",)], "state string")).collect()] == ["finding_code_changed"]
