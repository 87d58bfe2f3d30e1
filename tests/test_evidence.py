"""Tolerant snippets and the parse cache."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from findweave.functions.evidence import evidence_json, parsed_evidence
from findweave.operators import parse_cache
from findweave.sources import repository

GOOD = {"file_path": "a.py", "start_line": 3, "end_line": 4, "quoted_text": ' x = "1"\n é '}


def test_broken_rows_are_dropped_alone(spark):
    kept = ("a.py", 3, 4, ' x = "1"\n é ')
    cases = [
        (json.dumps([GOOD, GOOD]), [kept, kept]), (None, []), ("", []), ("not json", []), ("null", []), (json.dumps(GOOD), []), ("[]", []),
        (json.dumps([1, "s", None, [GOOD], GOOD]), [kept]), (json.dumps([{k: v for k, v in GOOD.items() if k != "end_line"}, GOOD]), [kept]),
        (json.dumps([{**GOOD, "start_line": x} for x in (" 3 ", "+3", 3.7, "3.0", "three", None, [3], {})]), [kept] * 3),
        (json.dumps([{**GOOD, "start_line": True, "file_path": 7}]), [("7", 1, *kept[2:])]), (json.dumps([{**GOOD, "quoted_text": None}]), []), (json.dumps([{**GOOD, "extra": {"a": 1}}]), [kept]),
    ]
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string").withColumn("found", parsed_evidence(F.col("raw")))
    for r in df.withColumn("again", parsed_evidence(evidence_json(F.col("found")))).collect():
        assert [tuple(s) for s in r["found"]] == cases[r["i"]][1], cases[r["i"]][0]
        assert r["again"] == r["found"]


def test_a_hit_is_not_parsed(spark, tmp_path):
    path = str(tmp_path / "cache")
    code = {"a.py": "import os\ndef f():\n    return g()\n", "copy/a.py": "import os\ndef f():\n    return g()\n", "b.py": "class B:\n    pass\n", "bad.py": "def (:\n"}

    def files(*names):
        df = spark.createDataFrame([(n, bytearray(code[n].encode()), "python") for n in names], "relative_path string, content binary, language string")
        return df.withColumn("sha256", F.sha2("content", 256))

    parsed = []

    def parse(df):
        parsed.append(sorted(r["relative_path"] for r in df.select("relative_path").collect()))
        return repository.parse_python(df)

    def run(version, *names):
        rows = parse_cache.parsed_through(files(*names), path, version, parse).collect()
        return {r["relative_path"]: (r["hit"], [s["qualified_name"] for s in r["symbols"]], [i["target"] for i in r["imports"]], [c["name"] for c in r["calls"]]) for r in rows}

    assert run(1, "a.py", "bad.py") == {"a.py": (False, ["f"], ["os"], ["g"]), "bad.py": (False, [], [], [])}
    # a copy under another path is a hit, and so is a file that doesn't parse; only b.py is parsed
    assert run(1, "a.py", "copy/a.py", "b.py", "bad.py") == {"a.py": (True, ["f"], ["os"], ["g"]), "copy/a.py": (True, ["f"], ["os"], ["g"]), "b.py": (False, ["B"], [], []), "bad.py": (True, [], [], [])}
    assert run(2, "b.py") == {"b.py": (False, ["B"], [], [])}  # another parser version parses anew
    assert parsed == [["a.py", "bad.py"], ["b.py"], ["b.py"]]
    parse_cache.evict(spark, path, 2)
    assert parse_cache.cached(spark, path, 1).count() == 0 and parse_cache.cached(spark, path, 2).count() == 1
