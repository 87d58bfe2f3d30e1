"""Pages, manifests, run claims and the publication sink: crashes, repeats and concurrent writers."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from findweave.sources import exclusive, manifest, paged, publish

ITEM = "id long, body string, at timestamp"


def _page(path, number, *items):
    exclusive.put(f"{path}/page={number}/a.json", "\n".join(json.dumps(i) for i in items).encode())


def test_pages_are_read_up_to_the_first_gap(spark, tmp_path):
    path = str(tmp_path)
    _page(path, 1, {"id": 1, "body": "é", "at": "2024-01-01 00:00:00"}, {"id": 2})
    _page(path, 2)
    _page(path, 3, {"id": 3, "more": [1]})
    _page(path, 5, {"id": 5})
    df = paged.read_paged(spark, path, ITEM)
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["id"], r["body"], r["at"] and r["at"].year) for r in df.collect()) == [(1, "é", 2024), (2, None, None), (3, None, None)]
    assert [r["id"] for r in paged.read_paged(spark, path, ITEM, max_pages=2).collect()] == [1, 2]
    assert paged.read_paged(spark, f"{path}/none", ITEM).count() == 0


def test_a_restarted_stream_reads_no_page_twice(spark, tmp_path):
    path = str(tmp_path / "pages")

    def run():
        stream = paged.read_paged(spark, path, ITEM, stream=True)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["id"] for r in spark.read.schema(ITEM).parquet(f"{tmp_path}/out").collect())

    _page(path, 1, {"id": 1}, {"id": 2})
    assert run() == [1, 2]
    assert run() == [1, 2]
    _page(path, 2, {"id": 3})
    _page(path, 3, {"id": 4})
    assert run() == [1, 2, 3, 4]


def test_tables_appear_together(spark, tmp_path):
    path, rows = str(tmp_path), spark.range(3).select(F.col("id"))
    read = lambda t: manifest.read_together(spark, path, t, "id long").count()
    assert read("parents") == 0
    broken = rows.select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        manifest.append_together({"children": rows, "parents": broken}, path, "one")
    assert read("parents") == read("children") == 0  # the children were written, and nobody sees them
    assert manifest.append_together({"children": rows, "parents": rows}, path, "one")
    assert not manifest.append_together({"children": rows, "parents": rows}, path, "one")
    assert manifest.append_together({"parents": rows}, path, "two")
    assert (read("parents"), read("children")) == (6, 3)


def test_concurrent_entries_get_numbers_of_their_own(tmp_path):
    path = str(tmp_path)
    threads = [threading.Thread(target=lambda n=n: [manifest.append(path, lambda known: {"n": n, "after": len(known)}) for _ in range(10)]) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = manifest.entries(path)
    assert len(found) == 60 and [e["after"] for e in found] == list(range(60))


def test_one_of_two_concurrent_runs_counts(spark, tmp_path):
    path, gate, counted = str(tmp_path), threading.Barrier(8), {}

    def work(n: int) -> None:
        run = f"run{n}"
        assert manifest.start_run(path, "sha", run) == (run, True)
        gate.wait()
        counted[run] = manifest.finish_run(path, "sha", run, "partial" if n == 0 else "succeeded")

    threads = [threading.Thread(target=work, args=(n,)) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    states = {r["run"]: (r["status"], r["superseded_by"]) for r in manifest.run_states(spark, path).where("identity = 'sha'").collect()}
    (winner,) = [r for r, s in states.items() if s[0] == "succeeded"]
    assert all(c == winner for r, c in counted.items() if r != "run0") and counted["run0"] in (winner, None)
    assert all(s == ("failed", winner) for r, s in states.items() if r not in (winner, "run0"))
    assert states["run0"] in (("partial", None), ("failed", winner))
    assert manifest.start_run(path, "sha", "later") == (winner, False)
    assert manifest.finish_run(path, "sha", winner, "succeeded") == winner  # repeated


def test_partial_and_failed_runs_are_not_reused(tmp_path):
    path = str(tmp_path)
    for run, status in (("a", "failed"), ("b", "partial")):
        assert manifest.start_run(path, "x", run) == (run, True)
        assert manifest.finish_run(path, "x", run, status) is None
    assert manifest.start_run(path, "x", "c") == ("c", True)
    assert manifest.finish_run(path, "x", "c", "succeeded") == "c"
    assert manifest.start_run(path, "x", "d") == ("c", False)


def test_publication_is_all_or_nothing_and_once(spark, tmp_path):
    path, rows = str(tmp_path), spark.range(20).repartition(4)
    seen = lambda: publish.published(spark, path, "id long").count()
    broken = rows.select(F.when(F.col("id") == 11, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost|failed"):
        publish.publish(broken, path, "p1")
    assert exclusive.listed(f"{path}/plans") == []
    publish.publish(rows, path, "p1")
    files = [f.base_name for f in exclusive.listed(f"{path}/rows")]
    assert seen() == 20
    publish.publish(rows, path, "p1")  # what was written again is gone
    listed = json.loads(exclusive.content(f"{path}/plans/p1.json"))
    assert seen() == 20 and listed["rows"] == 20 and set(listed["files"]) <= set(files)
    assert [f.base_name for f in exclusive.listed(f"{path}/rows")] == files
    publish.publish(rows.limit(0), path, "empty")
    publish.publish(rows, path, "p2")
    assert {r["plan"]: r["count"] for r in publish.published(spark, path, "id long").groupBy("plan").count().collect()} == {"p1": 20, "p2": 20}
