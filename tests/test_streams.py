"""State across micro-batches: events that come late, keys that are touched again, batches that run again."""

from __future__ import annotations

from pyspark.sql import functions as F

from findweave.streaming import ingest

EVENT = "k string, state string, at timestamp"


def _deliveries(spark, parts):
    return [spark.createDataFrame(rows, "k string, state string, at string").withColumn("at", F.col("at").cast("timestamp")) for rows in parts]


def test_a_late_event_is_put_in_its_place(spark):
    hour = lambda h: f"2024-01-01 {h:02d}:00:00"
    parts = [[("a", "resolved", hour(10)), ("b", "open", hour(9))], [("a", "open", hour(12))], [("a", "resolved", hour(8)), ("b", "resolved", hour(11))], [(None, None, "2024-02-01 00:00:00")]]
    query = lambda s: ingest.state_changes(s, "k", "state", "at", "open", "6 hours")
    got = ingest.settled_in_turn(_deliveries(spark, parts), "late", query).orderBy("k", "at").collect()
    assert [(r["k"], r["at"].hour, r["previous"], r["now"]) for r in got] == [("a", 8, "open", "resolved"), ("a", 12, "resolved", "open"), ("b", 11, "open", "resolved")]
    # without the last row the watermark stands six hours behind the newest event, and all wait
    assert ingest.settled_in_turn(_deliveries(spark, parts[:3]), "late", query).count() == 0


def test_events_behind_the_watermark_are_dropped(spark):
    parts = [[("a", "resolved", "2024-01-10 00:00:00")], [("a", "x", "2024-01-01 00:00:00"), ("a", "open", "2024-01-11 00:00:00")], [(None, None, "2024-03-01 00:00:00")]]
    got = ingest.settled_in_turn(_deliveries(spark, parts), "old", lambda s: ingest.state_changes(s, "k", "state", "at", "open", "1 day")).orderBy("at").collect()
    assert [(r["previous"], r["now"]) for r in got] == [("open", "resolved"), ("resolved", "open")]


def test_a_key_touched_twice_has_one_row(spark):
    parts = _deliveries(spark, [[("a", "x", "2024-01-02 00:00:00"), ("b", "x", "2024-01-02 00:00:00")], [("a", "y", "2024-01-01 00:00:00")], [("a", "z", "2024-01-03 00:00:00")]])
    assess = lambda h: h.groupBy("k").agg(F.max_by("state", "at").alias("last"), F.count("*").alias("n"))
    path = ingest.in_turn(parts, "touched", lambda s, path: ingest.assessed(s, assess, "k", path))
    latest = lambda: sorted(tuple(r) for r in ingest.latest(spark, path, "k", "k string, last string, n long").collect())
    assert latest() == [("a", "z", 3), ("b", "x", 1)]
    # all deliveries again, by a query that lost its checkpoint: batches overwrite what they wrote
    stream = spark.readStream.schema(parts[0].schema).parquet(f"{path}/in")
    ingest.assessed(stream, assess, "k", path).option("checkpointLocation", f"{path}/other").trigger(availableNow=True).start().awaitTermination()
    assert latest()[1] == ("b", "x", 1)


def test_counters_of_each_run(spark):
    rows = [[(1, "f", "s"), (1, "f", "s"), (2, None, None)], [(2, None, None), (3, "f", None)], [(1, "f", "s")]]
    parts = [spark.createDataFrame(p, "identity long, finding string, signal string") for p in rows]
    path = ingest.in_turn(parts, "counted", lambda s, path: ingest.counted_append(s, ["identity"], path))
    got = [tuple(r[c] for c in ingest.COUNTERS) for r in spark.read.parquet(f"{path}/counters").where("observed > 0").orderBy("batch").collect()]
    assert got == [(3, 2, 1, 1, 1), (2, 1, 1, 0, 0), (1, 0, 1, 0, 0)]
    assert spark.read.parquet(f"{path}/rows").count() == 3


def test_late_polls_of_reactions_are_put_in_order_by_windows(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    polls = lambda *rows: spark.createDataFrame(rows, "comment_id long, polled_at string, reaction_ids array<long>, actor_types array<string>").withColumn("polled_at", F.col("polled_at").cast("timestamp"))
    parts = [
        polls((1, day(5), [1, 2], ["User", "Bot"]), (2, day(5), [7], [None])),
        polls((1, day(9), [3, 3], ["User", "User"]), (2, day(9), [], [])),
        polls((1, day(7), [1, 3], ["User", "User"]), (2, day(1), [8], ["User"])),  # one in time, one five days too late
        polls((None, "2024-03-01 00:00:00", None, None)),
    ]
    start = lambda s, path: ingest.reactions_in_order(s, "5 days", path)
    read = lambda parts: ingest.ordered_reactions(spark, ingest.in_turn(parts, "reactions", start)).orderBy("comment_id", "polled_at", "reaction_id").collect()
    got = [(r["comment_id"], r["reaction_id"], r["event_type"].removeprefix("reaction_"), r["polled_at"].day) for r in read(parts)]
    assert got == [(1, 1, "added", 5), (1, 3, "added", 7), (1, 1, "removed", 9), (2, 7, "added", 5), (2, 7, "removed", 9)]
    assert read(parts[:1]) == []  # all wait


def test_polls_of_reactions_need_no_python_for_each_comment(spark, monkeypatch, tmp_path):
    from findweave.plans import streams

    def none(*_, **__):
        raise AssertionError("a call of Python for each comment and batch")

    monkeypatch.setattr(ingest, "in_order", none)
    spark.range(40).selectExpr("id AS event_id", "timestamp_micros(id * 1000000) AS ts", "id % 3 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert streams.stream_reactions(spark, str(tmp_path)).count() > 0
