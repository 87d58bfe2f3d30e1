"""Structured Streaming over feedback events: deduplicated ingest, netting, state changes."""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from findweave.session import shared_path

IDENTITY = ("source", "event_type", "external_event_id")


def timed(events: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events with a watermark; a timestamp without zone is read in the session's zone first."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def deduplicated(events: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Each identity once within the watermark, however often it is delivered."""
    return events.dropDuplicatesWithinWatermark(list(identity))


def append_absent(events: DataFrame, path: str, identity: tuple[str, ...], checkpoint: str, buckets: int = 256) -> DataStreamWriter:
    """Exactly-once by identity, forever: each micro-batch appends what the table at ``path`` lacks.

    A batch that is delivered again after a failure finds its rows there and appends nothing. The
    table is partitioned by ``bucket``, a hash of the identity, and a batch reads the identities of
    its own buckets only.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(identity)).withColumn("bucket", F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int"))
        table = spark._jvm.org.apache.hadoop.fs.Path(path)
        if table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(table):
            touched = F.broadcast(fresh.select("bucket").distinct())  # at most ``buckets`` rows
            known = spark.read.schema(fresh.schema).parquet(path).select("bucket", *identity).join(touched, "bucket", "left_semi")
            fresh = fresh.join(known, ["bucket", *identity], "left_anti")
        fresh.write.partitionBy("bucket").mode("append").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def settled(stream: DataFrame, label: str) -> DataFrame:
    """What the stream gives for the input that is there now, as a table in the shared folder."""
    path = shared_path(stream.sparkSession, label)
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def in_turn(deliveries: Sequence[DataFrame], label: str, start: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """Run a query after each delivery arrives, going on from its checkpoint; the folder that it works in.

    ``start(stream, folder)`` gives the writer; each delivery is at least one micro-batch of its own.
    """
    spark = deliveries[0].sparkSession
    path = shared_path(spark, label)
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        start(stream, path).trigger(availableNow=True).start().awaitTermination()
    return path


def settled_in_turn(deliveries: Sequence[DataFrame], label: str, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an appending query gives over deliveries that come one after the other."""
    found = []

    def start(stream: DataFrame, path: str) -> DataStreamWriter:
        out = query(stream)
        found[:] = [out.schema]
        return out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append")

    path = in_turn(deliveries, label, start)
    return deliveries[0].sparkSession.read.schema(found[0]).parquet(f"{path}/rows")


def in_order(events: DataFrame, key: str, at: str, ties: Sequence[str], delay: str, schema: str, begin: object, step: Callable[[object, object], tuple[object, list[tuple]]]) -> DataFrame:
    """``step(state, event) -> (state, rows)`` over each key's events in the order of their time, across micro-batches.

    An event waits in its key's state until the watermark, ``delay`` behind the newest event, has
    passed it, so one that comes late, in whatever batch, is still put in its place; what comes later
    than that is dropped. A key's state holds the events of one delay. ``ties`` settle equal times.
    """
    rows = timed(events, at, delay).withColumn("at_micros", F.unix_micros(at))
    place = [rows.columns.index(c) for c in ("at_micros", *ties)]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting = pickle.loads(kept.get[0]) if kept.exists else (begin, [])
        for frame in frames:
            waiting = [*waiting, *map(tuple, frame[names].itertuples(index=False, name=None))]
        passed = kept.getCurrentWatermarkMs() * 1000
        out = []
        for row in sorted((r for r in waiting if r[place[0]] <= passed), key=lambda r: tuple(r[p] for p in place)):
            state, more = step(state, event(*row))
            out += more
        waiting = [r for r in waiting if r[place[0]] > passed]
        kept.update((pickle.dumps((state, waiting)),))
        if waiting:
            kept.setTimeoutTimestamp(max(min(r[place[0]] for r in waiting), passed) // 1000 + 1)
        yield pd.DataFrame([(keys[0], *r) for r in out], columns=fields)

    names, fields = rows.columns, [f.split()[0] for f in schema.split(", ")]
    event = namedtuple("event", names)
    return rows.groupBy(key).applyInPandasWithState(run, schema, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)


def state_changes(events: DataFrame, key: str, state: str, at: str, initial: str, delay: str | None = None) -> DataFrame:
    """(key, at, previous, now) whenever a key's state differs from its last one, across batches.

    With a ``delay`` events are put in the order of their time first (``in_order``); without one, only
    those of a batch are.
    """
    schema = f"{key} string, at timestamp, previous string, now string"
    if delay is not None:

        def change(last: str, event) -> tuple[str, list[tuple]]:
            now = getattr(event, state)
            return now, [(getattr(event, at), last, now)] if now != last else []

        return in_order(events.select(key, state, at), key, at, [state], delay, schema, initial, change)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last = kept.get[0] if kept.exists else initial
        rows = pd.concat(list(frames)).sort_values([at, state])
        out = []
        for when, now in zip(rows[at], rows[state], strict=True):
            if now != last:
                out.append((str(keys[0]), when, last, now))
                last = now
        kept.update((last,))
        yield pd.DataFrame(out, columns=[key, "at", "previous", "now"])

    return events.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def commands_and_replies(replies: DataFrame, prefix: str) -> DataFrame:
    """A reply event for each reply, and a command event where its body is exactly a command."""
    from findweave.functions.text import explicit_command

    token = explicit_command(F.col("body"), prefix)
    reply = F.struct(F.lit("comment_reply").alias("event_type"), F.lit(None).cast("string").alias("signal"))
    command = F.when(token.isNotNull(), F.struct(F.lit("explicit_command").alias("event_type"), token.alias("signal")))
    return replies.withColumn("e", F.explode(F.array_compact(F.array(reply, command)))).select("*", "e.*").drop("e")


#: Lifecycle of a remembered finding -> feedback event; other states emit nothing.
LIFECYCLE_EVENTS = {"carried_forward": "finding_code_unchanged", "changed": "finding_code_changed", "resolved": "finding_disappeared"}


def lifecycle_events(states: DataFrame) -> DataFrame:
    from findweave.functions.ranks import looked_up

    return states.withColumn("event_type", looked_up(F.col("state"), LIFECYCLE_EVENTS)).where("event_type IS NOT NULL")


def hourly_counts(events: DataFrame, at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per kind and hour, final once the watermark has passed the hour."""
    return events.groupBy(F.window(at, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


def counted(events: DataFrame, name: str, **measures) -> DataFrame:
    """``events`` with run counters that ``observe`` reports per batch."""
    return events.observe(name, F.count("*").alias("observed"), *[m.alias(n) for n, m in measures.items()])


def recompute_touched(events: DataFrame, history: Callable[[], DataFrame], assess: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], key: str, checkpoint: str) -> DataStreamWriter:
    """Assess every key that a batch touches from its whole history, so late events count in order."""

    def write(batch: DataFrame, _: int) -> None:
        sink(assess(history().join(batch.select(key).distinct(), key, "left_semi")))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _by_batch(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])


def assessed(events: DataFrame, assess: Callable[[DataFrame], DataFrame], key: str, path: str) -> DataStreamWriter:
    """Keep the events and, per batch, the new assessment of every key that it touches (see ``latest``).

    Each batch owns a folder of events and one of assessments, which a batch that runs again
    overwrites, so that nothing is stored twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        history = spark.read.schema(_by_batch(batch)).parquet(f"{path}/events").where(F.col("batch") <= number).drop("batch")
        touched = spark.read.schema(batch.schema).parquet(f"{path}/events/batch={number}").select(key).distinct()
        assess(history.join(touched, key, "left_semi")).write.mode("overwrite").parquet(f"{path}/assessed/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")


def latest(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """One row per key of what ``assessed`` has stored: that of the last batch that touched it."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/assessed")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch")]), "batch").alias("r")).select(key, "r.*")


#: What a run of the ingest reports.
COUNTERS = ("observed", "ingested", "duplicate", "unattributed", "enriched")


def counted_append(events: DataFrame, identity: Sequence[str], path: str) -> DataStreamWriter:
    """Append events that are not stored yet and, per batch, a row of run counters.

    observed: events of the batch; ingested: those stored; duplicate: the others; unattributed:
    ingested ones without a ``finding``; enriched: ingested ones with a ``signal``. The counts are
    observed while the batch is written, and a batch that runs again overwrites its own folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        stored = batch.observe(seen, F.count("*").alias("observed")).dropDuplicates(list(identity))
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            known = spark.read.schema(_by_batch(batch)).parquet(f"{path}/rows").where(F.col("batch") < number).select(*identity)
            stored = stored.join(known, list(identity), "left_anti")
        kept = Observation()
        stored = stored.select(batch.columns).observe(kept, F.count("*").alias("ingested"), F.count_if(F.col("finding").isNull()).alias("unattributed"), F.count_if(F.col("signal").isNotNull()).alias("enriched"))
        stored.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        n = seen.get["observed"], kept.get["ingested"], kept.get["unattributed"], kept.get["enriched"]
        row = spark.range(1).select(*[F.lit(int(v)).cast("long").alias(c) for c, v in zip(COUNTERS, (n[0], n[1], n[0] - n[1], n[2], n[3]), strict=True)])
        row.write.mode("overwrite").parquet(f"{path}/counters/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")


def reaction_changes(snapshots: DataFrame, comment: str = "comment_id") -> DataFrame:
    """Added and removed reactions from polled snapshots of a comment's reactions; bots are left out.

    ``snapshots``: comment id, polled_at, reaction_ids (all that are active), actor_types alike. Polls
    of a batch are put in the order of their time; ``reactions_in_order`` does it across batches.
    """
    schema = f"{comment} long, reaction_id long, event_type string, polled_at timestamp"

    def change(active: frozenset, row) -> tuple[frozenset, list[tuple]]:
        now = frozenset(int(i) for i, kind in zip(row.reaction_ids, row.actor_types, strict=True) if kind != "Bot")
        return now, [*[(i, "reaction_added", row.polled_at) for i in sorted(now - active)], *[(i, "reaction_removed", row.polled_at) for i in sorted(active - now)]]

    def step(keys: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        active = frozenset(kept.get[0]) if kept.exists else frozenset()
        out = []
        for row in pd.concat(list(frames)).sort_values("polled_at").itertuples(index=False):
            active, more = change(active, row)
            out += [(keys[0], *r) for r in more]
        kept.update((sorted(active),))
        yield pd.DataFrame(out, columns=[comment, "reaction_id", "event_type", "polled_at"])

    return snapshots.groupBy(comment).applyInPandasWithState(step, schema, "active array<long>", "append", GroupStateTimeout.NoTimeout)


def reactions_in_order(snapshots: DataFrame, delay: str, path: str, comment: str = "comment_id") -> DataStreamWriter:
    """What ``reaction_changes`` gives, with polls put in the order of their time across batches; see ``ordered_reactions``.

    A poll waits in a table until the newest one is ``delay`` ahead of it, so one that comes late is
    still put in its place; what comes later than that is dropped. A comment's last poll that has
    passed is kept beside those that wait. Each batch owns its folders and overwrites them when it
    runs again.
    """
    behind = int(pd.Timedelta(delay) / pd.Timedelta(1, "us"))
    people = F.filter(F.arrays_zip(F.col("reaction_ids").alias("id"), F.col("actor_types").alias("kind")), lambda r: ~r["kind"].eqNullSafe("Bot"))
    active = F.array_sort(F.array_distinct(F.transform(people, lambda r: r["id"].cast("long"))))
    uneven = F.size("reaction_ids") != F.size("actor_types")
    active = F.when(uneven, F.raise_error(F.lit("a reaction without an actor type, or the reverse"))).otherwise(active)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        polls = batch.select(F.col(comment).cast("long").alias(comment), F.unix_micros("polled_at").alias("at"), active.alias("active"), F.lit(False).alias("passed"))
        newest = batch.agg(F.max(F.unix_micros("polled_at"))).first()[0]
        if number:
            old = spark.read.parquet(f"{path}/newest/batch={number - 1}").first()[0]
            kept = spark.read.schema(polls.schema).parquet(f"{path}/kept/batch={number - 1}")
            polls = kept.unionByName(polls if old is None else polls.where(F.col("at") > old - behind))
            newest = max((x for x in (old, newest) if x is not None), default=None)
        until = F.lit(None if newest is None else newest - behind).cast("long")
        own = Window.partitionBy(comment).orderBy(F.desc("passed"), "at", "active")
        due = polls.where(F.col("passed") | (F.col("at") <= until))
        due = due.withColumn("before", F.coalesce(F.lag("active").over(own), F.array().cast("array<long>"))).withColumn("last", F.lead("at").over(own).isNull())
        event = lambda ids, kind: F.transform(ids, lambda i: F.struct(i.alias("reaction_id"), F.lit(kind).alias("event_type")))
        events = F.concat(event(F.array_except("active", "before"), "reaction_added"), event(F.array_except("before", "active"), "reaction_removed"))
        found = due.where(~F.col("passed")).select(comment, F.explode(events).alias("e"), F.timestamp_micros("at").alias("polled_at")).select(comment, "e.*", "polled_at")
        found.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rest = polls.where(~F.col("passed") & F.coalesce(F.col("at") > until, F.lit(True)))
        rest.unionByName(due.where("last").select(comment, "at", "active", F.lit(True).alias("passed"))).write.mode("overwrite").parquet(f"{path}/kept/batch={number}")
        spark.range(1).select(F.lit(newest).cast("long").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
        past = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kept/batch={number - 2}")  # the batch before this one may run again, none before it
        past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")


def ordered_reactions(spark: SparkSession, path: str, comment: str = "comment_id") -> DataFrame:
    """All changes that ``reactions_in_order`` has stored."""
    return spark.read.schema(f"{comment} long, reaction_id long, event_type string, polled_at timestamp").parquet(f"{path}/rows/batch=*")
