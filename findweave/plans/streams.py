"""Streaming queries, run over all events that are there. Surrogates: users are comments or findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.session import shared_path
from findweave.sources import drops, reports
from findweave.streaming import ingest

c = F.col


def _stream(spark, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", c("ts").cast("timestamp"))  # a pattern, since a plain path must be a folder


def _pick(number: Column, *values) -> Column:
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def _identified(spark, d: str) -> DataFrame:
    return _stream(spark, d).select(_pick(c("event_id"), "api", "hook").alias("source"), "event_type", F.floor(c("event_id") / 3).cast("string").alias("external_event_id"), "ts")


#: Deliveries of a month of events, and how far behind the newest one an event is still put in order.
DELIVERIES, DELAY = 4, "20 days"


def _delivered(spark, d: str, columns: Sequence[Column]) -> list[DataFrame]:
    """All events in four deliveries by time, one in seven a delivery late, and a last row, without a user, that moves the watermark on."""
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", c("ts").cast("timestamp"))
    low, high = (F.lit(x) for x in rows.agg(F.min("ts"), F.max("ts")).first())
    part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(low)) * DELIVERIES / (F.unix_micros(high) - F.unix_micros(low) + 1)), F.lit(DELIVERIES - 1)) + (c("event_id") % 7 == 3).cast("int")
    closing = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]).withColumn("ts", high + F.expr("INTERVAL 60 DAYS"))
    return [*[rows.where(part == n).select(*columns) for n in range(DELIVERIES + 1)], closing.select(*columns)]


def stream_deduped(spark, d):
    """Each identity once; the watermark is longer than the events' month, so none is forgotten."""
    return ingest.settled(ingest.deduplicated(ingest.timed(_identified(spark, d), delay="60 days")), "deduped").select(*ingest.IDENTITY)


def stream_appended(spark, d):
    """All events delivered twice, by two runs of the ingest, and stored once by identity."""
    path = shared_path(spark, "appended")
    for run in range(2):
        ingest.append_absent(_identified(spark, d), f"{path}/rows", ingest.IDENTITY, f"{path}/state{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").select(*ingest.IDENTITY)


def stream_state_changes(spark, d):
    """State changes of threads in the order of their time, though one event in seven comes a delivery late."""
    rows = _delivered(spark, d, [c("user_id").cast("string").alias("thread"), c("event_type").alias("state"), c("ts").alias("at")])
    return ingest.settled_in_turn(rows, "changes", lambda s: ingest.state_changes(s, "thread", "state", "at", "view", DELAY))


def stream_reactions(spark, d):
    """Polled snapshots of two reactions a comment, one of them a bot's now and then, in deliveries out of order."""
    k = c("event_id")
    rows = _delivered(spark, d, [c("user_id").alias("comment_id"), c("ts").alias("polled_at"), F.array(k % 3, k % 5 + 3).alias("reaction_ids"), F.array(F.lit("User"), _pick(k, "User", "Bot", "User")).alias("actor_types")])
    return ingest.ordered_reactions(spark, ingest.in_turn(rows, "reactions", lambda s, path: ingest.reactions_in_order(s, DELAY, path)))


def stream_counters(spark, d):
    """Run counters of the ingest over deliveries in which identities come again; summed over the batches."""
    k = c("event_id")
    rows = _delivered(spark, d, [F.floor(k / 3).alias("identity"), F.when(F.floor(k / 3) % 4 != 0, c("user_id")).alias("finding"), F.when(F.floor(k / 3) % 5 == 1, F.lit("useful")).alias("signal")])[:-1]
    path = ingest.in_turn(rows, "counters", lambda s, path: ingest.counted_append(s, ["identity"], path))
    return spark.read.parquet(f"{path}/counters").agg(*[F.sum(n).alias(n) for n in ingest.COUNTERS])


def stream_replies(spark, d):
    body = _pick(c("event_id"), "/review useful", "  /review false-positive\n", "/review fixed now", "thanks", "/review ignore", "/reviewuseful")
    return ingest.settled(ingest.commands_and_replies(_stream(spark, d).select("event_id", body.alias("body")), "/review "), "replies").select("event_id", "event_type", "signal")


def stream_lifecycle(spark, d):
    rows = _stream(spark, d).select("event_id", _pick(c("user_id"), "carried_forward", "changed", "resolved", "new", "reconfirmed").alias("state"))
    return ingest.settled(ingest.lifecycle_events(rows), "lifecycle").select("event_id", "event_type")


def stream_pull_requests(spark, d):
    """Pull requests that were merged or closed; open ones emit nothing."""
    k = c("event_id")
    rows = _stream(spark, d).select(k.alias("id"), _pick(k, "open", "closed", "closed").alias("state"), F.when((k % 3 == 1) & (k % 2 == 0), c("ts")).alias("merged_at"), c("ts").alias("closed_at"))
    return ingest.settled(drops.lifecycle_of_pull_request(rows), "pulls")


def stream_webhooks(spark, d):
    """Webhook deliveries reserved by their id: redelivered ones change nothing."""
    delivery = F.floor(c("event_id") / 2)
    action = _pick(delivery, "opened", "labeled", "synchronize", "reopened", "closed")
    body = F.concat(F.lit('{"action": "'), action, F.lit('", "pull_request": {"number": '), (delivery % 90).cast("string"), F.lit(', "head": {"sha": "h'), delivery.cast("string"), F.lit('"}}, "repository": {"id": 7}}'))
    path = shared_path(spark, "deliveries")
    ingest.append_absent(_stream(spark, d).select(delivery.alias("delivery"), body.alias("body")), f"{path}/rows", ("delivery",), f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return reports.pull_request_events(spark.read.parquet(f"{path}/rows")).select("delivery", "action", "number", "head_sha")


def stream_touched(spark, d):
    """Users assessed anew from their whole history by each delivery that touches them; the last assessment of each."""
    assess = lambda history: history.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))
    rows = _delivered(spark, d, [c("event_id"), c("user_id"), c("event_type"), c("ts")])[:-1]
    path = ingest.in_turn(rows, "touched", lambda s, path: ingest.assessed(s, assess, "user_id", path))
    return ingest.latest(spark, path, "user_id", "user_id long, last string, n long")


QUERIES = {
    "stream_deduped": stream_deduped, "stream_appended": stream_appended, "stream_state_changes": stream_state_changes, "stream_reactions": stream_reactions, "stream_replies": stream_replies,
    "stream_lifecycle": stream_lifecycle, "stream_pull_requests": stream_pull_requests, "stream_webhooks": stream_webhooks, "stream_touched": stream_touched, "stream_counters": stream_counters,
}

_ONCE = "SELECT DISTINCT ['api', 'hook'][event_id % 2 + 1] AS source, event_type, (event_id // 3)::VARCHAR AS external_event_id FROM events"
ORACLES = {
    "stream_deduped": _ONCE,
    "stream_appended": _ONCE,
    "stream_state_changes": """WITH x AS (SELECT user_id::VARCHAR AS thread, ts AS "at", lag(event_type, 1, 'view') OVER (PARTITION BY user_id ORDER BY ts, event_type) AS previous, event_type AS now FROM events) SELECT thread, "at", previous, now FROM x WHERE previous <> now""",
    "stream_reactions": """WITH x AS (SELECT user_id AS comment_id, ts AS polled_at, CASE WHEN event_id % 3 = 1 THEN [event_id % 3] ELSE [event_id % 3, event_id % 5 + 3] END AS now FROM events), y AS (SELECT *, lag(now, 1, []) OVER (PARTITION BY comment_id ORDER BY polled_at) AS prev FROM x)
SELECT comment_id, unnest(list_filter(now, lambda v: NOT list_contains(prev, v))) AS reaction_id, 'reaction_added' AS event_type, polled_at FROM y UNION ALL SELECT comment_id, unnest(list_filter(prev, lambda v: NOT list_contains(now, v))), 'reaction_removed', polled_at FROM y""",
    "stream_replies": "SELECT event_id, 'comment_reply' AS event_type, NULL::VARCHAR AS signal FROM events UNION ALL SELECT event_id, 'explicit_command', CASE event_id % 6 WHEN 0 THEN 'useful' WHEN 1 THEN 'false-positive' ELSE 'ignore' END FROM events WHERE event_id % 6 IN (0, 1, 4)",
    "stream_lifecycle": "SELECT event_id, ['finding_code_unchanged', 'finding_code_changed', 'finding_disappeared'][user_id % 5 + 1] AS event_type FROM events WHERE user_id % 5 < 3",
    "stream_pull_requests": "SELECT event_id AS pull_request_id, CASE WHEN event_id % 6 = 4 THEN 'pr_merged' ELSE 'pr_closed' END AS event_type, ts AS occurred_at FROM events WHERE event_id % 3 <> 0",
    "stream_webhooks": "SELECT DISTINCT event_id // 2 AS delivery, ['opened', 'labeled', 'synchronize', 'reopened', 'closed'][(event_id // 2) % 5 + 1] AS action, ((event_id // 2) % 90)::INT AS number, 'h' || (event_id // 2) AS head_sha FROM events WHERE (event_id // 2) % 5 IN (0, 2, 3)",
    "stream_touched": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY 1",
    "stream_counters": "WITH i AS (SELECT DISTINCT event_id // 3 AS i FROM events), u AS (SELECT (SELECT count(*) FROM events) AS observed, (SELECT count(*) FROM i) AS ingested) SELECT observed, ingested, observed - ingested AS duplicate, (SELECT count(*) FROM i WHERE i % 4 = 0) AS unattributed, (SELECT count(*) FROM i WHERE i % 5 = 1) AS enriched FROM u",
}
