"""Feedback queries over the event log.

Surrogate mapping of ``events``: the user is the finding and ``props.k`` the reaction or thread.
Clicks and errors add a positive or negative reaction, views remove one (or are replies), purchases
are commands, sign-ups are thread or lifecycle events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.functions.text import explicit_command
from findweave.operators import events as ops
from findweave.operators.matching import first_by, insert_if_absent
from findweave.sources.export import json_line

PREFIX = "/review "
COMMANDS = ("useful", "false-positive", "fixed", "ignore")


def log(spark, d: str) -> DataFrame:
    k, t, i = F.col("k"), F.col("event_type"), F.col("event_id")
    raw = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = (
        F.when(t.isin("click", "error"), F.lit("reaction_added")).when((t == "view") & (k % 10 == 0), F.lit("comment_reply")).when(t == "view", F.lit("reaction_removed")).when(t == "purchase", F.lit("explicit_command"))
        .when(k % 3 == 0, F.lit("thread_resolved")).when(k % 3 == 1, F.lit("thread_reopened")).when(i % 3 == 0, F.lit("finding_code_changed")).when(i % 3 == 1, F.lit("finding_code_unchanged")).otherwise(F.lit("finding_disappeared"))
    )
    signal = F.when(t == "click", F.lit("positive_hint")).when(t == "error", F.lit("negative_hint")).when(t == "purchase", F.get(F.array(*map(F.lit, COMMANDS)), (k % 4).cast("int")))
    strength = F.when(t == "purchase", F.lit("strong")).when(t == "signup", F.lit("medium")).otherwise(F.lit("weak"))
    return raw.select(F.col("user_id").alias("finding_id"), kind.alias("event_type"), k.alias("reaction_id"), signal.alias("signal"), strength.alias("strength"), F.col("ts").alias("at"), i.alias("seq"), "value")


LOG = """
l AS (SELECT user_id AS finding_id, CASE WHEN event_type IN ('click', 'error') THEN 'reaction_added' WHEN event_type = 'view' AND k % 10 = 0 THEN 'comment_reply' WHEN event_type = 'view' THEN 'reaction_removed'
    WHEN event_type = 'purchase' THEN 'explicit_command' WHEN k % 3 = 0 THEN 'thread_resolved' WHEN k % 3 = 1 THEN 'thread_reopened' WHEN event_id % 3 = 0 THEN 'finding_code_changed' WHEN event_id % 3 = 1 THEN 'finding_code_unchanged' ELSE 'finding_disappeared' END AS event_type,
  k AS reaction_id, CASE event_type WHEN 'click' THEN 'positive_hint' WHEN 'error' THEN 'negative_hint' WHEN 'purchase' THEN ['useful', 'false-positive', 'fixed', 'ignore'][k % 4 + 1] END AS signal,
  CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS strength, ts AS tm, event_id AS seq, value FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"""
NET = """
net AS (SELECT finding_id, reaction_id, signal FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, reaction_id ORDER BY tm DESC, seq DESC) AS r FROM l WHERE event_type IN ('reaction_added', 'reaction_removed')) WHERE r = 1 AND event_type = 'reaction_added')"""
ASSESS = f"""{LOG},{NET},
h AS (SELECT finding_id, count(*) FILTER (signal = 'positive_hint') AS pos, count(*) FILTER (signal = 'negative_hint') AS neg FROM net GROUP BY 1),
f AS (SELECT finding_id, count(*) FILTER (event_type = 'comment_reply') AS developer_replies, count(*) FILTER (signal = 'useful') AS explicit_useful, count(*) FILTER (signal = 'false-positive') AS explicit_false_positive,
  count(*) FILTER (signal = 'fixed') AS explicit_fixed, count(*) FILTER (signal = 'ignore') AS explicit_ignore,
  arg_max(event_type, (tm, seq)) FILTER (event_type IN ('thread_resolved', 'thread_reopened')) AS th, arg_max(event_type, (tm, seq)) FILTER (event_type LIKE 'finding_%') AS lc,
  bool_or(event_type = 'finding_code_changed') AS finding_changed, bool_or(event_type = 'finding_disappeared') AS finding_disappeared, max(strength) FILTER (event_type <> 'reaction_removed') AS st FROM l GROUP BY 1),
j AS (SELECT f.*, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(lc = 'finding_code_unchanged', false) AS un FROM f LEFT JOIN h USING (finding_id)),
a AS (SELECT finding_id, pos AS positive_reactions, neg AS negative_reactions, developer_replies, explicit_useful, explicit_false_positive, explicit_fixed, explicit_ignore, coalesce(th = 'thread_resolved', false) AS thread_resolved,
  finding_changed, finding_disappeared, un AS finding_code_unchanged,
  CASE WHEN explicit_useful > 0 THEN 'positive' WHEN explicit_false_positive > 0 THEN 'negative' WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' WHEN pos + neg > 0 THEN 'neutral' ELSE 'unknown' END AS usefulness,
  CASE WHEN explicit_false_positive > 0 THEN 'negative' WHEN explicit_fixed > 0 THEN 'positive' WHEN lc = 'finding_disappeared' THEN 'positive' WHEN un AND neg > 0 THEN 'negative' ELSE 'unknown' END AS correctness,
  CASE WHEN th = 'thread_resolved' THEN 'closed' WHEN th IS NOT NULL THEN 'open' ELSE 'unknown' END AS resolution, developer_replies > 0 AS engaged, ['weak', 'medium', 'strong'][st + 1] AS confidence,
  array_to_string(list_filter([
    CASE WHEN explicit_useful > 0 THEN 'explicit useful command' WHEN explicit_false_positive > 0 THEN 'explicit false-positive command' WHEN pos > neg THEN pos || ' positive reaction(s) outweigh ' || neg || ' negative'
      WHEN neg > pos THEN neg || ' negative reaction(s) outweigh ' || pos || ' positive' WHEN pos + neg > 0 THEN 'equal positive and negative reactions' END,
    CASE WHEN explicit_false_positive > 0 THEN 'explicit false-positive command' WHEN explicit_fixed > 0 THEN 'explicit fixed command' WHEN lc = 'finding_disappeared' THEN 'finding disappeared on a later commit (a signal, not confirmed)'
      WHEN un AND neg > 0 THEN 'code unchanged across a later commit despite negative reaction(s)' END,
    CASE WHEN th = 'thread_resolved' THEN 'thread resolved' WHEN th IS NOT NULL THEN 'thread reopened/open' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM j)"""


def net_active(spark, d):
    e = log(spark, d)
    return ops.net_active(e, ["finding_id"], "reaction_id", ["at", "seq"], F.col("event_type") == "reaction_added", F.col("event_type") == "reaction_removed", ["signal"])


def assessment(spark, d):
    return ops.assess(log(spark, d))


def candidates(rule):
    def run(spark, d):
        return assessment(spark, d).where(rule()).select("finding_id", "usefulness", "correctness", "positive_reactions", "negative_reactions")

    return run


def slices(spark, d):
    attributes = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("finding_id"), F.col("c_mktsegment").alias("category"), (F.col("c_nationkey") % 5).cast("string").alias("severity"))
    return ops.feedback_slices(assessment(spark, d), attributes, ["category", "severity"])


def thread_transitions(spark, d):
    threads = log(spark, d).where(F.col("event_type").isin(*ops.THREAD)).withColumn("state", F.when(F.col("event_type") == "thread_resolved", F.lit("resolved")).otherwise(F.lit("open")))
    return ops.transitions(threads, ["finding_id"], "state", ["at", "seq"], "open").select("finding_id", "seq", "previous_state", "state")


def dedupe_identity(spark, d):
    e = log(spark, d).select("seq", "event_type", "finding_id", "value")
    replay = e.unionByName(e.where("seq % 3 = 0"))
    return insert_if_absent(replay, e.where("seq % 10 = 0"), ["seq", "event_type"], [F.col("value")])


def synthesised_removals(spark, d):
    e = log(spark, d)
    return ops.vanished(e.where("event_type = 'reaction_added'"), net_active(spark, d), ["finding_id", "reaction_id"])


def command_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    word = F.when(F.col("event_type") == "click", F.lit("useful")).when(F.col("event_type") == "view", F.lit("false-positive")).when(F.col("event_type") == "error", F.lit("fixed now")).otherwise(F.col("event_type"))
    body = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("  ")).otherwise(F.lit("")), F.lit(PREFIX), word, F.when(F.col("event_id") % 5 == 0, F.lit("\n")).otherwise(F.lit("")))
    return e.select("event_id", explicit_command(body, PREFIX).alias("command")).where("command IS NOT NULL")


def latest_state(spark, d):
    return ops.latest(log(spark, d), ["finding_id"], ["at", "seq"], ["event_type", "seq"])


def reaction_hints(spark, d):
    content = F.get(F.array(*map(F.lit, ("+1", "heart", "hooray", "-1", "confused", "eyes", "laugh", "rocket", "shrug"))), (F.col("event_id") % 9).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.coalesce(ops.reaction_hint(content), F.lit("none")).alias("hint")).agg(F.count("*").alias("n"))


def jsonl_export(spark, d):
    rolled = log(spark, d).groupBy("finding_id").agg(F.count("*").alias("n_events"), F.max("seq").alias("last_seq"), F.min("event_type").alias("first_type"))
    line = rolled.select(json_line(rolled).alias("line"))
    return line.select(F.get_json_object("line", "$.finding_id").cast("long").alias("finding_id"), F.get_json_object("line", "$.n_events").cast("long").alias("n_events"), F.get_json_object("line", "$.last_seq").cast("long").alias("last_seq"), F.get_json_object("line", "$.first_type").alias("first_type"))


def first_seen(spark, d):
    return first_by(log(spark, d), ["finding_id", "event_type"], [F.col("at"), F.col("seq")]).select("finding_id", "event_type", "seq")


def hourly_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


QUERIES = {
    "feedback_net_active": net_active, "feedback_assessment": assessment, "fp_candidates": candidates(ops.false_positive_candidate), "high_value_candidates": candidates(ops.high_value_candidate), "feedback_slices": slices,
    "thread_transitions": thread_transitions, "event_dedupe_identity": dedupe_identity, "synth_removals": synthesised_removals, "command_parse": command_parse, "latest_state": latest_state, "reaction_hints": reaction_hints,
    "jsonl_export": jsonl_export, "first_seen": first_seen, "hourly_events": hourly_events,
}

_CANDIDATE = "SELECT finding_id, usefulness, correctness, positive_reactions, negative_reactions FROM a WHERE "
_SLICE = "count(*) AS n_findings, count(*) FILTER (usefulness = 'positive') AS n_useful, count(*) FILTER (usefulness = 'negative') AS n_negative, count(*) FILTER (engaged) AS n_engaged, sum(positive_reactions)::BIGINT AS positive_reactions, sum(negative_reactions)::BIGINT AS negative_reactions, count(*) FILTER (usefulness = 'positive') / count(*) AS useful_rate, count(*) FILTER (usefulness = 'negative') / count(*) AS negative_rate"
ORACLES = {
    "feedback_net_active": f"WITH {LOG},{NET} SELECT * FROM net",
    "feedback_assessment": f"WITH {ASSESS} SELECT * FROM a",
    "fp_candidates": f"WITH {ASSESS} {_CANDIDATE} explicit_false_positive > 0 OR negative_reactions >= 2 OR (negative_reactions > 0 AND finding_code_unchanged)",
    "high_value_candidates": f"WITH {ASSESS} {_CANDIDATE} explicit_useful > 0 OR finding_disappeared OR (positive_reactions > 0 AND finding_changed)",
    "feedback_slices": f"""WITH {ASSESS}, x AS (SELECT c_custkey AS finding_id, c_mktsegment AS category, (c_nationkey % 5)::VARCHAR AS severity FROM customer WHERE c_custkey % 7 <> 0), y AS (SELECT a.*, category, severity FROM a JOIN x USING (finding_id))
SELECT 'all' AS slice, '' AS value, {_SLICE} FROM a UNION ALL SELECT 'category', category, {_SLICE} FROM y GROUP BY category UNION ALL SELECT 'severity', severity, {_SLICE} FROM y GROUP BY severity""",
    "thread_transitions": f"WITH {LOG}, t AS (SELECT finding_id, seq, tm, CASE event_type WHEN 'thread_resolved' THEN 'resolved' ELSE 'open' END AS state FROM l WHERE event_type LIKE 'thread_%'), p AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY finding_id ORDER BY tm, seq), 'open') AS previous_state FROM t) SELECT finding_id, seq, previous_state, state FROM p WHERE state <> previous_state",
    "event_dedupe_identity": f"WITH {LOG} SELECT DISTINCT seq, event_type, finding_id, value FROM l WHERE seq % 10 <> 0",
    "synth_removals": f"WITH {LOG},{NET} SELECT DISTINCT finding_id, reaction_id FROM l WHERE event_type = 'reaction_added' EXCEPT SELECT finding_id, reaction_id FROM net",
    "command_parse": "SELECT event_id, CASE event_type WHEN 'click' THEN 'useful' ELSE 'false-positive' END AS command FROM events WHERE event_type IN ('click', 'view')",
    "latest_state": f"WITH {LOG} SELECT finding_id, arg_max(event_type, (tm, seq)) AS event_type, arg_max(seq, (tm, seq)) AS seq FROM l GROUP BY 1",
    "reaction_hints": "SELECT ['positive_hint', 'positive_hint', 'positive_hint', 'negative_hint', 'negative_hint', 'neutral_attention', 'uninterpreted', 'uninterpreted', 'none'][event_id % 9 + 1] AS hint, count(*) AS n FROM events GROUP BY 1",
    "jsonl_export": f"WITH {LOG} SELECT finding_id, count(*) AS n_events, max(seq) AS last_seq, min(event_type) AS first_type FROM l GROUP BY 1",
    "first_seen": f"WITH {LOG} SELECT finding_id, event_type, arg_min(seq, (tm, seq)) AS seq FROM l GROUP BY 1, 2",
    "hourly_events": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
