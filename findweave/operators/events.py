"""Event-log operators: netting, latest state, transitions, assessments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.functions.ranks import STRENGTHS, at_rank, looked_up, rank, rate

SCORED = ("reaction_added", "explicit_command", "thread_resolved", "thread_reopened", "finding_code_changed", "finding_code_unchanged", "finding_disappeared", "comment_reply")
LIFECYCLE = ("finding_code_changed", "finding_code_unchanged", "finding_disappeared")
THREAD = ("thread_resolved", "thread_reopened")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Sequence[str]) -> DataFrame:
    """The values of the last row of each key; the order must be total."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("l")).select(*keys, "l.*")


def net_active(events: DataFrame, keys: Sequence[str], item: str, at: Sequence[str], added: Column, removed: Column, carry: Sequence[str] = ()) -> DataFrame:
    """Items whose last addition or removal is an addition."""
    only = events.where(added | removed).withColumn("__on", added)
    return latest(only, [*keys, item], at, ["__on", *carry]).where("__on").drop("__on")


def transitions(events: DataFrame, keys: Sequence[str], state: str, at: Sequence[str], initial) -> DataFrame:
    """Rows whose state differs from the one before (from ``initial``, for the first)."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*at))
    return events.withColumn("previous_state", F.coalesce(before, F.lit(initial))).where(F.col(state) != F.col("previous_state"))


def vanished(seen: DataFrame, active: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identities seen before that are no longer active: the removals to synthesise."""
    return seen.select(*identity).distinct().join(active.select(*identity), list(identity), "left_anti")


def assess(events: DataFrame, command_label: str = "command") -> DataFrame:
    """One row per finding: counters, signals with reasons in rule order, strongest signal.

    ``events``: finding_id, event_type, reaction_id, signal (hint or command), strength, at, seq.
    """
    kind = F.col("event_type")
    reactions = net_active(events, ["finding_id"], "reaction_id", ["at", "seq"], kind == "reaction_added", kind == "reaction_removed", ["signal"])
    hints = reactions.groupBy("finding_id").agg(F.count_if(F.col("signal") == "positive_hint").alias("positive_reactions"), F.count_if(F.col("signal") == "negative_hint").alias("negative_reactions"))
    command = lambda name: F.count_if((kind == "explicit_command") & (F.col("signal") == name))
    stamp = F.struct("at", "seq")
    facts = events.groupBy("finding_id").agg(
        F.count_if(kind == "comment_reply").alias("developer_replies"),
        command("useful").alias("explicit_useful"),
        command("false-positive").alias("explicit_false_positive"),
        command("fixed").alias("explicit_fixed"),
        command("ignore").alias("explicit_ignore"),
        F.max_by(kind, F.when(kind.isin(*THREAD), stamp)).alias("last_thread"),
        F.max_by(kind, F.when(kind.isin(*LIFECYCLE), stamp)).alias("last_lifecycle"),
        F.coalesce(F.bool_or(kind == "finding_code_changed"), F.lit(False)).alias("finding_changed"),
        F.coalesce(F.bool_or(kind == "finding_disappeared"), F.lit(False)).alias("finding_disappeared"),
        F.max(F.when(kind.isin(*SCORED), rank(F.col("strength"), STRENGTHS))).alias("strongest"),
    )
    out = facts.join(hints, "finding_id", "left").fillna(0, ["positive_reactions", "negative_reactions"])
    return _judge(out, command_label)


def _judge(out: DataFrame, label: str) -> DataFrame:
    c = F.col
    pos, neg = c("positive_reactions"), c("negative_reactions")
    # max_by over only-null orderings gives null, so a missing thread or lifecycle is null here
    out = out.withColumn("last_thread", F.when(c("last_thread").isin(*THREAD), c("last_thread"))).withColumn("last_lifecycle", F.when(c("last_lifecycle").isin(*LIFECYCLE), c("last_lifecycle")))
    said = lambda name: F.lit(f"explicit {name} {label}")
    outweigh = lambda a, b, x, y: F.concat(a.cast("string"), F.lit(f" {x} reaction(s) outweigh "), b.cast("string"), F.lit(f" {y}"))
    useful = [
        (c("explicit_useful") > 0, "positive", said("useful")),
        (c("explicit_false_positive") > 0, "negative", said("false-positive")),
        (pos > neg, "positive", outweigh(pos, neg, "positive", "negative")),
        (neg > pos, "negative", outweigh(neg, pos, "negative", "positive")),
        (pos + neg > 0, "neutral", F.lit("equal positive and negative reactions")),
    ]
    unchanged = F.coalesce(c("last_lifecycle") == "finding_code_unchanged", F.lit(False))
    correct = [
        (c("explicit_false_positive") > 0, "negative", said("false-positive")),
        (c("explicit_fixed") > 0, "positive", said("fixed")),
        (F.coalesce(c("last_lifecycle") == "finding_disappeared", F.lit(False)), "positive", F.lit("finding disappeared on a later commit (a signal, not confirmed)")),
        (unchanged & (neg > 0), "negative", F.lit("code unchanged across a later commit despite negative reaction(s)")),
    ]

    def ladder(rules, pick, default):
        chain = F
        for holds, value, reason in rules:
            chain = chain.when(holds, F.lit(value) if pick == "value" else reason)
        return chain.otherwise(default)

    closed = c("last_thread") == "thread_resolved"
    threaded = F.when(closed, F.lit("thread resolved")).when(c("last_thread").isNotNull(), F.lit("thread reopened/open"))
    none = F.lit(None).cast("string")
    return out.select(
        "finding_id", "positive_reactions", "negative_reactions", "developer_replies", "explicit_useful", "explicit_false_positive", "explicit_fixed", "explicit_ignore",
        F.coalesce(closed, F.lit(False)).alias("thread_resolved"), "finding_changed", "finding_disappeared", unchanged.alias("finding_code_unchanged"),
        ladder(useful, "value", F.lit("unknown")).alias("usefulness"), ladder(correct, "value", F.lit("unknown")).alias("correctness"),
        F.when(closed, F.lit("closed")).when(c("last_thread").isNotNull(), F.lit("open")).otherwise(F.lit("unknown")).alias("resolution"),
        (c("developer_replies") > 0).alias("engaged"), at_rank(c("strongest"), STRENGTHS).alias("confidence"),
        F.array_join(F.array_compact(F.array(ladder(useful, "reason", none), ladder(correct, "reason", none), threaded)), "; ").alias("reasons"),
    )


def false_positive_candidate() -> Column:
    return (F.col("explicit_false_positive") > 0) | (F.col("negative_reactions") >= 2) | ((F.col("negative_reactions") > 0) & F.col("finding_code_unchanged"))


def high_value_candidate() -> Column:
    return (F.col("explicit_useful") > 0) | F.col("finding_disappeared") | ((F.col("positive_reactions") > 0) & F.col("finding_changed"))


def feedback_slices(assessments: DataFrame, attributes: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Totals and rates of all findings, and of each value of each dimension, in one pass.

    Findings without attributes count in the total only.
    """
    joined = assessments.join(attributes.withColumn("__known", F.lit(True)), "finding_id", "left")
    sets = [[], *[[d] for d in dimensions]]
    useful, wrong = F.count_if(F.col("usefulness") == "positive"), F.count_if(F.col("usefulness") == "negative")
    grouped = joined.groupingSets(sets, *dimensions).agg(
        F.grouping_id(*dimensions).alias("gid"), F.count("*").alias("n_findings"), useful.alias("n_useful"), wrong.alias("n_negative"), F.count_if("engaged").alias("n_engaged"),
        F.max("__known").alias("__known"), F.sum("positive_reactions").alias("positive_reactions"), F.sum("negative_reactions").alias("negative_reactions"),
        rate(useful, F.count("*"), 0.0).alias("useful_rate"), rate(wrong, F.count("*"), 0.0).alias("negative_rate"),
    )
    everything = (1 << len(dimensions)) - 1
    name = F.when(F.col("gid") == everything, F.lit("all"))
    for i, d in enumerate(dimensions):
        name = name.when(F.col("gid") == everything - (1 << (len(dimensions) - 1 - i)), F.lit(d))
    out = grouped.withColumn("slice", name).where((F.col("slice") == "all") | F.col("__known"))
    return out.select("slice", F.coalesce(*[F.col(d).cast("string") for d in dimensions], F.lit("")).alias("value"), "n_findings", "n_useful", "n_negative", "n_engaged", "positive_reactions", "negative_reactions", "useful_rate", "negative_rate")


def reaction_hint(content: Column) -> Column:
    from findweave.functions.ranks import REACTION_HINTS

    return looked_up(content, REACTION_HINTS)
