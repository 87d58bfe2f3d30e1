"""Runs, generations and remembered findings as state over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.operators.matching import first_by
from findweave.operators.ranking import partition_ranked


def generation_gate(runs: DataFrame) -> DataFrame:
    """Runs with ``mode``: why the previous generation can't be used, memory_only, or incremental.

    ``runs``: previous_id, previous_status, ancestry (true, false or null for unverifiable),
    fingerprint, previous_fingerprint.
    """
    c = F.col
    mode = (
        F.when(c("previous_id").isNull(), F.lit("full_no_previous")).when(c("previous_status") != "succeeded", F.lit("full_previous_not_succeeded")).when(c("ancestry").isNull(), F.lit("full_ancestry_unverifiable"))
        .when(~c("ancestry"), F.lit("full_not_an_ancestor")).when(~c("fingerprint").eqNullSafe(c("previous_fingerprint")), F.lit("memory_only")).otherwise(F.lit("incremental"))
    )
    return runs.withColumn("mode", mode)


def incremental_selection(candidates: DataFrame, changes: DataFrame, recheck: DataFrame, changed_files: DataFrame, usable: bool = True) -> DataFrame:
    """Candidates with ``selected``: their symbol changed, was added or needs a recheck, or they are module regions of changed files.

    Without a usable previous generation all are selected.
    """
    if not usable:
        return candidates.withColumn("selected", F.lit(True))
    wanted = changes.where("status IN ('modified', 'added')").select(F.col("cur_id").alias("symbol_id")).union(recheck.select("symbol_id")).where("symbol_id IS NOT NULL").distinct().withColumn("__symbol", F.lit(True))
    files = changed_files.select("path").distinct().withColumn("__file", F.lit(True))
    j = candidates.join(wanted, "symbol_id", "left").join(files, "path", "left")
    chosen = F.coalesce(F.col("__symbol"), F.lit(False)) | (F.col("symbol_id").isNull() & F.coalesce(F.col("__file"), F.lit(False)))
    return j.withColumn("selected", chosen).drop("__symbol", "__file")


def incremental_metrics(selected: DataFrame) -> DataFrame:
    return selected.agg(F.count("*").alias("candidates"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("provider_calls_avoided"))


def current_state(transitions: DataFrame) -> DataFrame:
    """Latest status of each remembered finding; a resolved or superseded one has no current finding."""
    last = transitions.groupBy("memory_id").agg(F.max_by(F.struct("to_status", "finding_id", "evidence", "reconfirmed"), F.struct("occurred_at", "id")).alias("l"), F.max_by("evidence", F.when(F.col("reconfirmed"), F.struct("occurred_at", "id"))).alias("kept_evidence"))
    gone = F.col("l.to_status").isin("resolved", "superseded")
    return last.select("memory_id", F.col("l.to_status").alias("status"), F.when(~gone, F.col("l.finding_id")).alias("finding_id"), F.coalesce("kept_evidence", F.col("l.evidence")).alias("evidence"))


def finalize(run_id: str, live: DataFrame, found: DataFrame, outcomes: DataFrame, done: DataFrame) -> DataFrame:
    """Transitions (memory_id, to_status, finding_id) that a run adds; none if it is in ``done``.

    ``live``: memory_id, family; ``found``: finding_id, family, ord; ``outcomes``: memory_id,
    state, current_id of remembered findings. A finding that no memory matched is new; it first
    supersedes the live memory of its family, and of several of one family the last counts.
    """
    if not done.where(F.col("run_id") == run_id).isEmpty():
        return outcomes.where("false").select("memory_id", F.col("state").alias("to_status"), F.col("current_id").alias("finding_id"))
    kept = outcomes.select("memory_id", F.col("state").alias("to_status"), F.when(F.col("state") != "resolved", F.col("current_id")).alias("finding_id"))
    fresh = first_by(found.join(outcomes.where("current_id IS NOT NULL").select(F.col("current_id").alias("finding_id")), "finding_id", "left_anti"), ["family"], [F.desc("ord")])
    over = live.join(outcomes.where("state = 'resolved'").select("memory_id"), "memory_id", "left_anti").join(fresh.select("family"), "family", "left_semi")
    superseded = over.select("memory_id", F.lit("superseded").alias("to_status"), F.lit(None).cast("string").alias("finding_id"))
    opened = fresh.select(F.sha2(F.concat_ws("\x1f", F.lit(run_id), "family"), 256).alias("memory_id"), F.lit("open").alias("to_status"), F.col("finding_id"))
    return kept.join(superseded.select("memory_id"), "memory_id", "left_anti").unionByName(superseded).unionByName(opened)


def reusable_run(runs: DataFrame, identity: str) -> DataFrame:
    """The run to reuse for an identity: the latest succeeded one, else a running one; partial ones never."""
    fit = runs.where((F.col("identity") == identity) & F.col("status").isin("succeeded", "running"))
    return fit.orderBy(F.desc(F.col("status") == "succeeded"), F.desc("completed_at"), "id").limit(1)


def reusable_runs(runs: DataFrame) -> DataFrame:
    """Of every identity the run that ``reusable_run`` gives, in one pass; identities without one are left out."""
    done = F.col("status") == "succeeded"
    first = F.max_by(F.struct("id", "status"), F.struct(done.alias("done"), F.col("completed_at").isNotNull().alias("known"), "completed_at", F.col("place")))
    last_id = Window.partitionBy("identity", done, "completed_at").orderBy(F.desc("id"))
    fit = runs.where(F.col("status").isin("succeeded", "running") & F.col("identity").isNotNull()).withColumn("place", F.row_number().over(last_id))
    return fit.groupBy("identity").agg(first.alias("run")).select("identity", "run.id", "run.status")


def analysis_status(executions: DataFrame, key: str) -> DataFrame:
    """Per run: succeeded if nothing failed (skips count as success), partial if some succeeded, else failed."""
    bad, ok = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "succeeded")
    return executions.groupBy(key).agg(bad.alias("failed"), ok.alias("succeeded"), F.sum("raw_findings_count").alias("raw_findings")).withColumn("run_status", F.when(F.col("failed") == 0, F.lit("succeeded")).when(F.col("succeeded") > 0, F.lit("partial")).otherwise(F.lit("failed")))


def scenario_rollup(scenarios: DataFrame) -> DataFrame:
    return scenarios.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.sum("calls_avoided").alias("calls_avoided"), F.sum("unsafe_carry_forward").alias("unsafe_carry_forward"))


def by_variant(results: DataFrame, variant: str, measures: Sequence[str]) -> DataFrame:
    """The same sums for each variant of an ablation."""
    return results.groupBy(variant).agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in measures])


def publication_plan(findings: DataFrame, order: Sequence[Column], max_inline: int, max_summary: int, head: str | Column, reviewed_head: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Dispositions of each run's findings (without ``keys``, of one run); stale if the head moved on since the review."""
    ranked = partition_ranked(findings.withColumn("__all", F.lit(0)), [*keys, "__all"], order, F.col("line").isNotNull(), max_inline, max_summary, F.col("already_reported")).drop("__all")
    return ranked.withColumn("disposition", F.when(~F.lit(head).eqNullSafe(F.lit(reviewed_head)), F.lit("stale")).otherwise(F.col("disposition")))
