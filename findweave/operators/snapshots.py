"""Comparison of two snapshots of symbols, and what follows for remembered findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IDENTITY = ("path", "name", "kind")


def continuity(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What became of each symbol: (prev_id, cur_id, status).

    Both sides have id, path, name, kind, hash. Identity is settled first (unchanged or modified by
    hash); what is left pairs up by (hash, kind): with one candidate the first previous symbol, by
    path, name and id, moved (same name) or was renamed, and any others are deleted; with several
    candidates all are ambiguous. Current symbols that nothing took are added.
    """
    p = previous.select(*[F.col(c).alias(f"p_{c}") for c in ("id", *IDENTITY, "hash")])
    c = current.select(*[F.col(x).alias(f"c_{x}") for x in ("id", *IDENTITY, "hash")])
    on = F.lit(True)
    for x in IDENTITY:
        on = on & (F.col(f"p_{x}") == F.col(f"c_{x}"))
    same = p.join(c, on)
    settled = same.select("p_id", "c_id", F.when(F.col("p_hash") == F.col("c_hash"), F.lit("unchanged")).otherwise(F.lit("modified")).alias("status"))
    rest_p = p.join(same.select("p_id"), "p_id", "left_anti")
    rest_c = c.join(same.select("c_id"), "c_id", "left_anti")
    pool = rest_c.groupBy("c_hash", "c_kind").agg(F.count("*").alias("n"), F.min("c_id").alias("c_id"), F.min("c_name").alias("c_name"))
    turn = F.row_number().over(Window.partitionBy("p_hash", "p_kind").orderBy("p_path", "p_name", "p_id"))
    hashed = rest_p.withColumn("turn", turn).join(pool, (F.col("p_hash") == F.col("c_hash")) & (F.col("p_kind") == F.col("c_kind")), "left")
    taken = (F.col("n") == 1) & (F.col("turn") == 1)
    status = F.when(F.col("n") > 1, F.lit("ambiguous")).when(taken, F.when(F.col("p_name") == F.col("c_name"), F.lit("moved")).otherwise(F.lit("renamed"))).otherwise(F.lit("deleted"))
    moved = hashed.select("p_id", F.when(taken, F.col("c_id")).alias("c_id"), status.alias("status"))
    added = rest_c.join(moved.where("c_id IS NOT NULL").select("c_id"), "c_id", "left_anti").select(F.lit(None).cast(previous.schema["id"].dataType).alias("p_id"), "c_id", F.lit("added").alias("status"))
    return settled.unionByName(moved).unionByName(added).select(F.col("p_id").alias("prev_id"), F.col("c_id").alias("cur_id"), "status")


def before_review(memory: DataFrame, changes: DataFrame, file_changes: DataFrame | None = None) -> DataFrame:
    """Disposition of remembered findings: resolved, recheck or carry_forward, with the reason.

    ``memory``: symbol_id, evidence_holds, ... (and path, if ``file_changes`` is given); ``changes``:
    prev_id, status from ``continuity``; ``file_changes``: path, change. A finding without a symbol
    is settled by its file alone: gone with it, else to be looked at again.
    """
    joined = memory.join(changes.select(F.col("prev_id").alias("symbol_id"), "status"), "symbol_id", "left")
    steady = F.col("status").isin("unchanged", "moved", "renamed")
    disposition = F.when(F.col("status") == "deleted", F.lit("resolved")).when(steady & F.col("evidence_holds"), F.lit("carry_forward")).otherwise(F.lit("recheck"))
    reason = F.when(F.col("status").isNull(), F.lit("no_continuity")).when(steady & ~F.col("evidence_holds"), F.lit("evidence_lost")).otherwise(F.concat(F.lit("symbol_"), F.col("status")))
    if file_changes is not None:
        joined = joined.join(file_changes.select("path", "change").dropDuplicates(["path"]), "path", "left")
        module = F.col("symbol_id").isNull()
        gone = module & F.coalesce(F.col("change") == "D", F.lit(False))
        disposition = F.when(gone, F.lit("resolved")).when(module, F.lit("recheck")).otherwise(disposition)
        reason = F.when(gone, F.lit("file_deleted")).when(module & (F.col("change") == "R"), F.lit("file_renamed")).when(module, F.lit("module_level")).otherwise(reason)
    return joined.withColumn("disposition", disposition).withColumn("reason", reason)


def after_review(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Final state of remembered findings once current ones are known.

    ``prior``: subject, category, severity, message, disposition; ``current``: the same without it.
    """
    first = current.withColumn("__r", F.row_number().over(Window.partitionBy("subject", "category").orderBy("id"))).where("__r = 1")
    first = first.select("subject", "category", F.col("id").alias("current_id"), F.col("severity").alias("c_severity"), F.col("message").alias("c_message"))
    met = prior.join(first, ["subject", "category"], "left")
    equal = (F.col("severity") == F.col("c_severity")) & (F.col("message") == F.col("c_message"))
    state = (
        F.when(F.col("disposition") == "resolved", F.lit("resolved"))
        .when(F.col("current_id").isNull(), F.when(F.col("disposition") == "carry_forward", F.lit("carried_forward")).otherwise(F.lit("resolved")))
        .when(equal, F.lit("carried_forward"))
        .otherwise(F.lit("changed"))
    )
    return met.withColumn("state", state).drop("c_severity", "c_message")


def newest_of_family(rows: DataFrame, family: list[str], version: str, row_id: str) -> DataFrame:
    """Rows with ``state``: the latest of each family is live, the others are superseded by the next."""
    by = Window.partitionBy(*family).orderBy(version, row_id)
    following = F.lead(row_id).over(by)
    return rows.withColumn("superseded_by", following).withColumn("state", F.when(following.isNull(), F.lit("live")).otherwise(F.lit("superseded")))


def active_version(versions: DataFrame, group: str, version: str, succeeded: str) -> DataFrame:
    """(group, active_version, next_version): the latest succeeded one, and one more than any."""
    return versions.groupBy(group).agg(F.max(F.when(F.col(succeeded), F.col(version))).alias("active_version"), (F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))
