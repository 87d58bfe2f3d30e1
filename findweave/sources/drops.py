"""Polled API pages that were dropped as JSON files: comments, reactions, threads, changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "changed_files": "path string, previous_path string, status string, additions int, deletions int, patch string",
    "comments": "id long, path string, line int, original_line int, side string, body string, actor_login string, actor_type string, in_reply_to_id long, created_at timestamp",
    "reactions": "comment_id long, id long, content string, actor_login string, actor_type string, created_at timestamp",
    "reviews": "id long, state string, body string, actor_login string, actor_type string, commit_sha string, submitted_at timestamp",
    "threads": "first_comment_id long, is_resolved boolean",
}


def read_pages(spark: SparkSession, path: str, kind: str, max_pages: int | None = None) -> DataFrame:
    """Rows of the JSON arrays in ``path``; files are named by page (page-1.json, page-2.json, ...).

    With ``max_pages`` the later pages are not read into the result, as a polling client would stop.
    """
    df = spark.read.schema(SCHEMAS[kind]).option("multiLine", "true").json(path)
    if max_pages is None:
        return df
    page = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).try_cast("int")
    return df.where(page <= max_pages)


def human(df: DataFrame) -> DataFrame:
    return df.where("actor_type IS NULL OR actor_type <> 'Bot'")


def attributable(comments: DataFrame) -> DataFrame:
    """Top-level comments with what attribution compares: path, line (or the original one), side and body hash."""
    return comments.where("in_reply_to_id IS NULL").select("id", "path", F.coalesce("line", "original_line").alias("line"), "side", F.sha2(F.col("body"), 256).alias("body_hash"))


def lifecycle_of_pull_request(pulls: DataFrame) -> DataFrame:
    """One unattributed event for each merged or closed pull request (id, state, merged_at, closed_at)."""
    merged = F.col("merged_at").isNotNull()
    return pulls.where(merged | (F.col("state") == "closed")).select(F.col("id").alias("pull_request_id"), F.when(merged, F.lit("pr_merged")).otherwise(F.lit("pr_closed")).alias("event_type"), F.coalesce("merged_at", "closed_at").alias("occurred_at"))
