"""Unified diffs as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def patch_lines(files: DataFrame, path: str = "path", patch: str = "patch") -> DataFrame:
    """Lines of each file's patch: path, hunk, pos, line_type, old_line, new_line, content, error.

    Null and empty patches have no lines. A line before the first hunk, a malformed hunk header and
    an unknown marker come as rows with ``error``; "\\ No newline" and a final blank are skipped.
    """
    text = files.where(F.coalesce(F.length(patch), F.lit(0)) > 0)
    raw = text.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(patch), "\n")).alias("pos", "raw"))
    c = F.col
    raw = raw.withColumn("head", c("raw").startswith("@@"))
    by = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    raw = raw.withColumn("hunk", F.sum(c("head").cast("int")).over(by))
    skip = c("raw").startswith("\\") | (c("raw") == "")
    group = lambda n: F.regexp_extract("raw", HUNK, n)
    marked = raw.where(c("head") | ~skip).select(
        "path", "pos", "hunk", "raw", "head",
        F.when(c("head"), group(1).try_cast("int") - 0).alias("old_start"), F.when(c("head"), group(3).try_cast("int")).alias("new_start"),
        F.when(c("head"), F.lit(None).cast("string")).when(c("raw").startswith("+"), F.lit("addition")).when(c("raw").startswith("-"), F.lit("deletion")).when(c("raw").startswith(" "), F.lit("context")).alias("line_type"),
        F.when(c("head") & ~c("raw").rlike(HUNK), F.lit("malformed hunk header")).when(~c("head") & (c("hunk") == 0), F.lit("content before first hunk")).when(~c("head") & ~c("raw").rlike("^[-+ ]"), F.lit("unknown marker")).alias("error"),
    )
    inside = Window.partitionBy("path", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = Window.partitionBy("path", "hunk")
    old = F.max("old_start").over(start) + F.coalesce(F.sum(c("line_type").isin("context", "deletion").cast("int")).over(inside), F.lit(0))
    new = F.max("new_start").over(start) + F.coalesce(F.sum(c("line_type").isin("context", "addition").cast("int")).over(inside), F.lit(0))
    numbered = marked.withColumn("old", old).withColumn("new", new)
    return numbered.where(~c("head") | c("error").isNotNull()).select(
        "path", (c("hunk") - 1).cast("int").alias("hunk"), "pos", "line_type",
        F.when(c("line_type").isin("context", "deletion"), c("old")).cast("int").alias("old_line"), F.when(c("line_type").isin("context", "addition"), c("new")).cast("int").alias("new_line"),
        F.substring("raw", 2, 1 << 30).alias("content"), "error",
    )


def split_files(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, patch) of each file in a ``git diff`` text; the patch starts at its first hunk."""
    lines = diffs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    path = F.regexp_extract("raw", r"^diff --git a/.* b/(.*)$", 1)
    by = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("starts", F.col("raw").rlike(r"^diff --git a/.* b/")).withColumn("file", F.sum(F.col("starts").cast("int")).over(by)).where("file > 0")
    in_file = Window.partitionBy(key, "file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("path", F.max(F.when(F.col("starts"), path)).over(Window.partitionBy(key, "file"))).withColumn("hunks", F.sum(F.col("raw").startswith("@@").cast("int")).over(in_file))
    body = F.sort_array(F.collect_list(F.when(F.col("hunks") > 0, F.struct("pos", "raw"))))
    return lines.groupBy(key, "file", "path").agg(body.alias("b")).select(key, "path", F.array_join("b.raw", "\n").alias("patch"))


def name_status(text: Column) -> Column:
    """``git diff --name-status -z`` output as an array of (change, path, previous_path).

    A rename has two paths; A, M, D one; other statuses use up their own field only.
    """
    entry = "array<struct<change:string,path:string,previous_path:string>>"
    zero = F.struct(F.array().cast(entry).alias("out"), F.lit("").alias("status"), F.lit(None).cast("string").alias("old"))
    keep = lambda a, status, old, more=None: F.struct(a["out"].alias("out") if more is None else F.concat(a["out"], F.array(more)).alias("out"), status.alias("status"), old.alias("old"))
    none = F.lit(None).cast("string")
    row = lambda change, path, old: F.struct(change.alias("change"), path.alias("path"), old.alias("previous_path"))

    def step(a, x):
        letter = F.substring(x, 1, 1)
        known = letter.isin("A", "M", "D", "R")
        return (
            F.when(a["status"] == "", F.when(known, keep(a, letter, none)).otherwise(keep(a, F.lit(""), none)))
            .when((a["status"] == "R") & a["old"].isNull(), keep(a, F.lit("R"), x))
            .otherwise(keep(a, F.lit(""), none, row(a["status"], x, a["old"])))
        )

    return F.aggregate(F.filter(F.split(text, "\x00"), lambda x: x != ""), zero, step, lambda a: a["out"])


def all_lines_added(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Every line of every file as an addition."""
    lines = F.split(F.regexp_replace(F.col(content), r"\n\z", ""), "\n")
    return files.where(F.length(content) > 0).select(F.col(path).alias("path"), F.posexplode(lines).alias("pos", "content")).select("path", (F.col("pos") + 1).alias("new_line"), "content", F.lit("addition").alias("line_type"))


def diff_position(findings: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with the line (or range) they can be shown at, or the reason why not.

    ``findings``: id, path, start_line, end_line; ``files``: path, status, patch; ``lines``: from
    ``patch_lines``.
    """
    from findweave.functions.text import safe_relative_path

    c = F.col
    shown = lines.where("line_type <> 'deletion' AND new_line IS NOT NULL").select(c("path").alias("l_path"), "hunk", "new_line")
    f = findings.withColumn("lo", F.least("start_line", "end_line")).withColumn("hi", F.greatest("start_line", "end_line"))
    met = f.select("id", "path", "lo", "hi").join(shown, (c("path") == c("l_path")) & c("new_line").between(c("lo"), c("hi")))
    seen = met.groupBy("id").agg(F.count_distinct("hunk").alias("hunks"), F.count_distinct("new_line").alias("n"), F.bool_or(c("new_line") == c("hi")).alias("has_hi"), F.bool_or(c("new_line") == c("lo")).alias("has_lo"))
    hunks = lines.select("path").distinct().withColumn("has_hunks", F.lit(True))
    g = f.join(files.select("path", "status", c("patch").isNotNull().alias("has_patch"), F.lit(True).alias("known")), "path", "left").join(hunks, "path", "left").join(seen, "id", "left")
    whole = (c("hunks") == 1) & (c("n") == c("hi") - c("lo") + 1)
    reason = (
        F.when(~safe_relative_path(c("path")), F.lit("path_unsafe")).when(c("known").isNull(), F.lit("file_not_in_diff")).when(c("status") == "removed", F.lit("file_deleted"))
        .when(~c("has_patch") | c("has_hunks").isNull(), F.lit("binary_or_no_patch")).when(~F.coalesce(c("has_hi") | c("has_lo"), F.lit(False)), F.lit("line_not_in_diff"))
    )
    line = F.when(whole | c("has_hi"), c("hi")).when(c("has_lo"), c("lo"))
    return g.select("id", "path", reason.alias("reason"), F.when(reason.isNull(), line).alias("line"), F.when(reason.isNull() & whole & (c("hi") > c("lo")), c("lo")).alias("first_line"))
