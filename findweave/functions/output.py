"""Texts shown to people: diff excerpts, comment bodies, markers; and rule metadata."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.functions.ranks import SEVERITIES, looked_up

MARKER = r"<!-- finding:([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}) -->"
MAX_BODY = 60_000
#: What stands behind a text that was cut.
CUT = "\n\n*(truncated)*"


def diff_excerpt(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, excerpt) of spans (id, path, start, end): the diff's lines in them, marked "+", "-" or " "."""
    mark = F.when(F.col("line_type") == "addition", F.lit("+")).when(F.col("line_type") == "deletion", F.lit("-")).otherwise(F.lit(" "))
    at = lines.select("path", "pos", F.coalesce("new_line", "old_line").alias("line"), F.concat(mark, "content").alias("text"))
    inside = spans.join(at, "path").where(F.col("line").between(F.col("start"), F.col("end")))
    joined = inside.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return spans.select("id").join(joined.select("id", F.array_join("t.text", "\n").alias("excerpt")), "id", "left")


def comment_body(header: Column, *sentences: Column, limit: int = MAX_BODY) -> Column:
    """Header and the distinct sentences in order, cut to the limit, without markers of others."""
    said = F.array_distinct(F.filter(F.transform(F.array(*sentences), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))
    text = F.concat(header, F.lit("\n\n"), F.array_join(said, " "))
    return F.left(F.replace(F.replace(text, F.lit("<!--"), F.lit("&lt;!--")), F.lit("-->"), F.lit("--&gt;")), F.lit(limit))


def without_markers(text: Column) -> Column:
    """A text whose comment signs can't open or close a marker."""
    return F.replace(F.replace(text, F.lit("<!--"), F.lit("&lt;!--")), F.lit("-->"), F.lit("--&gt;"))


def summary_bodies(findings: DataFrame, marker: Column, heading: str, limit: int = MAX_BODY) -> DataFrame:
    """(run_id, body, truncated): the text on top of each run's review, its marker always whole at the end.

    ``findings``: run_id, place, disposition (inline, summary, omitted), severity, path, line, title;
    ``marker`` over run_id. Lines are gathered of published findings only, which the plan bounds;
    omitted ones are counted. A body without room is cut at the end of its text.
    """
    c, empty, nl = F.col, F.lit(""), F.lit("\n")
    told = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** `"), "path", F.lit(":"), c("line").cast("string"), F.lit("` — "), without_markers(F.trim("title")))
    of = lambda kind: F.count_if(c("disposition") == kind)
    lines = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("disposition") == kind, F.struct("place", told.alias("told"))))), lambda x: x["told"]), "\n")
    levels = tuple(reversed(SEVERITIES))
    g = findings.groupBy("run_id").agg(*[F.count_if(c("severity") == s).alias(s) for s in levels], *[of(k).alias(f"n_{k}") for k in ("inline", "summary", "omitted")], lines("inline").alias("inline"), lines("summary").alias("summary"))
    counted = F.array_join(F.array_compact(F.array(*[F.when(c(s) > 0, F.concat(c(s).cast("string"), F.lit(f" {s}"))) for s in levels])), ", ")
    number = lambda kind: c(f"n_{kind}").cast("string")
    part = lambda kind, title: F.when(c(f"n_{kind}") > 0, F.concat(F.lit(f"### {title}\n"), c(kind), F.lit("\n\n"))).otherwise(empty)
    text = F.concat(
        F.lit(f"## {heading}\n\n**Findings:** "), F.when(counted == "", F.lit("none")).otherwise(counted), F.lit("\n**Published inline:** "), number("inline"), F.lit(" · **Summary-only:** "), number("summary"), F.lit(" · **Omitted:** "), number("omitted"), F.lit("\n\n"),
        part("inline", "Inline comments"), part("summary", "Additional findings (not mappable to a diff line)"), F.when(c("n_omitted") > 0, F.concat(F.lit("*"), number("omitted"), F.lit(" additional finding(s) omitted.*"))).otherwise(empty),
    )
    g = g.select("run_id", F.rtrim(text, nl).alias("text"), marker.alias("mark")).withColumn("room", limit - F.length("mark") - 2)
    over = F.length("text") > c("room")
    kept = F.when(over, F.concat(F.left("text", F.greatest(c("room") - len(CUT), F.lit(0))), F.lit(CUT))).otherwise(c("text"))
    return g.select("run_id", F.concat(kept, nl, nl, "mark").alias("body"), over.alias("truncated"))


def marker_id(body: Column) -> Column:
    """The id in a body's marker, or null."""
    return F.nullif(F.regexp_extract(body, MARKER, 1), F.lit(""))


def remapped(line: Column, old_start: Column, new_start: Column) -> Column:
    """A line of a symbol that moved."""
    return line - old_start + new_start


def rule_metadata(rule_id: Column, table: dict[str, dict[str, str]], field: str) -> Column:
    return looked_up(rule_id, {rule: values[field] for rule, values in table.items() if field in values})


def config_fingerprint(config: dict) -> str:
    """SHA-256 of the settings as canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def folder_fingerprint(files: DataFrame) -> DataFrame:
    """One hash over all files (path, sha256): first over those of each prefix of the path's hash, then over these."""
    entry = F.transform(F.sort_array(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat_ws("\x1f", f["path"], f["sha256"]))
    parts = files.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.sha2(F.array_join(entry, "\n"), 256).alias("hash"))
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("part", "hash")))["hash"], "\n"), 256).alias("fingerprint"))
