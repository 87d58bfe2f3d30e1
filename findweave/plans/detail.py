"""Queries that show rows where others count them, over texts and paths that differ from row to row.
Surrogates: a part is a file, its diff, its comment; an order is a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.functions.output import comment_body, diff_excerpt, marker_id
from findweave.functions.text import module_of, safe_relative_path
from findweave.operators import code, dedupe, lifecycle
from findweave.plans.lifecycle import _FINDINGS, _findings
from findweave.sources.diff import name_status, patch_lines, split_files
from findweave.sources.repository import TEST_PATH


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _parts(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.col("p_name").alias("n"), F.col("p_type").alias("y"))


def _if(given: Column, *parts) -> Column:
    return F.when(given, _text(*parts)).otherwise(F.lit(""))


def merged_findings(spark, d):
    """Each finding with its group, whether it stands for it, and how many it holds."""
    return dedupe.merge(_findings(spark, d)).select("id", "group_id", "is_primary", "n_sources")


def generation_modes(spark, d):
    c = F.col("o_orderkey")
    runs = spark.read.parquet(f"{d}/orders.parquet").select(
        c.alias("id"), F.when(c % 5 != 0, c).alias("previous_id"), F.when(F.col("o_orderstatus") == "F", F.lit("failed")).otherwise(F.lit("succeeded")).alias("previous_status"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(True)).when(F.col("o_custkey") % 3 == 1, F.lit(False)).alias("ancestry"), F.when(c % 11 != 0, F.lit("a")).alias("fingerprint"), F.when(c % 2 == 0, F.lit("a")).alias("previous_fingerprint"),
    )
    return lifecycle.generation_gate(runs).select("id", "mode")


def reusable_by_identity(spark, d):
    c = F.col
    status = F.get(F.array(*map(F.lit, ("partial", "running", "succeeded", "failed"))), ((c("o_custkey") + c("o_orderkey")) % 4).cast("int"))
    at = F.when(c("o_orderpriority") != "1-URGENT", F.date_trunc("year", "o_orderdate"))
    return lifecycle.reusable_runs(spark.read.parquet(f"{d}/orders.parquet").select(c("o_orderkey").alias("id"), c("o_custkey").cast("string").alias("identity"), status.alias("status"), at.alias("completed_at")))


def diff_file_patches(spark, d):
    """A changed file, a binary one, a renamed one and one with two hunks, as sizes have it."""
    k, s, n = F.col("k"), F.col("s"), F.col("n")
    text = F.concat(
        _if(s % 7 == 0, "warning: noise\n"), _text("diff --git a/x/", n, " b/x/", n, "\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+", n), _if(s % 2 == 0, "\ndiff --git a/b", k, ".png b/b", k, ".png\nBinary files differ"),
        _if(s % 3 == 0, "\ndiff --git a/old", k, " b/new", k, "\nsimilarity index 87%\nrename from old", k, "\nrename to new", k), _if(s % 5 < 2, "\ndiff --git a/z b/z\n@@ -3 +3 @@\n-", s, "\n@@ -9 +9 @@\n+diff --git a/no b/no\n "),
    )
    return split_files(_parts(spark, d).select("k", text.alias("text")), "k", "text")


def name_status_entries(spark, d):
    k, s, n = F.col("k"), F.col("s"), F.col("n")
    text = F.concat(_if(s % 2 == 0, "M\x00a/", n, "\x00"), _if(s % 3 == 0, "R087\x00old/", n, "\x00new/", k, "\x00"), _if(s % 5 == 0, "T\x00"), _if(s % 4 == 1, "A\x00M\x00"), _if(s % 7 == 0, "D\x00gone", k))
    return _parts(spark, d).select("k", F.inline(name_status(text)))


def path_modules(spark, d):
    """Modules and safety of paths of ten shapes."""
    k, s = F.col("k"), F.col("s")
    name = F.replace("n", F.lit(" "), F.lit("_"))
    shapes = (("src/", ".py"), ("src/", "/__init__.py"), ("/abs/", ".py"), ("a/../", ".py"), ("a\\", ".py"), ("C:", ".py"), ("a//", ".py"), ("./", ".py"), ("..", ""), ("", ""))
    path = F.when(s % 11 == 10, F.lit(None).cast("string"))
    for i, (before, after) in enumerate(shapes):
        path = path.when(s % 11 == i, _text(before, name if i < 9 else F.lit(""), after))
    p = _parts(spark, d).select("k", path.alias("path"))
    return p.select(k, "path", module_of(F.col("path")).alias("module"), safe_relative_path(F.col("path")).alias("safe"))


def related_test_files(spark, d):
    """Tests by prefix and suffix, sources with twins, and imports."""
    k, s, p = F.col("k"), F.col("s"), _parts(spark, d)
    of = lambda given, before, after: p.where(given).select(_text(before, k, after).alias("path"))
    files = of(F.lit(True), "src/mod", ".py").union(of(s % 6 == 0, "lib/mod", ".py")).union(of(s % 2 == 0, "tests/test_mod", ".py")).union(of(s % 5 == 0, "src/mod", "_test.py"))
    imports = p.where(s % 4 == 0).select(_text("tests/test_mod", k, ".py").alias("path"), F.when(s % 8 == 0, _text("src/mod", k, ".py")).otherwise(_text("src/other", k, ".py")).alias("resolved_path"))
    return code.related_tests(files.withColumn("is_test", F.col("path").rlike(TEST_PATH)), imports.union(p.where(s % 3 == 0).select(_text("src/mod", k, ".py"), _text("src/other", k, ".py"))))


def comment_texts(spark, d):
    """Comments with repeated, blank and missing sentences and foreign markers, cut at 60 characters."""
    k, s = F.col("k"), F.col("s")
    body = comment_body(_text("**", F.col("y"), "**"), F.col("n"), F.when(s % 2 == 0, F.concat(F.lit(" "), "n")), F.when(s % 3 == 0, F.lit("  ")).otherwise(F.col("y")), F.when(s % 5 == 0, F.lit("<!-- finding:x -->")), limit=60)
    ident = F.concat(F.lit("0000000A-0000-4000-8000-"), F.lpad(k.cast("string"), 12, "0"))
    marked = F.concat(body, F.lit("\n<!-- finding:"), ident, F.when(s % 7 == 0, F.lit("-->")).otherwise(F.lit(" -->")))
    return _parts(spark, d).select("k", body.alias("body"), marker_id(marked).alias("marker"))


def diff_span_excerpts(spark, d):
    """The lines of a diff within a span, none where it lies outside."""
    k, s, n = F.col("k"), F.col("s"), F.col("n")
    files = _parts(spark, d).select(_text("p", k).alias("path"), "k", "s", _text("@@ -1,3 +1,4 @@\n ctx\n-old ", n, "\n+new ", n, "\n+more\n end").alias("patch"))
    return diff_excerpt(files.select(F.col("k").alias("id"), "path", (s % 6).alias("start"), (s % 6 + s % 3).alias("end")), patch_lines(files))


QUERIES = {
    "merged_findings": merged_findings, "generation_modes": generation_modes, "reusable_by_identity": reusable_by_identity, "diff_file_patches": diff_file_patches, "name_status_entries": name_status_entries,
    "path_modules": path_modules, "related_test_files": related_test_files, "comment_texts": comment_texts, "diff_span_excerpts": diff_span_excerpts,
}

_P = "p AS (SELECT p_partkey AS k, p_size AS s, p_name AS n, p_type AS y FROM part)"
ORACLES = {
    "merged_findings": f"""WITH RECURSIVE {_FINDINGS}, b AS (SELECT a_id AS x, b_id AS y FROM p UNION SELECT b_id, a_id FROM p), w AS (SELECT DISTINCT x, x AS r FROM b UNION SELECT b.y, w.r FROM w JOIN b ON b.x = w.x), g AS (SELECT x, min(r) AS root FROM w GROUP BY 1),
n AS (SELECT f.*, coalesce(root, f.id) AS root FROM f LEFT JOIN g ON g.x = f.id)
SELECT id, root AS group_id, row_number() OVER (PARTITION BY root ORDER BY sev, conf, an, id) = 1 AS is_primary, count(*) OVER (PARTITION BY root) AS n_sources FROM n""",
    "generation_modes": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'full_no_previous' WHEN o_orderstatus = 'F' THEN 'full_previous_not_succeeded' WHEN o_custkey % 3 = 2 THEN 'full_ancestry_unverifiable' WHEN o_custkey % 3 = 1 THEN 'full_not_an_ancestor'
  WHEN (o_orderkey % 11 <> 0) <> (o_orderkey % 2 = 0) THEN 'memory_only' ELSE 'incremental' END AS mode FROM orders""",
    "reusable_by_identity": """SELECT o_custkey::VARCHAR AS identity, o_orderkey AS id, CASE (o_custkey + o_orderkey) % 4 WHEN 1 THEN 'running' ELSE 'succeeded' END AS status FROM orders WHERE (o_custkey + o_orderkey) % 4 IN (1, 2)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_custkey + o_orderkey) % 4 DESC, CASE WHEN o_orderpriority <> '1-URGENT' THEN year(o_orderdate) END DESC NULLS LAST, o_orderkey) = 1""",
    "diff_file_patches": f"""WITH {_P} SELECT k, 'x/' || n AS path, '@@ -1 +1 @@' || chr(10) || '+' || n AS patch FROM p UNION ALL SELECT k, 'b' || k || '.png', '' FROM p WHERE s % 2 = 0 UNION ALL SELECT k, 'new' || k, '' FROM p WHERE s % 3 = 0
UNION ALL SELECT k, 'z', '@@ -3 +3 @@' || chr(10) || '-' || s || chr(10) || '@@ -9 +9 @@' || chr(10) || '+diff --git a/no b/no' || chr(10) || ' ' FROM p WHERE s % 5 < 2""",
    "name_status_entries": f"""WITH {_P} SELECT k, 'M' AS change, 'a/' || n AS path, NULL::VARCHAR AS previous_path FROM p WHERE s % 2 = 0 UNION ALL SELECT k, 'R', 'new/' || k, 'old/' || n FROM p WHERE s % 3 = 0
UNION ALL SELECT k, 'A', 'M', NULL FROM p WHERE s % 4 = 1 UNION ALL SELECT k, 'D', 'gone' || k, NULL FROM p WHERE s % 7 = 0""",
    "path_modules": f"""WITH {_P}, x AS (SELECT k, s % 11 AS i, replace(n, ' ', '_') AS m FROM p) SELECT k, CASE i WHEN 0 THEN 'src/' || m || '.py' WHEN 1 THEN 'src/' || m || '/__init__.py' WHEN 2 THEN '/abs/' || m || '.py' WHEN 3 THEN 'a/../' || m || '.py' WHEN 4 THEN 'a\\' || m || '.py' WHEN 5 THEN 'C:' || m || '.py'
  WHEN 6 THEN 'a//' || m || '.py' WHEN 7 THEN './' || m || '.py' WHEN 8 THEN '..' || m WHEN 9 THEN '' END AS path, CASE i WHEN 0 THEN 'src.' || m WHEN 1 THEN 'src.' || m WHEN 2 THEN '.abs.' || m WHEN 3 THEN 'a....' || m WHEN 4 THEN 'a\\' || m WHEN 5 THEN 'C:' || m WHEN 6 THEN 'a..' || m WHEN 7 THEN '..' || m
  WHEN 8 THEN '..' || m WHEN 9 THEN '' END AS module, i IN (0, 1, 8) AS safe FROM x""",
    "related_test_files": f"""WITH {_P}, t AS (SELECT 'tests/test_mod' || k || '.py' AS test_path, 'src/mod' || k || '.py' AS source_path, 'filename' AS r FROM p WHERE s % 2 = 0 AND s % 6 <> 0 UNION ALL SELECT 'src/mod' || k || '_test.py', 'src/mod' || k || '.py', 'filename' FROM p WHERE s % 5 = 0 AND s % 6 <> 0
  UNION ALL SELECT 'tests/test_mod' || k || '.py', CASE WHEN s % 8 = 0 THEN 'src/mod' ELSE 'src/other' END || k || '.py', 'import' FROM p WHERE s % 4 = 0) SELECT test_path, source_path, string_agg(r, ', ' ORDER BY r) AS reason FROM t GROUP BY 1, 2""",
    "comment_texts": f"""WITH {_P}, x AS (SELECT k, s, '**' || y || '**' || chr(10) || chr(10) || n || CASE WHEN s % 3 <> 0 AND y <> n THEN ' ' || y ELSE '' END || CASE WHEN s % 5 = 0 THEN ' &lt;!-- finding:x --&gt;' ELSE '' END AS b FROM p)
SELECT k, left(b, 60) AS body, CASE WHEN s % 7 <> 0 THEN '0000000A-0000-4000-8000-' || lpad(k::VARCHAR, 12, '0') END AS marker FROM x""",
    "diff_span_excerpts": f"""WITH {_P}, l AS (SELECT k, s % 6 AS lo, s % 6 + s % 3 AS hi, unnest([1, 2, 2, 3, 4]) AS line, unnest([1, 2, 3, 4, 5]) AS pos, unnest([' ctx', '-old ' || n, '+new ' || n, '+more', ' end']) AS t FROM p) SELECT k AS id, string_agg(t, chr(10) ORDER BY pos) FILTER (line BETWEEN lo AND hi) AS excerpt FROM l GROUP BY 1""",
}
