"""Span queries. Surrogates: an order is a file, a line item a span from its line number.

The four-column key (order, line, part, supplier) is the identity of a span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.operators import intervals as iv
from findweave.operators.graph import neighbours_within_two
from findweave.sources.diff import all_lines_added, diff_position, name_status, patch_lines, split_files


def spans(spark, d: str) -> DataFrame:
    """file, id, category, start, end, rank."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    start = F.col("l_linenumber").cast("long") * 3
    return li.select(F.col("l_orderkey").alias("file"), ident.alias("id"), F.col("l_returnflag").alias("category"), start.alias("start"), (start + (F.col("l_quantity").cast("long") % 7)).alias("end"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("at"))


SPANS = """
s AS (SELECT l_orderkey AS file, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS category, l_linenumber::BIGINT * 3 AS "start", l_linenumber::BIGINT * 3 + l_quantity::BIGINT % 7 AS "end", l_extendedprice AS price FROM lineitem)"""


def lines(spark, d: str) -> DataFrame:
    """Changed lines: one per order, derived from its customer."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 24).alias("line"))


LINES = "ch AS (SELECT o_orderkey AS file, o_custkey % 24 AS line FROM orders)"


def overlap_pairs(spark, d):
    return iv.overlap_pairs(spans(spark, d), ["file", "category"], "id", "start", "end").select("file", "category", "a_id", "b_id")


def overlap_components(spark, d):
    return iv.overlap_components(spans(spark, d), ["file", "category"], "id", "start", "end")


def innermost(spark, d):
    points = lines(spark, d)
    return iv.innermost(points, spans(spark, d), ["file"], "file", "line", "id", "start", "end").select("file", "line", "innermost_id")


def changed_flags(spark, d):
    """Does a changed line fall on a span's first line, and does one fall into it? Three lines of a file change."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    many = o.select(F.col("o_orderkey").alias("file"), F.explode(F.array(F.col("o_custkey") % 24, F.col("o_custkey") % 11 + 3, F.col("o_custkey") % 24)).alias("line"))
    s = iv.touched(spans(spark, d), many, ["file"], "id", "start", "end", "line", "in_changed_symbol")
    return iv.touched(s, many, ["file"], "id", "start", "start", "line", "on_changed_line").select("id", "on_changed_line", "in_changed_symbol")


def greedy(spark, d):
    return iv.greedy_disjoint(spans(spark, d), ["file", "category"], [F.col("start"), -F.col("price"), F.col("id")], "start", "end", ["id", "start", "end"])


def clusters(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("hour"))
    return iv.anchored_clusters(e, ["user_id"], "hour", 60)


def attach(spark, d):
    s = spans(spark, d)
    left, right = s.where("category = 'A'").select("file", "id", "start", "end"), s.where("category = 'N'").select("file", F.col("id").alias("finding"), "start", "end")
    out = iv.attached(left, right, ["file"], "id", "finding", "start", "end", "findings")
    return out.select("id", F.array_join("findings", ",").alias("findings"))


def siblings(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = o.select(F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("parent"), F.col("o_orderkey").alias("id"), day.alias("start"), (day + F.col("o_totalprice").cast("long") % 90).alias("end"))
    return iv.nearest_siblings(rows, ["parent"], "id", "start", "end").select("id", "previous_id", "next_id")


def two_hop(spark, d):
    """Suppliers and parts are nodes by their numbers; a part leads on where a supplier has its number."""
    e = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return neighbours_within_two(e, "src", "dst", 5)


def diff_line_numbers(spark, d):
    """Conversations as patches: lines are context, additions and deletions in turn."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.split(F.regexp_replace("text", "\n", " "), " ").alias("w"))
    marks = F.array(F.lit(" "), F.lit("+"), F.lit("-"))
    body = F.array_join(F.transform("w", lambda x, i: F.concat(F.get(marks, i % 3), x)), "\n")
    files = c.where(F.size("w") > 0).select("path", F.concat(F.lit("@@ -1,9 +11,9 @@\n"), body).alias("patch")).dropDuplicates(["path"])
    return patch_lines(files).select("path", F.col("pos").cast("long").alias("pos"), "line_type", F.col("old_line").cast("long").alias("old_line"), F.col("new_line").cast("long").alias("new_line"), "content")


def _patches(spark, d) -> DataFrame:
    """A small patch per nation."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    body = F.concat(F.lit("@@ -1,2 +1,3 @@\n "), F.col("n_name"), F.lit("\n+added\n-gone\n kept\n@@ -20 +21,2 @@\n+one\n+two\n\\ No newline at end of file"))
    return n.select(F.concat(F.lit("src/"), F.lower("n_name"), F.lit(".py")).alias("path"), F.when(F.col("n_nationkey") % 5 != 4, body).alias("patch"), F.when(F.col("n_nationkey") % 7 == 6, F.lit("removed")).otherwise(F.lit("modified")).alias("status"), "n_nationkey")


def positions(spark, d):
    files = _patches(spark, d)
    at = files.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 6 == 5, F.lit("../x.py")).otherwise(F.col("path")).alias("path"), (F.col("n_nationkey") % 4 + 1).alias("start_line"), (F.col("n_nationkey") % 4 + 1 + F.col("n_nationkey") % 3 * 10).alias("end_line"))
    return diff_position(at, files, patch_lines(files)).select("id", "reason", F.col("line").cast("int").alias("line"), F.col("first_line").cast("int").alias("first_line"))


def name_status_records(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    text = F.concat(F.lit("M\x00a/"), "n_name", F.lit("\x00R087\x00old/"), "n_name", F.lit("\x00new/"), "n_name", F.lit("\x00T\x00D\x00gone\x00"))
    return n.select("n_nationkey", F.inline(name_status(text)))


def git_diff_files(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    name = F.lower("n_name")
    text = F.concat(F.lit("diff --git a/x/"), name, F.lit(" b/x/"), name, F.lit("\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+y\ndiff --git a/z b/z\n@@ -3 +3 @@\n-q"))
    return split_files(n.select("n_nationkey", text.alias("text")), "n_nationkey", "text")


def whole_repo_lines(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("path"), F.concat(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("\n")).alias("content"))
    return all_lines_added(b).select("path", "new_line", "content")


QUERIES = {
    "interval_overlap_pairs": overlap_pairs, "interval_components": overlap_components, "innermost_containing": innermost, "changed_flags": changed_flags, "greedy_interval_dedup": greedy, "anchored_clusters": clusters,
    "attach_overlaps": attach, "nearest_siblings": siblings, "graph_two_hop": two_hop, "diff_line_numbers": diff_line_numbers, "diff_positions": positions, "name_status_records": name_status_records, "git_diff_files": git_diff_files, "whole_repo_lines": whole_repo_lines,
}

ORACLES = {
    "interval_overlap_pairs": f'WITH {SPANS} SELECT a.file, a.category, a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.file = b.file AND a.category = b.category AND a.id < b.id AND a."start" <= b."end" AND b."start" <= a."end"',
    # spans on a line: a component ends where the running maximum of the ends is passed
    "interval_components": f"""WITH {SPANS}, m AS (SELECT *, max("end") OVER (PARTITION BY file, category ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, sum((before IS NULL OR "start" > before)::INT) OVER (PARTITION BY file, category ORDER BY "start", "end", id) AS grp FROM m) SELECT id, min(id) OVER (PARTITION BY file, category, grp) AS root FROM g""",
    "innermost_containing": f"""WITH {SPANS}, {LINES} SELECT file, line, (SELECT arg_min(id, ("end" - "start", "start", id)) FROM s WHERE s.file = ch.file AND ch.line BETWEEN s."start" AND s."end") AS innermost_id FROM ch""",
    "changed_flags": f"""WITH {SPANS}, ch AS (SELECT o_orderkey AS file, unnest([o_custkey % 24, o_custkey % 11 + 3]) AS line FROM orders)
SELECT id, coalesce(bool_or("start" = line), false) AS on_changed_line, coalesce(bool_or(line BETWEEN "start" AND "end"), false) AS in_changed_symbol FROM s LEFT JOIN ch USING (file) GROUP BY id""",
    "greedy_interval_dedup": f"""WITH RECURSIVE {SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY file, category ORDER BY "start", -price, id) AS r FROM s),
w AS (SELECT file, category, id, "start", "end", r, true AS kept, "end" AS last FROM o WHERE r = 1 UNION ALL SELECT o.file, o.category, o.id, o."start", o."end", o.r, o."start" > w.last, CASE WHEN o."start" > w.last THEN o."end" ELSE w.last END FROM w JOIN o ON o.file = w.file AND o.category = w.category AND o.r = w.r + 1)
SELECT file, category, id, "start", "end" FROM w WHERE kept""",
    "anchored_clusters": """WITH RECURSIVE h AS (SELECT user_id, epoch_us(ts) // 3600000000 AS hour, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events),
w AS (SELECT user_id, hour, r, hour AS first FROM h WHERE r = 1 UNION ALL SELECT h.user_id, h.hour, h.r, CASE WHEN h.hour - w.first <= 60 THEN w.first ELSE h.hour END FROM w JOIN h ON h.user_id = w.user_id AND h.r = w.r + 1)
SELECT user_id, first, max(hour) AS last, count(*) AS n FROM w GROUP BY user_id, first""",
    "attach_overlaps": f"""WITH {SPANS}, x AS (SELECT a.id, string_agg(DISTINCT n.id, ',' ORDER BY n.id) AS f FROM s a JOIN s n ON a.file = n.file AND a.category = 'A' AND n.category = 'N' AND a."start" <= n."end" AND n."start" <= a."end" GROUP BY a.id)
SELECT id, coalesce(f, '') AS findings FROM s LEFT JOIN x USING (id) WHERE category = 'A'""",
    "nearest_siblings": """WITH o AS (SELECT CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS parent, o_orderkey AS id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + trunc(o_totalprice)::BIGINT % 90 AS e FROM orders),
p AS (SELECT a.id, arg_max(b.id, (b.e, b.id)) AS previous_id FROM o a JOIN o b ON a.parent IS NOT DISTINCT FROM b.parent AND b.e < a.s GROUP BY 1), n AS (SELECT a.id, arg_min(b.id, (b.s, b.id)) AS next_id FROM o a JOIN o b ON a.parent IS NOT DISTINCT FROM b.parent AND b.s > a.e GROUP BY 1)
SELECT id, previous_id, next_id FROM o LEFT JOIN p USING (id) LEFT JOIN n USING (id)""",
    "graph_two_hop": """WITH e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS r FROM e) WHERE r <= 5),
t AS (SELECT DISTINCT f.source, e.target FROM f JOIN e ON e.source = f.target EXCEPT SELECT source, target FROM e) SELECT source, target, 1 AS distance FROM e UNION ALL SELECT source, target, 2 FROM t""",
    "diff_line_numbers": """WITH c AS (SELECT DISTINCT ON (conv_id, turn) concat_ws('/', conv_id, turn) AS path, string_split(replace(text, chr(10), ' '), ' ') AS w FROM conversations),
r AS (SELECT path, unnest(range(len(w))) AS i, unnest(w) AS x FROM c), m AS (SELECT *, i % 3 AS k FROM r)
SELECT path, i + 1 AS pos, ['context', 'addition', 'deletion'][k + 1] AS line_type, CASE WHEN k <> 1 THEN 1 + (i - (i + 1) // 3) END AS old_line, CASE WHEN k <> 2 THEN 11 + (i - i // 3) END AS new_line, x AS content FROM m""",
    "diff_positions": """WITH p AS (SELECT n_nationkey::BIGINT AS id, n_nationkey AS k, n_nationkey % 4 + 1 AS a, n_nationkey % 4 + 1 + n_nationkey % 3 * 10 AS b FROM nation), q AS (SELECT *, a IN (1, 2, 3, 21, 22) AS ia, b IN (1, 2, 3, 21, 22) AS ib FROM p),
r AS (SELECT *, CASE WHEN k % 6 = 5 THEN 'path_unsafe' WHEN k % 7 = 6 THEN 'file_deleted' WHEN k % 5 = 4 THEN 'binary_or_no_patch' WHEN NOT (ia OR ib) THEN 'line_not_in_diff' END AS reason FROM q)
SELECT id, reason, CASE WHEN reason IS NULL THEN CASE WHEN ib THEN b ELSE a END END::INT AS line, NULL::INT AS first_line FROM r""",
    "name_status_records": "SELECT n_nationkey, unnest(['M', 'R', 'D']) AS change, unnest(['a/' || n_name, 'new/' || n_name, 'gone']) AS path, unnest([NULL, 'old/' || n_name, NULL]) AS previous_path FROM nation",
    "git_diff_files": "SELECT n_nationkey, unnest(['x/' || lower(n_name), 'z']) AS path, unnest(['@@ -1 +1 @@' || chr(10) || '+y', '@@ -3 +3 @@' || chr(10) || '-q']) AS patch FROM nation",
    "whole_repo_lines": "WITH b AS (SELECT item_id::VARCHAR AS path, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS w FROM benchmark) SELECT path, unnest(range(1, len(w) + 1))::INT AS new_line, unnest(w) AS content FROM b",
}
