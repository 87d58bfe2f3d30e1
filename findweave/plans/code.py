"""Code-intelligence queries. Surrogates: parts are symbols, suppliers imports, orders calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.functions.output import comment_body, diff_excerpt, marker_id
from findweave.operators import code
from findweave.operators.graph import code_edges
from findweave.plans.lookup import Catalog
from findweave.sources.repository import TEST_PATH


#: Symbols of a file; files, names and imports grow with the tables.
FILE_SYMBOLS = 40


def _file(n: Column) -> Column:
    return F.concat(F.lit("f"), n.cast("string"), F.lit(".py"))


def _of(k: Column) -> Column:
    return F.floor(k / FILE_SYMBOLS)


def _name(k: Column) -> Column:
    """Half of the symbols have names of their own, the others share one by threes."""
    third = F.floor(k / 3)
    return F.concat(F.lit("n"), F.when(third % 2 == 0, k).otherwise(third * 3).cast("string"))


def symbols(spark, d: str) -> DataFrame:
    p, k, s = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey"), F.col("p_size")
    return p.select(
        k.alias("id"), _file(_of(k)).alias("path"), _name(k).alias("name"), F.when(s % 5 == 0, F.lit("method")).otherwise(F.lit("function")).alias("kind"),
        F.when(k % 3 == 0, F.concat(F.lit("C"), (s % 4).cast("string"))).alias("scope"), (s % 7 == 0).alias("is_declaration"), s.alias("start"), (s + 5).alias("end"),
    )


def imports(spark, d: str) -> DataFrame:
    """Two imports a file, of names or all of one of the next three files."""
    s, k = spark.read.parquet(f"{d}/supplier.parquet"), F.col("s_suppkey")
    near = F.floor(k / 2) + 1 + k % 3
    return s.select(_file(F.floor(k / 2)).alias("path"), k.alias("ord"), _name(near * FILE_SYMBOLS + k % FILE_SYMBOLS).alias("name"), F.when(k % 11 != 0, _file(near)).alias("resolved_path"), F.when(k % 2 == 0, F.lit("#include <x>")).otherwise(F.lit("import x")).alias("raw_text"))


def calls(spark, d: str) -> DataFrame:
    """Calls in a customer's file of symbols there, in the next files, far away, and of none."""
    o, k, at = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey"), _of(F.col("o_custkey"))
    callee = F.when(k % 13 == 0, F.lit("missing")).when(k % 17 == 0, _name(F.floor(k / 10))).otherwise(_name(at * FILE_SYMBOLS + k % (4 * FILE_SYMBOLS)))
    return o.select(k.alias("call_id"), _file(at).alias("path"), callee.alias("callee"), F.when(k % 4 != 0, F.concat(F.lit("C"), (k % 4).cast("string"))).alias("scope"))


def _sql_name(k: str) -> str:
    return f"'n' || CASE WHEN ({k}) // 3 % 2 = 0 THEN {k} ELSE ({k}) // 3 * 3 END"


CODE = f"""
s AS (SELECT p_partkey AS id, 'f' || (p_partkey // 40) || '.py' AS path, {_sql_name("p_partkey")} AS name, CASE WHEN p_size % 5 = 0 THEN 'method' ELSE 'function' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'C' || (p_size % 4) END AS scope, p_size % 7 = 0 AS decl, p_size AS st FROM part),
i AS (SELECT 'f' || (s_suppkey // 2) || '.py' AS path, s_suppkey AS ord, {_sql_name("(s_suppkey // 2 + 1 + s_suppkey % 3) * 40 + s_suppkey % 40")} AS name, CASE WHEN s_suppkey % 11 <> 0 THEN 'f' || (s_suppkey // 2 + 1 + s_suppkey % 3) || '.py' END AS rp, s_suppkey % 2 = 0 AS inc FROM supplier),
c AS (SELECT o_orderkey AS call_id, 'f' || (o_custkey // 40) || '.py' AS path, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 17 = 0 THEN {_sql_name("o_orderkey // 10")} ELSE {_sql_name("o_custkey // 40 * 40 + o_orderkey % 160")} END AS callee, CASE WHEN o_orderkey % 4 <> 0 THEN 'C' || (o_orderkey % 4) END AS scope FROM orders)"""
RESOLVED = f"""{CODE},
t AS (SELECT * FROM s WHERE scope IS NULL), df AS (SELECT * FROM t QUALIFY decl = min(decl) OVER (PARTITION BY name)), f1 AS (SELECT * FROM i WHERE rp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY ord) = 1),
t1 AS (SELECT path, scope, name AS callee, count(DISTINCT id) AS n, min(id) AS id FROM s WHERE scope IS NOT NULL GROUP BY ALL), t2 AS (SELECT path, name AS callee, count(DISTINCT id) AS n, min(id) AS id FROM s WHERE kind <> 'method' GROUP BY ALL),
t3 AS (SELECT f1.path, f1.name AS callee, count(DISTINCT id) AS n, min(id) AS id FROM f1 JOIN t ON t.path = f1.rp AND t.name = f1.name GROUP BY ALL), t4 AS (SELECT x.path, df.name AS callee, count(DISTINCT id) AS n, min(id) AS id FROM (SELECT DISTINCT path, rp FROM i WHERE rp IS NOT NULL) x JOIN df ON df.path = x.rp GROUP BY ALL),
t5 AS (SELECT name AS callee, count(DISTINCT id) AS n, min(id) AS id FROM df GROUP BY ALL),
r AS (SELECT c.*, CASE WHEN t1.n > 0 THEN 'parent_scope' WHEN t2.n > 0 THEN 'same_file' WHEN t3.n > 0 THEN 'imported_name' WHEN t4.n > 0 THEN 'imported_file' WHEN t5.n > 0 THEN 'repository' END AS tier, coalesce(t1.n, t2.n, t3.n, t4.n, t5.n) AS n, CASE WHEN t1.n > 0 THEN t1.id WHEN t2.n > 0 THEN t2.id WHEN t3.n > 0 THEN t3.id WHEN t4.n > 0 THEN t4.id ELSE t5.id END AS id
 FROM c LEFT JOIN t1 ON t1.path = c.path AND t1.scope = c.scope AND t1.callee = c.callee LEFT JOIN t2 ON t2.path = c.path AND t2.callee = c.callee LEFT JOIN t3 ON t3.path = c.path AND t3.callee = c.callee LEFT JOIN t4 ON t4.path = c.path AND t4.callee = c.callee LEFT JOIN t5 ON t5.callee = c.callee)"""


def call_resolution(spark, d):
    return code.resolve_calls(calls(spark, d), symbols(spark, d), imports(spark, d)).select("call_id", "resolved", "tier", "status")


def _nation_files(spark, d) -> DataFrame:
    n, name = spark.read.parquet(f"{d}/nation.parquet"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    sources = n.select(F.concat(F.lit("src/"), name, F.lit(".py")).alias("path"))
    twins = n.where("n_nationkey % 6 = 0").select(F.concat(F.lit("lib/"), name, F.lit(".py")).alias("path"))
    tests = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("tests/test_"), name, F.lit(".py")).alias("path"))
    return sources.union(twins).union(tests).withColumn("is_test", F.col("path").rlike(TEST_PATH))


def test_relationships(spark, d):
    n, name = spark.read.parquet(f"{d}/nation.parquet"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    found = n.where("n_nationkey % 4 = 0").select(F.concat(F.lit("tests/test_"), name, F.lit(".py")).alias("path"), F.concat(F.lit("src/"), name, F.lit(".py")).alias("resolved_path"))
    return code.related_tests(_nation_files(spark, d), found)


def graph_edges(spark, d):
    s, i = symbols(spark, d), imports(spark, d)
    resolved = call_resolution(spark, d).where("status = 'resolved'").join(calls(spark, d), "call_id")
    contains = s.select(F.col("path").alias("src_file"), F.col("path").alias("dst_file"), F.col("id").alias("dst_symbol"))
    imported = i.where("resolved_path IS NOT NULL").select(F.col("path").alias("src_file"), F.col("resolved_path").alias("dst_file"))
    called = resolved.select(F.col("path").alias("src_file"), F.col("scope").alias("src_symbol"), F.lit("").alias("dst_file"), F.col("resolved").alias("dst_symbol"))
    tests = test_relationships(spark, d).select(F.col("test_path").alias("src_file"), F.col("source_path").alias("dst_file"), "reason")
    return code_edges(contains, imported, called, tests)


def import_regions(spark, d):
    return code.import_regions(imports(spark, d), symbols(spark, d)).select("path", "resolved_path", "relationship", "symbol", "start", "end")


def symbol_lookups(spark, d):
    s = symbols(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("i").alias("repository_index_id"), F.col("path").alias("file_id"), "path", "name", F.col("start").alias("start_line"), F.col("end").alias("end_line"))
    found = Catalog({"symbols": s})
    return found.find("symbol_by_name", repository_index_id="i", name="n9").select("id", "path").unionByName(found.symbol_containing_line("f3.py", 20).select("id", "path"))


def comment_bodies(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    ident = F.concat(F.lit("00000000-0000-4000-8000-0000000000"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    body = comment_body(F.concat(F.lit("**"), "n_name", F.lit("**")), F.lit("Same. "), F.col("n_name"), F.lit("Same."), F.when(F.col("n_nationkey") % 2 == 0, F.lit("<!-- x -->")))
    return n.select("n_nationkey", body.alias("body"), marker_id(F.concat(body, F.lit("<!-- finding:"), ident, F.lit(" -->"))).alias("marker"))


def excerpts(spark, d):
    from findweave.plans.spans import _patches
    from findweave.sources.diff import patch_lines

    files = _patches(spark, d).where("patch IS NOT NULL")
    return diff_excerpt(files.select(F.col("n_nationkey").alias("id"), "path", F.lit(1).alias("start"), F.lit(2).alias("end")), patch_lines(files))


QUERIES = {
    "call_resolution": call_resolution, "test_relationships": test_relationships, "graph_edges": graph_edges, "import_regions": import_regions, "symbol_lookups": symbol_lookups, "comment_bodies": comment_bodies, "diff_excerpts": excerpts,
}

_NATION = "lower(replace(n_name, ' ', '_'))"
_TESTS = f"""x AS (SELECT 'tests/test_' || {_NATION} || '.py' AS test_path, 'src/' || {_NATION} || '.py' AS source_path, array_to_string(list_filter([CASE WHEN n_nationkey % 6 <> 0 THEN 'filename' END, CASE WHEN n_nationkey % 4 = 0 THEN 'import' END], lambda v: v IS NOT NULL), ', ') AS reason FROM nation WHERE n_nationkey % 2 = 0 AND (n_nationkey % 6 <> 0 OR n_nationkey % 4 = 0))"""
ORACLES = {
    "call_resolution": f"WITH {RESOLVED} SELECT call_id, CASE WHEN n = 1 THEN id END AS resolved, tier, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM r",
    "test_relationships": f"WITH {_TESTS} SELECT * FROM x",
    "graph_edges": f"""WITH {RESOLVED}, {_TESTS} SELECT 'file_contains_symbol' AS kind, path AS src_file, NULL::VARCHAR AS src_symbol, path AS dst_file, id::VARCHAR AS dst_symbol, NULL::VARCHAR AS reason FROM s UNION ALL SELECT 'file_imports_file', path, NULL, rp, NULL, NULL FROM i WHERE rp IS NOT NULL
UNION ALL SELECT 'symbol_calls_symbol', path, scope, '', id::VARCHAR, NULL FROM r WHERE n = 1 AND scope IS NOT NULL UNION ALL SELECT 'file_tests_file', test_path, NULL, source_path, NULL, reason FROM x""",
    "import_regions": f"WITH {CODE}, g AS (SELECT path, rp, CASE WHEN bool_or(inc) THEN 'include_dependency' ELSE 'import_dependency' END AS relationship FROM i WHERE rp IS NOT NULL GROUP BY 1, 2), b AS (SELECT path AS rp, arg_min(name, (st, name)) AS symbol, min(st) AS a FROM s GROUP BY 1) SELECT path, rp AS resolved_path, relationship, symbol, coalesce(a, 1)::INT AS start, coalesce(a + 5, 30)::INT AS \"end\" FROM g LEFT JOIN b USING (rp)",
    "symbol_lookups": f"WITH {CODE} SELECT id::VARCHAR AS id, path FROM s WHERE name = 'n9' UNION ALL SELECT * FROM (SELECT id::VARCHAR, path FROM s WHERE path = 'f3.py' AND st <= 20 AND st + 5 >= 20 ORDER BY st, id::VARCHAR LIMIT 1)",
    "comment_bodies": "SELECT n_nationkey, '**' || n_name || '**' || chr(10) || chr(10) || 'Same. ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' &lt;!-- x --&gt;' ELSE '' END AS body, '00000000-0000-4000-8000-0000000000' || lpad(n_nationkey::VARCHAR, 2, '0') AS marker FROM nation",
    "diff_excerpts": "SELECT n_nationkey AS id, ' ' || n_name || chr(10) || '+added' || chr(10) || '-gone' AS excerpt FROM nation WHERE n_nationkey % 5 <> 4",
}
