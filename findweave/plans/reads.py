"""Queries of the read API and of source trees. Surrogates: an order is a row of every table of the data
model, its columns fixed by rules of its number; a document is a file of a tree at two commits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave import schemas
from findweave.plans import feedback
from findweave.plans.lookup import LOOKUPS, Catalog
from findweave.sources import repository

_STATUS = ("succeeded", "failed", "running", "resolved", "superseded")
_KINDS = ("file_tests_file", "calls", "imports")
#: Row whose values the lookups ask for, and the ids asked for together.
ASKED, ASKED_IDS = 46, ("x46", "x47", "x333", "missing")
_GROUPS = 300


def _columns(table: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns (nested types are written without blanks)."""
    return [tuple(column.split(" ")) for column in schemas.DDL[table].split(", ")]


def _rules(table: str) -> dict[str, str]:
    """SQL of a table's plain columns over o_orderkey k and o_orderdate t; Spark and DuckDB read it alike."""
    out = {}
    for i, (name, kind) in enumerate(_columns(table)):
        if name == "id":
            out[name] = "concat('x', k)"
        elif name in ("status", "kind"):
            words = _STATUS if name == "status" else _KINDS
            out[name] = "CASE " + " ".join(f"WHEN (floor(k / {_GROUPS}) + k * 7 + {i}) % {len(words)} = {n} THEN '{word}'" for n, word in enumerate(words)) + " END"
        elif kind == "string":
            out[name] = f"CASE WHEN (floor(k / {_GROUPS}) + {i}) % 6 <> 5 THEN concat('{name[:3]}', (k * {2 * i + 1}) % {_GROUPS}) END"
        elif kind in ("int", "long"):
            out[name] = f"CAST((k * {i + 3}) % 97 AS INT)"
        elif kind == "boolean":
            out[name] = f"(floor(k / {_GROUPS}) + k + {i}) % 3 = 0"
        elif kind == "timestamp":
            out[name] = "t"
    return out


def _tables(spark, d: str) -> dict[str, DataFrame]:
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS k", "o_orderdate AS t")
    return {table: o.selectExpr(*[f"{rule} AS {name}" for name, rule in _rules(table).items()]) for table in {spec.table for spec in LOOKUPS.values()} | {"symbols"}}


def _asked(table: str, column: str, name: str):
    """The value asked for: a list where the lookup takes several ids, else that of the row ``ASKED``."""
    if name.endswith("_by_ids"):
        return list(ASKED_IDS)
    rule, i = _rules(table)[column], [name for name, _ in _columns(table)].index(column)
    if column == "id":
        return f"x{ASKED}"
    if column in ("status", "kind"):
        words = _STATUS if column == "status" else _KINDS
        return words[(ASKED * 7 + i) % len(words)]
    return f"{column[:3]}{ASKED * (2 * i + 1) % _GROUPS}" if rule.startswith("CASE WHEN") else None


def lookup_results(spark, d):
    """What every named lookup finds: (lookup, value), the value its first column."""
    catalog = Catalog(_tables(spark, d))
    parts = []
    for name, spec in LOOKUPS.items():
        found = catalog.find(name, **{column: _asked(spec.table, column, name) for column in spec.by})
        parts.append(found.select(F.lit(name).alias("lookup"), F.col(spec.columns[0] if spec.columns else "id").alias("value")))
    at = catalog.symbol_containing_line(_asked("symbols", "file_id", ""), 40)
    parts.append(at.select(F.lit("symbol_containing_line").alias("lookup"), F.col("id").alias("value")))
    return reduce(DataFrame.union, parts)


def _lookup_sql() -> str:
    """The same by one SELECT per lookup."""
    tables = {table: ", ".join(f"{rule} AS {name}" for name, rule in _rules(table).items()) for table in {spec.table for spec in LOOKUPS.values()} | {"symbols"}}
    parts = []
    for name, spec in LOOKUPS.items():
        wanted = [(column, _asked(spec.table, column, name)) for column in spec.by]
        tests = [f"{column} IN ({', '.join(map(repr, value))})" if isinstance(value, list) else f"{column} = '{value}'" for column, value in wanted] + ([f"({spec.where})"] if spec.where else [])
        shown = spec.columns[0] if spec.columns else "id"
        rest = f" ORDER BY {', '.join(spec.order)} LIMIT {spec.first}" if spec.first else ""
        parts.append(f"SELECT * FROM (SELECT {'DISTINCT ' if spec.columns else ''}'{name}' AS lookup, {shown} AS value FROM t_{spec.table} WHERE {' AND '.join(tests) or 'true'}{rest})")
    parts.append(f"SELECT * FROM (SELECT 'symbol_containing_line', id FROM t_symbols WHERE file_id = '{_asked('symbols', 'file_id', '')}' AND start_line <= 40 AND end_line >= 40 ORDER BY end_line - start_line, start_line, id LIMIT 1)")
    rows = ", ".join(f"t_{table} AS (SELECT {columns} FROM o)" for table, columns in sorted(tables.items()))
    return f"WITH o AS (SELECT o_orderkey AS k, o_orderdate AS t FROM orders), {rows} {' UNION ALL '.join(parts)}"


def summary_lookups(spark, d):
    """Findings that feedback speaks against or for, off the table of feedback events."""
    log = feedback.log(spark, d)
    events = log.select(
        F.col("seq").alias("id"), "event_type", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("external_event_id"), F.when(F.col("seq") % 9 != 0, F.col("finding_id") * 1000 + F.col("reaction_id")).alias("finding_id"),
        F.col("signal").alias("normalized_signal"), F.col("strength").alias("signal_strength"), F.col("at").alias("occurred_at"), F.create_map(F.lit("reaction_id"), F.col("reaction_id").cast("string")).alias("metadata"),
    )
    catalog = Catalog({"feedback_events": events})
    return catalog.negative_findings().select("finding_id", F.lit("negative").alias("verdict")).union(catalog.positive_findings().select("finding_id", F.lit("positive").alias("verdict")))


def _files(spark, d: str) -> DataFrame:
    k = F.col("doc_id")
    name = k.cast("string")
    paths = (("src/a", ".py"), ("lib/node_modules/x", ".c"), ("tests/b", ".cpp"), ("include/h", ".H"), ("a/vendor/z", ".py"), ("lib/test_", ".hh"), ("doc", ".txt"), ("x/my_test", ".c"), ("include/g", ".h"), ("build", ".py"))
    path = reduce(lambda e, p: e.when(k % 10 == p[0], F.concat(F.lit(p[1][0]), name, F.lit(p[1][1]))), enumerate(paths[1:], 1), F.when(k % 10 == 0, F.concat(F.lit(paths[0][0]), name, F.lit(paths[0][1]))))
    empty = F.lit("")
    text = F.concat(F.when(k % 7 == 0, F.lit("// Generated BY a tool\n")).otherwise(empty), F.when(k % 4 == 3, F.lit("std::x ")).otherwise(empty), F.when(k % 11 == 0, F.lit("\x00")).otherwise(empty), F.coalesce("text", empty))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", path.alias("relative_path"), F.encode(text, "utf-8").alias("content"))


def source_inventory(spark, d):
    """Tracked files with language, size, hash and marks."""
    return repository.inventory(_files(spark, d)).drop("content")


def files_at_commit(spark, d):
    """Files of the commit that a request names, of two commits a file."""
    files = _files(spark, d)
    versions = files.withColumn("commit", F.lit("base")).unionByName(files.withColumn("commit", F.lit("head")).withColumn("content", F.concat("content", F.encode(F.lit("!"), "utf-8"))))
    wanted = files.select(F.when(F.col("doc_id") % 3 == 0, F.lit("base")).when(F.col("doc_id") % 3 == 1, F.lit("head")).otherwise(F.lit("gone")).alias("commit"), "relative_path")
    return repository.at_commit(versions, wanted.union(wanted)).select("commit", "relative_path", F.sha2("content", 256).alias("sha256"))


QUERIES = {"lookup_results": lookup_results, "summary_lookups": summary_lookups, "source_inventory": source_inventory, "files_at_commit": files_at_commit}

_TREE = """f AS (SELECT doc_id AS k, ['src/a', 'lib/node_modules/x', 'tests/b', 'include/h', 'a/vendor/z', 'lib/test_', 'doc', 'x/my_test', 'include/g', 'build'][doc_id % 10 + 1] || doc_id || ['.py', '.c', '.cpp', '.H', '.py', '.hh', '.txt', '.c', '.h', '.py'][doc_id % 10 + 1] AS relative_path,
  CASE WHEN doc_id % 7 = 0 THEN '// Generated BY a tool' || chr(10) ELSE '' END || CASE WHEN doc_id % 4 = 3 THEN 'std::x ' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN chr(0) ELSE '' END || coalesce(text, '') AS content FROM documents)"""
ORACLES = {
    "lookup_results": _lookup_sql(),
    "summary_lookups": f"""WITH {feedback.ASSESS.replace("SELECT user_id AS finding_id", "SELECT user_id * 1000 + k AS finding_id").replace("AS k FROM events))", "AS k FROM events WHERE event_id % 9 <> 0))")}
SELECT finding_id, 'negative' AS verdict FROM a WHERE explicit_false_positive > 0 OR negative_reactions >= 2 OR (negative_reactions > 0 AND finding_code_unchanged)
UNION ALL SELECT finding_id, 'positive' FROM a WHERE explicit_useful > 0 OR finding_disappeared OR (positive_reactions > 0 AND finding_changed)""",
    "source_inventory": f"""WITH {_TREE} SELECT relative_path, CASE k % 10 WHEN 0 THEN 'python' WHEN 2 THEN 'cpp' WHEN 3 THEN CASE WHEN k % 4 = 3 THEN 'cpp' ELSE 'c' END WHEN 5 THEN 'cpp' WHEN 7 THEN 'c' WHEN 8 THEN CASE WHEN k % 4 = 3 THEN 'cpp' ELSE 'c' END WHEN 9 THEN 'python' END AS language,
  octet_length(encode(content))::INT AS size, sha256(content) AS sha256, k % 10 IN (2, 5) AS is_test, k % 7 = 0 AS is_generated FROM f WHERE k % 10 NOT IN (1, 4) AND k % 11 <> 0""",
    "files_at_commit": f"WITH {_TREE} SELECT CASE k % 3 WHEN 0 THEN 'base' ELSE 'head' END AS \"commit\", relative_path, sha256(content || CASE k % 3 WHEN 0 THEN '' ELSE '!' END) AS sha256 FROM f WHERE k % 3 < 2",
}
