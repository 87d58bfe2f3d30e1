"""Queries on sources in C and C++. Surrogates: a part makes a C file, a customer a C++ file, both with
braces in strings and comments; their lengths follow the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.sources import languages

_SHOWN = ("relative_path", "entry", "name", "qualified_name", "kind", "parent", "start_line", "end_line", "target", "signature", "visibility", "content_hash")


def _joined(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def c_files(spark, d: str) -> DataFrame:
    k, s, n = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    text = _joined(
        '#include "h', k % 100, '.h"\n#define LIMIT_', k, " ", s, "\n/* int ghost(void) { ", n, " */\nstatic const char *label_", k, ' = "} ', n, '";\ntypedef struct s_', k, "\n{\n",
        F.repeat(F.lit("    int a;\n"), s), "} t_", k, ";\nint f_", k, "(int a)\n{\n    if (a) { return g_", k % 7, "(a, '{'); }\n", F.when(s % 4 != 0, F.lit("}\n")).otherwise(F.lit("")),
    )
    return spark.read.parquet(f"{d}/part.parquet").select(_joined("p", k, ".c").alias("relative_path"), F.lit("c").alias("language"), F.encode(text, "utf-8").alias("content"))


def cpp_files(spark, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = _joined(
        "#include <v", n, ">\nnamespace n", n, " {\n// class Ghost {\nclass C", k, " : public B<int> {\npublic:\n    C", k, "();\n    int get(int k) { return h", n, "(k); }\n", F.repeat(F.lit("    int m_ = 0;\n"), n), "};\nint C", k,
        "::put(int k) { if (k) { run(k); } return k; }\n}\n",
    )
    return spark.read.parquet(f"{d}/customer.parquet").select(_joined("c", k, ".cpp").alias("relative_path"), F.lit("cpp").alias("language"), F.encode(text, "utf-8").alias("content"))


def _entries(files: DataFrame) -> DataFrame:
    """Entries; hashes of functions only."""
    hashed = F.when(F.col("kind").isin("function", "method"), F.col("content_hash"))
    return languages.parsed(files).withColumn("content_hash", hashed).select(*_SHOWN)


def c_entries(spark, d):
    return _entries(c_files(spark, d))


def cpp_entries(spark, d):
    return _entries(cpp_files(spark, d))


def parsed_languages(spark, d):
    """Files and entries of all languages, Python texts of documents among them, which don't parse."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(_joined("d", F.col("doc_id"), ".py").alias("relative_path"), F.lit("python").alias("language"), F.encode(F.concat(F.lit("def f(a):\n    return g(a)\n# "), F.regexp_replace("text", r"\s+", " ")), "utf-8").alias("content"))
    files = c_files(spark, d).unionByName(cpp_files(spark, d)).unionByName(docs)
    found = languages.parsed(files).groupBy("relative_path").agg(F.count_if(F.col("entry") == "symbol").alias("symbols"), F.count_if(F.col("entry") == "call").alias("calls"))
    return files.select("relative_path", "language").join(found, "relative_path", "left").fillna(0).groupBy("language").agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"), F.sum("calls").alias("calls"))


QUERIES = {"c_entries": c_entries, "cpp_entries": cpp_entries, "parsed_languages": parsed_languages}

_NO = "NULL::VARCHAR"


def _row(source: str, path: str, entry: str, name: str, qualified: str = _NO, kind: str = _NO, parent: str = _NO, start: str = "1", end: str = "", target: str = _NO, signature: str = _NO, visibility: str = _NO, digest: str = _NO, where: str = "true") -> str:
    end = end or start
    return f"SELECT {path} AS relative_path, {entry} AS entry, {name} AS name, {qualified} AS qualified_name, {kind} AS kind, {parent} AS parent, ({start})::INT AS start_line, ({end})::INT AS end_line, {target} AS target, {signature} AS signature, {visibility} AS visibility, {digest} AS content_hash FROM {source} WHERE {where}"


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def _c_rows() -> list[str]:
    c = lambda *a, **b: _row("p", "'p' || k || '.c'", *a, **b)
    sym = "'symbol'"
    body = "'int f_' || k || '(int a)' || chr(10) || '{' || chr(10) || '    if (a) { return g_' || k % 7 || '(a, ''{''); }' || chr(10)"
    return [
        c("'import'", "'h' || k % 100 || '.h'", kind="'local'", target="'h' || k % 100 || '.h'"),
        c(sym, "'LIMIT_' || k", "'LIMIT_' || k", "'macro'", start="2", signature="'#define LIMIT_' || k"),
        c(sym, "'label_' || k", "'label_' || k", "'variable'", start="4"),
        c(sym, "'s_' || k", "'s_' || k", "'struct'", start="5", end="7 + s", signature="'struct s_' || k"),
        c(sym, "'t_' || k", "'t_' || k", "'type_alias'", start="5", end="7 + s", signature="'typedef ... t_' || k"),
        c(sym, "'f_' || k", "'f_' || k", "'function'", start="8 + s", end="11 + s", signature="'int f_' || k || '(int a)'", visibility="'definition'", digest=f"sha256({body} || '}}')", where="s % 4 <> 0"),
        # a block that isn't closed ends with its head
        c(sym, "'f_' || k", "'f_' || k", "'function'", start="8 + s", end="9 + s", signature="'int f_' || k || '(int a)'", visibility="'definition'", digest="sha256('int f_' || k || '(int a)' || chr(10) || '{')", where="s % 4 = 0"),
        c("'call'", "'g_' || k % 7", kind="'call'", parent="'f_' || k", start="10 + s"),
        c("'error'", "'unbalanced'", kind="'error'", start="10 + s", where="s % 4 = 0"),
    ]


def _cpp_rows() -> list[str]:
    c = lambda *a, **b: _row("u", "'c' || k || '.cpp'", *a, **b)
    sym, space, own = "'symbol'", "'n' || n", "'n' || n || '::C' || k"
    get = "'int get(int k) { return h' || n || '(k); }'"
    put = "'int C' || k || '::put(int k) { if (k) { run(k); } return k; }'"
    return [
        c("'import'", "'v' || n", kind="'external'", target="'v' || n"),
        c(sym, "'C' || k", own, "'class'", space, "4", "8 + n", signature="'class C' || k"),
        c(sym, "'C' || k", f"{own} || '::C' || k", "'method'", own, "6", signature="'C' || k || '()'", visibility="'declaration'", digest="sha256('C' || k || '();')"),
        c(sym, "'get'", f"{own} || '::get'", "'method'", own, "7", signature="'int get(int k)'", visibility="'definition'", digest=f"sha256({get})"),
        c(sym, "'put'", f"{own} || '::put'", "'method'", space, "9 + n", signature="'int C' || k || '::put(int k)'", visibility="'definition'", digest=f"sha256({put})"),
        c("'call'", "'h' || n", kind="'call'", parent=f"{own} || '::get'", start="7"), c("'call'", "'run'", kind="'call'", parent=f"{own} || '::put'", start="9 + n"),
    ]


_FILES = "p AS (SELECT p_partkey AS k, p_size AS s FROM part), u AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)"
ORACLES = {
    "c_entries": f"WITH {_FILES} {_union(_c_rows())}",
    "cpp_entries": f"WITH {_FILES} {_union(_cpp_rows())}",
    "parsed_languages": f"""WITH {_FILES}, e AS (SELECT 'c' AS language, relative_path, entry FROM ({_union(_c_rows())}) UNION ALL SELECT 'cpp', relative_path, entry FROM ({_union(_cpp_rows())}))
SELECT language, count(DISTINCT relative_path) AS files, count(*) FILTER (entry = 'symbol') AS symbols, count(*) FILTER (entry = 'call') AS calls FROM e GROUP BY 1 UNION ALL SELECT 'python', count(*), count(*), count(*) FROM documents""",
}
