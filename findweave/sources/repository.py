"""Source trees: tracked files, languages and symbols."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which files are tracked, and marks of languages, generated files and tests (fixed values).
MAX_BYTES = 2 * 1024 * 1024
SKIPPED_FOLDERS = (".git", "node_modules", ".venv", "venv", "env", "dist", "build", "target", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "vendor", "third_party", "thirdparty")
LANGUAGES = {"py": "python", "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp"}
#: Marks of C++ in a header that could be C.
CPP_MARKS = r"\bnamespace\s+\w+|\bclass\s+\w+|\btemplate\s*<|\bstd::|::\s*\w|\bpublic\s*:|\bprivate\s*:|\bprotected\s*:"
GENERATED_MARKS = "do not edit|auto-generated|autogenerated|@generated|generated by|this file is generated"
TEST_PATH = r"(?i)(^|/)(tests?)(/|$)|(^|[_/-])test[_-]|[_-]test(\.[A-Za-z0-9]+)?$"


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(relative_path, content) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    return files.where(F.col("length") <= MAX_BYTES).select(F.expr(f"substring(path, locate('{base}', path) + {len(base)})").alias("relative_path"), "content")


def language(path: Column, content: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(extension == "h", F.when(F.decode(F.substring(content, 1, 8192), "iso-8859-1").rlike(CPP_MARKS), F.lit("cpp")).otherwise(F.lit("c")))
    for suffix, name in LANGUAGES.items():
        out = out.when(extension == suffix, F.lit(name))
    return out


def inventory(files: DataFrame) -> DataFrame:
    """Tracked source files: relative_path, language, size, sha256, is_test, is_generated.

    Left out: files in skipped folders, over 2 MiB, and with a NUL in their first 8 KiB.
    """
    path, content = F.col("relative_path"), F.col("content")
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    kept = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))) & (F.octet_length(content) <= MAX_BYTES) & (F.position(F.lit("\x00"), F.decode(F.substring(content, 1, 8192), "iso-8859-1")) == 0))
    head = F.lower(F.decode(F.substring(content, 1, 512), "iso-8859-1"))
    return kept.select("relative_path", language(path, content).alias("language"), F.octet_length(content).alias("size"), F.sha2(content, 256).alias("sha256"), path.rlike(TEST_PATH).alias("is_test"), head.rlike(GENERATED_MARKS).alias("is_generated"), "content")


_PARSED = "relative_path string, entry string, name string, qualified_name string, kind string, parent string, start_line int, end_line int, target string, content_hash string"


def parse_python(files: DataFrame) -> DataFrame:
    """Symbols, imports and calls of Python files (``entry``); a file that doesn't parse gives nothing."""

    def rows(path: str, source: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return
        lines = source.splitlines()

        def walk(node: ast.AST, scope: tuple[str, ...], inside: str | None) -> Iterator[tuple]:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                    name = (*scope, child.name)
                    text = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                    yield path, "symbol", child.name, ".".join(name), kind, ".".join(scope) or None, child.lineno, child.end_lineno, None, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
                    yield from walk(child, name, ".".join(name))
                    continue
                if isinstance(child, ast.Import):
                    for alias in child.names:
                        yield path, "import", alias.asname or alias.name, None, "import", inside, child.lineno, child.end_lineno, alias.name, None
                elif isinstance(child, ast.ImportFrom):
                    module = "." * child.level + (child.module or "")
                    for alias in child.names:
                        yield path, "import", alias.asname or alias.name, None, "from", inside, child.lineno, child.end_lineno, module, None
                elif isinstance(child, ast.Call):
                    called = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                    if called:
                        yield path, "call", called, None, "call", inside, child.lineno, child.end_lineno, None, None
                yield from walk(child, scope, inside)

        yield from walk(tree, (), None)

    names = [f.split()[0] for f in _PARSED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for path, content in zip(batch["relative_path"], batch["content"], strict=True) for r in rows(path, bytes(content).decode("utf-8", "replace"))]
            yield pd.DataFrame(found, columns=names)

    return files.select("relative_path", "content").mapInPandas(run, _PARSED)


#: A C or C++ definition head: return type, qualified name, arguments, opening brace.
_C_FUNCTION = r"(?m)^(?!\s*(?:if|for|while|switch|return|else|do)\b)[A-Za-z_][\w\s\*&<>,:~]*?\b([A-Za-z_~][\w:~]*)\s*\([^;{}]*\)\s*(?:const)?\s*\{"


def c_functions(files: DataFrame) -> DataFrame:
    """(relative_path, qualified_name, start_line) of function definitions, by a pattern.

    No C parser is at hand: macros, templates over several lines and K&R heads are not seen.
    """
    text = F.decode("content", "utf-8")
    heads = files.select("relative_path", text.alias("text")).withColumn("heads", F.regexp_extract_all("text", F.lit(_C_FUNCTION), F.lit(0)))
    # heads don't overlap, so each is looked for behind the end of the one before it
    at = F.aggregate("heads", F.array(F.lit(0)), lambda done, head: F.concat(done, F.array(F.call_function("locate", head, F.col("text"), F.element_at(done, -1) + 1) + F.length(head) - 1)))
    found = heads.select("relative_path", "text", F.posexplode("heads").alias("pos", "head"), at.alias("ends"))
    start = F.get("ends", F.col("pos") + 1) - F.length("head") + 1
    line = F.size(F.split(F.substring(F.col("text"), F.lit(1), start), "\n"))
    return found.select("relative_path", F.regexp_extract("head", _C_FUNCTION, 1).alias("qualified_name"), line.alias("start_line"))


def at_commit(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files (commit, relative_path, content) that ``wanted`` (commit, relative_path) names."""
    return files.join(wanted.select("commit", "relative_path").distinct(), ["commit", "relative_path"], "left_semi")


def load_cases(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark cases below a local folder: one row per sub-folder with a case.yaml; ids are unique."""
    import yaml  # only needed here

    rows = []
    for path in sorted(Path(root).glob("*/case.yaml")):
        case = yaml.safe_load(path.read_text(encoding="utf-8"))
        rows.append((str(case.get("id", path.parent.name)), case.get("title"), case.get("language"), case.get("difficulty"), [str(t) for t in case.get("tags", [])], json.dumps(case.get("expected", []), sort_keys=True), json.dumps(case.get("forbidden", []), sort_keys=True)))
    ids = [r[0] for r in rows]
    if len(ids) != len(set(ids)):
        raise ValueError(f"case ids occur more than once: {sorted({i for i in ids if ids.count(i) > 1})}")
    return spark.createDataFrame(rows, "case_id string, title string, language string, difficulty string, tags array<string>, expected string, forbidden string")
