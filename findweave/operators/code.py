"""Resolution of imports, calls and tests between source files, and context drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findweave.functions.text import module_of
from findweave.operators.matching import first_by, resolve_in_tiers, unique_suffix

TEST_MARK = r"(?i)(^test[_-])|([_-]test$)"


def symbol_matches(expected: Column, found: Column) -> Column:
    """No expectation matches all; else equal, or the found name ends with it after "." or "::"."""
    tail = found.endswith(F.concat(F.lit("."), expected)) | found.endswith(F.concat(F.lit("::"), expected))
    return F.when(expected.isNull(), F.lit(True)).when(found.isNull(), F.lit(False)).otherwise((found == expected) | tail)


def resolve_python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (path, ord, target, ...) with ``resolved_path``: the module itself, else its parent.

    Leading dots start from the importer's package, one more for each level up. Of several files
    with one module the last path counts.
    """
    index = files.where(F.col("path").endswith(".py")).groupBy(module_of(F.col("path")).alias("module")).agg(F.max("path").alias("resolved"))
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    rest = F.regexp_replace("target", r"^\.+", "")
    folders = F.split(F.col("path"), "/")
    package = F.slice(folders, 1, F.greatest(F.size(folders) - dots, F.lit(0)))
    absolute = F.when(dots == 0, rest).otherwise(F.array_join(F.filter(F.concat(package, F.array(rest)), lambda x: x != ""), "."))
    j = imports.withColumn("__full", absolute).withColumn("__parent", F.regexp_replace("__full", r"\.?[^.]+$", ""))
    whole = index.select(F.col("module").alias("__full"), F.col("resolved").alias("__r1"))
    above = index.select(F.col("module").alias("__parent"), F.col("resolved").alias("__r2"))
    return j.join(whole, "__full", "left").join(above, "__parent", "left").withColumn("resolved_path", F.coalesce("__r1", "__r2")).drop("__full", "__parent", "__r1", "__r2")


def normalized_join(folder: Column, target: Column) -> Column:
    """``folder/target`` with "." and ".." taken out; null if it leaves the root."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(target, "/")), lambda p: ~p.isin("", "."))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("left"))
    up = lambda a: F.struct(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))).alias("out"), (a["left"] | (F.size(a["out"]) == 0)).alias("left"))
    done = F.aggregate(parts, zero, lambda a, p: F.when(p == "..", up(a)).otherwise(F.struct(F.concat(a["out"], F.array(p)).alias("out"), a["left"].alias("left"))))
    return F.when(~done["left"], F.array_join(done["out"], "/"))


def resolve_includes(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with ``resolved_path``: the file beside the importer, else the only one with that path suffix."""
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "^$", "")
    beside = files.select(F.col("path").alias("__near"), F.lit(True).alias("__hit"))
    ending = unique_suffix(files.select("path", F.col("path").alias("file")), "path", "file").select(F.col("suffix").alias("target"), F.col("file").alias("__far"))
    j = imports.withColumn("__near", normalized_join(folder, F.col("target"))).join(beside, "__near", "left").join(ending, "target", "left")
    return j.withColumn("resolved_path", F.coalesce(F.when(F.col("__hit"), F.col("__near")), F.col("__far"))).drop("__near", "__hit", "__far")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` with resolved, tier and status.

    ``calls``: call_id, path, callee, scope (the caller's parent, or null); ``symbols``: id, path,
    name, kind, scope, is_declaration; ``imports``: path, ord, name, resolved_path. Tiers: the
    caller's parent scope; the file (methods apart); a name imported from a resolved file (first
    import of it); imported files; the whole repository. In the last two a declaration doesn't
    count where a definition is known.
    """
    named = symbols.select("id", "path", "scope", "kind", F.col("name").alias("callee"), "is_declaration")
    top = named.where("scope IS NULL")
    defined = top.withColumn("__best", F.min("is_declaration").over(_by("callee"))).where("is_declaration = __best")
    scoped = named.where("scope IS NOT NULL").select("path", "scope", "callee", F.col("id"))
    local = named.where("kind <> 'method'").select("path", "callee", F.col("id"))
    first = first_by(imports.where("resolved_path IS NOT NULL"), ["path", "name"], [F.col("ord")])
    brought = first.select("path", F.col("name").alias("callee"), "resolved_path").join(top.select(F.col("path").alias("resolved_path"), "callee", "id"), ["resolved_path", "callee"]).select("path", "callee", "id")
    reached = imports.where("resolved_path IS NOT NULL").select("path", "resolved_path").distinct().join(defined.select(F.col("path").alias("resolved_path"), "callee", "id"), "resolved_path").select("path", "callee", "id")
    tiers = [("parent_scope", scoped, ["path", "scope", "callee"], "id"), ("same_file", local, ["path", "callee"], "id"), ("imported_name", brought, ["path", "callee"], "id"), ("imported_file", reached, ["path", "callee"], "id"), ("repository", defined.select("callee", "id"), ["callee"], "id")]
    return resolve_in_tiers(calls, "call_id", tiers)


def _by(*columns):
    from pyspark.sql.window import Window

    return Window.partitionBy(*columns)


def related_tests(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(test_path, source_path, reason): equal stems where one source alone has the stem, and imports by tests."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1), TEST_MARK, "")
    f = files.select("path", "is_test", stem.alias("stem"))
    sources = f.where("NOT is_test").groupBy("stem").agg(F.count("*").alias("n"), F.min("path").alias("source_path")).where("n = 1 AND stem <> ''")
    by_name = f.where("is_test").join(sources, "stem").select(F.col("path").alias("test_path"), "source_path", F.lit("filename").alias("reason"))
    tests = f.where("is_test").select("path")
    by_import = imports.where("resolved_path IS NOT NULL").join(tests, "path").select(F.col("path").alias("test_path"), F.col("resolved_path").alias("source_path"), F.lit("import").alias("reason"))
    return by_name.unionByName(by_import).groupBy("test_path", "source_path").agg(F.array_join(F.sort_array(F.collect_set("reason")), ", ").alias("reason"))


def test_regions(targets: DataFrame, tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per target and test file the symbol to show: its name holds the target's, else the first; else lines 1-30.

    ``targets``: target, path, name; ``tests``: test_path, source_path; ``symbols``: path, name, start, end.
    """
    # targets with the same wants in the same files see the same tests: symbols are chosen once for each such profile
    wants = targets.groupBy("target").agg(F.sort_array(F.collect_set(F.struct("path", F.lower("name").alias("wanted")))).alias("profile"))
    profiles = wants.select("profile").distinct().select("profile", F.explode("profile").alias("w")).select("profile", "w.*")
    pairs = profiles.join(tests, profiles["path"] == tests["source_path"]).select("profile", "wanted", "test_path")
    s = symbols.select(F.col("path").alias("test_path"), F.col("name").alias("symbol"), "start", "end")
    j = pairs.join(s, "test_path", "left")
    best = F.min_by(F.struct("symbol", "start", "end"), F.struct(~F.contains(F.lower("symbol"), F.col("wanted")), F.col("start"), F.col("symbol")))
    chosen = j.groupBy("profile", "test_path").agg(best.alias("b")).select("profile", "test_path", "b.symbol", F.coalesce("b.start", F.lit(1)).alias("start"), F.coalesce("b.end", F.lit(30)).alias("end"))
    return wants.join(chosen, "profile").select("target", "test_path", "symbol", "start", "end")


def import_regions(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per importing file and resolved file its first symbol, else lines 1-30; the kind tells includes from imports."""
    kind = F.max(F.when(F.col("raw_text").startswith("#include"), F.lit("include_dependency")).otherwise(F.lit("import_dependency")))
    files = imports.where("resolved_path IS NOT NULL").groupBy("path", "resolved_path").agg(kind.alias("relationship"))
    first = symbols.groupBy(F.col("path").alias("resolved_path")).agg(F.min_by(F.struct("name", "start", "end"), F.struct("start", "name")).alias("b"))
    return files.join(first, "resolved_path", "left").select("path", "resolved_path", "relationship", F.col("b.name").alias("symbol"), F.coalesce("b.start", F.lit(1)).alias("start"), F.coalesce("b.end", F.lit(30)).alias("end"))
