"""Parsed files kept by content: nested rows keyed by hash, language and parser version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findweave.session import materialize

KEY = ("sha256", "language")
SCHEMA = (
    "sha256 string, language string, symbols array<struct<name:string,qualified_name:string,kind:string,parent:string,start_line:int,end_line:int,content_hash:string>>, "
    "imports array<struct<name:string,kind:string,target:string,start_line:int>>, calls array<struct<name:string,parent:string,start_line:int>>"
)


def packed(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per content: its symbols, imports and calls as arrays, without the path.

    ``entries``: rows of a parser (relative_path, entry, name, ...); ``contents``: relative_path,
    sha256, language of what was parsed. A content without entries, such as one that doesn't parse,
    has empty arrays, so that it isn't parsed again. A file bounds a row.
    """
    pick = lambda kind, *names: F.sort_array(F.collect_list(F.when(F.col("entry") == kind, F.struct(F.col("start_line").alias("at"), *[F.col(n) for n in names]))))
    grouped = entries.groupBy("relative_path").agg(
        pick("symbol", "name", "qualified_name", "kind", "parent", "start_line", "end_line", "content_hash").alias("symbols"),
        pick("import", "name", "kind", "target", "start_line").alias("imports"),
        pick("call", "name", "parent", "start_line").alias("calls"),
    )
    found = contents.join(grouped, "relative_path", "left")
    bare = lambda column, *names: F.coalesce(F.transform(column, lambda x: F.struct(*[x[n].alias(n) for n in names])), F.array())
    return found.select(
        *KEY, bare("symbols", "name", "qualified_name", "kind", "parent", "start_line", "end_line", "content_hash").alias("symbols"),
        bare("imports", "name", "kind", "target", "start_line").alias("imports"), bare("calls", "name", "parent", "start_line").alias("calls"),
    )


def cached(spark: SparkSession, path: str, version: int) -> DataFrame:
    """What the cache holds for a parser version; columns that older rows lack are null. Other versions' folders aren't read."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/version={version}").dropDuplicates(list(KEY))


def parsed_through(files: DataFrame, path: str, version: int, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each file (relative_path, sha256, language) with its nested rows and ``hit``; contents that the cache lacks are parsed once and added.

    ``files`` also has ``content``. Only the misses' contents go to ``parse``, one file for each.
    """
    spark = files.sparkSession
    known = cached(spark, path, version).select(*KEY)
    first = files.groupBy(*KEY).agg(F.min_by(F.struct("relative_path", "content"), "relative_path").alias("f"))
    missing = first.join(known, list(KEY), "left_anti").select(*KEY, "f.*")
    fresh = packed(parse(missing.select("relative_path", "content")), missing.select("relative_path", *KEY))
    batch = f"{path}/version={version}"
    hits = files.select("relative_path", *KEY).join(known.withColumn("hit", F.lit(True)), list(KEY), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    hits = materialize(hits, "hits")  # before the misses are added
    fresh.write.mode("append").parquet(batch)
    return hits.join(cached(spark, path, version), list(KEY))


def evict(spark: SparkSession, path: str, keep: int) -> None:
    """Delete the rows of other parser versions."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(base) if fs.exists(base) else []:
        name = status.getPath().getName()
        if name.startswith("version=") and name != f"version={keep}":
            fs.delete(status.getPath(), True)
