"""Session factory and the session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task of ``materialize`` holds on the heap before it writes them out as a row group.
ROW_GROUP_BYTES = 4 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, AQE on, few shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A folder under /tmp is used only where the session names none and runs on one machine, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or "file:///tmp/checkpoints"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``drop_materialized`` deletes."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    spark.sparkContext._findweave_tables = [*getattr(spark.sparkContext, "_findweave_tables", []), path]
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and survives lost executors: the files live in the folder that all
    executors share, unlike a local checkpoint. Row groups are small, as every running task holds
    one while it writes, and again when the table is read.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors of ``spark``, once per context."""
    context = spark.sparkContext
    if getattr(context, "_findweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._findweave_shipped = True


def materialized(spark: SparkSession) -> int:
    """How many tables ``materialize`` has written in this context and not dropped."""
    return len(getattr(spark.sparkContext, "_findweave_tables", []))


def drop_materialized(spark: SparkSession, first: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``materialize`` has written in this context; read results before.

    Only those after the first ``first``, and not the last ``keep``.
    """
    context = spark.sparkContext
    tables = getattr(context, "_findweave_tables", [])
    for path in tables[first : len(tables) - keep]:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    context._findweave_tables = tables[:first] + tables[max(first, len(tables) - keep) :]
