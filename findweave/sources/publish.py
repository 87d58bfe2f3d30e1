"""A sink for publications: rows become visible when all tasks have succeeded, once per plan.

Tasks write files under names of their own; the commit lists them in one marker file, named by the
plan and created exclusively. Readers follow markers, so a failed or repeated attempt leaves nothing
that is read, and of two writers of one plan one wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from findweave.sources import exclusive

#: Rows of a file at most.
FILE_ROWS = 50_000


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class PlanWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.plan = options["path"], options["plan"]

    def write(self, rows: Iterator[Row]) -> Written:
        files, lines, n = [], [], 0

        def flush() -> None:
            name = f"{self.plan}-{uuid.uuid4().hex}.jsonl"
            exclusive.put(f"{self.path}/rows/{name}", "".join(f"{line}\n" for line in lines).encode())
            files.append(name)
            lines.clear()

        for row in rows:
            lines.append(json.dumps(row.asDict(recursive=True), sort_keys=True, default=str))
            n += 1
            if len(lines) >= FILE_ROWS:
                flush()
        if lines:
            flush()
        return Written(files, n)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        marker = {"plan": self.plan, "files": sorted(f for m in done for f in m.files), "rows": sum(m.rows for m in done)}
        if not exclusive.create(f"{self.path}/plans/{self.plan}.json", json.dumps(marker).encode()):
            self.abort(messages)  # this plan is published: what was written again goes

    def abort(self, messages: list[Written | None]) -> None:
        fs, inner = exclusive.opened(f"{self.path}/rows")
        for message in messages:
            for name in message.files if message is not None else ():
                fs.delete_file(f"{inner}/{name}")


class PublishSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "findweave_publish"

    def writer(self, schema: StructType, overwrite: bool) -> PlanWriter:
        return PlanWriter(self.options)


def publish(rows: DataFrame, path: str, plan: str) -> None:
    """Publish ``rows`` under a plan's id; a plan that is published already stays as it is."""
    rows.sparkSession.dataSource.register(PublishSink)
    rows.write.format(PublishSink.name()).mode("append").option("path", path).option("plan", plan).save()


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All published rows with the plan that they belong to."""
    markers = spark.read.schema("plan string, files array<string>").json(f"{path}/plans")
    files = markers.select("plan", F.explode("files").alias("file"))
    rows = spark.read.schema(schema).json(f"{path}/rows").withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.join(files, "file").drop("file")
