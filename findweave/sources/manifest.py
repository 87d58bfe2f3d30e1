"""Append-only logs of small entries: tables that become visible together, and claims of runs.

An entry is a numbered file that its writer creates exclusively. A writer that loses a number reads
what the winner wrote and decides anew, so entries form one order that all readers see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.sources import exclusive


def entries(path: str) -> list[dict]:
    """The entries of a log in order; one log is a run's or a manifest's, so it is short."""
    return [json.loads(exclusive.content(f"{path}/{f.base_name}")) for f in exclusive.listed(path)]


def append(path: str, decide: Callable[[list[dict]], dict | None]) -> tuple[dict | None, list[dict]]:
    """Append what ``decide(entries so far)`` returns, again and again until no one was faster; nothing for None."""
    while True:
        known = entries(path)
        entry = decide(known)
        if entry is None or exclusive.create(f"{path}/{len(known):09d}.json", json.dumps(entry, sort_keys=True).encode()):
            return entry, known


# tables that are appended together


def append_together(tables: Mapping[str, DataFrame], path: str, entry: str) -> bool:
    """Append to several tables at once, by one name; false if an entry of that name is committed already.

    The rows are written first, and readers see them by the manifest's entry alone: before it none
    of the tables has them, after it all have. What a writer that fails leaves behind is never read.
    """
    if any(e["entry"] == entry for e in entries(f"{path}/manifest")):
        return False
    folder = f"{entry}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}/{folder}")
    mine = {"entry": entry, "folder": folder, "tables": sorted(tables)}
    done, _ = append(f"{path}/manifest", lambda known: None if any(e["entry"] == entry for e in known) else mine)
    return done is not None


def read_together(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The committed rows of one of the tables."""
    folders = [f"{path}/{table}/{e['folder']}" for e in entries(f"{path}/manifest") if table in e["tables"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


# claims of runs


def _winner(known: list[dict]) -> str | None:
    return next((e["run"] for e in known if e["status"] == "succeeded"), None)


def start_run(path: str, identity: str, run: str) -> tuple[str, bool]:
    """(run, is it new): the succeeded run of an identity, or this one, which is running from now on.

    Partial and failed runs are not used again.
    """
    began, known = append(f"{path}/{identity}", lambda known: None if _winner(known) else {"run": run, "status": "running"})
    return (run, True) if began else (_winner(known), False)


def finish_run(path: str, identity: str, run: str, status: str) -> str | None:
    """The run that counts after ``run`` ends as succeeded, partial or failed; None if none has succeeded.

    If another one has succeeded meanwhile, this one fails as superseded by it, and its caller must
    not commit what it found.
    """

    def decide(known: list[dict]) -> dict | None:
        if any(e["run"] == run and e["status"] != "running" for e in known):
            return None  # ended already: the call is a repeated one
        best = _winner(known)
        if best is None or status == "failed":
            return {"run": run, "status": status}
        return {"run": run, "status": "failed", "superseded_by": best}

    ended, known = append(f"{path}/{identity}", decide)
    return _winner([*known, *([ended] if ended else [])])


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """(identity, run, status, superseded_by) of every run in the logs under ``path``: its last entry."""
    rows = spark.read.schema("run string, status string, superseded_by string").json(f"{path}/*/*.json")
    at = F.struct(F.col("_metadata.file_path").alias("file"), "status", "superseded_by")
    last = rows.select("run", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("identity"), at.alias("at")).groupBy("identity", "run").agg(F.max("at").alias("at"))
    return last.select("identity", "run", "at.status", "at.superseded_by")


def settled_runs(attempts: DataFrame) -> DataFrame:
    """What the protocol makes of timed attempts: (identity, run, outcome, canonical_run).

    ``attempts``: identity, run, started, finished, status (succeeded, partial, failed). The first to
    succeed counts; an attempt that starts after that is reused, one that ends later, whole or in
    part, is superseded.
    """
    first = F.min(F.when(F.col("status") == "succeeded", F.struct("finished", "run"))).over(Window.partitionBy("identity"))
    seen = attempts.withColumn("first", first)
    late = F.col("first").isNotNull() & (F.struct("finished", "run") > F.col("first"))
    outcome = F.when(F.col("first").isNotNull() & (F.col("started") > F.col("first.finished")), F.lit("reused")).when(late & (F.col("status") != "failed"), F.lit("superseded")).otherwise(F.col("status"))
    return seen.select("identity", "run", outcome.alias("outcome"), F.col("first.run").alias("canonical_run"))
