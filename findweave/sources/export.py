"""Sinks: JSON lines with sorted keys, and run reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_line(df: DataFrame, hashed: tuple[str, ...] = (), left_out: tuple[str, ...] = ()) -> Column:
    """One JSON object per row, keys sorted; ``hashed`` columns leave as their SHA-256 alone."""
    names = sorted(c for c in df.columns if c not in left_out)
    fields = [F.sha2(F.col(c).cast("string"), 256).alias(f"{c}_sha256") if c in hashed else F.col(c) for c in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, **options) -> None:
    df.select(json_line(df, **options).alias("value")).write.text(path)


def markdown_report(title: str, metrics: DataFrame) -> str:
    """A table of a small metrics frame (one row per metric)."""
    rows = metrics.collect()
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"


def json_report(sections: dict[str, DataFrame]) -> str:
    """Small frames as one JSON document, keys sorted, two spaces of indent."""
    return json.dumps({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in sections.items()}, indent=2, sort_keys=True, default=str)
