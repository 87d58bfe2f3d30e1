"""Labelled training texts for the classifiers: a bounded sample, held-out rows left out."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.llm._blocks import crc_mod

#: Labelled rows at most, and bytes of their texts at most, that a classifier is fitted on.
MAX_ROWS = 6_000
MAX_BYTES = 64_000_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, label, *extra, o) of labelled documents whose crc32 mod 4 is not 2.

    At most ``max_rows`` rows, the first by a hash of the id (``o``), so the choice is fixed for
    given tables. A document with several labels takes the largest; of several texts under one id
    the smallest counts. Rows with a null id, text or label don't take part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = known.orderBy(order, "doc_id").limit(max_rows)  # at most max_rows narrow rows
    sized = docs.select("doc_id", F.struct("text", *extra).alias("row")).where(F.col("row.text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return sized.groupBy("doc_id", "label").agg(F.min("row").alias("row")).select("doc_id", "row.*", "label", order.alias("o"))


def fit_in_task(rows: DataFrame, train, max_bytes: int = MAX_BYTES) -> object:
    """``train(rows)`` of the first ``max_bytes`` of text of ``rows`` (from ``training_rows``), run in one task.

    The sample is bounded by rows and bytes, so one task can hold it; the driver sees only the model.
    """
    names = [n for n in rows.columns if n != "o"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("o", "ascending"), ("doc_id", "ascending")])
        texts = [t.as_py().encode() for t in group["text"]]
        ends = np.cumsum([len(t) for t in texts])
        n = max(1, int(np.searchsorted(ends, max_bytes, side="right")))
        columns = {c: texts[:n] if c == "text" else group[c].slice(0, n).to_pylist() for c in names}
        return pa.table({"model": pa.array([pickle.dumps(train(columns))], pa.binary())})

    found = rows.groupBy(F.lit(0).alias("one")).applyInArrow(run, "model binary").collect()  # one row, or none
    return pickle.loads(found[0]["model"]) if found else train({c: [] for c in names})


def folds(id_col: str = "doc_id"):
    """Held out: crc32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))
