"""Matching and resolution of one relation's rows to another's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def greedy_assign(candidates: DataFrame, case: Sequence[str], expected_order: str, predicted_order: str) -> DataFrame:
    """One row per matched prediction: its expected entry and TRUE_POSITIVE or DUPLICATE.

    Expected entries are served in order and take every match that is still free, so a prediction
    goes to the first entry it matches, and of an entry's predictions the first is the hit.
    """
    first = candidates.groupBy(*case, predicted_order).agg(F.min(expected_order).alias(expected_order))
    place = F.row_number().over(Window.partitionBy(*case, expected_order).orderBy(predicted_order))
    return first.withColumn("outcome", F.when(place == 1, F.lit("true_positive")).otherwise(F.lit("duplicate")))


def unmatched(expected: DataFrame, assigned: DataFrame, on: Sequence[str]) -> DataFrame:
    return expected.join(assigned.select(*on).distinct(), list(on), "left_anti")


def unique_on_both(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], required: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose key occurs once on either side; null equals null, but not in ``required``."""
    alone = lambda df, cols: df.withColumn("__n", F.count("*").over(Window.partitionBy(*cols))).where("__n = 1").drop("__n")
    for name in required:
        left = left.where(F.col(name).isNotNull())
    a, b = alone(left, [x for x, _ in on]), alone(right, [y for _, y in on])
    joined = None
    for x, y in on:
        one = a[x].eqNullSafe(b[y])
        joined = one if joined is None else joined & one
    return a.join(b, joined)


def resolve_in_tiers(rows: DataFrame, row_id: str, tiers: Sequence[tuple[str, DataFrame, Sequence[str], str]]) -> DataFrame:
    """Rows with ``resolved``, ``tier`` and ``status``.

    ``tiers``: (name, candidates, key columns shared with the rows, candidate id). The first tier
    with candidates decides: one candidate resolves the row, several make it ambiguous and end the
    search. Each tier is one join against candidates counted per key, so no pairs are formed.
    """
    out, status = rows, F
    for k, (_, candidates, keys, target) in enumerate(tiers):
        counted = candidates.groupBy(*keys).agg(F.count_distinct(target).alias(f"n{k}"), F.min(target).alias(f"id{k}"))
        out = out.join(counted, list(keys), "left")
    resolved, tier = F, F
    for k, (name, *_) in enumerate(tiers):
        some = F.col(f"n{k}") > 0
        resolved = resolved.when(some, F.when(F.col(f"n{k}") == 1, F.col(f"id{k}")))
        tier = tier.when(some, F.lit(name))
        status = status.when(some, F.when(F.col(f"n{k}") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")))
    extra = [f"{p}{k}" for k in range(len(tiers)) for p in ("n", "id")]
    return out.withColumn("resolved", resolved.otherwise(F.lit(None))).withColumn("tier", tier.otherwise(F.lit(None).cast("string"))).withColumn("status", status.otherwise(F.lit("unresolved"))).drop(*extra)


def path_suffixes(df: DataFrame, path: str, name: str = "suffix") -> DataFrame:
    """One row per suffix of whole path segments."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    return df.withColumn("__parts", parts).withColumn(name, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("__parts"), F.lit(1))), lambda n: F.array_join(F.slice("__parts", -1 * F.least(n, F.size("__parts")), n), "/")))).drop("__parts")


def unique_suffix(df: DataFrame, path: str, id_col: str) -> DataFrame:
    """(suffix, id) of the suffixes that one path alone has."""
    counted = path_suffixes(df, path).groupBy("suffix").agg(F.count_distinct(id_col).alias("n"), F.min(id_col).alias(id_col))
    return counted.where("n = 1 AND suffix <> ''").drop("n")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def insert_if_absent(new: DataFrame, existing: DataFrame, identity: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``new`` whose identity isn't known yet, the first of each identity."""
    return first_by(new, identity, order).join(existing.select(*identity).distinct(), list(identity), "left_anti")


def upsert(new: DataFrame, existing: DataFrame, identity: Sequence[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of the same identity."""
    return existing.join(new.select(*identity), list(identity), "left_anti").unionByName(new)


def attributed_threads(threads: DataFrame, comments: DataFrame) -> DataFrame:
    """Thread states of our comments: (finding_id, is_resolved), joined by the thread's first comment.

    ``threads``: first_comment_id, is_resolved; ``comments``: comment_id, finding_id, published_at.
    Of several comments on a finding the last published one speaks.
    """
    met = threads.where("first_comment_id IS NOT NULL").join(comments, threads["first_comment_id"] == comments["comment_id"])
    return met.groupBy("finding_id").agg(F.max_by("is_resolved", F.struct("published_at", "comment_id")).alias("is_resolved"))


def with_ids(rows: DataFrame, known: DataFrame, keys: Sequence[str], id_col: str, name: str) -> DataFrame:
    """Rows with the id of the natural key (the last one of several); null where it isn't known."""
    ids = known.groupBy(*keys).agg(F.max(id_col).alias(name))
    return rows.join(ids, list(keys), "left")


def current_findings(findings: DataFrame, candidates: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with their candidate's symbol and path; a missing file is the empty path.

    ``findings``: id, candidate_id; ``candidates``: candidate_id, symbol_id; ``symbols``: symbol_id,
    file_id, qualified_name; ``files``: file_id, path.
    """
    j = findings.join(candidates, "candidate_id", "left").join(symbols, "symbol_id", "left").join(files, "file_id", "left")
    return j.withColumn("path", F.coalesce("path", F.lit("")))
