"""Ranked selection under limits and budgets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from findweave.operators import scan
from findweave.operators.intervals import LONG_KEY, _split
from findweave.session import materialize


def partition_ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], mappable: Column, max_inline: int, max_summary: int, reported: Column | None = None) -> DataFrame:
    """Rows with ``disposition``: already_reported, inline, summary or omitted.

    The best mappable rows of each key go inline; the rest of these and all others are ranked
    again, and the best of them go to the summary.
    """
    known = F.coalesce(reported, F.lit(False)) if reported is not None else F.lit(False)
    flagged = rows.withColumn("__known", known).withColumn("__map", F.coalesce(mappable, F.lit(False)))
    inline = F.row_number().over(Window.partitionBy(*keys, "__known", "__map").orderBy(*order))
    flagged = flagged.withColumn("__inline", F.col("__map") & ~F.col("__known") & (inline <= max_inline))
    rest = F.row_number().over(Window.partitionBy(*keys, "__known", "__inline").orderBy(*order))
    flagged = flagged.withColumn("__rest", rest)
    disposition = F.when(F.col("__known"), F.lit("already_reported")).when(F.col("__inline"), F.lit("inline")).when(F.col("__rest") <= max_summary, F.lit("summary")).otherwise(F.lit("omitted"))
    return flagged.withColumn("disposition", disposition).drop("__known", "__map", "__inline", "__rest")


def _admitted_in_turn(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with admitted and used: keys are dealt out, sorted and streamed against their ``__left``; one number is held."""
    schema = T.StructType([*df.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("used", T.LongType())])

    def run(batches):
        key, used = None, 0
        for batch in batches:
            admitted, sums = [], []
            columns = [batch.column(n).to_pylist() for n in (*keys, "__cost", "__left")]
            for *now, cost, left in zip(*columns, strict=True):
                if now != key:
                    key, used = now, 0
                fits = None if cost is None else used + cost <= left
                used += cost if fits else 0
                admitted.append(fits)
                sums.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.bool_()), pa.array(sums, pa.int64())], names=[*batch.schema.names, "admitted", "used"])

    return df.repartition(*keys).sortWithinPartitions(*keys, *by).mapInArrow(run, schema)


def _admitted_by_rounds(rows: DataFrame, keys: Sequence[str], by: Sequence[str], budget: int, long_key: int) -> DataFrame:
    """``rows`` with admitted and used, for keys of any size whose costs aren't negative.

    In each round the rows up to the first that doesn't fit are taken by running sums; of the others
    those that cost more than is left then are refused for good, as less and less is left, and the rest
    go on. Once a key's rest is small, it is streamed. A round takes a row of each key at least.
    """
    base = scan.numbered(rows, keys, [F.col(b) for b in by])
    places = [scan.KEY, scan.PART, scan.NUMBER]
    rest, taken = base.where("__cost IS NOT NULL").select(*keys, *places, "__cost", F.lit(budget).cast("long").alias("__left")), []
    while not rest.groupBy(*keys).count().where(F.col("count") > long_key).isEmpty():
        summed = materialize(scan.running_sum(rest, F.col("__cost"), "__sum"), "summed")
        fits = F.col("__sum") <= F.col("__left")
        taken.append(summed.where(fits).select(scan.NUMBER))
        left = summed.groupBy(F.col(scan.KEY).alias("__key")).agg((F.max("__left") - F.coalesce(F.max(F.when(fits, F.col("__sum"))), F.lit(0))).alias("__now"))
        over = summed.where(~fits).join(left, F.col(scan.KEY).eqNullSafe(F.col("__key"))).where("__cost <= __now")
        rest = materialize(over.select(*keys, *places, "__cost", F.col("__now").alias("__left")), "rest")
    taken.append(_admitted_in_turn(rest, keys, [scan.NUMBER]).where("admitted").select(scan.NUMBER))
    admitted = reduce(DataFrame.unionByName, taken).withColumn("admitted", F.lit(True))
    marked = base.join(admitted, scan.NUMBER, "left").withColumn("admitted", F.when(F.col("__cost").isNotNull(), F.coalesce("admitted", F.lit(False))))
    return scan.running_sum(marked, F.when(F.col("admitted"), F.col("__cost")).otherwise(F.lit(0)), "used")


def admit(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, budget: int, row: Sequence[str], long_key: int = LONG_KEY) -> DataFrame:
    """Rows with ``admitted`` and ``used``: each is taken in order if it still fits the key's budget.

    Keys with up to ``long_key`` rows, and those with a negative cost, are streamed in order; longer
    ones are split over tasks. A row without a cost is neither taken nor refused.
    """
    by = list(dict.fromkeys([*order, cost, *row]))
    given = rows.select(*dict.fromkeys([*keys, *by])).withColumn("__cost", F.col(cost).cast("long"))
    short, long = _split(given, keys, long_key, F.coalesce(F.min("__cost"), F.lit(0)) >= 0)
    columns = [*dict.fromkeys([*keys, *by]), "admitted", "used"]
    out = _admitted_in_turn(short.withColumn("__left", F.lit(budget).cast("long")), keys, by).select(*columns)
    return out if long is None else out.unionByName(_admitted_by_rounds(long, keys, by, budget, long_key).select(*columns))


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Callable, step: Callable, added: str, left_out: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """Rows with the columns ``added`` (a schema string) that ``step(state, row)`` returns as a tuple.

    Rows of a key come one after the other in order, and ``begin()`` makes a key's state. Keys are
    exchanged (unless ``dealt``: they are already dealt out by key) and sorted once and then streamed,
    so that many small keys cost no call each and a task holds one batch and one key's state.
    """
    names = [f.split()[0] for f in added.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for now, row in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf.itertuples(index=False), strict=True):
                now = tuple(None if v != v else v for v in now)  # a null may come as nan
                if now != key:
                    key, state = now, begin()
                out.append(step(state, row))
            yield pdf.drop(columns=list(left_out)).assign(**{n: pd.Series([o[i] for o in out], index=pdf.index, dtype=object) for i, n in enumerate(names)})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in left_out] + [added])
    return (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def suppress_overlaps(rows: DataFrame, target: Sequence[str], ratio: float = 0.6, exempt: Sequence[str] = ("parent_symbol",)) -> DataFrame:
    """Context candidates with ``verdict``: kept, duplicate or overlap; the first conflict in kept order decides.

    ``rows``: target columns, ord (unique within the target), file, start, end, symbol, kind. The
    state is the target's kept candidates by file.
    """

    def verdict(kept: dict, c) -> str:
        for o in kept.get(c.file, ()):
            same_symbol = o.symbol == c.symbol or (pd.isna(o.symbol) and pd.isna(c.symbol))
            if o.start == c.start and o.end == c.end and same_symbol:
                return "duplicate"
            if c.kind in exempt or o.kind in exempt:
                continue
            shared = min(o.end, c.end) - max(o.start, c.start) + 1
            if shared > 0 and shared / min(o.end - o.start + 1, c.end - c.start + 1) >= ratio:
                return "overlap"
        kept.setdefault(c.file, []).append(c)
        return "kept"

    return folded(rows, target, ["ord"], dict, lambda kept, c: (verdict(kept, c),), "verdict string")


def _served(max_tokens: int, max_lines: int, item_tokens: int, item_lines: int, reserve: float, per_relationship: int) -> tuple[Callable, Callable]:
    """``begin()`` and ``serve(left, candidate, lengths)`` -> (offset, lines, tokens) of what is taken, or None."""
    of_target, of_others = (max(item_lines, int(max_lines * reserve)), max(item_tokens, int(max_tokens * reserve))), (item_lines, item_tokens)

    def window(c, lengths: list[int], size: int) -> tuple[int, int, int]:
        spare = len(lengths) - size
        if spare <= 0:
            first, size = 0, len(lengths)
        else:
            anchor = 0 if pd.isna(c.anchor) else int(c.anchor) - c.start
            first = min(max(anchor - size // 2, 0), spare)
        return first, size, sum(lengths[first : first + size]) + size - 1

    def begin() -> dict:
        return {"tokens": max_tokens, "lines": max_lines, "used": Counter()}

    def serve(left: dict, c, lengths: list[int] | None) -> tuple[int, int, int] | None:
        line_cap, token_cap = of_target if c.is_target else of_others
        line_cap, token_cap = min(line_cap, left["lines"]), min(token_cap, left["tokens"])
        free = c.is_target or left["used"][c.relationship] < per_relationship
        if free and line_cap >= 1 and token_cap >= 1 and lengths:
            first, size, chars = window(c, lengths, line_cap)
            cost = -(-chars // 4)
            if cost > token_cap:
                first, size, chars = window(c, lengths, max(1, int(size * (token_cap / cost))))
                cost = -(-chars // 4)
            if chars:
                left["tokens"] -= cost
                left["lines"] -= size
                left["used"][c.relationship] += 1
                return first, size, cost
        return None

    return begin, serve


def plan_budget(rows: DataFrame, target: Sequence[str], max_tokens: int, max_lines: int, item_tokens: int, item_lines: int, reserve: float = 0.35, per_relationship: int = 3, dealt: bool = False) -> DataFrame:
    """``fill_budget`` without contents: ``rows`` have the lines' ``lengths`` (code points) instead of ``lines``.

    Only lengths are shuffled, never texts; contents are the lines ``first`` to ``last`` of the file.
    """
    begin, serve = _served(max_tokens, max_lines, item_tokens, item_lines, reserve, per_relationship)

    def step(left: dict, c) -> tuple:
        got = serve(left, c, None if c.lengths is None else c.lengths.tolist())
        if got is None:
            return False, None, None, 0, False
        first, size, cost = got
        return True, c.start + first, c.start + first + size - 1, cost, size < len(c.lengths)

    return folded(rows, target, ["ord"], begin, step, "taken boolean, first long, last long, tokens long, truncated boolean", ["lengths"], dealt)


def fill_budget(rows: DataFrame, target: Sequence[str], max_tokens: int, max_lines: int, item_tokens: int, item_lines: int, reserve: float = 0.35, per_relationship: int = 3) -> DataFrame:
    """Context candidates with ``taken``, ``first``, ``last``, ``content``, ``tokens`` and ``truncated`` under token and line budgets.

    ``rows``: target columns, ord, relationship, is_target, start, anchor (or null), lines (those of
    the candidate's range; null if the file has none of it), which the result leaves out. Candidates
    are served in order. A target may use its reserved share; other relationships are capped. What
    is too long is cut to a window around its anchor, once for the lines and once, in proportion,
    for the tokens. Candidates that aren't taken are the dropped ones. Lines are shuffled with their
    candidates; where many candidates share files, ``plan_budget`` moves lengths only.
    """
    begin, serve = _served(max_tokens, max_lines, item_tokens, item_lines, reserve, per_relationship)

    def step(left: dict, c) -> tuple:
        got = serve(left, c, None if c.lines is None else list(map(len, c.lines)))
        if got is None:
            return False, None, None, None, 0, False
        first, size, cost = got
        return True, c.start + first, c.start + first + size - 1, "\n".join(c.lines[first : first + size]), cost, size < len(c.lines)

    return folded(rows, target, ["ord"], begin, step, "taken boolean, first long, last long, content string, tokens long, truncated boolean", ["lines"])


def budget_totals(filled: DataFrame, target: Sequence[str]) -> DataFrame:
    """Per target the taken and dropped candidates, tokens and lines of ``fill_budget`` or ``plan_budget``."""
    taken = F.col("taken")
    return filled.groupBy(*target).agg(F.count_if(taken).alias("taken"), F.count_if(~taken).alias("dropped"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).alias("lines"))


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


