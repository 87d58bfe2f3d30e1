"""Closed-interval operators: containment, overlap, greedy selection, clusters.

Joins are equi-joins on a key (a file, an order) with the range as residual condition; where a key
holds many spans, both sides also meet on line buckets, so no pair of far-apart spans is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from findweave.operators import scan

#: Rows of a key from which on it is split over tasks.
LONG_KEY = 10_000


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def bucketed(df: DataFrame, start: str, end: str, width: int, name: str = "bucket") -> DataFrame:
    """One row per line bucket that the span touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))))


def overlap_pairs(df: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, width: int = 64, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b), a < b, of spans of one key that overlap; ``keep`` columns come as a_*, b_*.

    A pair is formed in the first bucket that both spans touch, so it appears once.
    """
    side = lambda p: bucketed(df, start, end, width).select(*keys, "bucket", *[F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys((id_col, start, end, *keep))])
    a, b = side("a"), side("b")
    c = F.col
    first = c("bucket") == F.floor(F.greatest(c(f"a_{start}"), c(f"b_{start}")) / width)
    return a.join(b, [*keys, "bucket"]).where((c(f"a_{id_col}") < c(f"b_{id_col}")) & overlaps(c(f"a_{start}"), c(f"a_{end}"), c(f"b_{start}"), c(f"b_{end}")) & first).drop("bucket")


def overlap_components(df: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str) -> DataFrame:
    """(id, root): the smallest id among the spans of a key that hang together by overlaps.

    Spans lie on a line, so a component ends where a start passes the largest end so far: one sort
    per key, no iteration. Where more than overlap decides, use ``graph.components`` on pairs.
    """
    order = Window.partitionBy(*keys).orderBy(start, end, id_col)
    passed = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = df.select(*keys, id_col, start, end).withColumn("__new", (passed.isNull() | (F.col(start) > passed)).cast("int"))
    grouped = opens.withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.withColumn("root", F.min(id_col).over(Window.partitionBy(*keys, "__group"))).select(id_col, "root")


def innermost(points: DataFrame, spans: DataFrame, keys: Sequence[str], point_id: str, line: str, span_id: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Each point with the smallest span that contains it (ties: earlier start, then id); null if none."""
    p = points.withColumn("bucket", F.floor(F.col(line) / width))
    s = bucketed(spans, start, end, width).select(*keys, "bucket", F.col(span_id).alias("span_id"), F.col(start).alias("span_start"), F.col(end).alias("span_end"))
    inside = p.join(s, [*keys, "bucket"]).where((F.col("span_start") <= F.col(line)) & (F.col(line) <= F.col("span_end")))
    best = inside.groupBy(point_id).agg(F.min(F.struct((F.col("span_end") - F.col("span_start")).alias("length"), F.col("span_start").alias("start"), F.col("span_id").alias("id"))).alias("best"))
    return points.join(best, point_id, "left").withColumn("innermost_id", F.col("best.id")).drop("best")


def touched(spans: DataFrame, lines: DataFrame, keys: Sequence[str], span_id: str, start: str, end: str, line: str, name: str = "touched", width: int = 64) -> DataFrame:
    """Spans with a flag: does any of the lines of the key fall into it?"""
    s = bucketed(spans, start, end, width).select(*keys, "bucket", span_id, start, end)
    at = lines.select(*keys, F.floor(F.col(line) / width).alias("bucket"), F.col(line).alias("__line")).distinct()
    hit = s.join(at, [*keys, "bucket"]).where(F.col("__line").between(F.col(start), F.col(end))).select(span_id).distinct().withColumn(name, F.lit(True))
    return spans.join(hit, span_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def attached(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, start: str, end: str, name: str, width: int = 64) -> DataFrame:
    """Left spans with the sorted ids of right spans that overlap them (empty if none)."""
    a = bucketed(left, start, end, width).select(*keys, "bucket", left_id, F.col(start).alias("s"), F.col(end).alias("e"))
    b = bucketed(right, start, end, width).select(*keys, "bucket", F.col(right_id).alias("__id"), F.col(start).alias("s2"), F.col(end).alias("e2"))
    met = a.join(b, [*keys, "bucket"]).where(overlaps(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")))
    ids = met.groupBy(left_id).agg(F.sort_array(F.collect_set("__id")).alias(name))
    return left.join(ids, left_id, "left").withColumn(name, F.coalesce(name, F.array().cast(ids.schema[name].dataType)))


def _split(df: DataFrame, keys: Sequence[str], long_key: int, given: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with up to ``long_key`` rows, and of the others (None if there are none).

    A key for which the aggregate ``given`` doesn't hold stays with the first.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__size"), (F.lit(True) if given is None else given).alias("__given")).where((F.col("__size") > long_key) & F.col("__given"))
    if sizes.isEmpty():
        return df, None
    long = sizes.select(F.struct(*keys).alias("__key"))
    marked = df.withColumn("__key", F.struct(*keys))
    side = lambda how: marked.join(long.withColumnRenamed("__key", "__long"), F.col("__key").eqNullSafe(F.col("__long")), how).drop("__key", "__long")
    return side("left_anti"), side("left_semi")


def _streamed(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str) -> DataFrame:
    """``df`` with __last, the end of the span that was kept before a row, and __at, the start of the last one kept by then.

    Keys are dealt out, sorted and streamed; two numbers are all that is held.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__last", T.LongType()), T.StructField("__at", T.LongType())])

    def run(batches):
        key, last, at = None, None, None
        for batch in batches:
            ends, starts = [], []
            for now, s, e in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column(start).to_pylist(), batch.column(end).to_pylist(), strict=True):
                if now != key:
                    key, last = now, None
                ends.append(last)
                if last is None or s > last:
                    last, at = e, s
                starts.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.int64()), pa.array(starts, pa.int64())], names=[*batch.schema.names, "__last", "__at"])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _chained(spans: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The kept spans of keys of any size: each span points at the first that starts behind its end, and the first of a key reaches the kept ones."""
    base = scan.numbered(spans, keys, [F.col(o) for o in order]).withColumnRenamed(scan.NUMBER, "__n").drop(scan.PART, scan.KEY)
    side = lambda at, kind: base.select(*keys, F.col(at).alias("at"), F.lit(kind).alias("kind"), "__n")
    # backwards: a span's end comes before the starts on its own line
    points = scan.numbered(side("__s", 1).unionByName(side("__e", 2)), keys, [F.desc("at"), F.desc("kind"), F.desc("__n")])
    behind = scan.last_before(points, F.when(F.col("kind") == 1, F.col("__n")), "following").where("kind = 2").select("__n", "following")
    first = base.groupBy(*keys).agg(F.min("__n").alias("__n")).select("__n", F.lit(True).alias("first"))
    chain = behind.join(first, "__n", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return base.join(scan.reached(chain, "__n", "following", "first"), "__n", "left_semi").select(*columns)


def greedy_disjoint(df: DataFrame, keys: Sequence[str], order: Sequence[Column], start: str, end: str, row: Sequence[str], long_key: int = LONG_KEY) -> DataFrame:
    """Rows kept when spans are taken in order and one that overlaps a kept one of its key is left out.

    The order begins with the start and is total; spans without a start or an end are never kept.
    Keys with up to ``long_key`` spans are streamed in order, which needs the end of the last kept
    one only. Longer ones are split over tasks: after a kept span the next one is the first whose
    start lies behind its end, so each span points at that one and pointers are doubled.
    """
    spans = df.withColumns({**{f"__o{i}": o for i, o in enumerate(order)}, "__s": F.col(start).cast("long"), "__e": F.col(end).cast("long")}).where("__s IS NOT NULL AND __e IS NOT NULL")
    by, columns = [f"__o{i}" for i in range(len(order))], [*keys, *[c for c in row if c not in keys]]
    spans = spans.select(*dict.fromkeys([*columns, *by, "__s", "__e"]))
    short, long = _split(spans, keys, long_key)
    kept = _streamed(short, keys, by, "__s", "__e").where("__last IS NULL OR __s > __last").select(*columns)
    return kept if long is None else kept.unionByName(_chained(long, keys, by, columns))


def anchored_clusters(df: DataFrame, keys: Sequence[str], position: str, reach: int, long_key: int = LONG_KEY) -> DataFrame:
    """(keys, first, last, n): clusters whose members lie within ``reach`` of their first member.

    The first members are the spans [position, position + reach] that a greedy choice keeps; rows
    without a position belong to no cluster.
    """
    at = df.groupBy(*keys, F.col(position).cast("long").alias("__s")).agg(F.count("*").alias("__rows")).where("__s IS NOT NULL").withColumn("__e", F.col("__s") + reach)
    short, long = _split(at, keys, long_key)
    of = _streamed(short, keys, ["__s"], "__s", "__e").select(*keys, F.col("__at").alias("first"), "__s", "__rows")
    if long is not None:
        anchors = _chained(long, keys, ["__s"], [*keys, "__s"]).withColumn("anchor", F.col("__s"))
        marked = long.select(*keys, "__s", "__rows", F.lit(None).cast("long").alias("anchor")).unionByName(anchors.select(*keys, "__s", F.lit(0).cast("long").alias("__rows"), "anchor"))
        found = scan.last_before(scan.numbered(marked, keys, [F.col("__s"), F.col("anchor").desc_nulls_last()]), F.col("anchor"), "first", inclusive=True)
        of = of.unionByName(found.select(*keys, "first", "__s", "__rows"))
    return of.groupBy(*keys, "first").agg(F.max("__s").alias("last"), F.sum("__rows").alias("n"))


def nearest_siblings(df: DataFrame, parent: Sequence[str], id_col: str, start: str, end: str) -> DataFrame:
    """Per row the last sibling that ends before it and the first that starts after it.

    Siblings share the parent columns (nulls are one parent). Both are scans over the sorted ends of
    the spans, forwards and backwards, that split a parent's rows over tasks.
    """
    side = lambda at, kind: df.select(*parent, F.col(id_col).alias("id"), F.col(at).alias("at"), F.lit(kind).alias("kind"))
    points = side(start, 1).unionByName(side(end, 2))  # on one line starts come first, so that an end there isn't before them
    forwards = scan.numbered(points, parent, [F.col("at"), F.col("kind"), F.col("id")])
    previous = scan.last_before(forwards, F.when(F.col("kind") == 2, F.col("id")), "previous_id").where("kind = 1").select(F.col("id").alias(id_col), "previous_id")
    backwards = scan.numbered(points, parent, [F.desc("at"), F.desc("kind"), F.desc("id")])
    following = scan.last_before(backwards, F.when(F.col("kind") == 1, F.col("id")), "next_id").where("kind = 2").select(F.col("id").alias(id_col), "next_id")
    return df.join(previous, id_col, "left").join(following, id_col, "left")
