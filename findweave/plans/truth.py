"""Queries on labelled ground truth. Surrogates: a line item is a prediction of its order's case; those
of line status F stand for expectations, with null symbols, lines and quotes among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.functions.ranks import SEVERITIES
from findweave.operators import matching, truth

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _items(spark, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    number = F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), "l_partkey", "l_suppkey")
    return li.select("*", F.col("l_orderkey").alias("case_id"), number.alias("ord"), F.col("l_returnflag").alias("category"), F.concat(F.lit("f"), (F.col("l_suppkey") % 2).cast("string")).alias("file"), F.col("l_quantity").cast("long").alias("q"))


def expected(spark, d: str) -> DataFrame:
    q, n = F.col("q"), F.col("l_linenumber").cast("long")
    return _items(spark, d).where("l_linestatus = 'F'").select(
        "case_id", F.col("ord").alias("exp_ord"), "file", "category",
        F.when(q % 3 == 0, F.lit("close")).when(q % 3 == 1, F.lit("File.close")).alias("symbol"), F.when(q % 5 != 0, n * 3).alias("line"),
        F.when(q % 4 == 0, n * 3 + 2).alias("line_end"), (q % 3).alias("line_tolerance"), F.when(q % 7 == 0, F.lit(" Leaks  the HANDLE")).when(q % 7 == 1, F.lit("never freed")).alias("evidence"),
    )


def predicted(spark, d: str) -> DataFrame:
    p, n = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    start = n * 3 + F.col("q") % 2
    return _items(spark, d).select(
        "case_id", F.col("ord").alias("pred_idx"), "file", "category",
        F.when(p % 4 == 0, F.lit("close")).when(p % 4 == 1, F.lit("io.File.close")).when(p % 4 == 2, F.lit("File::close")).alias("symbol"), start.alias("start"), (start + F.col("q") % 4).alias("end"),
        F.when(p % 3 != 0, F.lit("x = open(a)\n leaks the")).alias("evidence_text"), F.when(p % 5 == 0, F.lit("never  freed")).otherwise(F.lit("handle")).alias("message"),
    )


def matches(spark, d):
    return truth.truth_matches(expected(spark, d), predicted(spark, d))


def assigned(spark, d):
    """Predictions with their expectation and outcome; expectations without one are missed."""
    hits = matching.greedy_assign(matches(spark, d), ["case_id"], "exp_ord", "pred_idx").select("case_id", "exp_ord", "pred_idx", "outcome")
    lost = matching.unmatched(expected(spark, d).select("case_id", "exp_ord"), hits, ["case_id", "exp_ord"])
    return hits.unionByName(lost.select("case_id", "exp_ord", F.lit(None).cast("string").alias("pred_idx"), F.lit("missed").alias("outcome")))


def _cases(spark, d: str) -> DataFrame:
    hits = assigned(spark, d).groupBy("case_id").agg(F.count_if(F.col("outcome") == "true_positive").alias("tp"), F.count_if(F.col("outcome") == "duplicate").alias("duplicate"))
    li = _items(spark, d).groupBy("case_id").agg(F.count("*").alias("predictions"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")).alias("unsupported"), F.sum("l_linenumber").alias("candidates"))
    cases = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "P").alias("is_error"))
    return cases.join(li, "case_id").join(hits, "case_id", "left").fillna(0).withColumn("false_positive", F.col("predictions") - F.col("tp") - F.col("duplicate"))


def overall(spark, d):
    return truth.overall_rates(_cases(spark, d))


def by_difficulty(spark, d):
    """An order's priority stands for its case's difficulty."""
    of = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("difficulty"))
    a = assigned(spark, d).join(of, "case_id")
    spare = predicted(spark, d).select("case_id", "pred_idx").join(a.select("case_id", "pred_idx"), ["case_id", "pred_idx"], "left_anti").join(of, "case_id").withColumn("outcome", F.lit("false_positive"))
    found = a.where("outcome <> 'missed'").select("difficulty", "outcome").unionByName(spare.select("difficulty", "outcome"))
    return truth.by_group(found, a.where("outcome = 'missed'"), "difficulty", PRIORITIES)


def _findings(spark, d: str) -> DataFrame:
    scale = F.array(*map(F.lit, (*SEVERITIES[:-1], "odd")))
    return _items(spark, d).select("case_id", F.col("file").alias("path"), F.floor(F.col("q") / 10).alias("line"), F.get(scale, (F.col("l_partkey") % len(SEVERITIES)).cast("int")).alias("severity"), F.col("ord").alias("fingerprint"))


def severities(spark, d):
    return truth.severity_counts(_findings(spark, d))


def presentation(spark, d):
    return truth.presented(_findings(spark, d), ["case_id"]).select("case_id", "fingerprint", "place")


def analyzers(spark, d):
    """Suppliers of an order's lines by return flag, in the order of their first line."""
    rows = _items(spark, d).select("case_id", "ord", F.col("l_returnflag").alias("analyzer"))
    return truth.in_order_of_use(rows, ["case_id"], "ord", "analyzer").select("case_id", F.array_join("names", ",").alias("names"))


def ingested(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    kinds = ("click", "view", "purchase")
    per = e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    return truth.events_ingested(per, list(kinds))


QUERIES = {
    "truth_matches": matches, "truth_outcomes": assigned, "overall_rates": overall, "eval_by_difficulty": by_difficulty, "severity_counts": severities, "presentation_order": presentation,
    "analyzers_in_order": analyzers, "events_ingested": ingested,
}

_ITEMS = """i AS (SELECT *, l_orderkey AS case_id, concat_ws('-', lpad(l_linenumber::VARCHAR, 2, '0'), l_partkey, l_suppkey) AS ord, l_returnflag AS category, 'f' || l_suppkey % 2 AS file, l_quantity::BIGINT AS q FROM lineitem)"""
_TRUTH = f"""{_ITEMS},
e AS (SELECT case_id, ord AS exp_ord, file, category, CASE q % 3 WHEN 0 THEN 'close' WHEN 1 THEN 'File.close' END AS sym, CASE WHEN q % 5 <> 0 THEN l_linenumber * 3 END AS line, CASE WHEN q % 4 = 0 THEN l_linenumber * 3 + 2 END AS line_end,
  q % 3 AS tol, CASE q % 7 WHEN 0 THEN 'leaks the handle' WHEN 1 THEN 'never freed' END AS ev FROM i WHERE l_linestatus = 'F'),
p AS (SELECT case_id, ord AS pred_idx, file, category, CASE l_partkey % 4 WHEN 0 THEN 'close' WHEN 1 THEN 'io.File.close' WHEN 2 THEN 'File::close' END AS sym, l_linenumber * 3 + q % 2 AS s, l_linenumber * 3 + q % 2 + q % 4 AS t,
  CASE WHEN l_partkey % 3 <> 0 THEN 'x = open(a) leaks the ' ELSE '' END || CASE WHEN l_partkey % 5 = 0 THEN 'never freed' ELSE 'handle' END AS told FROM i),
m AS (SELECT case_id, exp_ord, pred_idx FROM e JOIN p USING (case_id, file, category)
  WHERE (e.sym IS NULL OR coalesce(e.sym = p.sym OR ends_with(p.sym, '.' || e.sym) OR ends_with(p.sym, '::' || e.sym), false)) AND (line IS NULL OR (t >= line - tol AND s <= coalesce(line_end, line) + tol)) AND (ev IS NULL OR contains(told, ev))),
g AS (SELECT case_id, min(exp_ord) AS exp_ord, pred_idx FROM m GROUP BY case_id, pred_idx),
h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY case_id, exp_ord ORDER BY pred_idx) = 1 THEN 'true_positive' ELSE 'duplicate' END AS outcome FROM g),
a AS (SELECT case_id, exp_ord, pred_idx, outcome FROM h UNION ALL SELECT case_id, exp_ord, NULL, 'missed' FROM e WHERE (case_id, exp_ord) NOT IN (SELECT (case_id, exp_ord) FROM h))"""
_SCALE = ", ".join(f"'{s}'" for s in (*SEVERITIES[:-1], "odd"))
_RANKS = ", ".join(f"('{s}', {k})" for k, s in enumerate(SEVERITIES))
_FOUND = f"""{_ITEMS}, f AS (SELECT case_id, file AS path, q // 10 AS line, [{_SCALE}][l_partkey % {len(SEVERITIES)} + 1] AS severity, ord AS fingerprint FROM i), r AS (SELECT * FROM (VALUES {_RANKS}) AS v(severity, k))"""
ORACLES = {
    "truth_matches": f"WITH {_TRUTH} SELECT * FROM m",
    "truth_outcomes": f"WITH {_TRUTH} SELECT * FROM a",
    "overall_rates": f"""WITH {_TRUTH}, c AS (SELECT o_orderkey AS case_id, o_orderstatus = 'P' AS err, (SELECT count(*) FROM h WHERE case_id = o_orderkey) AS hit, (SELECT count(*) FROM h WHERE case_id = o_orderkey AND outcome = 'duplicate') AS dup FROM orders),
x AS (SELECT case_id, count(*) AS n, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N') AS uns, sum(l_linenumber) AS cand FROM i GROUP BY 1), y AS (SELECT * FROM c JOIN x USING (case_id))
SELECT count(*) FILTER (NOT err) AS cases, count(*) FILTER (err) AS error_cases, coalesce(sum(n - hit) FILTER (NOT err) / count(*) FILTER (NOT err), 0) AS fp_per_case, coalesce(sum(n - hit) FILTER (NOT err) / sum(cand) FILTER (NOT err), 0) * 100 AS fp_per_100_candidates,
  coalesce(sum(dup) FILTER (NOT err) / sum(n) FILTER (NOT err), 0) AS duplicate_rate, coalesce(sum(uns) FILTER (NOT err) / sum(n) FILTER (NOT err), 0) AS unsupported_rate FROM y""",
    "eval_by_difficulty": f"""WITH {_TRUTH}, o AS (SELECT o_orderkey AS case_id, o_orderpriority AS difficulty FROM orders), z AS (SELECT difficulty, outcome FROM a JOIN o USING (case_id) UNION ALL SELECT difficulty, 'false_positive' FROM p JOIN o USING (case_id) WHERE (case_id, pred_idx) NOT IN (SELECT (case_id, pred_idx) FROM h)),
c AS (SELECT difficulty, count(*) FILTER (outcome = 'true_positive') AS t, count(*) FILTER (outcome = 'false_positive') AS f, count(*) FILTER (outcome = 'missed') AS m FROM z GROUP BY 1), s AS (SELECT *, CASE WHEN t + f = 0 THEN 1.0 ELSE t / (t + f) END AS "precision", CASE WHEN t + m = 0 THEN 1.0 ELSE t / (t + m) END AS recall FROM c)
SELECT difficulty, left(difficulty, 1)::INT - 1 AS place, t + m AS support, "precision", recall, CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM s""",
    "severity_counts": f"WITH {_FOUND} SELECT r.severity, {len(SEVERITIES) - 1} - k AS place, count(f.severity) AS n FROM r LEFT JOIN f USING (severity) GROUP BY ALL",
    "presentation_order": f"WITH {_FOUND} SELECT case_id, fingerprint, row_number() OVER (PARTITION BY case_id ORDER BY path, line, k DESC NULLS LAST, fingerprint) AS place FROM f LEFT JOIN r USING (severity)",
    "analyzers_in_order": f"WITH {_ITEMS}, u AS (SELECT case_id, l_returnflag AS name, min(ord) AS first FROM i GROUP BY 1, 2) SELECT case_id, string_agg(name, ',' ORDER BY first, name) AS names FROM u GROUP BY 1",
    "events_ingested": "SELECT count(*) AS events_ingested FROM events WHERE event_type IN ('click', 'view', 'purchase')",
}
