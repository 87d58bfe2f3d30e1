"""Queries on whole review runs. Surrogates: conversations are findings that hit, suppliers runs, each
compared with the next; orders cite documents; the event log has a finding per user and reaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.functions.output import summary_bodies
from findweave.functions.ranks import SEVERITIES, at_rank, rate
from findweave.operators import events as feedback_ops
from findweave.operators import quality
from findweave.plans import feedback, review
from findweave.plans.evaluation import ABSOLUTE, GENERIC, HEDGES, outcomes


def _severity(n) -> F.Column:
    return at_rank((n % 5).cast("int"), SEVERITIES)


def security_rates(spark, d):
    c, v, t = F.col, F.col("conv_id"), F.col("turn")
    pairs = spark.read.parquet(f"{d}/conversations.parquet").select(
        "role", F.when(v % 11 == 0, F.lit("  ")).otherwise(F.concat("text", F.when(t % 3 == 0, F.lit(" Sanitize input")).when(t % 3 == 1, F.lit(" this allows, if so")).otherwise(F.lit(" this enables")))).alias("message"),
        F.when(v % 4 == 0, F.lit("  ")).when(v % 4 == 1, F.lit("It depends on the caller")).when(v % 4 == 2, c("role")).alias("reasoning"),
        F.when(v % 3 == 1, F.lit(" ")).when(v % 3 == 2, F.concat(F.lit("Use PROPER error handling, "), "role")).alias("fix"),
        F.when(t % 4 != 0, F.when(v % 5 == 0, F.concat(F.lit("Full TAKEOVER of "), "role")).when(v % 5 == 1, F.lit("")).otherwise(F.col("text"))).alias("impact"),
        _severity(v + t).alias("severity"), F.get(F.array(*map(F.lit, ("low", "medium", "high"))), (v % 3).cast("int")).alias("confidence"), F.when(v % 2 == 1, F.lit("x")).alias("remediation"), F.when(v % 3 != 2, F.lit("y")).alias("impact_concept"),
        F.when(t % 2 == 0, _severity(v)).alias("max_severity"), F.when(v % 7 != 0, F.array(F.lit("takeover"), F.lit("Full"))).otherwise(F.array().cast("array<string>")).alias("forbidden_claims"),
    )
    return quality.security_rates(pairs, GENERIC, ABSOLUTE, HEDGES, ["role"])


def _runs(spark, d: str) -> DataFrame:
    """One run per supplier; every tenth has another engine than the one before, some another mode."""
    c, n, k = F.col, F.count("*"), F.col("l_suppkey")
    hit, wrong = F.count_if(c("l_returnflag") == "R"), F.count_if(c("l_returnflag") == "A")
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(
        rate(hit, hit + wrong, 1.0).alias("precision"), rate(hit, n - wrong, 1.0).alias("recall"), rate(F.count_if(c("l_tax") < 0.05), n, 1.0).alias("clean_pass_rate"), F.count_if(c("l_quantity") > 48).alias("unsupported"),
        rate(F.count_if(c("l_linenumber") == 1), n, 0.0).alias("duplicate_rate"), F.count_if((c("l_quantity") == 50) & (c("l_discount") > 0.09) & (c("l_tax") > 0.07)).alias("unsafe"),
    )
    versions = {name: F.lit("1") for name in quality.IDENTITY} | {"review_engine_version": F.floor(k / 10).cast("string"), "mode": F.when(k % 17 == 0, F.lit("static")).otherwise(F.lit("full")), "review_memory_version": F.lit(None).cast("string")}
    return li.select(k.alias("run"), F.struct(*[e.alias(name) for name, e in versions.items()], "precision", "recall", "clean_pass_rate", "unsupported", "duplicate_rate", F.when(k % 3 != 0, F.col("unsafe")).alias("unsafe_carry_forward")).alias("r"))


def regression_by_run(spark, d):
    runs = _runs(spark, d)
    pairs = runs.select("run", F.col("r").alias("baseline")).join(runs.select((F.col("run") - 1).alias("run"), F.col("r").alias("current")), "run")
    return quality.regression_checks(pairs, ["run"])


def hallucination_by_case(spark, d):
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n")).alias("n_lines"), "source")
    k = F.col("o_orderkey")
    cited = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("case_id"), F.col("o_custkey").alias("file"), (k % 9).alias("start"), (k % 7 + 2).alias("end"))
    accepted = outcomes(spark, d).select(F.col("category").alias("case_id"), "outcome")
    both = outcomes(spark, d).where("toxic = 1").select(F.lit("F").alias("case_id"), "outcome")
    return quality.hallucination_rates(cited, files, accepted.unionByName(both), ["case_id"])


def _log(spark, d: str) -> DataFrame:
    """The event log with a finding per user and reaction, so that many have a single event."""
    return feedback.log(spark, d).withColumn("finding_id", F.col("finding_id") * 1000 + F.col("reaction_id"))


def feedback_totals(spark, d):
    """Events of reactions that no labelled document has are unattributed."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("reaction_id"))
    log = _log(spark, d)
    return quality.feedback_totals(feedback_ops.assess(log), log.join(labels, "reaction_id", "left_anti"))


def feedback_bands(spark, d):
    """A finding is known as the order of its number, as far as there is one."""
    known = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderpriority").alias("category"), _severity(F.col("o_custkey")).alias("severity"), F.when(F.col("o_totalprice") > 100000, F.lit("high")).otherwise(F.lit("low")).alias("confidence"))
    return quality.feedback_bands(feedback_ops.assess(_log(spark, d)), known, ["category", "severity", "confidence"])


def candidate_verdicts(spark, d):
    """Every finding, with whether it looks like a false positive, and of high value."""
    a = feedback_ops.assess(_log(spark, d))
    return a.select("finding_id", feedback_ops.false_positive_candidate().alias("false_positive"), feedback_ops.high_value_candidate().alias("high_value"))


def claim_problems(spark, d):
    q, li = F.col("l_quantity").cast("long"), spark.read.parquet(f"{d}/lineitem.parquet")
    key = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    claims = F.when(q % 3 == 0, F.array(F.lit("takeover"), F.lit(" \t"))).when(q % 3 == 1, F.array(F.lit("breach"))).otherwise(F.array().cast("array<string>"))
    expected = li.select(F.col("l_orderkey").alias("case_id"), key.alias("exp_ord"), claims.alias("forbidden_claims"))
    p = F.col("l_partkey")
    rules = li.select(
        F.col("l_orderkey").alias("case_id"), key.alias("rule_ord"), F.when(p % 2 == 0, F.col("l_returnflag")).alias("category"), F.when(p % 3 == 0, F.lit("family")).alias("issue_family"),
        F.when(q % 5 == 0, F.lit("  ")).when(q % 5 != 1, F.col("l_linestatus")).alias("reason"),
    )
    return quality.claim_problems(expected, rules)


def prediction_sides(spark, d):
    """Line items as predictions; parts of size 10 and more are candidates, cheap orders have no expectation."""
    c = F.col
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_suppkey", F.col("l_partkey").alias("candidate_id"), F.when(c("l_returnflag") != "N", F.col("l_linestatus")).alias("matched"))
    candidates = spark.read.parquet(f"{d}/part.parquet").where("p_size >= 10").select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("name"))
    expected = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("exp_ord"), F.col("o_orderpriority").alias("severity"))
    return quality.with_sides(li, candidates, expected).select("case_id", "l_linenumber", "l_suppkey", "candidate_id", "matched", "symbol", "expected_severity")


def incremental_by_run(spark, d):
    """A supplier is a run: its returned items were candidates before, all are now; open ones are chosen again."""
    c = F.col
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("run"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("candidate_id"), F.when(c("l_quantity") > 5, F.col("l_partkey")).alias("symbol_id"), "l_linestatus", "l_returnflag", "l_discount", "l_tax")
    disposition = F.when(c("l_returnflag") == "R", F.lit("carry_forward")).when(c("l_returnflag") == "A", F.lit("resolved_immediately")).otherwise(F.lit("needs_recheck"))
    decisions = li.where("l_discount > 0.08").select("run", disposition.alias("disposition"), F.when(c("l_tax") > 0.04, F.lit("ambiguous_symbol_match")).otherwise(F.lit("file_changed")).alias("reason"), "symbol_id")
    return quality.incremental_totals(li.where("l_returnflag = 'R' AND l_tax < 0.02"), li, li.where("l_linestatus = 'O'"), decisions, ["run"])


def summaries(spark, d):
    """An order is a run; its first items are placed inline, further ones in the summary, and the rest left out."""
    from pyspark.sql.window import Window

    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").join(part, "l_partkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    findings = li.select(
        F.col("l_orderkey").alias("run_id"), place.alias("place"), F.when(place <= 2, F.lit("inline")).when(place <= 4, F.lit("summary")).otherwise(F.lit("omitted")).alias("disposition"), _severity(F.col("l_partkey")).alias("severity"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("path"), F.col("l_linenumber").alias("line"), F.concat(F.lit(" "), "title", F.when(F.col("l_partkey") % 5 == 0, F.lit(" --> <!-- x")).otherwise(F.lit(""))).alias("title"),
    )
    marker = F.concat(F.lit("<!-- run:"), F.col("run_id").cast("string"), F.lit(" -->"))
    return summary_bodies(findings, marker, "Review summary", limit=260)


def _changed(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fifteen symbols a file, one by three around others; lines are changed by line items, findings by open orders."""
    k, li = F.col("c_custkey"), spark.read.parquet(f"{d}/lineitem.parquet")
    path = lambda n: F.concat(F.lit("f"), n.cast("string"))
    m = k % 15
    start = m * 100 + F.when(m % 3 == 0, 1).when(m % 3 == 1, 10).otherwise(60)
    symbols = spark.read.parquet(f"{d}/customer.parquet").select(path(F.floor(k / 15)).alias("path"), F.concat(F.lit("s"), k.cast("string")).alias("id"), start.alias("start"), (start + F.when(m % 3 == 0, 249).when(m % 3 == 1, 40).otherwise(30)).alias("end"))
    added = li.select(path(F.col("l_suppkey")).alias("path"), (F.col("l_partkey") % 2000).alias("line")).distinct()
    o, n = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P' AND o_totalprice < 60000"), F.col("o_orderkey")
    findings = o.select(path(F.floor(F.col("o_custkey") / 15)).alias("path"), F.concat(F.lit("w"), n.cast("string")).alias("id"), (n % 2000).alias("start"), (n % 2000 + 5).alias("end"))
    return added, symbols, findings


def _shown(candidates: DataFrame) -> DataFrame:
    return candidates.select("path", "symbol", "first", "last", "n_lines", F.array_join(F.sort_array("static_findings"), ",").alias("static_findings"))


def review_candidates(spark, d):
    return _shown(review.review_candidates(*_changed(spark, d)))


def review_priorities(spark, d):
    """The hundred candidates that come first."""
    return _shown(review.review_candidates(*_changed(spark, d), limit=100))


QUERIES = {
    "security_rates": security_rates, "regression_by_run": regression_by_run, "hallucination_by_case": hallucination_by_case, "feedback_totals": feedback_totals, "feedback_bands": feedback_bands, "candidate_verdicts": candidate_verdicts,
    "claim_problems": claim_problems, "prediction_sides": prediction_sides, "incremental_by_run": incremental_by_run, "summary_bodies": summaries, "review_candidates": review_candidates, "review_priorities": review_priorities,
}


def _any(text: str, phrases) -> str:
    return f"list_bool_or([contains(lower({text}), p) FOR p IN [{', '.join(repr(p) for p in phrases)}]])"


_SEV = "['info', 'low', 'medium', 'high', 'critical']"
_MARKED = f"{feedback.ASSESS.replace('SELECT user_id AS finding_id', 'SELECT user_id * 1000 + k AS finding_id')}"
_RUNS = """r AS (SELECT l_suppkey AS run, count(*) FILTER (l_returnflag = 'R') AS h, count(*) FILTER (l_returnflag = 'A') AS w, count(*) AS n, count(*) FILTER (l_tax < 0.05) AS cl, count(*) FILTER (l_quantity > 48) AS u, count(*) FILTER (l_linenumber = 1) AS dup,
  count(*) FILTER (l_quantity = 50 AND l_discount > 0.09 AND l_tax > 0.07) AS un, l_suppkey // 10 AS ver, l_suppkey % 17 = 0 AS st FROM lineitem GROUP BY l_suppkey),
x AS (SELECT run, ver, st, CASE WHEN h + w = 0 THEN 1.0::DOUBLE ELSE h / (h + w) END AS p, CASE WHEN n = w THEN 1.0::DOUBLE ELSE h / (n - w) END AS c, cl / n AS cl, u, dup / n AS dup, CASE WHEN run % 3 <> 0 THEN un ELSE 0 END AS un FROM r)"""
_CHANGED = """s AS (SELECT 'f' || (c_custkey // 15) AS path, 's' || c_custkey AS id, c_custkey % 15 * 100 + CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 60 END AS st, c_custkey % 15 * 100 + CASE c_custkey % 3 WHEN 0 THEN 250 WHEN 1 THEN 50 ELSE 90 END AS en FROM customer),
a AS (SELECT DISTINCT 'f' || l_suppkey AS path, l_partkey % 2000 AS line FROM lineitem),
w AS (SELECT 'f' || (o_custkey // 15) AS path, 'w' || o_orderkey AS id, o_orderkey % 2000 AS st FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 60000),
i AS (SELECT a.path, a.line, arg_min(id, (en - st, st, id)) AS sym, arg_min(st, (en - st, st, id)) AS st, arg_min(en, (en - st, st, id)) AS en FROM a LEFT JOIN s ON s.path = a.path AND line BETWEEN st AND en GROUP BY 1, 2),
f AS (SELECT path, min(line) AS first FROM i WHERE sym IS NULL GROUP BY 1 UNION ALL SELECT i.path, min(i.line) FROM f JOIN i ON i.path = f.path AND i.line > f.first + 60 WHERE i.sym IS NULL GROUP BY i.path),
c AS (SELECT path, sym AS symbol, min(st) AS first, min(en) AS last, count(*) AS n_lines FROM i WHERE sym IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT i.path, NULL, first, max(line), count(*) FROM f JOIN i ON i.path = f.path AND sym IS NULL AND line BETWEEN first AND first + 60 GROUP BY i.path, first),
o AS (SELECT c.path, symbol, first, last, n_lines, coalesce(string_agg(w.id, ',' ORDER BY w.id), '') AS static_findings FROM c LEFT JOIN w ON w.path = c.path AND w.st <= last AND w.st + 5 >= first GROUP BY ALL)"""
ORACLES = {
    "security_rates": f"""WITH b AS (SELECT role, conv_id AS v, turn AS t, CASE WHEN conv_id % 11 = 0 THEN '  ' ELSE text || CASE turn % 3 WHEN 0 THEN ' Sanitize input' WHEN 1 THEN ' this allows, if so' ELSE ' this enables' END END AS message,
  CASE conv_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'It depends on the caller' WHEN 2 THEN role END AS reasoning, CASE conv_id % 3 WHEN 1 THEN ' ' WHEN 2 THEN 'Use PROPER error handling, ' || role END AS fix,
  CASE WHEN turn % 4 <> 0 THEN CASE conv_id % 5 WHEN 0 THEN 'Full TAKEOVER of ' || role WHEN 1 THEN '' ELSE text END END AS impact FROM conversations),
x AS (SELECT *, trim(message) <> '' AS m, coalesce(trim(reasoning) <> '', false) AS r, coalesce(trim(fix) <> '', false) AS f, coalesce(trim(impact) <> '', false) AS i, coalesce(v % 7 <> 0 AND contains(lower(impact), 'takeover'), false) AS ex,
  {_any("message", GENERIC)} OR coalesce({_any("reasoning", GENERIC)}, false) OR coalesce({_any("fix", GENERIC)}, false) AS g, {_any("message || ' ' || coalesce(reasoning, '')", ABSOLUTE)} AND NOT {_any("message || ' ' || coalesce(reasoning, '')", HEDGES)} AS oc, v % 3 < 2 AS low FROM b),
n AS (SELECT role, count(*) AS n, count(*) FILTER (m) AS m, count(*) FILTER (r) AS r, count(*) FILTER (v % 2 = 1) AS fe, count(*) FILTER (v % 2 = 1 AND f) AS f, count(*) FILTER (v % 3 <> 2) AS ie, count(*) FILTER (v % 3 <> 2 AND i AND NOT ex) AS ig,
  count(*) FILTER (t % 2 = 0) AS se, count(*) FILTER (t % 2 = 0 AND (v + t) % 5 > v % 5) AS so, count(*) FILTER (i) AS i, count(*) FILTER (i AND ex) AS ex, count(*) FILTER (g) AS g, count(*) FILTER (low) AS low, count(*) FILTER (low AND oc) AS oc FROM x GROUP BY 1)
SELECT role, n AS true_positives_scored, m / n AS identification_present_rate, r / n AS root_cause_present_rate, coalesce(f / nullif(fe, 0), 1) AS actionable_fix_present_rate, fe AS actionable_fix_expected_count, coalesce(ig / nullif(ie, 0), 1) AS impact_grounded_rate, ie AS impact_expected_count,
  coalesce(so / nullif(se, 0), 0) AS severity_overstatement_rate, se AS severity_checked_count, coalesce(ex / nullif(i, 0), 0) AS unsupported_impact_rate, g / n AS generic_advice_rate, coalesce(oc / nullif(low, 0), 0) AS low_confidence_overclaim_rate, low AS low_or_medium_confidence_count FROM n""",
    "regression_by_run": f"""WITH {_RUNS}, j AS (SELECT b.run, CASE WHEN b.ver <> n.ver THEN 'review_engine_version' WHEN b.st <> n.st THEN 'mode' END AS differs,
  [{{'check_name': 'precision', 'change': b.p - n.p, 'threshold': 0.03::DOUBLE}}, {{'check_name': 'recall', 'change': b.c - n.c, 'threshold': 0.1::DOUBLE}}, {{'check_name': 'clean_case_pass_rate', 'change': b.cl - n.cl, 'threshold': 0.05::DOUBLE}},
   {{'check_name': 'unsupported_accepted_findings', 'change': (n.u - b.u)::DOUBLE, 'threshold': 0::DOUBLE}}, {{'check_name': 'duplicate_rate', 'change': n.dup - b.dup, 'threshold': 0.02::DOUBLE}}, {{'check_name': 'unsafe_carry_forward', 'change': n.un::DOUBLE, 'threshold': 0::DOUBLE}}] AS checks
  FROM x b JOIN x n ON n.run = b.run + 1), e AS (SELECT run, differs, CASE WHEN differs IS NOT NULL THEN 2 WHEN len(list_filter(checks, lambda k: k.change > k.threshold)) > 0 THEN 1 ELSE 0 END AS exit_code, unnest(checks) AS k FROM j)
SELECT run, k.check_name AS check_name, k.change AS change, k.threshold AS threshold, CASE WHEN differs IS NOT NULL THEN 'not comparable' WHEN k.change <= k.threshold THEN 'passed' ELSE 'failed' END AS verdict, differs, exit_code FROM e""",
    "hallucination_by_case": """WITH f AS (SELECT doc_id AS file, len(string_split(text, chr(10))) AS n FROM documents), p AS (SELECT o_orderstatus AS case_id, count(*) AS proposals, count(*) FILTER (n IS NULL OR o_orderkey % 7 + 2 > n OR o_orderkey % 9 < 1 OR o_orderkey % 7 + 2 < o_orderkey % 9) AS unsupported_before FROM orders LEFT JOIN f ON file = o_custkey GROUP BY 1),
l AS (SELECT lang, toxic, toxic = 1 AND quality <> 1 AS bad FROM labels JOIN documents USING (doc_id)), a AS (SELECT case_id, count(*) AS accepted, count(*) FILTER (bad) AS unsupported_after FROM (SELECT lang AS case_id, bad FROM l UNION ALL SELECT 'F', bad FROM l WHERE toxic = 1) GROUP BY 1)
SELECT case_id, coalesce(proposals, 0) AS proposals, coalesce(unsupported_before, 0) AS unsupported_before, coalesce(accepted, 0) AS accepted, coalesce(unsupported_after, 0) AS unsupported_after,
  coalesce(unsupported_before / nullif(proposals, 0), 0) AS rate_before, coalesce(unsupported_after / nullif(accepted, 0), 0) AS rate_after FROM p FULL JOIN a USING (case_id)""",
    "feedback_totals": f"""WITH {_MARKED} SELECT sum(positive_reactions + negative_reactions + developer_replies + explicit_useful + explicit_false_positive + explicit_fixed + explicit_ignore)::BIGINT AS events_ingested, count(*) AS findings,
  count(*) FILTER (usefulness = 'positive') / count(*) AS positive_rate, count(*) FILTER (usefulness = 'negative') / count(*) AS negative_rate, sum(explicit_useful)::BIGINT AS explicit_useful, sum(explicit_false_positive)::BIGINT AS explicit_false_positive, sum(explicit_fixed)::BIGINT AS explicit_fixed,
  count(*) FILTER (engaged) / count(*) AS engagement_rate, count(*) FILTER (confidence = 'strong') AS confidence_strong, count(*) FILTER (confidence = 'medium') AS confidence_medium, count(*) FILTER (confidence = 'weak') AS confidence_weak, count(*) FILTER (confidence IS NULL) AS confidence_none,
  (SELECT count(*) FROM l WHERE reaction_id NOT IN (SELECT doc_id FROM labels)) AS unattributed FROM a""",
    "feedback_bands": f"""WITH {_MARKED}, k AS (SELECT usefulness, explicit_false_positive AS e, o_orderpriority AS category, {_SEV}[o_custkey % 5 + 1] AS severity, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS confidence FROM a JOIN orders ON o_orderkey = finding_id),
b AS (SELECT usefulness, e, unnest(['category', 'severity', 'confidence']) AS band, unnest([category, severity, confidence]) AS value FROM k)
SELECT band, value, count(*) AS findings, count(*) FILTER (usefulness = 'positive') / count(*) AS positive_rate, count(*) FILTER (usefulness = 'negative') / count(*) AS negative_rate, count(*) FILTER (e > 0) AS false_positives FROM b GROUP BY 1, 2""",
    "candidate_verdicts": f"""WITH {_MARKED} SELECT finding_id, explicit_false_positive > 0 OR negative_reactions >= 2 OR (negative_reactions > 0 AND finding_code_unchanged) AS false_positive,
  explicit_useful > 0 OR finding_disappeared OR (positive_reactions > 0 AND finding_changed) AS high_value FROM a""",
    "claim_problems": """WITH x AS (SELECT l_orderkey AS case_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS place, l_quantity::BIGINT AS q, l_partkey AS p FROM lineitem)
SELECT case_id, place, 'blank_claim' AS error FROM x WHERE q % 3 = 0 UNION ALL SELECT case_id, place, 'no_target' FROM x WHERE p % 2 <> 0 AND p % 3 <> 0 UNION ALL SELECT case_id, place, 'no_reason' FROM x WHERE q % 5 < 2""",
    "prediction_sides": """SELECT l_orderkey AS case_id, l_linenumber, l_suppkey, l_partkey AS candidate_id, CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS matched, p_name AS symbol, o_orderpriority AS expected_severity
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size >= 10 LEFT JOIN orders ON o_orderkey = l_orderkey AND o_totalprice > 100000 AND l_returnflag <> 'N' AND o_orderstatus = l_linestatus""",
    "incremental_by_run": """WITH x AS (SELECT *, l_suppkey AS run, CASE WHEN l_quantity > 5 THEN l_partkey END AS sym, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id FROM lineitem), k AS (SELECT DISTINCT run, sym FROM x WHERE l_discount > 0.08 AND l_returnflag = 'R' AND sym IS NOT NULL),
g AS (SELECT DISTINCT run, id, true AS sel FROM x WHERE l_linestatus = 'O'), y AS (SELECT x.run, sel IS NULL AS skip, k.sym IS NOT NULL AS conf FROM x LEFT JOIN g ON g.run = x.run AND g.id = x.id LEFT JOIN k ON k.run = x.run AND k.sym = x.sym),
c AS (SELECT run, count(*) AS current_candidates, count(*) FILTER (NOT skip) AS incremental_candidates, count(*) FILTER (skip) AS skipped, count(*) FILTER (skip AND NOT conf) AS skipped_finding_free, count(*) FILTER (skip AND conf) AS skipped_evidence_confirmed FROM y GROUP BY 1),
d AS (SELECT run, count(*) FILTER (l_returnflag = 'R' AND l_tax < 0.02) AS previous_candidates, count(*) FILTER (l_discount > 0.08 AND l_returnflag = 'R') AS carried_forward, count(*) FILTER (l_discount > 0.08 AND l_returnflag = 'A') AS resolved, count(*) FILTER (l_discount > 0.08 AND l_returnflag = 'N' AND l_tax > 0.04) AS ambiguous FROM x GROUP BY 1)
SELECT * FROM c JOIN d USING (run)""",
    "summary_bodies": f"""WITH x AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_partkey % 5 AS sev, '- **' || upper({_SEV}[l_partkey % 5 + 1]) || '** `f' || l_suppkey || '.py:' || l_linenumber || '` — ' || p_name || CASE WHEN l_partkey % 5 = 0 THEN ' --&gt; &lt;!-- x' ELSE '' END AS told FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT run_id, sev, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT run_id, string_agg(n || ' ' || {_SEV}[sev + 1], ', ' ORDER BY sev DESC) AS s FROM n GROUP BY 1),
g AS (SELECT run_id, count(*) FILTER (place <= 2) AS a, count(*) FILTER (place IN (3, 4)) AS b, count(*) FILTER (place > 4) AS c, string_agg(told, chr(10) ORDER BY place) FILTER (place <= 2) AS ta, string_agg(told, chr(10) ORDER BY place) FILTER (place IN (3, 4)) AS tb FROM x GROUP BY 1),
t AS (SELECT run_id, '<!-- run:' || run_id || ' -->' AS mark, '## Review summary' || chr(10) || chr(10) || '**Findings:** ' || s || chr(10) || '**Published inline:** ' || a || ' · **Summary-only:** ' || b || ' · **Omitted:** ' || c || chr(10) || chr(10) || '### Inline comments' || chr(10) || ta || chr(10) || chr(10)
  || CASE WHEN b > 0 THEN '### Additional findings (not mappable to a diff line)' || chr(10) || tb || chr(10) || chr(10) ELSE '' END || CASE WHEN c > 0 THEN '*' || c || ' additional finding(s) omitted.*' || chr(10) || chr(10) ELSE '' END AS told FROM g JOIN s USING (run_id)),
u AS (SELECT run_id, mark, rtrim(told, chr(10)) AS told, 260 - length(mark) - 2 AS room FROM t)
SELECT run_id, CASE WHEN length(told) <= room THEN told ELSE left(told, greatest(room - 15, 0)) || chr(10) || chr(10) || '*(truncated)*' END || chr(10) || chr(10) || mark AS body, length(told) > room AS truncated FROM u""",
    "review_candidates": f"WITH RECURSIVE {_CHANGED} SELECT * FROM o",
    "review_priorities": f"WITH RECURSIVE {_CHANGED} SELECT * FROM o ORDER BY static_findings = '', n_lines DESC, path, first, last LIMIT 100",
}
