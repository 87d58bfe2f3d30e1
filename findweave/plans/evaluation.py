"""Evaluation queries. Surrogates: a benchmark item is an expected finding, a document a prediction;
labels are outcomes of cases (one per document); order priorities are severities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.functions import ranks, rules
from findweave.functions.text import contains_any, normalized
from findweave.operators import matching, metrics

PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
#: Phrases of generic advice, of certainty and of hedging (fixed values).
GENERIC = ("validate user input", "validate all input", "consider using safer apis", "be careful with authentication", "ensure proper synchronization", "avoid logging sensitive data", "follow security best practices", "sanitize input", "use proper error handling")
ABSOLUTE = ("this allows", "this is vulnerable to", "confirmed vulnerability", "definitely exploitable", "this enables")
HEDGES = ("if ", "may ", "could ", "verify", "assuming", "depends on", "unclear")


def outcomes(spark, d: str) -> DataFrame:
    """Predictions with outcomes: a document is a hit by its quality label, its language the category."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("category"), "source")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    o = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit("duplicate")).when(F.col("quality") == 1, F.lit("true_positive")).when(F.col("toxic") == 1, F.lit("unsupported")).otherwise(F.lit("false_positive"))
    return labels.join(docs, "doc_id").withColumn("outcome", o)


def missed(spark, d: str) -> DataFrame:
    """Expectations without a prediction: documents without a label."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("category"), "source")
    return matching.unmatched(docs, spark.read.parquet(f"{d}/labels.parquet"), ["doc_id"])


OUT = """o AS (SELECT doc_id, lang AS category, source, quality, CASE WHEN quality = 1 AND toxic = 1 THEN 'duplicate' WHEN quality = 1 THEN 'true_positive' WHEN toxic = 1 THEN 'unsupported' ELSE 'false_positive' END AS outcome FROM labels JOIN documents USING (doc_id)),
m AS (SELECT doc_id, lang AS category, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
COUNTS = ", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in metrics.OUTCOMES)
PRF = "true_positive / (true_positive + false_positive)"


def confusion(spark, d):
    return metrics.confusion(outcomes(spark, d), missed(spark, d))


def prf1(spark, d):
    return metrics.scores(confusion(spark, d)).select("precision", "recall", "f1")


def by_category(spark, d):
    return metrics.scores(metrics.confusion(outcomes(spark, d), missed(spark, d), ["category"])).select("category", "true_positive", "false_positive", "missed", "precision", "recall", "f1", (F.col("true_positive") + F.col("missed")).alias("support"))


def severity_calibration(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    expected = ranks.rank(F.col("o_orderpriority"), PRIORITIES)
    return metrics.calibration(o.select(expected.alias("e"), (F.floor(F.col("o_totalprice") / 100000) % 5).cast("int").alias("f")), "e", "f")


def greedy_assign(spark, d):
    """Documents that quote a benchmark item, each assigned to the first item; the first document of an item is the hit.

    A passage may begin and end inside a word, so it is looked up by up to four of its words after
    the first and before the last, which must stand whole in the text; one of one or two words by
    its letters. Only ids and these keys are joined; texts come in for the hits.
    """
    squeezed = lambda t: normalized(F.col(t))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", squeezed("text").alias("passage"))
    n = F.size(F.split("passage", " "))
    inner = F.least(n - 2, F.lit(4))
    items = items.where("passage <> ''").withColumn("size", F.greatest(inner, F.lit(0))).withColumn("key", F.when(inner > 0, F.array_join(F.slice(F.split("passage", " "), F.lit(2), F.greatest(inner, F.lit(1))), " ")))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", squeezed("text").alias("t"))
    sizes = [r["size"] for r in items.select("size").where("size > 0").distinct().collect()]  # four at most
    words = docs.select("doc_id", F.split("t", " ").alias("w"))
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))
    keyed = words.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, sizes))))).alias("key")) if sizes else None
    pairs = [keyed.join(items.where("size > 0").select("item_id", "key"), "key").select("doc_id", "item_id").distinct()] if sizes else []
    short = items.where("size = 0").select("item_id", "passage")
    letters = words.select("doc_id", F.explode(F.array_distinct("w")).alias("word")).join(short.select("item_id", F.substring_index("passage", " ", 1).alias("head")), F.expr("right(word, length(head)) = head OR contains(word, head)"))
    if not short.isEmpty():
        pairs.append(letters.select("doc_id", "item_id").distinct())
    if not pairs:
        return spark.createDataFrame([], "item_id long, doc_id long, outcome string")
    found = pairs[0] if len(pairs) == 1 else pairs[0].union(pairs[1])
    met = found.join(items.select("item_id", "passage"), "item_id").join(docs, "doc_id").where(F.contains("t", "passage")).select(F.lit(0).alias("case_id"), "item_id", "doc_id")
    return matching.greedy_assign(met, ["case_id"], "item_id", "doc_id").select("item_id", "doc_id", "outcome")


def clean_case_metrics(spark, d):
    per = outcomes(spark, d).groupBy("source").agg(F.count_if(F.col("outcome").isin("false_positive", "unsupported")).alias("wrong"))
    return metrics.clean_cases(per, "wrong", "source", "source")


def worst_fp(spark, d):
    per = outcomes(spark, d).groupBy("source").agg(F.count_if(F.col("outcome") == "false_positive").alias("n_fp"))
    return metrics.worst(per, "n_fp", "source")


def overlap(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return metrics.source_overlap(li, ["l_orderkey"], "l_returnflag", ["A"], ["R"])


def analyzer_coverage(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return metrics.coverage(li, "l_linestatus", "l_returnflag", ["A", "N", "R"], "l_linenumber")


def _run(spark, d, half: int) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").where(F.col("o_orderkey") % 2 == half)
    good, n = F.count_if(F.col("o_orderstatus") == "O"), F.count("*")
    return o.agg(F.lit("v1").alias("version"), ranks.rate(good, n, 1.0).alias("precision"), ranks.rate(F.count_if(F.col("o_orderpriority") < "4"), n, 1.0).alias("recall"), F.count_if(F.col("o_totalprice") > 400000).alias("unsupported"))


def run_delta(spark, d):
    a, b = _run(spark, d, 0), _run(spark, d, 1)
    return metrics.compare_runs(a, b, [], [(m, F.col(f"c_{m}") - F.col(f"b_{m}"), 0.0) for m in ("precision", "recall", "unsupported")]).select("check_name", "change")


def regression_checks(spark, d):
    c = F.col
    checks = [("precision", c("b_precision") - c("c_precision"), 0.03), ("recall", c("b_recall") - c("c_recall"), 0.10), ("unsupported", c("c_unsupported") - c("b_unsupported"), 0.0)]
    return metrics.compare_runs(_run(spark, d, 0), _run(spark, d, 1), ["version"], checks).select("check_name", "verdict")


def severity_expectation(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    sev = lambda n: ranks.at_rank((n % 5).cast("int"), ranks.SEVERITIES)
    ok = ranks.severity_as_expected(sev(F.col("o_orderkey")), F.when(F.col("o_custkey") % 3 == 0, sev(F.col("o_custkey"))), F.when(F.col("o_custkey") % 2 == 0, F.lit("low")), F.when(F.col("o_custkey") % 5 == 0, F.lit("high")))
    return o.groupBy(ok.alias("as_expected")).agg(F.count("*").alias("n"))


def prefix_rules(spark, d):
    """Part types and sizes as rule codes of three analyzers."""
    p = spark.read.parquet(f"{d}/part.parquet")
    code = F.concat(F.get(F.array(*[F.lit(x) for x in ("E9", "E722", "E5", "F821", "F4", "SIM1", "S1", "B0", "BLE0", "ASYNC1", "A0", "ZZ")]), (F.col("p_partkey") % 12).cast("int")), F.col("p_size").cast("string"))
    rule = rules.ruff_rule(code)
    return p.select("p_partkey", rule["category"].alias("category"), rule["severity"].alias("severity"), rules.cppcheck_category(F.concat(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.lit("NullPointer")).otherwise(F.lit("x")))).alias("cppcheck"))


def security_quality(spark, d):
    """Curated phrases over conversation texts, with conditional denominators."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, F.lit(" Sanitize input")).when(F.col("turn") % 3 == 1, F.lit(" this allows, if so")).otherwise(F.lit(" this enables")))
    generic, absolute, hedged = contains_any(text, GENERIC), contains_any(text, ABSOLUTE), contains_any(text, HEDGES)
    low = F.col("role") != "system"
    return c.agg(F.count("*").alias("scored"), ranks.rate(F.count_if(generic), F.count("*"), 0.0).alias("generic_rate"), ranks.rate(F.count_if(low & absolute & ~hedged), F.count_if(low), 0.0).alias("overclaim_rate"), F.count_if(low).alias("n_low"))


def truth_errors(spark, d):
    """Problems of labelled truth: each document against the rules."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", "source")
    rows = docs.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return metrics.validation_errors(rows, "doc_id", {"too_short": F.col("n_chars") < 100, "toxic_and_good": (F.col("toxic") == 1) & (F.col("quality") == 1), "untrusted_source": F.col("source").isin("src0", "src1")})


def hallucinations(spark, d):
    """First reason why a cited place can't exist: file absent, past its end, or a bad range."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n")).alias("n_lines"))
    cited = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 9).alias("s"), (F.col("o_orderkey") % 7 + 2).alias("e"))
    j = cited.join(docs, "file", "left")
    reason = F.when(F.col("n_lines").isNull(), F.lit("file_absent")).when(F.col("e") > F.col("n_lines"), F.lit("past_end")).when((F.col("s") < 1) | (F.col("e") < F.col("s")), F.lit("bad_range"))
    return j.select("o_orderkey", F.coalesce(reason, F.lit("supported")).alias("reason"))


def efficiency(spark, d):
    o = outcomes(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    tp = F.count_if(F.col("outcome") == "true_positive")
    return o.agg(F.count("*").alias("provider_calls"), F.sum("n_chars").alias("chars"), ranks.rate(F.sum("n_chars"), tp, 0.0).alias("chars_per_hit"), ranks.rate(F.count("*"), tp, 0.0).alias("calls_per_hit"))


QUERIES = {
    "eval_confusion": confusion, "eval_prf1": prf1, "eval_by_category": by_category, "eval_severity_calibration": severity_calibration, "greedy_assign": greedy_assign, "clean_case_metrics": clean_case_metrics, "worst_fp_topk": worst_fp,
    "source_overlap": overlap, "analyzer_coverage": analyzer_coverage, "run_delta": run_delta, "regression_checks": regression_checks, "severity_expectation": severity_expectation, "prefix_rule_classify": prefix_rules,
    "security_quality": security_quality, "truth_errors": truth_errors, "hallucinations": hallucinations, "efficiency": efficiency,
}

_RUNS = """r AS (SELECT o_orderkey % 2 AS h, count(*) FILTER (o_orderstatus = 'O') / count(*) AS p, count(*) FILTER (o_orderpriority < '4') / count(*) AS c, count(*) FILTER (o_totalprice > 400000) AS u FROM orders GROUP BY 1), b AS (SELECT * FROM r WHERE h = 0), c AS (SELECT * FROM r WHERE h = 1)"""
ORACLES = {
    "eval_confusion": f"WITH {OUT} SELECT {COUNTS}, (SELECT count(*) FROM m) AS missed FROM o",
    "eval_prf1": f"WITH {OUT}, c AS (SELECT {COUNTS}, (SELECT count(*) FROM m) AS missed FROM o), p AS (SELECT {PRF} AS precision, true_positive / (true_positive + missed) AS recall FROM c) SELECT precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM p",
    "eval_by_category": f"""WITH {OUT}, g AS (SELECT category, {COUNTS} FROM o GROUP BY 1), n AS (SELECT category, count(*) AS missed FROM m GROUP BY 1), j AS (SELECT category, coalesce(true_positive, 0) AS true_positive, coalesce(false_positive, 0) AS false_positive, coalesce(missed, 0) AS missed FROM g FULL JOIN n USING (category)),
p AS (SELECT *, CASE WHEN true_positive + false_positive = 0 THEN 1.0::DOUBLE ELSE {PRF} END AS precision, CASE WHEN true_positive + missed = 0 THEN 1.0::DOUBLE ELSE true_positive / (true_positive + missed) END AS recall FROM j)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1, true_positive + missed AS support FROM p""",
    "eval_severity_calibration": """WITH x AS (SELECT (floor(o_totalprice / 100000)::BIGINT % 5) - (list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) - 1) AS d FROM orders)
SELECT count(*) AS n, count(*) FILTER (d = 0) / count(*) AS exact, count(*) FILTER (abs(d) <= 1) / count(*) AS within_one, count(*) FILTER (d > 0) / count(*) AS over, count(*) FILTER (d < 0) / count(*) AS under FROM x""",
    "greedy_assign": r"""WITH n AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM benchmark), t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents),
f AS (SELECT doc_id, min(item_id) AS item_id FROM t, n WHERE contains(t, ' ' || p || ' ') OR starts_with(t, p || ' ') OR ends_with(t, ' ' || p) OR t = p OR contains(t, p) GROUP BY 1)
SELECT item_id, doc_id, CASE WHEN row_number() OVER (PARTITION BY item_id ORDER BY doc_id) = 1 THEN 'true_positive' ELSE 'duplicate' END AS outcome FROM f""",
    "clean_case_metrics": f"WITH {OUT}, p AS (SELECT source, count(*) FILTER (outcome IN ('false_positive', 'unsupported')) AS wrong FROM o GROUP BY 1) SELECT count(*) AS n_cases, count(*) FILTER (wrong = 0) / count(*) AS pass_rate, avg(wrong) AS mean_wrong, CASE WHEN max(wrong) > 0 THEN arg_min(source, (-wrong, source)) END AS worst_case FROM p",
    "worst_fp_topk": f"WITH {OUT} SELECT source, count(*) FILTER (outcome = 'false_positive') AS n_fp FROM o GROUP BY 1 HAVING n_fp > 0 ORDER BY n_fp DESC, source LIMIT 10",
    "source_overlap": "WITH k AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS b FROM lineitem GROUP BY 1) SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first_only' WHEN b THEN 'second_only' ELSE 'missed' END AS overlap, count(*) AS n FROM k GROUP BY 1",
    "analyzer_coverage": "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n, count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) AS n_all, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1",
    "run_delta": f"WITH {_RUNS} SELECT unnest(['precision', 'recall', 'unsupported']) AS check_name, unnest([c.p - b.p, c.c - b.c, (c.u - b.u)::DOUBLE]) AS change FROM b, c",
    "regression_checks": f"WITH {_RUNS} SELECT unnest(['precision', 'recall', 'unsupported']) AS check_name, unnest([CASE WHEN b.p - c.p <= 0.03 THEN 'passed' ELSE 'failed' END, CASE WHEN b.c - c.c <= 0.1 THEN 'passed' ELSE 'failed' END, CASE WHEN c.u <= b.u THEN 'passed' ELSE 'failed' END]) AS verdict FROM b, c",
    "severity_expectation": "SELECT CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 5 = o_custkey % 5 ELSE (o_custkey % 2 <> 0 OR o_orderkey % 5 >= 1) AND (o_custkey % 5 <> 0 OR o_orderkey % 5 <= 3) END AS as_expected, count(*) AS n FROM orders GROUP BY 1",
    "prefix_rule_classify": """SELECT p_partkey, ['correctness', 'correctness', 'style', CASE WHEN true THEN 'correctness' END, 'correctness', 'maintainability', 'security', 'correctness', 'correctness', 'concurrency', 'maintainability', 'unknown'][p_partkey % 12 + 1] AS category,
  ['high', 'medium', 'info', 'high', 'medium', 'low', 'high', 'medium', 'low', 'medium', 'low', 'medium'][p_partkey % 12 + 1] AS severity, CASE WHEN p_size % 2 = 0 THEN 'memory_safety' ELSE 'unknown' END AS cppcheck FROM part""",
    "security_quality": """WITH x AS (SELECT *, lower(text || CASE turn % 3 WHEN 0 THEN ' Sanitize input' WHEN 1 THEN ' this allows, if so' ELSE ' this enables' END) AS t FROM conversations),
y AS (SELECT *, list_bool_or([contains(t, p) FOR p IN ['validate user input', 'validate all input', 'consider using safer apis', 'be careful with authentication', 'ensure proper synchronization', 'avoid logging sensitive data', 'follow security best practices', 'sanitize input', 'use proper error handling']]) AS g,
  list_bool_or([contains(t, p) FOR p IN ['this allows', 'this is vulnerable to', 'confirmed vulnerability', 'definitely exploitable', 'this enables']]) AS a, list_bool_or([contains(t, p) FOR p IN ['if ', 'may ', 'could ', 'verify', 'assuming', 'depends on', 'unclear']]) AS h, role <> 'system' AS low FROM x)
SELECT count(*) AS scored, count(*) FILTER (g) / count(*) AS generic_rate, count(*) FILTER (low AND a AND NOT h) / count(*) FILTER (low) AS overclaim_rate, count(*) FILTER (low) AS n_low FROM y""",
    "truth_errors": "WITH x AS (SELECT * FROM documents JOIN labels USING (doc_id)) SELECT doc_id, 'too_short' AS error FROM x WHERE n_chars < 100 UNION ALL SELECT doc_id, 'toxic_and_good' FROM x WHERE toxic = 1 AND quality = 1 UNION ALL SELECT doc_id, 'untrusted_source' FROM x WHERE source IN ('src0', 'src1')",
    "hallucinations": "WITH f AS (SELECT doc_id AS file, len(string_split(text, chr(10))) AS n FROM documents), c AS (SELECT o_orderkey, o_custkey AS file, o_orderkey % 9 AS s, o_orderkey % 7 + 2 AS e FROM orders) SELECT o_orderkey, CASE WHEN n IS NULL THEN 'file_absent' WHEN e > n THEN 'past_end' WHEN s < 1 OR e < s THEN 'bad_range' ELSE 'supported' END AS reason FROM c LEFT JOIN (SELECT file, n FROM f) USING (file)",
    "efficiency": f"WITH {OUT} SELECT count(*) AS provider_calls, sum(n_chars)::BIGINT AS chars, sum(n_chars)::BIGINT / count(*) FILTER (outcome = 'true_positive') AS chars_per_hit, count(*) / count(*) FILTER (outcome = 'true_positive') AS calls_per_hit FROM o JOIN documents USING (doc_id)",
}
