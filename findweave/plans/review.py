"""Review and publication: candidates, context, proposal funnel, publication plan.

Surrogates: line items are proposals of an order, parts their rules, documents responses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.functions import ranks
from findweave.functions.text import estimated_tokens, redacted, secret_counts
from findweave.operators import intervals as iv
from findweave.operators.ranking import capped, partition_ranked, suppress_overlaps
from findweave.sources import reports


def publication_order(prefix: str = "") -> list[Column]:
    """Worst and surest first, then by place and id."""
    return [F.desc(f"{prefix}severity_rank"), F.desc(f"{prefix}confidence_rank"), F.col(f"{prefix}path"), F.col(f"{prefix}line"), F.col(f"{prefix}id")]


def review_candidates(added: DataFrame, symbols: DataFrame, findings: DataFrame, reach: int = 60, limit: int | None = None) -> DataFrame:
    """Added lines as review candidates: the innermost symbol around them, else regions of a module.

    ``added``: path, line; ``symbols``: path, id, start, end; ``findings``: path, id, start, end.
    Candidates that static findings touch come first, then those with most changed lines.
    """
    points = added.select("path", "line", F.concat_ws(":", "path", "line").alias("point"))
    inside = iv.innermost(points, symbols, ["path"], "point", "line", "id", "start", "end")
    by_symbol = inside.where("innermost_id IS NOT NULL").groupBy("path", F.col("innermost_id").cast("string").alias("symbol")).agg(F.sort_array(F.collect_set("line")).alias("lines"))
    spans = symbols.select("path", F.col("id").cast("string").alias("symbol"), F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))
    by_symbol = by_symbol.join(spans, ["path", "symbol"]).select("path", "symbol", "first", "last", F.size("lines").cast("long").alias("n_lines"))
    regions = iv.anchored_clusters(inside.where("innermost_id IS NULL"), ["path"], "line", reach).select("path", F.lit(None).cast("string").alias("symbol"), "first", "last", F.col("n").alias("n_lines"))
    all_ = by_symbol.unionByName(regions).withColumn("candidate", F.concat_ws(":", "path", F.coalesce("symbol", F.lit("")), "first"))
    found = findings.select("path", "id", F.col("start").alias("first"), F.col("end").alias("last"))
    out = iv.attached(all_, found, ["path"], "candidate", "id", "first", "last", "static_findings")
    ordered = out.orderBy(F.desc(F.size("static_findings") > 0), F.desc("n_lines"), "path", "first", "last")
    return ordered.limit(limit) if limit is not None else ordered


def context_items(candidates: DataFrame, target: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Scored candidates in rank order with duplicates and overlaps marked; ``ties`` settle equal places."""
    order = list(ranks.RELATIONSHIPS)
    s = ranks.relationship_score(F.col("relationship"), F.col("same_file"), F.col("changed"), F.col("distance"), F.col("category"))
    scored = candidates.withColumn("s", s).withColumn("score", F.col("s.score")).withColumn("priority", ranks.rank(F.col("relationship"), tuple(order))).drop("s")
    by = Window.partitionBy(*target).orderBy(F.desc("score"), "priority", "file", "start", F.coalesce(F.col("symbol"), F.lit("")), *ties)
    return suppress_overlaps(scored.withColumn("ord", F.row_number().over(by)), target)


def proposal_funnel(proposals: DataFrame, verdicts: DataFrame, minimum: str) -> DataFrame:
    """Proposals with ``status``: the first gate that stops them, or accepted.

    ``proposals``: id, path, category, start, end, severity, confidence, title, rejection,
    corroborated; ``verdicts``: id, decision, lowered_severity, lowered_confidence (none where the
    critic failed).
    """
    c = F.col
    j = proposals.join(verdicts, "id", "left")
    final_severity = F.when(c("decision") == "downgrade", F.coalesce("lowered_severity", "severity")).otherwise(c("severity"))
    final_confidence = ranks.settled_confidence(c("confidence"), F.coalesce("decision", F.lit("none")), c("lowered_confidence"), c("corroborated"))
    j = j.withColumn("final_severity", final_severity).withColumn("final_confidence", final_confidence)
    gate = F.when(c("rejection").isNotNull(), F.lit("rejected_validation")).when(c("decision") == "reject", F.lit("rejected_critic")).when(~ranks.at_least(c("final_confidence"), minimum, ranks.CONFIDENCES), F.lit("rejected_low_confidence"))
    j = j.withColumn("gate", gate)
    order = [c("start"), -ranks.rank(c("final_severity"), ranks.SEVERITIES), -ranks.rank(c("final_confidence"), ranks.CONFIDENCES), c("title"), c("id")]
    kept = iv.greedy_disjoint(j.where("gate IS NULL"), ["path", "category"], order, "start", "end", ["id"]).select("id", F.lit(True).alias("kept"))
    return j.join(kept, "id", "left").withColumn("status", F.coalesce("gate", F.when(c("kept"), F.lit("accepted")).otherwise(F.lit("suppressed_duplicate")))).drop("gate", "kept")


def publication_gate(runs: DataFrame) -> DataFrame:
    """Runs with ``gate``: stale head, nothing to say, already published, in progress elsewhere, reconcile, or new."""
    c = F.col
    recent = F.coalesce(c("last_status") == "publishing", F.lit(False)) & (F.unix_timestamp(c("now").cast("timestamp")) - F.unix_timestamp(c("last_at").cast("timestamp")) < 300)
    gate = (
        F.when(c("last_status") == "published", F.lit("already_published")).when(recent, F.lit("in_progress_elsewhere")).when(c("last_status") == "publishing", F.lit("reconcile_needed"))
        .when(c("head") != c("reviewed_head"), F.lit("stale")).when(c("n_findings") == 0, F.lit("skipped")).otherwise(F.lit("new"))
    )
    return runs.withColumn("gate", gate)


def review_status(results: DataFrame, key: str) -> DataFrame:
    """Per run: failed if nothing was reviewed and something failed, partial if some failed."""
    ok, bad = F.count_if(F.col("status") == "reviewed"), F.count_if(F.col("status") == "failed")
    return results.groupBy(key).agg(ok.alias("reviewed"), bad.alias("failed")).withColumn("run_status", F.when((F.col("reviewed") == 0) & (F.col("failed") > 0), F.lit("failed")).when(F.col("failed") > 0, F.lit("partial")).otherwise(F.lit("succeeded")))


# queries over the driver's tables


def _proposals(spark, d) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    c = F.col
    sev = ranks.at_rank((c("l_quantity").cast("long") % 5).cast("int"), ranks.SEVERITIES)
    conf = ranks.at_rank((c("l_partkey") % 3).cast("int"), ranks.CONFIDENCES)
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), c("l_orderkey").alias("path"), c("l_returnflag").alias("category"), (c("l_linenumber").cast("long") * 3).alias("start"), (c("l_linenumber").cast("long") * 3 + c("l_quantity").cast("long") % 7).alias("end"),
        sev.alias("severity"), conf.alias("confidence"), c("l_linestatus").alias("title"), F.when(c("l_suppkey") % 9 == 0, F.lit("no_evidence")).alias("rejection"), (c("l_suppkey") % 4 == 0).alias("corroborated"), c("l_suppkey").alias("k"),
    )


def validation_funnel(spark, d):
    p = _proposals(spark, d)
    verdicts = p.where("k % 2 = 0").select("id", F.when(F.col("k") % 5 == 0, F.lit("reject")).when(F.col("k") % 3 == 0, F.lit("downgrade")).otherwise(F.lit("accept")).alias("decision"), F.lit("low").alias("lowered_severity"), F.when(F.col("k") % 12 == 0, F.lit("low")).otherwise(F.lit("medium")).alias("lowered_confidence"))
    return proposal_funnel(p, verdicts, "medium").select("id", "final_confidence", "status")


def publication(spark, d):
    p = _proposals(spark, d).withColumn("severity_rank", ranks.rank(F.col("severity"), ranks.SEVERITIES)).withColumn("confidence_rank", ranks.rank(F.col("confidence"), ranks.CONFIDENCES)).withColumn("line", F.col("start"))
    return partition_ranked(p, ["path"], publication_order(), F.col("k") % 3 != 0, 2, 2, F.col("k") % 10 == 0).select("id", "disposition")


def score_rank(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    c = F.col
    names = list(ranks.RELATIONSHIPS)
    relation = F.get(F.array(*map(F.lit, names)), (c("l_partkey") % 10).cast("int"))
    category = F.get(F.array(*map(F.lit, [*ranks.FAVOURED, "style"])), (c("l_suppkey") % 6).cast("int"))
    s = ranks.relationship_score(relation, c("l_linenumber") % 2 == 0, c("l_quantity") > 25, c("l_linenumber"), category)
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), c("l_orderkey").alias("target"), s["score"].alias("score"), (c("l_partkey") % 10).alias("priority"))
    return capped(rows, ["target"], [F.desc("score"), c("priority"), c("id")], 3).select("target", "id", "score")


def redact_secrets(spark, d):
    """Texts with one of the six shapes (or near misses) behind them: what is left, and how often each shape was found."""
    k = F.col("doc_id")
    body = lambda n: F.substring(F.md5(k.cast("string").cast("binary")), 1, n)
    planted = F.concat(
        F.lit("\n"),
        F.when(k % 8 == 0, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), body(32), F.lit("\n-----END RSA PRIVATE KEY-----"))).when(k % 8 == 1, F.concat(F.lit("ghp_"), body(24))).when(k % 8 == 2, F.concat(F.lit("AKIA"), F.upper(body(16))))
        .when(k % 8 == 3, F.concat(F.lit("aws_secret_access_key = '"), body(32), F.lit("/+ABcd01'"))).when(k % 8 == 4, F.concat(F.lit("xoxb-"), body(12), F.lit("-"), body(12)))
        .when(k % 8 == 5, F.concat(F.lit('DB_PASSWORD: "'), body(20), F.lit('"'))).when(k % 8 == 6, F.concat(F.lit("ghp_"), body(12), F.lit(" AKIA"), body(8), F.lit(" xoxb-"), body(4), F.lit(' PASSWORD = "'), body(8), F.lit('"')))
        .otherwise(F.lit("nothing here")),
        F.lit("\nend"),
    )
    text = F.concat("text", planted)
    counts = secret_counts(text)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(redacted(text).cast("binary")).alias("digest"), *[n.cast("long").alias(name) for name, n in counts.items()])


def token_estimates(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("lang").agg(F.sum(estimated_tokens(F.col("n_chars"))).alias("tokens"))


def ruff_findings(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    code = F.when(F.col("p_partkey") % 10 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), F.get(F.array(*[F.lit(x) for x in ("F401", "S105", "E722", "UP006")]), (F.col("p_partkey") % 4).cast("int")), F.lit('"')))
    report = F.concat(F.lit('[{"code": '), code, F.lit(', "filename": "a.py", "message": "m", "name": "n", "location": {"row": '), F.col("p_size").cast("string"), F.lit(', "column": 1}, "end_location": {"row": '), (F.col("p_size") + 1).cast("string"), F.lit(', "column": 9}}]'))
    return reports.ruff(p.select(F.col("p_partkey").alias("run_id"), report.alias("report"))).select("run_id", "rule_id", "category", "severity", "start_line", "end_line")


def clang_findings(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    report = F.concat(F.lit("src/a.c:"), F.col("p_size").cast("string"), F.lit(":7: warning: use after move [bugprone-use-after-move]\n  x = y;\n  ^\nsrc/a.c:9:1: note: here\nsrc/b.c:3:2: error: broken"))
    return reports.clang_tidy(p.select(F.col("p_partkey").alias("run_id"), report.alias("report"))).select("run_id", "rule_id", "category", "severity", "file_path", "start_line", "message")


def run_statuses(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 500).alias("run"), F.when(F.col("o_orderstatus") == "F", F.lit("failed")).when(F.col("o_orderkey") % 3 == 0, F.lit("skipped")).otherwise(F.lit("reviewed")).alias("status"))
    return review_status(o, "run")


def gates(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = F.col
    runs = o.select(
        "o_orderkey", F.when(c("o_orderkey") % 4 == 0, F.lit("published")).when(c("o_orderkey") % 4 == 1, F.lit("publishing")).alias("last_status"), c("o_orderdate").alias("last_at"),
        (c("o_orderdate") + F.expr("make_dt_interval(0, 0, cast(o_custkey % 10 as int), 0)")).alias("now"), (c("o_custkey") % 3).alias("head"), F.lit(1).alias("reviewed_head"), (c("o_custkey") % 5).alias("n_findings"),
    )
    return publication_gate(runs).select("o_orderkey", "gate")


QUERIES = {
    "validation_funnel": validation_funnel, "publication_partition": publication, "score_rank": score_rank, "redact_secrets": redact_secrets, "token_estimates": token_estimates, "ruff_findings": ruff_findings, "clang_findings": clang_findings,
    "run_statuses": run_statuses, "publication_gates": gates,
}

_P = """p AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS path, l_returnflag AS category, l_linenumber::BIGINT * 3 AS s, l_linenumber::BIGINT * 3 + l_quantity::BIGINT % 7 AS e, l_quantity::BIGINT % 5 AS sev, l_partkey % 3 AS conf, l_linestatus AS title, l_suppkey AS k FROM lineitem)"""
ORACLES = {
    "validation_funnel": f"""WITH RECURSIVE {_P}, v AS (SELECT *, CASE WHEN k % 2 <> 0 THEN NULL WHEN k % 5 = 0 THEN 'reject' WHEN k % 3 = 0 THEN 'downgrade' ELSE 'accept' END AS dec FROM p),
f AS (SELECT *, CASE WHEN dec = 'downgrade' THEN 1 ELSE sev END AS fs, CASE WHEN dec = 'downgrade' THEN CASE WHEN k % 12 = 0 THEN 0 ELSE 1 END WHEN k % 4 = 0 THEN least(conf + 1, 2) ELSE conf END AS fc FROM (SELECT * REPLACE (sev AS sev) FROM v)),
g AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'rejected_validation' WHEN dec = 'reject' THEN 'rejected_critic' WHEN fc < 1 THEN 'rejected_low_confidence' END AS gate FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY path, category ORDER BY s, -fs, -fc, title, id) AS r FROM g WHERE gate IS NULL),
w AS (SELECT path, category, id, r, true AS kept, e AS last FROM o WHERE r = 1 UNION ALL SELECT o.path, o.category, o.id, o.r, o.s > w.last, CASE WHEN o.s > w.last THEN o.e ELSE w.last END FROM w JOIN o ON o.path = w.path AND o.category = w.category AND o.r = w.r + 1)
SELECT g.id, ['low', 'medium', 'high'][fc + 1] AS final_confidence, coalesce(gate, CASE WHEN kept THEN 'accepted' ELSE 'suppressed_duplicate' END) AS status FROM g LEFT JOIN w ON w.id = g.id""",
    "publication_partition": f"""WITH {_P}, a AS (SELECT *, k % 10 = 0 AS kn, k % 3 <> 0 AS mp FROM p), b AS (SELECT *, mp AND NOT kn AND row_number() OVER (PARTITION BY path, kn, mp ORDER BY sev DESC, conf DESC, path, s, id) <= 2 AS inl FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY path, kn, inl ORDER BY sev DESC, conf DESC, path, s, id) AS r FROM b) SELECT id, CASE WHEN kn THEN 'already_reported' WHEN inl THEN 'inline' WHEN r <= 2 THEN 'summary' ELSE 'omitted' END AS disposition FROM c""",
    "score_rank": """WITH x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS target, l_partkey % 10 AS pr, l_suppkey % 6 AS cat, l_linenumber AS ln, l_quantity AS q FROM lineitem),
y AS (SELECT id, target, pr, greatest(0, round([1.0, 0.55, 0.5, 0.5, 0.45, 0.3, 0.3, 0.2, 0.25, 0.25][pr + 1]::DOUBLE + CASE WHEN ln % 2 = 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN q > 25 THEN 0.15 ELSE 0 END::DOUBLE - CASE WHEN ln > 1 THEN 0.05::DOUBLE * (ln - 1) ELSE 0 END
  + CASE WHEN (cat <= 2 AND pr IN (2, 3)) OR (cat = 3 AND pr IN (3, 5, 6)) OR (cat = 4 AND pr = 1) THEN 0.08 ELSE 0 END::DOUBLE, 6)) AS score FROM x)
SELECT target, id, score FROM y QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, pr, id) <= 3""",
    # no text holds a shape before the planted one, so what is left and the counts follow from the ids
    "redact_secrets": """WITH p AS (SELECT doc_id, text, doc_id % 8 AS k, md5(doc_id::VARCHAR) AS m FROM documents)
SELECT doc_id, md5(text || chr(10) || CASE WHEN k IN (0, 1, 2, 4) THEN '[REDACTED]' WHEN k = 3 THEN 'aws_secret_access_key = ' || chr(39) || '[REDACTED]' || chr(39) WHEN k = 5 THEN 'DB_PASSWORD: "[REDACTED]"'
  WHEN k = 6 THEN 'ghp_' || left(m, 12) || ' AKIA' || left(m, 8) || ' xoxb-' || left(m, 4) || ' PASSWORD = "' || left(m, 8) || '"' ELSE 'nothing here' END || chr(10) || 'end') AS digest,
  (k = 0)::BIGINT AS pem_private_key, (k = 1)::BIGINT AS github_token, (k = 2)::BIGINT AS aws_access_key_id, (k = 3)::BIGINT AS aws_secret_access_key, (k = 4)::BIGINT AS slack_token, (k = 5)::BIGINT AS labeled_secret_assignment FROM p""",
    "token_estimates": "SELECT lang, sum((n_chars + 3) // 4)::BIGINT AS tokens FROM documents GROUP BY 1",
    "ruff_findings": "SELECT p_partkey AS run_id, ['F401', 'S105', 'E722', 'UP006'][p_partkey % 4 + 1] AS rule_id, ['correctness', 'security', 'correctness', 'maintainability'][p_partkey % 4 + 1] AS category, ['medium', 'high', 'medium', 'low'][p_partkey % 4 + 1] AS severity, p_size AS start_line, p_size + 1 AS end_line FROM part WHERE p_partkey % 10 <> 0",
    "clang_findings": "SELECT p_partkey AS run_id, unnest(['bugprone-use-after-move', 'clang-tidy']) AS rule_id, unnest(['memory_safety', 'unknown']) AS category, unnest(['medium', 'high']) AS severity, unnest(['src/a.c', 'src/b.c']) AS file_path, unnest([p_size, 3])::INT AS start_line, unnest(['use after move', 'broken']) AS message FROM part",
    "run_statuses": "WITH x AS (SELECT o_custkey % 500 AS run, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 3 <> 0) AS reviewed, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1) SELECT *, CASE WHEN reviewed = 0 AND failed > 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'succeeded' END AS run_status FROM x",
    "publication_gates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'already_published' WHEN o_orderkey % 4 = 1 AND o_custkey % 10 < 5 THEN 'in_progress_elsewhere' WHEN o_orderkey % 4 = 1 THEN 'reconcile_needed' WHEN o_custkey % 3 <> 1 THEN 'stale' WHEN o_custkey % 5 = 0 THEN 'skipped' ELSE 'new' END AS gate FROM orders",
}
