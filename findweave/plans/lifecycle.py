"""Snapshot, resolution and state queries. Surrogates: documents are symbols (language the file,
source the name, id band the kind), customers and suppliers are callers and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.functions.text import fingerprint, module_of, safe_relative_path, squeezed
from findweave.operators import dedupe, lifecycle, matching
from findweave.operators import snapshots as snap
from findweave.operators.ranking import admit


def symbols(spark, d: str, current: bool) -> DataFrame:
    """One snapshot: by their lengths, some documents were added and some deleted; every fifth changed its name, every seventh its text, every eleventh its file."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("n_chars % 13 <> 0" if current else "n_chars % 17 <> 0")
    c = F.col("doc_id")
    path, name = F.concat(F.col("lang"), (c % 40).cast("string")), F.concat_ws("_", "source", c.cast("string"))
    if current:
        path = F.when(c % 11 == 0, F.concat(F.lit("moved/"), path)).otherwise(path)
        name = F.when(c % 5 == 0, F.concat(name, F.lit("_new"))).otherwise(name)
    body = F.concat("text", F.when(F.lit(current) & (c % 7 == 0), F.lit("!")).otherwise(F.lit("")))
    return docs.select(c.alias("id"), path.alias("path"), name.alias("name"), (c % 3).cast("string").alias("kind"), F.md5(body.cast("binary")).alias("hash"))


SYMBOLS = """
d AS (SELECT *, lang || (doc_id % 40) AS path, source || '_' || doc_id AS name, (doc_id % 3)::VARCHAR AS kind FROM documents),
p AS (SELECT doc_id AS id, path, name, kind, md5(text) AS hash FROM d WHERE n_chars % 17 <> 0),
c AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'moved/' ELSE '' END || path AS path, name || CASE WHEN doc_id % 5 = 0 THEN '_new' ELSE '' END AS name, kind, md5(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS hash FROM d WHERE n_chars % 13 <> 0),
sm AS (SELECT p.id AS prev_id, c.id AS cur_id, CASE WHEN p.hash = c.hash THEN 'unchanged' ELSE 'modified' END AS status FROM p JOIN c USING (path, name, kind)),
rp AS (SELECT *, row_number() OVER (PARTITION BY hash, kind ORDER BY path, name, id) AS turn FROM p WHERE id NOT IN (SELECT prev_id FROM sm)), rc AS (SELECT * FROM c WHERE id NOT IN (SELECT cur_id FROM sm)),
po AS (SELECT hash, kind, count(*) AS n, min(id) AS cid, min(name) AS cname FROM rc GROUP BY 1, 2),
hs AS (SELECT rp.id AS prev_id, CASE WHEN n = 1 AND turn = 1 THEN cid END AS cur_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND turn = 1 THEN CASE WHEN name = cname THEN 'moved' ELSE 'renamed' END ELSE 'deleted' END AS status FROM rp LEFT JOIN po USING (hash, kind)),
ct AS (SELECT * FROM sm UNION ALL SELECT * FROM hs UNION ALL SELECT NULL, id, 'added' FROM rc WHERE id NOT IN (SELECT cur_id FROM hs WHERE cur_id IS NOT NULL))"""


def continuity(spark, d):
    return snap.continuity(symbols(spark, d, False), symbols(spark, d, True))


def reconcile(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    c = F.col("doc_id")
    severity = F.get(F.array(*map(F.lit, ("low", "medium", "high"))), (c % 3).cast("int"))
    memory = docs.select(c.alias("symbol_id"), (c % 4 != 0).alias("evidence_holds"), F.col("lang").alias("category"), severity.alias("severity"), F.col("text").alias("message"))
    prior = snap.before_review(memory, continuity(spark, d)).withColumn("subject", F.col("symbol_id"))
    current = docs.select(c.alias("id"), c.alias("subject"), F.col("lang").alias("category"), F.when(c % 5 == 0, F.lit("critical")).otherwise(severity).alias("severity"), F.col("text").alias("message"))
    return snap.after_review(prior, current).select("symbol_id", "disposition", "reason", "state")


def supersede(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return snap.newest_of_family(docs.select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], "n_chars", "doc_id").select("doc_id", "superseded_by", "state")


def versions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 97).alias("repo"), "o_orderkey", (F.col("o_orderstatus") == "O").alias("ok"))
    return snap.active_version(o, "repo", "o_orderkey", "ok")


def cache_misses(spark, d):
    key = lambda df: df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), "lang", F.lit(1).alias("parser"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return matching.insert_if_absent(key(docs), key(docs.where("doc_id % 3 = 0")), ["hash", "lang", "parser"], [F.col("doc_id")]).select("doc_id", "hash")


def attribution(spark, d):
    """Comments and publications matched on a body hash and side that are unique on both sides."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    c = F.col("doc_id")
    side = lambda by: F.when(by % 5 != 0, F.col("lang"))
    left = docs.select(c.alias("comment_id"), F.md5(F.col("text").cast("binary")).alias("hash"), side(c).alias("side"))
    right = docs.select(c.alias("publication_id"), F.md5(F.col("text").cast("binary")).alias("r_hash"), side(F.col("n_chars")).alias("r_side"))
    return matching.unique_on_both(left, right, [("hash", "r_hash"), ("side", "r_side")], ["hash"]).select("comment_id", "publication_id")


def resolution(spark, d):
    """Customers to suppliers: unique in the nation with equal key modulo 7, else unique in the region."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    cust = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("m"), (F.col("c_custkey") % 29).alias("mm")).join(nation, "nation")
    sup = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("m"), (F.col("s_suppkey") % 29).alias("mm")).join(nation, "nation")
    return matching.resolve_in_tiers(cust, "c_custkey", [("nation", sup, ["nation", "m"], "s_suppkey"), ("region", sup, ["region", "mm"], "s_suppkey")]).select("c_custkey", "resolved", "tier", "status")


def suffixes(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return matching.unique_suffix(p, "path", "page_id")


def evidence(spark, d):
    """Is a document's evidence (a benchmark passage or its own words) still in its text?"""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("passage"))
    j = docs.withColumn("item_id", F.col("doc_id") % max(1, items.count())).join(items, "item_id", "left")
    quotes = F.array(F.when(F.col("doc_id") % 2 == 0, F.coalesce("passage", F.lit(""))).otherwise(F.substring("text", 3, 30)))
    content = squeezed(F.col("text"))
    holds = (F.size(quotes) > 0) & F.forall(quotes, lambda q: F.contains(content, squeezed(q)))
    return j.select("doc_id", holds.alias("holds"))


def fingerprints(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", fingerprint(F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), F.col("o_orderpriority")).alias("fingerprint"))


def module_paths(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    path = F.concat(F.lit("src/"), F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("/__init__.py")).otherwise(F.lit(".py")))
    return n.select("n_nationkey", module_of(path).alias("module"), safe_relative_path(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("a/../"), path)).otherwise(path)).alias("safe"))


def budget_admission(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang", "doc_id", F.floor((F.col("n_chars") + 3) / 4).cast("long").alias("tokens"))
    return admit(docs, ["lang"], ["doc_id"], "tokens", 20_000, ["doc_id"]).select("doc_id", "admitted", "used")


QUERIES = {
    "snapshot_continuity": continuity, "lifecycle_reconcile": reconcile, "supersede_latest_family": supersede, "latest_version_activation": versions, "cache_miss_anti": cache_misses, "attribution_unique_both": attribution,
    "tiered_resolution": resolution, "path_suffix_unique": suffixes, "evidence_revalidate": evidence, "fingerprints": fingerprints, "module_paths": module_paths, "budget_admission": budget_admission,
}

ORACLES = {
    "snapshot_continuity": f"WITH {SYMBOLS} SELECT * FROM ct",
    "lifecycle_reconcile": f"""WITH {SYMBOLS}, me AS (SELECT doc_id AS symbol_id, doc_id % 4 <> 0 AS ev, lang AS category, ['low', 'medium', 'high'][doc_id % 3 + 1] AS sev, text AS message FROM documents),
b AS (SELECT me.*, status, CASE WHEN status = 'deleted' THEN 'resolved' WHEN status IN ('unchanged', 'moved', 'renamed') AND ev THEN 'carry_forward' ELSE 'recheck' END AS disposition, CASE WHEN status IS NULL THEN 'no_continuity' WHEN status IN ('unchanged', 'moved', 'renamed') AND NOT ev THEN 'evidence_lost' ELSE 'symbol_' || status END AS reason FROM me LEFT JOIN ct ON prev_id = symbol_id),
n AS (SELECT doc_id AS subject, lang AS category, CASE WHEN doc_id % 5 = 0 THEN 'critical' ELSE ['low', 'medium', 'high'][doc_id % 3 + 1] END AS sev, text AS message FROM documents)
SELECT symbol_id, disposition, reason, CASE WHEN disposition = 'resolved' THEN 'resolved' WHEN n.subject IS NULL THEN CASE WHEN disposition = 'carry_forward' THEN 'carried_forward' ELSE 'resolved' END WHEN n.sev = b.sev AND n.message = b.message THEN 'carried_forward' ELSE 'changed' END AS state
FROM b LEFT JOIN n ON subject = symbol_id AND n.category = b.category""",
    "supersede_latest_family": "WITH x AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS superseded_by FROM documents) SELECT *, CASE WHEN superseded_by IS NULL THEN 'live' ELSE 'superseded' END AS state FROM x",
    "latest_version_activation": "SELECT o_custkey % 97 AS repo, max(o_orderkey) FILTER (o_orderstatus = 'O') AS active_version, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY 1",
    "cache_miss_anti": "WITH k AS (SELECT doc_id, md5(text) AS hash, lang FROM documents) SELECT min(doc_id) AS doc_id, hash FROM k WHERE (hash, lang) NOT IN (SELECT hash, lang FROM k WHERE doc_id % 3 = 0) GROUP BY hash, lang",
    "attribution_unique_both": """WITH l AS (SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % 5 <> 0 THEN lang END AS s FROM documents QUALIFY count(*) OVER (PARTITION BY h, s) = 1), r AS (SELECT doc_id, md5(text) AS h, CASE WHEN n_chars % 5 <> 0 THEN lang END AS s FROM documents QUALIFY count(*) OVER (PARTITION BY h, s) = 1)
SELECT l.doc_id AS comment_id, r.doc_id AS publication_id FROM l JOIN r ON l.h = r.h AND l.s IS NOT DISTINCT FROM r.s""",
    "tiered_resolution": """WITH c AS (SELECT *, c_custkey % 7 AS m, c_custkey % 29 AS mm FROM customer JOIN nation ON n_nationkey = c_nationkey), s AS (SELECT *, s_suppkey % 7 AS m, s_suppkey % 29 AS mm FROM supplier JOIN nation ON n_nationkey = s_nationkey),
a AS (SELECT s_nationkey AS nk, m, count(*) AS n, min(s_suppkey) AS id FROM s GROUP BY 1, 2), b AS (SELECT n_regionkey AS rk, mm, count(*) AS n, min(s_suppkey) AS id FROM s GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN a.n IS NOT NULL THEN CASE WHEN a.n = 1 THEN a.id END WHEN b.n = 1 THEN b.id END AS resolved, CASE WHEN a.n IS NOT NULL THEN 'nation' WHEN b.n IS NOT NULL THEN 'region' END AS tier,
  CASE WHEN a.n = 1 THEN 'resolved' WHEN a.n > 1 THEN 'ambiguous' WHEN b.n = 1 THEN 'resolved' WHEN b.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
FROM c LEFT JOIN a ON a.nk = c_nationkey AND a.m = c.m LEFT JOIN b ON b.rk = n_regionkey AND b.mm = c.mm""",
    "path_suffix_unique": r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS w FROM pages), s AS (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS n FROM p), x AS (SELECT page_id, array_to_string(w[len(w) - n + 1:], '/') AS suffix FROM s)
SELECT suffix, min(page_id) AS page_id FROM x GROUP BY 1 HAVING count(DISTINCT page_id) = 1""",
    "evidence_revalidate": r"""WITH j AS (SELECT d.doc_id, d.text AS t, coalesce(b.text, '') AS b FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)), q AS (SELECT doc_id, t, CASE WHEN doc_id % 2 = 0 THEN b ELSE substr(t, 3, 30) END AS q FROM j)
SELECT doc_id, contains(trim(regexp_replace(t, '\s+', ' ', 'g')), trim(regexp_replace(q, '\s+', ' ', 'g'))) AS holds FROM q""",
    "fingerprints": "SELECT o_orderkey, sha256(o_custkey || chr(31) || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE '' END || chr(31) || o_orderpriority) AS fingerprint FROM orders",
    "module_paths": "SELECT n_nationkey, 'src.' || lower(n_name) AS module, n_nationkey % 3 <> 0 AS safe FROM nation",
    "budget_admission": """WITH RECURSIVE o AS (SELECT lang, doc_id, (n_chars + 3) // 4 AS tokens, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
w AS (SELECT lang, doc_id, r, tokens <= 20000 AS admitted, CASE WHEN tokens <= 20000 THEN tokens ELSE 0 END AS used FROM o WHERE r = 1 UNION ALL SELECT o.lang, o.doc_id, o.r, w.used + o.tokens <= 20000, CASE WHEN w.used + o.tokens <= 20000 THEN w.used + o.tokens ELSE w.used END FROM w JOIN o ON o.lang = w.lang AND o.r = w.r + 1)
SELECT doc_id, admitted, used FROM w""",
}


def _findings(spark, d) -> DataFrame:
    """Line items as analyzer findings: the order is the file, the line status the analyzer."""
    from findweave.plans.review import _proposals

    p = _proposals(spark, d)
    return p.select("id", F.col("path").alias("file_path"), "category", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.col("title").alias("source_analyzer"), (F.col("k") % 2).cast("string").alias("rule_id"), F.when(F.col("k") % 3 == 0, F.col("k") % 2).alias("symbol_id"), "severity", "confidence")


def finding_pairs(spark, d):
    return dedupe.duplicate_pairs(_findings(spark, d))


def finding_groups(spark, d):
    return dedupe.merge(_findings(spark, d)).groupBy("is_primary").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"))


def generation_gates(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = F.col("o_orderkey")
    runs = o.select(c.alias("id"), F.when(c % 5 != 0, c).alias("previous_id"), F.when(c % 7 == 0, F.lit("failed")).otherwise(F.lit("succeeded")).alias("previous_status"), F.when(c % 3 == 0, F.lit(True)).when(c % 3 == 1, F.lit(False)).alias("ancestry"), F.lit("a").alias("fingerprint"), F.when(c % 2 == 0, F.lit("a")).alias("previous_fingerprint"))
    return lifecycle.generation_gate(runs).groupBy("mode").agg(F.count("*").alias("n"))


def analysis_statuses(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 4000).alias("run"), F.when(F.col("l_returnflag") == "R", F.lit("failed")).when(F.col("l_returnflag") == "A", F.lit("succeeded")).otherwise(F.lit("skipped")).alias("status"), F.col("l_linenumber").cast("long").alias("raw_findings_count"))
    return lifecycle.analysis_status(li, "run")


QUERIES |= {"finding_pairs": finding_pairs, "finding_groups": finding_groups, "generation_gates": generation_gates, "analysis_statuses": analysis_statuses}
_FINDINGS = """f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS fp, l_returnflag AS cat, l_linenumber::BIGINT * 3 AS s, l_linenumber::BIGINT * 3 + l_quantity::BIGINT % 7 AS e, l_linestatus AS an, l_suppkey % 2 AS ru, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 2 END AS sy, l_quantity::BIGINT % 5 AS sev, l_partkey % 3 AS conf FROM lineitem),
p AS (SELECT a.id AS a_id, b.id AS b_id FROM f a JOIN f b ON a.fp = b.fp AND a.cat = b.cat AND a.id < b.id AND a.s <= b.e AND b.s <= a.e AND NOT (a.an = b.an AND a.ru <> b.ru) AND NOT coalesce(a.sy <> b.sy, false))"""
ORACLES |= {
    "finding_pairs": f"WITH {_FINDINGS} SELECT * FROM p",
    "finding_groups": f"""WITH RECURSIVE {_FINDINGS}, b AS (SELECT a_id AS x, b_id AS y FROM p UNION SELECT b_id, a_id FROM p), w AS (SELECT DISTINCT x, x AS r FROM b UNION SELECT b.y, w.r FROM w JOIN b ON b.x = w.x), g AS (SELECT x, min(r) AS root FROM w GROUP BY 1),
n AS (SELECT f.id, coalesce(root, f.id) AS root FROM f LEFT JOIN g ON g.x = f.id), t AS (SELECT count(DISTINCT root) AS g, count(*) AS n FROM n), q AS (SELECT count(DISTINCT root) AS m FROM (SELECT root FROM n GROUP BY 1 HAVING count(*) > 1))
SELECT true AS is_primary, g AS n, g AS n_groups FROM t UNION ALL SELECT false, t.n - g, m FROM t, q""",
    "generation_gates": "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'full_no_previous' WHEN o_orderkey % 7 = 0 THEN 'full_previous_not_succeeded' WHEN o_orderkey % 3 = 2 THEN 'full_ancestry_unverifiable' WHEN o_orderkey % 3 = 1 THEN 'full_not_an_ancestor' WHEN o_orderkey % 2 = 1 THEN 'memory_only' ELSE 'incremental' END AS mode, count(*) AS n FROM orders GROUP BY 1",
    "analysis_statuses": "WITH x AS (SELECT l_orderkey % 4000 AS run, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'A') AS succeeded, sum(l_linenumber)::BIGINT AS raw_findings FROM lineitem GROUP BY 1) SELECT *, CASE WHEN failed = 0 THEN 'succeeded' WHEN succeeded > 0 THEN 'partial' ELSE 'failed' END AS run_status FROM x",
}
