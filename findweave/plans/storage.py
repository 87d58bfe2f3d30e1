"""Queries that go through pages, manifests, run logs and the publication sink in the shared folder.

Surrogates: turns of conversations are reviews, orders are runs and parents, line items children.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from findweave.functions.evidence import evidence_json, parsed_evidence
from findweave.operators import parse_cache
from findweave.session import shared_path
from findweave.sources import drops, manifest, paged, publish, repository

c = F.col
#: Items of a page, as the polled API gives them.
PAGE_ITEMS = 100


def paged_reviews(spark, d):
    """Reviews read from pages; bots are left out."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    n_pages = F.lit(max(1, -(-turns.count() // PAGE_ITEMS)))
    state = F.when(c("turn") % 3 == 0, F.lit("approved")).when(c("turn") % 3 == 1, F.lit("commented"))
    items = turns.select(
        (F.pmod(F.xxhash64("conv_id", "turn", "text"), n_pages) + 1).alias("page"), c("conv_id").cast("long").alias("id"), state.alias("state"), c("text").alias("body"), c("role").alias("actor_login"),
        F.when(c("role") == "assistant", F.lit("Bot")).otherwise(F.lit("User")).alias("actor_type"), F.lit(None).cast("string").alias("commit_sha"), F.timestamp_seconds(c("turn") * 60).cast("string").alias("submitted_at"),
    )
    path = shared_path(spark, "pages")
    paged.write_pages(items, path, "page")
    _filled(spark, path, n_pages)
    return drops.human(paged.read_paged(spark, path, drops.SCHEMAS["reviews"])).select("id", "state", "body", "actor_login", F.unix_timestamp("submitted_at").alias("submitted"))


def _filled(spark, path: str, n_pages) -> None:
    """Pages that no item was dealt to are empty, not missing: a file without items stands for them."""
    numbers = spark.range(1).select(F.explode(F.sequence(F.lit(1).cast("long"), n_pages.cast("long"))).alias("page"))
    there = spark.read.schema("value string, page long").text(path).select("page").distinct()
    numbers.join(there, "page", "left_anti").select("page", F.lit("").alias("value")).write.mode("append").partitionBy("page").text(path)


def run_outcomes(spark, d):
    """Orders as attempts of a customer's run."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    day = F.datediff(c("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    status = F.when(c("o_orderstatus") == "F", F.lit("succeeded")).when(c("o_orderstatus") == "P", F.lit("partial")).otherwise(F.when(c("o_orderkey") % 2 == 0, F.lit("succeeded")).otherwise(F.lit("failed")))
    return manifest.settled_runs(o.select(c("o_custkey").alias("identity"), c("o_orderkey").alias("run"), day.alias("started"), (day + c("o_totalprice").cast("long") % 900).alias("finished"), status.alias("status")))


def committed_orders(spark, d):
    """Parents and children appended together by status; the writer of the last status fails before its entry."""
    orders, items = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    path = shared_path(spark, "together")
    for status in ("F", "O"):
        parents = orders.where(c("o_orderstatus") == status).select("o_orderkey", "o_custkey")
        children = items.join(parents.select(c("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")
        for _ in range(2):  # a repeated call changes nothing
            manifest.append_together({"parents": parents, "children": children}, path, status)
    orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey").write.parquet(f"{path}/parents/P-lost")
    kept = manifest.read_together(spark, path, "parents", "o_orderkey long, o_custkey long")
    of = manifest.read_together(spark, path, "children", "l_orderkey long, l_linenumber long, l_partkey long").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("children"), F.sum("l_partkey").alias("parts"))
    return kept.join(of, "o_orderkey", "left")


def published_orders(spark, d):
    """Orders published by priority, each plan twice."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    path = shared_path(spark, "published")
    for n in range(2):
        for plan in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"):
            publish.publish(orders.where(c("o_orderpriority") == plan).select(c("o_orderkey").alias("id"), (c("o_custkey") + n).alias("line")), path, plan)
    return publish.published(spark, path, "id long, line long")


def stored_evidence(spark, d):
    """Snippets read from documents' stored JSON: whole rows, broken ones, and rows that are partly usable; written and read again."""
    k = c("doc_id")
    id_ = k.cast("string")
    whole = F.concat(F.lit('{"file_path": "f'), id_, F.lit('", "start_line": '), id_, F.lit(', "end_line": "'), id_, F.lit(' ", "quoted_text": "a \\"q\\" é"}'))
    second = F.lit('{"file_path": "g", "start_line": 2.9, "end_line": true, "quoted_text": "", "more": [1]}')
    raw = (
        F.when(k % 9 == 0, F.concat(F.lit("["), whole, F.lit(", "), second, F.lit("]"))).when(k % 9 == 1, F.lit("{not json")).when(k % 9 == 2, whole).when(k % 9 == 3, F.concat(F.lit('[1, "x", null, ['), whole, F.lit("], "), whole, F.lit("]")))
        .when(k % 9 == 4, F.concat(F.lit('[{"file_path": "f"}, '), whole, F.lit("]"))).when(k % 9 == 5, F.concat(F.lit('[{"file_path": "f", "start_line": "1.5", "end_line": 2, "quoted_text": "q"}, '), second, F.lit("]")))
        .when(k % 9 == 6, F.lit('[{"file_path": "f", "start_line": null, "end_line": 2, "quoted_text": "q"}]')).when(k % 9 == 7, F.lit("[]"))
    )
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", parsed_evidence(raw).alias("found"))
    again = F.to_json(parsed_evidence(evidence_json(c("found")))) == F.to_json("found")
    return rows.select("doc_id", again.alias("stable"), F.posexplode_outer("found").alias("pos", "s")).select("doc_id", "stable", "pos", "s.*")


def cached_symbols(spark, d):
    """Symbols of documents' source files by way of the parse cache; files of some sources are parsed before."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = (c("n_chars") % 500).cast("string")
    source = F.concat(F.lit("import os\n\nclass C"), n, F.lit(":\n    def f"), n, F.lit("(self):\n        return g"), n, F.lit("()\n"))
    content = F.when(c("n_chars") % 500 == 7, F.lit("def broken(:\n")).otherwise(source).cast("binary")
    files = docs.select(F.concat(F.lit("d"), c("doc_id").cast("string"), F.lit(".py")).alias("relative_path"), "source", content.alias("content"), F.sha2(content, 256).alias("sha256"), F.lit("python").alias("language"))
    path = shared_path(spark, "parsed")
    for version in (1, 2):
        parse_cache.parsed_through(files.where("source < 'src2'"), path, version, repository.parse_python)
    parse_cache.evict(spark, path, 2)
    found = parse_cache.parsed_through(files, path, 2, repository.parse_python)
    symbols = F.transform("symbols", lambda x: F.concat_ws(" ", x["qualified_name"], x["kind"], x["start_line"].cast("string"), x["end_line"].cast("string")))
    calls = F.transform("calls", lambda x: F.concat(x["parent"], F.lit(" "), x["name"]))
    return found.select("relative_path", "hit", F.array_join(symbols, ", ").alias("symbols"), F.size("imports").alias("imports"), F.array_join(calls, ", ").alias("calls"))


QUERIES = {"stored_evidence": stored_evidence, "cached_symbols": cached_symbols, "paged_reviews": paged_reviews, "run_outcomes": run_outcomes, "committed_orders": committed_orders, "published_orders": published_orders}
ORACLES = {
    "stored_evidence": """WITH w AS (SELECT doc_id, doc_id % 9 AS k, {'file_path': 'f' || doc_id, 'start_line': doc_id, 'end_line': doc_id, 'quoted_text': 'a "q" é'} AS a, {'file_path': 'g', 'start_line': 2::BIGINT, 'end_line': 1::BIGINT, 'quoted_text': ''} AS b FROM documents),
l AS (SELECT doc_id, CASE k WHEN 0 THEN [a, b] WHEN 3 THEN [a] WHEN 4 THEN [a] WHEN 5 THEN [b] ELSE [] END AS s FROM w), e AS (SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS s FROM l)
SELECT doc_id, true AS stable, pos, s.file_path AS file_path, s.start_line AS start_line, s.end_line AS end_line, s.quoted_text AS quoted_text FROM (SELECT doc_id FROM l) JOIN documents USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "cached_symbols": """WITH x AS (SELECT *, n_chars % 500 AS n FROM documents), h AS (SELECT DISTINCT n FROM x WHERE source < 'src2')
SELECT 'd' || doc_id || '.py' AS relative_path, h.n IS NOT NULL AS hit, CASE WHEN x.n = 7 THEN '' ELSE 'C' || x.n || ' class 3 5, C' || x.n || '.f' || x.n || ' method 4 5' END AS symbols, CASE WHEN x.n = 7 THEN 0 ELSE 1 END AS imports, CASE WHEN x.n = 7 THEN '' ELSE 'C' || x.n || '.f' || x.n || ' g' || x.n END AS calls FROM x LEFT JOIN h ON h.n = x.n""",
    "paged_reviews": "SELECT conv_id::BIGINT AS id, CASE turn % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'commented' END AS state, text AS body, role AS actor_login, turn::BIGINT * 60 AS submitted FROM conversations WHERE role IS DISTINCT FROM 'assistant'",
    "run_outcomes": """WITH a AS (SELECT o_custkey AS identity, o_orderkey AS run, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS started, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + trunc(o_totalprice)::BIGINT % 900 AS finished,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'partial' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'succeeded' ELSE 'failed' END END AS status FROM orders),
w AS (SELECT identity, run AS winner, finished AS won FROM a WHERE status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY identity ORDER BY finished, run) = 1)
SELECT a.identity, run, CASE WHEN started > won THEN 'reused' WHEN status <> 'failed' AND (finished > won OR (finished = won AND run > winner)) THEN 'superseded' ELSE status END AS outcome, winner AS canonical_run FROM a LEFT JOIN w ON w.identity = a.identity""",
    "committed_orders": "SELECT o_orderkey, o_custkey, children, parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS children, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O')",
    "published_orders": "SELECT o_orderkey AS id, o_custkey AS line, o_orderpriority AS plan FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')",
}
