"""Queries over chains of commits. Surrogates: documents are files with one symbol each.

By the remainder of the id, a file is renamed several times, swaps its name with its neighbour, is
deleted and created anew, renamed and deleted, or modified in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.operators import renames

c = F.col


def file_changes(spark, d: str) -> DataFrame:
    """seq, change, path, previous_path: up to six renames in a row, over seven commits."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    k, kind = c("doc_id"), c("doc_id") % 6
    path = F.concat(F.lit("src/"), k.cast("string"))
    change = lambda seq, what, at, before=None: F.struct(F.lit(seq).alias("seq") if isinstance(seq, int) else seq.cast("int").alias("seq"), F.lit(what).alias("change"), at.alias("path"), (F.lit(None) if before is None else before).cast("string").alias("previous_path"))
    version = lambda j: F.when(j == 0, path).otherwise(F.concat(path, F.lit(".v"), j.cast("string")))
    neighbour = F.concat(F.lit("src/"), F.when(kind == 1, k + 1).otherwise(k - 1).cast("string"))
    steps = (
        F.when((kind == 0) & (c("n_chars") % 7 > 0), F.transform(F.sequence(F.lit(1), F.greatest((c("n_chars") % 7).cast("int"), F.lit(1))), lambda j: change(j, "R", version(j), version(j - 1))))
        .when(kind.isin(1, 2), F.array(change(2, "R", neighbour, path)))
        .when(kind == 3, F.array(change(2, "D", path), change(4, "A", path)))
        .when(kind == 4, F.array(change(1, "R", F.concat(path, F.lit(".old")), path), change(3, "D", F.concat(path, F.lit(".old")))))
        .when(kind == 5, F.array(change(1, "M", path)))
    )
    return docs.select(F.inline(steps))


CHANGES = """
d AS (SELECT *, 'src/' || doc_id AS path, doc_id % 6 AS k FROM documents),
ch AS (SELECT j AS seq, 'R' AS change, path || '.v' || j AS path, CASE WHEN j = 1 THEN path ELSE path || '.v' || (j - 1) END AS previous_path FROM (SELECT path, unnest(range(1, n_chars % 7 + 1)) AS j FROM d WHERE k = 0)
  UNION ALL SELECT 2, 'R', 'src/' || CASE WHEN k = 1 THEN doc_id + 1 ELSE doc_id - 1 END, path FROM d WHERE k IN (1, 2) UNION ALL SELECT unnest([2, 4]), unnest(['D', 'A']), path, NULL FROM d WHERE k = 3
  UNION ALL SELECT unnest([1, 3]), unnest(['R', 'D']), path || '.old', unnest([path, NULL]) FROM d WHERE k = 4 UNION ALL SELECT 1, 'M', path, NULL FROM d WHERE k = 5),
ev AS (SELECT CASE change WHEN 'R' THEN previous_path ELSE path END AS source, seq, CASE change WHEN 'R' THEN path END AS target FROM ch WHERE change IN ('R', 'D')),
hop AS (SELECT e.source AS path, e.target, e.seq FROM ev e QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) = 1
  UNION ALL SELECT hop.path, f.target, f.seq FROM hop JOIN ev f ON f.source = hop.target AND f.seq = (SELECT min(g.seq) FROM ev g WHERE g.source = hop.target AND g.seq > hop.seq)),
ef AS (SELECT path, arg_max({t: target}, seq).t AS effective_path FROM hop GROUP BY path)"""


def path_history(spark, d):
    return renames.effective_paths(file_changes(spark, d))


def symbols(spark, d: str, current: bool) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    k, kind = c("doc_id"), c("doc_id") % 6
    path = F.concat(F.lit("src/"), k.cast("string"))
    if current:
        last = c("n_chars") % 7
        path = F.when((kind == 0) & (last > 0), F.concat(path, F.lit(".v"), last.cast("string"))).when(kind == 1, F.concat(F.lit("src/"), (k + 1).cast("string"))).when(kind == 2, F.concat(F.lit("src/"), (k - 1).cast("string"))).otherwise(path)
        docs = docs.where(kind != 4)
    name = F.concat_ws("_", "source", F.when(F.lit(current) & (k % 5 == 0), F.lit("new")).otherwise(F.lit("old")))
    body = F.concat("text", F.when(F.lit(current) & ((kind == 3) | (c("n_chars") % 4 == 1)), F.lit("!")).otherwise(F.lit("")))
    return docs.select(k.alias("id"), path.alias("path"), name.alias("name"), c("lang").alias("kind"), F.md5(body.cast("binary")).alias("hash"))


def renamed_continuity(spark, d):
    return renames.continuity_over(symbols(spark, d, False), symbols(spark, d, True), file_changes(spark, d))


QUERIES = {"path_history": path_history, "renamed_continuity": renamed_continuity}
ORACLES = {
    "path_history": f"WITH RECURSIVE {CHANGES} SELECT path, effective_path, effective_path IS NULL AS deleted FROM ef",
    "renamed_continuity": f"""WITH RECURSIVE {CHANGES},
p0 AS (SELECT doc_id AS id, d.path AS was, source || '_old' AS name, lang AS kind, md5(text) AS hash, ef.path IS NOT NULL AND effective_path IS NULL AS gone, coalesce(effective_path, d.path) AS path FROM d LEFT JOIN ef USING (path)),
p AS (SELECT * FROM p0 WHERE NOT gone),
c AS (SELECT doc_id AS id, CASE WHEN k = 0 AND n_chars % 7 > 0 THEN path || '.v' || n_chars % 7 WHEN k = 1 THEN 'src/' || (doc_id + 1) WHEN k = 2 THEN 'src/' || (doc_id - 1) ELSE path END AS path, source || CASE WHEN doc_id % 5 = 0 THEN '_new' ELSE '_old' END AS name, lang AS kind,
  md5(text || CASE WHEN k = 3 OR n_chars % 4 = 1 THEN '!' ELSE '' END) AS hash FROM d WHERE k <> 4),
sm AS (SELECT p.id AS prev_id, c.id AS cur_id, CASE WHEN p.hash = c.hash THEN 'unchanged' ELSE 'modified' END AS status FROM p JOIN c USING (path, name, kind)),
rp AS (SELECT *, row_number() OVER (PARTITION BY hash, kind ORDER BY path, name, id) AS turn FROM p WHERE id NOT IN (SELECT prev_id FROM sm)), rc AS (SELECT * FROM c WHERE id NOT IN (SELECT cur_id FROM sm)),
po AS (SELECT hash, kind, count(*) AS n, min(id) AS cid, min(name) AS cname FROM rc GROUP BY 1, 2),
hs AS (SELECT rp.id AS prev_id, CASE WHEN n = 1 AND turn = 1 THEN cid END AS cur_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND turn = 1 THEN CASE WHEN name = cname THEN 'moved' ELSE 'renamed' END ELSE 'deleted' END AS status FROM rp LEFT JOIN po USING (hash, kind)),
ct AS (SELECT * FROM sm UNION ALL SELECT * FROM hs UNION ALL SELECT NULL, id, 'added' FROM rc WHERE id NOT IN (SELECT cur_id FROM hs WHERE cur_id IS NOT NULL))
SELECT *, 'symbol_' || status AS reason FROM ct UNION ALL SELECT id, NULL, 'deleted', 'file_deleted' FROM p0 WHERE gone""",
}
