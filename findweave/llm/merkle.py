"""Merkle manifest of a table of documents by superblock reduction.

Each row is a leaf. The leaves of a language ascend by id, the subroots of the languages make one
more tree over them. A node's index divided by ``FANOUT ** LEVELS`` is its superblock; a task
collapses up to ``LEVELS`` levels of one superblock, and the superblocks' roots are reduced in the
same way until every tree has one node. Proofs are built on the way back: each superblock's task
gets the path above it (one small row), joins its own levels in front, and hands the paths of its
nodes down. So a task never holds more than ``FANOUT ** LEVELS`` nodes, whatever a language's
share of the rows, and texts are read once and never shuffled.

Indices come from one global sort: rows are numbered inside their partition, and a table of one row
per partition and language adds the rows before it.

Defined results: a null field is hashed as ``-``, an empty one as ``0:``; a null language is a
language of its own, first in order; rows with a null id come first in their language and are never
tampered with; rows that share an id are ordered by their hashes, and repeated rows are leaves of
their own; very long texts are hashed whole; other columns never take part; an empty table gives an
empty manifest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.session import materialize

FANOUT = 8
#: Levels that one task collapses: superblocks of 8 ** 4 = 4,096 nodes.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A tree's name: null and text are told apart, and null comes first.
_TREE = ("tree_known", "tree")


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else byte count, ``:`` and the value."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _indexed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree_known, tree, ord, ...) with idx, the rank of a row in its tree by ``ord``, and n, the tree's rows.

    One global sort; no task needs a whole tree.
    """
    ordered = nodes.orderBy(*_TREE, "ord").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    numbered = materialize(ordered, "numbered")
    parts = numbered.groupBy(*_TREE, "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy(*_TREE)  # a row per partition that holds rows of the tree
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select(F.col("tree_known").alias("k"), F.col("tree").alias("t"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    same = (F.col("tree_known") == F.col("k")) & F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))
    return numbered.join(shifts, same).withColumn("idx", F.col("at") + F.col("shift")).drop("k", "t", "p", "shift", "part", "at", "ord")


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def collapse(nodes: list[str], n: int, levels: int, fanout: int) -> Iterator[list[str]]:
    """The nodes of each level that one superblock collapses, its own first, its root's last.

    ``n`` nodes stand in the whole tree at this level; it ends where one is left.
    """
    yield nodes
    for _ in range(levels):
        if n <= 1:
            return
        nodes = [digest(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        n = -(-n // fanout)
        yield nodes


def _up(levels: int, fanout: int, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("idx")
    first = group.iloc[0]
    *_, top = collapse(group["node"].tolist(), int(first["n"]), levels, fanout)
    block = int(first["idx"]) // fanout**levels
    return pd.DataFrame({"tree_known": [first["tree_known"]], "tree": [first["tree"]], "idx": [block], "node": top, "n": [-(-int(first["n"]) // fanout**levels)]})


def _paths(group: pd.DataFrame, above: pd.DataFrame, levels: int, fanout: int) -> Iterator[tuple[int, list[str], list[str]]]:
    """Per node of a superblock: its row, and the left and right siblings of each level up to the root."""
    found = list(collapse(group["node"].tolist(), int(group["n"].iloc[0]), levels, fanout))[:-1]
    left, right = list(above["lefts"].iloc[0]), list(above["rights"].iloc[0])
    runs = [[("".join(nodes[i - i % fanout : i]), "".join(nodes[i + 1 : i - i % fanout + fanout])) for i in range(len(nodes))] for nodes in found]
    for row in range(len(group)):
        at, lefts, rights = row, [], []
        for run in runs:
            lefts.append(run[at][0])
            rights.append(run[at][1])
            at //= fanout
        yield row, lefts + left, rights + right


def _down(levels: int, fanout: int, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("idx").reset_index(drop=True)
    lefts, rights = [], []
    for _, one, other in _paths(group, above, levels, fanout):
        lefts.append(one)
        rights.append(other)
    return pd.DataFrame({"tree_known": group["tree_known"], "tree": group["tree"], "block": group["idx"], "lefts": lefts, "rights": rights, "root": above["root"].iloc[0], "subroot": above["subroot"].iloc[0]})


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its path give."""
    for left, right in zip(lefts, rights, strict=True):
        leaf = digest([left, leaf, right])
    return leaf


def _proved(levels: int, fanout: int, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("idx").reset_index(drop=True)
    proofs, folded = [], []
    for row, lefts, rights in _paths(group, above, levels, fanout):
        proofs.append(digest([part for pair in zip(lefts, rights, strict=True) for part in pair]))
        folded.append(fold(group["claimed"][row], lefts, rights))
    out = group[["doc_id", "node"]].rename(columns={"node": "leaf"})
    return out.assign(subroot=above["subroot"].iloc[0], root=above["root"].iloc[0], proof_sha256=proofs, folded_root=folded)


class Tree:
    """The superlevels of a forest: nodes by superblock, from the leaves up."""

    _NODE = "tree_known boolean, tree string, idx long, node string, n long"
    _PATH = "tree_known boolean, tree string, block long, lefts array<string>, rights array<string>, root string, subroot string"

    def __init__(self, leaves: DataFrame, levels: int = LEVELS, fanout: int = FANOUT):
        """``leaves``: tree_known, tree, ord, node, and what they carry."""
        self.levels, self.fanout = levels, fanout
        self.tables = [materialize(_indexed(leaves), "leaves")]
        most = self.tables[0].agg(F.max("n")).first()[0] or 0
        while most > 1:
            grouped = self._blocks(self.tables[-1]).groupBy(*_TREE, "block")
            self.tables.append(materialize(grouped.applyInPandas(lambda group: _up(levels, fanout, group), self._NODE), "nodes"))
            most = -(-most // fanout**levels)

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("idx") / F.lit(self.fanout**self.levels)).cast("long"))

    def roots(self) -> DataFrame:
        """(tree_known, tree, node): one row per tree."""
        return self.tables[-1].select(*_TREE, "node")

    def paths(self, above: DataFrame, finish, schema: str) -> DataFrame:
        """``finish(group, path above)`` of the leaves' superblocks, with ``above`` (tree_known, tree, lefts, rights, root, subroot) on top."""
        above = above.withColumn("block", F.lit(0).cast("long"))
        for nodes in self.tables[:0:-1]:
            above = materialize(self._met(nodes, above, _down, self._PATH), "paths")
        return self._met(self.tables[0], above, finish, schema)

    def _met(self, nodes: DataFrame, above: DataFrame, task, schema: str) -> DataFrame:
        keys, levels, fanout = [*_TREE, "block"], self.levels, self.fanout
        return self._blocks(nodes).groupBy(*keys).cogroup(above.groupBy(*keys)).applyInPandas(lambda group, over: task(levels, fanout, group, over), schema)


def _tampered(docs: DataFrame) -> Column:
    """The leaf hash of a row whose text's A-Z are lower-cased, where 3 divides crc32 of its id; else its own."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    fields = [F.translate(docs[c].cast("string"), UPPER, LOWER) if c == "text" else docs[c] for c in FIELDS]
    return F.when(hit & (fields[-1] != docs["text"]), leaf_hash(*fields))


def manifest(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of ``docs``.

    ``claimed``: the leaf hash that a row is checked with, null for its own.
    """
    own = leaf_hash(*[docs[c] for c in FIELDS])
    lang = docs["lang"].cast("string")
    leaves = docs.select(lang.isNotNull().alias("tree_known"), lang.alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), own.alias("node"), F.lit(None if claimed is None else claimed).cast("string").alias("claimed"))
    leaves = materialize(leaves.withColumns({"claimed": F.coalesce("claimed", "node"), "ord": F.struct("doc_id", "node", "claimed")}), "hashed")
    langs = Tree(leaves, levels, fanout)
    subroots = langs.roots().select(F.lit(True).alias("tree_known"), F.lit("*").alias("tree"), F.struct(*_TREE).alias("ord"), "node", F.struct(*_TREE).alias("of"))
    top = Tree(subroots, levels, fanout)
    empty = F.array().cast("array<string>")
    over = top.roots().select(*_TREE, empty.alias("lefts"), empty.alias("rights"), F.col("node").alias("root"), F.lit(None).cast("string").alias("subroot"))
    above = top.paths(over, _handed, Tree._PATH).drop("block")
    found = langs.paths(above, _proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _handed(levels: int, fanout: int, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """The paths of the languages' subroots, under the languages' own names."""
    group = group.sort_values("idx").reset_index(drop=True)
    out = _down(levels, fanout, group, above)
    return out.assign(tree_known=[of["tree_known"] for of in group["of"]], tree=[of["tree"] for of in group["of"]], subroot=group["node"])


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, _tampered(docs))


#: Two trees in turn, each reduced and folded by a recursive query. CRC-32 by its table of 256 entries.
ORACLE = """
WITH RECURSIVE entries AS (SELECT i, list_reduce([i] || range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(v ORDER BY i) AS v FROM entries),
d AS (SELECT doc_id, source, lang, n_chars, text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, crc.v[xor(a, b) % 256 + 1])), 4294967295) % 3 = 0 AS hit
  FROM documents, crc),
f AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed_text FROM d),
h AS (SELECT doc_id, lang, head, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(claimed_text)::VARCHAR || ':' || claimed_text, '-')) AS claimed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
    || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head FROM f)),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS k FROM (SELECT DISTINCT lang FROM h)),
l AS (SELECT doc_id, k, leaf, claimed, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM h JOIN langs ON h.lang IS NOT DISTINCT FROM langs.lang),
up AS (SELECT k, 0 AS level, i, leaf AS node, n FROM l
  UNION ALL SELECT k, level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), max((n + 7) // 8) FROM up WHERE n > 1 GROUP BY k, level, i // 8),
beside AS (SELECT a.k, a.level, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lefts, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rights
  FROM up a JOIN up b ON a.k = b.k AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
low AS (SELECT row_number() OVER () AS r, doc_id, leaf, k, 0 AS level, i, claimed AS node, '' AS proof FROM l
  UNION ALL SELECT r, doc_id, leaf, low.k, low.level + 1, low.i // 8, sha256(lefts || node || rights), proof || lefts || rights FROM low JOIN beside USING (k, level, i)),
sub AS (SELECT k, node AS subroot FROM up WHERE n = 1),
top AS (SELECT 0 AS level, k AS i, subroot AS node, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), max((n + 7) // 8) FROM top WHERE n > 1 GROUP BY level, i // 8),
near AS (SELECT a.level, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lefts, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rights
  FROM top a JOIN top b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
high AS (SELECT r, doc_id, leaf, k, 0 AS level, k AS i, node, proof FROM (SELECT *, max(level) OVER (PARTITION BY r) AS last FROM low) WHERE level = last
  UNION ALL SELECT r, doc_id, leaf, k, high.level + 1, high.i // 8, sha256(lefts || node || rights), proof || lefts || rights FROM high JOIN near USING (level, i))
SELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, high.node AS folded_root, high.node = root.node AS verified
FROM (SELECT *, max(level) OVER (PARTITION BY r) AS last FROM high) AS high JOIN sub USING (k), (SELECT node FROM top WHERE n = 1) AS root WHERE high.level = last
"""
