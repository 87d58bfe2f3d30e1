"""The Merkle manifest against SQL and a plain tree, on small fan-outs and odd rows."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from duck import connect, rows_of, sql_rows
from pyspark.sql import functions as F

from findweave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, n int, node string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def _levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _plain(rows, fanout):
    """Row by row: the whole tree, one proof after the other."""
    told = []
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
        claimed = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]) if hit else r["text"]
        told.append((r["lang"], r["doc_id"], _leaf(r, r["text"]), _leaf(r, claimed)))
    langs = sorted({t[0] for t in told}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((t for t in told if t[0] == x), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3])) for x in langs}
    levels = {x: _levels([t[2] for t in trees[x]], fanout) for x in langs}
    top = _levels([levels[x][-1][0] for x in langs], fanout) if langs else []
    out = []
    for number, x in enumerate(langs):
        for i, (_, doc_id, leaf, claimed) in enumerate(trees[x]):
            proof, node = [], claimed
            for at, tree in ((i, levels[x]), (number, top)):
                for nodes in tree[:-1]:
                    run = at - at % fanout
                    left, right = nodes[run:at], nodes[at + 1 : run + fanout]
                    proof += left + right
                    node, at = _h(*left, node, *right), at // fanout
            out.append((doc_id, leaf, levels[x][-1][0], top[-1][0], _h(*proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_sql(spark, sf_dir):
    assert rows_of(merkle.op12_merkle(spark, sf_dir)) == sql_rows(connect(sf_dir), merkle.ORACLE)


@pytest.mark.parametrize(("levels", "fanout"), [(1, 2), (2, 3), (4, 8)])
def test_superblocks_match_a_plain_tree(spark, levels, fanout):
    # trees of one leaf, of exactly one block, of a block and one more, and a language with most rows
    sizes = {"a": 1, "b": fanout**levels, "c": fanout**levels + 1, "hot": 150, None: 2, "": 3}
    rows = [(n * 1000 + i, f"Text {i} OF {lang}", lang, "s", i, "x", 1, 2, "y") for n, (lang, size) in enumerate(sizes.items()) for i in range(size) if i < 300]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert _got(merkle.manifest(docs, merkle._tampered(docs), levels, fanout)) == _plain([r.asDict() for r in docs.collect()], fanout)


def test_odd_rows(spark):
    rows = [
        (1, None, "en", "s", 0, "t", 1, 2, "n"), (2, "", "en", None, None, "t", 1, 2, "n"), (3, "A" * 500_000, "en", "", 3, "t", 1, 2, "n"), (3, "A" * 500_000, "en", "", 3, "t", 1, 2, "n"),
        (3, "other", "en", "", 3, "t", 1, 2, "n"), (None, "NO ID", "en", "s", 1, "t", 1, 2, "n"), (None, None, None, None, None, None, None, None, None), (-5, "É 中 Ab", "zh", "s", 1, "t", 1, 2, "n"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert _got(merkle.manifest(docs, merkle._tampered(docs))) == _plain([r.asDict() for r in docs.collect()], 8)
    assert merkle.manifest(docs.where("false")).count() == 0
    assert merkle.manifest(docs).where("NOT verified").isEmpty()
    one = merkle.manifest(docs.limit(1)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == _h()


def test_a_change_anywhere_is_seen(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = merkle.manifest(docs).select("doc_id", "root").first()["root"]
    for changed in (docs.where("doc_id <> 17"), docs.withColumn("n_chars", F.expr("n_chars + int(doc_id = 17)")), docs.union(docs.where("doc_id = 17"))):
        assert merkle.manifest(changed).first()["root"] != whole
