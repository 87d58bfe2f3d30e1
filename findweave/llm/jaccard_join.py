"""Documents linked by the Jaccard overlap of their word shingles, by a grouped prefix join.

A document is the set of its distinct five-word shingles. Equal sets are folded into one
representative. Shingles have one order for the whole corpus: by how many rows have them, rarest
first. Two sets that overlap by the threshold share a shingle among the first
``size - ceil(threshold * size) + 1`` of each, their prefixes, so only sets whose prefixes meet are
compared, and sets with equal prefixes and sizes are one group until then:

1. One scan of the texts gives each row's set as codes into its block's list of distinct shingles,
   and that list, cut by hash into buckets. Buckets count the rows of a shingle and answer the
   blocks, whose payloads turn codes into prefixes: only shingles that several rows have remain. For
   this the leading bits of a hash do, a few more than number the corpus; shingles that share them
   are taken for one, which adds comparisons and loses none.
2. Sets with equal size and prefix form a group. Groups meet at each shingle of their prefixes;
   group pairs are filtered by size and by what the places of the shingle leave possible.
3. Groups are expanded, and members are compared by their whole sets of 64-bit hashes. In a bucket
   each member is compared with the bucket's smallest one first; where a bucket still spans several
   components, the rest is settled as in ``near_dedup``: no pair of different components stays
   uncompared unless shown to be no link, and a crowd isn't expanded into all its pairs.

Components come from the large-star and small-star iteration on tables.

Defined results: texts with one to four words have one shingle of all of them; null, empty and blank
texts have an empty set, are linked with nothing and form components of their own id; rows with a
null id have a null component and link nothing; repeated rows share a component; of several texts
under one id, each has the component of its text; an overlap of exactly the threshold is a link;
very long texts are compared whole; other columns never take part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findweave.llm._blocks import digest, grow, grow_wide, narrow, shrink, shrink_wide, texts_of
from findweave.llm.near_dedup import BATCH, _U, _WordHashes, components, links_between, shingles, verify
from findweave.session import materialize

WIDTH = 5
THRESHOLD = 0.8
#: Shingles of a block, and shingles of the corpus for each bucket of hashes.
BLOCK_SHINGLES = 1_000_000
BUCKET_SHINGLES = 1_000_000


def shingle_set(text: bytes, table: _WordHashes) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles of a text, its A-Z lower-cased."""
    return np.unique(shingles(text.lower().split(), table, WIDTH))


def prefix_length(size: int, threshold: float = THRESHOLD) -> int:
    return size - math.ceil(size * threshold - 1e-9) + 1


_BLOCK = "block long, nodes array<long>, ids array<long>, digests array<binary>, sizes array<int>, keys array<binary>, codes binary, tokens binary"


def _sets(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: number, id, digest, set size and set key of each, codes of the sets, and the block's tokens.

    A token is a shingle's leading ``bits``; codes are places in the block's ascending tokens.
    """
    context = TaskContext.get()
    base, shift, table = (context.partitionId() if context else 0) << 33, _U(64 - bits), _WordHashes()
    number, count, rows, tokens, size = 0, 0, [], [], 0

    def flush():
        listed, codes = np.unique(np.concatenate(tokens), return_inverse=True)
        steps = codes.astype(np.int64)
        starts = np.cumsum([0, *map(len, tokens)])[:-1]
        first = np.zeros(len(steps), bool)
        first[starts[[len(t) > 0 for t in tokens]]] = True
        steps = np.where(first, steps, np.diff(steps, prepend=0))  # codes ascend within a row
        nodes, ids, digests, keys = zip(*rows, strict=True)
        cells = ([base + number], [nodes], [ids], [digests], [[len(t) for t in tokens]], [keys], [shrink(steps)], [shrink_wide(np.diff(listed, prepend=_U(0)))])
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["block", "nodes", "ids", "digests", "sizes", "keys", "codes", "tokens"])

    for batch in batches:
        for doc_id, text, mark in zip(batch.column(0), texts_of(batch.column(1)), batch.column(2), strict=True):
            found = shingle_set(text, table)
            rows.append((base + count, doc_id.as_py(), mark.as_py(), hashlib.blake2b(found.tobytes(), digest_size=16).digest()))
            tokens.append(found >> shift)  # ascending, too
            count, size = count + 1, size + len(found)
            if size >= BLOCK_SHINGLES:
                yield flush()
                number, rows, tokens, size = number + 1, [], [], 0
    if rows:
        yield flush()


def _buckets_of(tokens: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Buckets ascend with the tokens."""
    return ((tokens >> _U(max(0, bits - 32))) * _U(buckets) >> _U(min(bits, 32))).astype(np.int64)


def _asked(blocks: DataFrame, buckets: int, bits: int) -> DataFrame:
    """(bucket, block, tokens, uses): each block's tokens by bucket, with the rows of the block that have them."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a block of some megabytes at a time
                block, sizes, codes, tokens = (batch.column(c)[k].as_py() for c in ("block", "sizes", "codes", "tokens"))
                listed = np.cumsum(grow_wide(tokens).view(_U), dtype=_U)
                if not len(listed):
                    continue
                uses, of = np.bincount(_codes(codes, sizes), minlength=len(listed)), _buckets_of(listed, buckets, bits)
                edges = np.flatnonzero(np.diff(of, prepend=-1))
                out = [(int(of[a]), block, shrink_wide(np.diff(listed[a:b], prepend=_U(0))), shrink(uses[a:b])) for a, b in zip(edges, [*edges[1:], len(of)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "tokens", "uses"])

    return blocks.select("block", "sizes", "codes", "tokens").mapInArrow(run, "bucket int, block long, tokens binary, uses binary")


def _codes(packed: bytes, sizes: list[int]) -> np.ndarray:
    """Codes of all rows of a block, from their steps."""
    steps, ends = grow(packed), np.cumsum(sizes)
    total = np.cumsum(steps)
    starts = (ends - sizes)[np.asarray(sizes) > 0]
    return total - np.repeat(total[starts] - steps[starts], np.asarray(sizes)[np.asarray(sizes) > 0]) if len(steps) else steps


def _answers(asked: DataFrame) -> DataFrame:
    """(block, bucket, rows): for each token of a block in a bucket, the rows of all blocks that have it."""

    def run(group: pa.Table) -> pa.Table:
        each = [np.cumsum(grow_wide(t.as_py()).view(_U), dtype=_U) for t in group["tokens"]]
        _, of = np.unique(np.concatenate(each), return_inverse=True)
        total = np.zeros(of.max() + 1, np.int64)
        np.add.at(total, of, np.concatenate([grow(u.as_py()) for u in group["uses"]]))
        parts = np.split(np.minimum(total[of], 2**32 - 1), np.cumsum([len(e) for e in each])[:-1])
        return pa.table({"block": group["block"], "bucket": group["bucket"], "rows": pa.array([shrink(p) for p in parts], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, rows binary")


_PREFIX = "node long, size int, whole binary, shared array<struct<token:long,place:int>>"


def _prefixes(blocks: DataFrame, answers: DataFrame, threshold: float) -> DataFrame:
    """(node, size, whole, shared) of the rows whose prefix has tokens that several rows have.

    ``whole`` is a digest of size and prefix; ``shared`` has those tokens with their places.
    """

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        listed = np.cumsum(grow_wide(row["tokens"]).view(_U), dtype=_U)
        told = sorted(zip(told["bucket"].to_pylist(), told["rows"].to_pylist(), strict=True))
        rows = np.concatenate([grow(r) for _, r in told]) if told else np.zeros(0, np.int64)
        place = np.empty(len(listed), np.int64)
        place[np.lexsort((listed, rows))] = np.arange(len(listed))  # the corpus' order, as far as this block goes
        codes, out, tokens_, places, start = _codes(row["codes"], row["sizes"]), [], [], [], 0
        for node, doc_id, size in zip(row["nodes"], row["ids"], row["sizes"], strict=True):
            own, start = codes[start : start + size], start + size
            if not size or doc_id is None or size - np.count_nonzero(rows[own] > 1) >= (n := prefix_length(size, threshold)):
                continue  # no token of the prefix is anywhere else
            own = own[np.argsort(place[own], kind="stable")][:n]
            where = np.flatnonzero(rows[own] > 1)
            tokens = listed[own].view(np.int64)
            whole = hashlib.blake2b(size.to_bytes(8, "little") + tokens.tobytes(), digest_size=16).digest()
            _, once = np.unique(tokens[where], return_index=True)
            out.append((node, size, whole))
            tokens_.append(tokens[where][once])
            places.append(where[once].astype(np.int32))
        # numbers stay in arrays: as Python's they would take many times the memory
        flat = [np.concatenate([np.zeros(0, k), *x]) for x, k in ((tokens_, np.int64), (places, np.int32))]
        shared = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens_)]), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["token", "place"]))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ([],) * 3, (pa.int64(), pa.int32(), pa.binary()), strict=True)]
        return pa.Table.from_arrays([*columns, shared], names=["node", "size", "whole", "shared"])

    payload = blocks.select("block", "nodes", "ids", "sizes", "codes", "tokens")
    return payload.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _PREFIX)


def group_buckets(groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(token, group) where groups of two or more that may be linked meet; ``groups``: group, size, shared.

    A group stays at a token if, with a partner of the least size, enough of it comes from there on
    (all of an overlap lies behind its first token), and if sizes near its own occur among the
    others: sizes within the threshold fall into the same or neighbouring powers of it.
    """
    each = groups.select("group", "size", F.explode("shared").alias("s")).select("group", "size", "s.token", "s.place")
    least = F.ceil((F.col("size") + F.ceil(F.col("size") * threshold - 1e-9)) * (threshold / (1 + threshold)) - 1e-9)
    power = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / threshold) + 1e-9)
    each = each.where(F.col("size") - F.col("place") >= least).withColumn("power", power)
    cells = each.groupBy("token", "power").agg(F.count("*").alias("n"))
    near = cells.select("token", F.explode(F.array(*[F.col("power") + k for k in (-1, 0, 1)])).alias("power"), "n").groupBy("token", "power").agg(F.sum("n").alias("n"))
    return each.join(near.where("n > 1"), ["token", "power"]).select("token", "group")


def _expanded(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(band, hash, rep): members of groups at the tokens where their groups meet, and of each group of several, at the group."""
    at_tokens = members.join(buckets, "group").select(F.lit(0).alias("band"), F.col("token").alias("hash"), "rep")
    several = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return at_tokens.unionByName(members.join(several, "group").select(F.lit(1).alias("band"), F.col("group").alias("hash"), "rep"))


def _hashed_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, size, bag) of (rep, text) batches, some ``BATCH`` hashes at a time."""
    table = _WordHashes()

    def told(reps, found):
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(map(len, found), pa.int32()), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "size", "bag"])

    for batch in batches:
        reps, found, size = [], [], 0
        for rep, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            reps.append(rep)
            found.append(shingle_set(text, table))
            size += len(found[-1])
            if size >= BATCH:
                yield told(reps, found)
                reps, found, size = [], [], 0
        yield told(reps, found)


def sets_of(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, size, bag) of the texts of ``reps`` (doc_id, digest, rep): whole sets of hashes."""

    found = rows.join(reps.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    return found.select("rep", "text").mapInArrow(_hashed_sets, "rep long, size int, bag binary")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    rows = narrow(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    # words are at least two bytes with their blank, and a word begins a shingle at most
    most = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    bits, buckets = min(63, max(32, most.bit_length() + 5)), 32 + most // (3 * BUCKET_SHINGLES)
    blocks = materialize(rows.mapInArrow(lambda batches: _sets(batches, bits), _BLOCK), "sets")
    each = F.explode(F.arrays_zip("nodes", "ids", "digests", "sizes", "keys")).alias("r")
    told = blocks.select(each).select(F.col("r.nodes").alias("node"), F.col("r.ids").alias("doc_id"), F.col("r.digests").alias("digest"), F.col("r.sizes").alias("size"), F.col("r.keys").alias("key"))
    told = materialize(told, "rows")
    filled = told.where("doc_id IS NOT NULL AND size > 0")
    firsts = materialize(filled.groupBy("key").agg(F.min(F.struct("doc_id", "digest", "node")).alias("first")).select("key", "first.*"), "firsts")
    prefixes = _prefixes(blocks, _answers(_asked(blocks, buckets, bits)), threshold).join(firsts.select("node"), "node", "left_semi")
    prefixes = materialize(prefixes, "prefixes")
    groups = materialize(prefixes.groupBy("whole").agg(F.min("node").alias("group"), F.first("size").alias("size"), F.first("shared").alias("shared")), "groups")
    members = prefixes.join(groups.select("whole", "group"), "whole").select("group", F.col("node").alias("rep"))
    spread = _expanded(members, group_buckets(groups, threshold))
    hubs = spread.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").drop("last")
    met = materialize(spread.join(hubs, ["band", "hash"]).select("band", "hash", "rep", "hub"), "buckets")
    able = firsts.withColumnRenamed("node", "rep").select("doc_id", "digest", "rep").join(met.select("rep").distinct(), "rep", "left_semi")
    bags = materialize(sets_of(rows, able), "bags")
    sizes = prefixes.select("node", "size")
    stars = met.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("size_b")), "b")
    stars = materialize(stars.where(F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-6).select("a", "b"), "stars")
    links = materialize(verify(stars, bags, threshold).select("a", "b"), "links")
    final = components(links.union(links_between(met, links, stars, bags, threshold)))
    rooted = firsts.join(final, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("key", "component_id")
    out = told.join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS o FROM w UNION SELECT r.doc_id, d.b FROM r JOIN d ON d.a = r.o)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(o) FROM r WHERE r.doc_id = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
