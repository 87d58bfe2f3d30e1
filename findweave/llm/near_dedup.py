"""Near-duplicate classes by BagMinHash over five-word shingles.

A text is the bag of its five-word shingles with their multiplicities. Each shingle and each dyadic
level of multiplicity (1; 2; 3-4; 5-8; ...) owns a Poisson process whose points carry a time, a
signature register and a unit cell of the level; a bag of multiplicity w keeps the points of the
cells below w, which is thinning down the hierarchy of levels. The earliest time kept in each
register is an unbiased weighted-Jaccard signature: two texts agree in a register with the
probability of their bags' overlap. Points are drawn in time order up to a bound at which every
register is taken almost surely (texts for which it is not go on with twice the bound), so the
work for a text is about M log M points, however long it is.

Signatures are banded. Exact copies are folded into one representative first. In every bucket each
text is compared with the bucket's smallest id, by the exact overlap of both bags; then, where a
bucket still spans several components, its texts outside the largest of them are compared with
those texts of other components that a count of the shingles shared between components leaves
possible. Texts of crowded buckets are compared where they share one of their rarest shingles, which
texts that overlap by the threshold must. So a pair that shares a bucket is compared, already in one
class, or proved no link, and no bucket is expanded into all its pairs. Components come from the
large-star and small-star iteration on tables; nothing of the corpus is collected.

Inside, a row is a number that is written with its signature, and its text is found again by its id
and a 128-bit digest, so rows that have one id and different texts are told apart.

Defined results: texts with one to four words have one shingle of all their words; texts without
words (null too) are copies of each other; rows with a null id have a null class and are kept;
repeated rows share a class, and the first of them is kept; of several texts under one id, each has
the class of its text; very long texts are signed and compared whole; an overlap of exactly the
threshold is a link; other columns never take part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findweave.llm._blocks import digest, narrow, texts_of
from findweave.session import materialize

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 6
REGISTERS = BANDS * ROWS
#: Shingles of one vectorised batch.
BATCH = 500_000
#: Documents of a bucket from which on it is compared in blocks, and documents of a block.
CROWD, BLOCK_DOCS = 64, 512
CACHE = 300_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], table: _WordHashes, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the windows of ``width`` words, in order; of all words, if fewer."""
    if not words:
        return np.zeros(0, _U)
    hashes = np.fromiter(map(table.__getitem__, words), _U, len(words))
    take = min(width, len(words))
    acc = np.full(len(words) - take + 1, take, _U)
    for k in range(take):
        acc = _mix(acc * _STEP + hashes[k : len(words) - take + 1 + k])
    return acc


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Earliest kept times per register of bags (hashes, multiplicities); none may be empty."""
    out = np.full((len(bags), registers), np.inf)
    todo, bound = np.arange(len(bags)), np.log(registers) + 4
    while len(todo):
        sizes = np.array([len(bags[i][0]) for i in todo])
        h = np.concatenate([bags[i][0] for i in todo])
        w = np.concatenate([bags[i][1] for i in todo]).astype(np.int64)
        doc = np.repeat(np.arange(len(todo)), sizes)
        limit = bound / np.bincount(doc, w)
        top = np.ceil(np.log2(w)).astype(np.int64)  # levels 0..top
        each = np.repeat(np.arange(len(h)), top + 1)
        level = np.arange(len(each)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
        cells = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.int64)
        below = np.where(level == 0, 0, cells)  # cells of the levels under this one
        seed, doc, w = _mix(h[each] + level.astype(_U) * _STEP), doc[each], w[each]
        rate, time = (cells * registers).astype(float), np.zeros(len(each))
        limit, sig = limit[doc], np.full((len(todo), registers), np.inf)
        number = 0
        while len(seed):
            z = _mix(seed + _U((2 * number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log(((z >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate
            live = time <= limit
            seed, time, rate, doc, w, cells, below, limit = (x[live] for x in (seed, time, rate, doc, w, cells, below, limit))
            z = _mix(seed + _U((2 * number + 2) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            kept = below + (z & _U(0xFFFFFFFF)).astype(np.int64) % cells < w
            np.minimum.at(sig, (doc[kept], ((z >> _U(32)).astype(np.int64) % registers)[kept]), time[kept])
            number += 1
        full = np.isfinite(sig).all(1)
        out[todo[full]] = sig[full]
        todo, bound = todo[~full], bound * 2
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = sig.view(_U).reshape(len(sig), bands, rows)
    acc = np.broadcast_to(np.arange(bands, dtype=_U), bits.shape[:2])
    for k in range(rows):
        acc = _mix(acc * _STEP + bits[:, :, k])
    return acc.view(np.int64)


def sign(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, key, bands): ``rows``' ids and digests, a 128-bit hash of the word sequence, and the band hashes."""

    def flush(ids, digests, keys, bags):
        filled = [i for i, b in enumerate(bags) if len(b[0])]
        bands = [[] for _ in bags]
        if filled:
            for i, row in zip(filled, band_hashes(signatures([bags[i] for i in filled])), strict=True):
                bands[i] = row
        columns = [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "key", "bands"])

    def run(batches):
        table, ids, digests, keys, bags, size = _WordHashes(), [], [], [], [], 0
        for batch in batches:
            for doc_id, text, mark in zip(batch.column(0), texts_of(batch.column(1)), batch.column(2), strict=True):
                words = text.split()
                ids.append(doc_id.as_py())
                digests.append(mark.as_py())
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                bags.append(np.unique(shingles(words, table), return_counts=True))
                size += len(bags[-1][0])
                if size >= BATCH:
                    yield flush(ids, digests, keys, bags)
                    ids, digests, keys, bags, size = [], [], [], [], 0
        yield flush(ids, digests, keys, bags)

    return rows.mapInArrow(run, "doc_id long, digest binary, key binary, bands array<long>")


def bag_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard of two sorted arrays of hashes, repeats included."""
    values, ca = np.unique(a, return_counts=True)
    other, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, other, assume_unique=True, return_indices=True)
    both = np.minimum(ca[i], cb[j]).sum()
    return float(both / max(1, len(a) + len(b) - both))


_BAG = "rep long, size int, bag binary"


def bags_of(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, size, bag) of the texts of ``reps`` (doc_id, digest, rep): sorted shingle hashes, repeats included."""

    def hashed(batches):
        table = _WordHashes()
        for batch in batches:
            bags = [np.sort(shingles(t.split(), table)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, bags), pa.int32()), pa.array([b.tobytes() for b in bags], pa.binary())], names=["rep", "size", "bag"])

    # the join has dealt the rows by id and digest, so dropping repeats shuffles nothing
    found = rows.join(reps.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    return found.select("rep", "text").mapInArrow(hashed, _BAG)


def verify(pairs: DataFrame, bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, overlap) of the pairs whose bags overlap by ``threshold`` or more."""
    left, right = bags.select(F.col("rep").alias("a"), F.col("bag").alias("bag_a")), bags.select(F.col("rep").alias("b"), F.col("bag").alias("bag_b"))

    def compare(batches):
        for batch in batches:
            out = [bag_overlap(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "overlap"])

    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "bag_a", "bag_b")
    return met.mapInArrow(compare, "a long, b long, overlap double").where(F.col("overlap") >= threshold)


def _spread(bags: DataFrame, roots: DataFrame) -> DataFrame:
    """(shingle, n, rep, size, root): the distinct shingles of the texts in ``roots`` (rep, root), with their counts."""

    def spread(batches):
        for batch in batches:
            for rep, size, root, bag in zip(*batch.columns, strict=True):
                values, counts = np.unique(np.frombuffer(bag.as_py(), _U), return_counts=True)
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(counts, pa.int32()), *(pa.array(np.full(n, x.as_py()), k) for x, k in ((rep, pa.int64()), (size, pa.int32()), (root, pa.int64())))],
                    names=["shingle", "n", "rep", "size", "root"],
                )

    each = bags.join(roots.hint("merge"), "rep").select("rep", "size", "root", "bag").mapInArrow(spread, "shingle long, n int, rep long, size int, root long")
    return materialize(each, "shingles")


def _between(each: DataFrame) -> DataFrame:
    """(shingle, docs): the shingles that several components have, and how many texts have them."""
    return each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("docs")).where("low < high").select("shingle", "docs")


def shareable(bags: DataFrame, roots: DataFrame) -> DataFrame:
    """(rep, size, shared): how many of a text's shingles texts of other components have too.

    ``roots``: (rep, root) of the texts that are compared. A text of ``size`` shingles can't
    overlap one of another component by more than its ``shared`` ones.
    """
    each = _spread(bags, roots)
    # texts without such shingles can't be linked and drop out
    return each.join(_between(each).hint("merge"), "shingle", "left_semi").groupBy("rep", "size").agg(F.sum("n").alias("shared"))


def meetings(bags: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(shingle, rep, root, size, crowd): the shingles at which the texts in ``roots`` are to be compared.

    Two texts that overlap by ``threshold`` share a shingle among the rarest of each: with the
    shingles in one order, those that no other component has first, then by how many texts have
    them, at most ``size - ceil(threshold * size)`` of a text's shingles (repeats counted) come
    before the first shared one.
    """
    each = _spread(bags, roots)
    common = each.join(_between(each).hint("merge"), "shingle")
    own = Window.partitionBy("rep")
    rarest = own.orderBy("docs", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("size") - F.ceil(F.col("size") * threshold - 1e-6)
    before = F.col("size") - F.sum("n").over(own) + F.coalesce(F.sum("n").over(rarest), F.lit(0))
    met = common.withColumn("before", before).where(F.col("before") <= room)
    found = met.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("crowd")).where("low < high")
    return met.select("shingle", "rep", "root", "size").join(found.select("shingle", "crowd").hint("merge"), "shingle")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge; root is the smallest node of its component.

    Alternates large-star and small-star until the edges no longer change. Each step is a
    minimum per node and a join on the node, so a hub's edges are split like any skewed join.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mixed(members: DataFrame, linked: DataFrame) -> DataFrame:
    """``members`` of buckets that span several components, with ``root`` and the largest (``most``)."""
    labelled = members.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = labelled.groupBy("band", "hash", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "hash").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    return labelled.join(mixed, ["band", "hash"])


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("band", "hash", *[F.col(c).alias(f"{name}_{c}") for c in ("rep", "root", "size", "shared")], *(["most"] if name == "y" else []))


def _may_link(threshold: float) -> Column:
    """The components differ, and as many shingles as both share with others could be enough."""
    most = F.least("x_shared", "y_shared")
    return (F.col("x_root") != F.col("y_root")) & (most >= threshold * (F.col("x_size") + F.col("y_size") - most) - 1e-6)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def links_between(members: DataFrame, links: DataFrame, tried: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Further links (a, b) between documents that share a bucket and are in different components.

    Documents that share too few shingles with other components to be linked drop out. In what is
    left, each bucket's least particular document is compared with the others first, which joins
    most components; then the documents outside the largest component of a bucket that is still
    mixed are compared with all that they may be linked to. Documents of crowded buckets meet at
    their rarest shingles instead, in pairs or, where these are crowded too, in blocks.
    """
    spread = materialize(_mixed(members.select("band", "hash", "rep"), components(links)), "mixed")
    room = shareable(bags, spread.select("rep", "root").distinct()).where(F.col("shared") >= threshold * F.col("size"))
    able = materialize(spread.join(room.hint("merge"), "rep"), "able")
    center = able.groupBy("band", "hash").agg(F.max_by(F.struct("rep", "root", "size", "shared", "most"), F.struct(F.col("shared") / F.col("size"), -F.col("rep"))).alias("c")).select("band", "hash", "c.*")
    stars = materialize(_pairs(_side(able, "x").join(_side(center, "y"), ["band", "hash"]).where(_may_link(threshold))).join(tried, ["a", "b"], "left_anti"), "stars")
    found = materialize(verify(stars, bags, threshold).select("a", "b"), "links")
    again = materialize(_mixed(able.select("band", "hash", "rep", "size", "shared"), components(links.union(found))), "mixed")
    again = again.join(again.groupBy("band", "hash").agg(F.count("*").alias("crowd")), ["band", "hash"])
    few = again.where(F.col("crowd") <= CROWD)
    one, two = _side(few.where("root <> most"), "x"), _side(few, "y")
    once = (F.col("y_root") == F.col("most")) | (F.col("x_rep") < F.col("y_rep"))
    crossed = _pairs(one.join(two, ["band", "hash"]).where(_may_link(threshold) & once))
    met = materialize(meetings(bags, again.where(F.col("crowd") > CROWD).select("rep", "root").distinct(), threshold), "met")
    thin = met.where(F.col("crowd") <= CROWD).select("shingle", "rep", "root", "size")
    other = thin.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("rep", "root", "size")])
    alike = (F.col("root") != F.col("y_root")) & (F.col("rep") < F.col("y_rep")) & (F.least("size", "y_size") >= threshold * F.greatest("size", "y_size") - 1e-6)
    rare = thin.join(other, "shingle").where(alike).select(F.col("rep").alias("a"), F.col("y_rep").alias("b")).distinct()
    crossed = materialize(crossed.union(rare).distinct().join(tried.union(stars), ["a", "b"], "left_anti"), "crossed")
    return found.union(verify(crossed, bags, threshold).select("a", "b")).union(crowded_links(met.where(F.col("crowd") > CROWD), bags, threshold))


def overlaps(bags: list[np.ndarray]) -> np.ndarray:
    """Shared shingles, repeats included, of every two of the bags (sorted arrays of hashes)."""
    sizes = [len(b) for b in bags]
    values, doc = np.concatenate(bags), np.repeat(np.arange(len(bags)), sizes)
    # the n-th copy of a shingle in a bag is an element of its own
    first = np.concatenate([np.searchsorted(b, b) for b in bags])
    nth = np.concatenate([np.arange(n) for n in sizes]) - first
    elements, column = np.unique(_mix(values + nth.astype(_U) * _STEP), return_inverse=True)
    used = np.bincount(column) > 1
    keep = used[column]
    column, doc = (np.cumsum(used) - 1)[column[keep]], doc[keep]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    out, width = np.zeros((len(bags), len(bags)), np.float32), 2048
    for start in range(0, int(used.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(bags), width), np.float32)
        part[doc[lo:hi], column[lo:hi] - start] = 1
        out += part @ part.T
    return out


def crowded_links(rows: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components at crowded shingles, whose texts are compared block by block.

    A block's documents are compared in one task by the exact overlaps of their bags; only one link
    of two components leaves it, so a large group of copies isn't expanded into pairs.
    """
    blocks = F.ceil(F.col("crowd") / BLOCK_DOCS).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = rows.select("shingle", "rep", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "root", "own")
    dealt = dealt.join(bags.hint("merge"), "rep")

    def compare(group: pa.Table) -> pa.Table:
        rep, root, own, size = (group[c].to_numpy() for c in ("rep", "root", "own", "size"))
        both = overlaps([np.frombuffer(b.as_py(), _U) for b in group["bag"]])
        linked = (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-3) & (root[:, None] != root[None, :])
        if group["i"][0].as_py() != group["j"][0].as_py():
            linked &= own[:, None] != own[None, :]
        x, y = np.nonzero(np.triu(linked, 1))
        sure = both[x, y].astype(float) / (size[x] + size[y] - both[x, y]) >= threshold
        x, y = x[sure], y[sure]
        _, one = np.unique(np.stack([np.minimum(root[x], root[y]), np.maximum(root[x], root[y])], 1), axis=0, return_index=True)
        x, y = x[one], y[one]
        return pa.table({"a": pa.array(np.minimum(rep[x], rep[y])), "b": pa.array(np.maximum(rep[x], rep[y]))})

    return dealt.groupBy("shingle", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(doc_id, digest, class_id, kept) of each row."""
    rows = narrow(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    signed = materialize(sign(rows).withColumn("node", F.monotonically_increasing_id()), "signed")
    known = signed.where("doc_id IS NOT NULL")
    copies = known.groupBy("key").agg(F.min(F.struct("doc_id", "digest", "node")).alias("first"))
    firsts = copies.select(F.col("first.node").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.digest").alias("digest"))
    reps = known.join(firsts.select("node"), "node", "left_semi").select(F.col("node").alias("rep"), F.posexplode("bands").alias("band", "hash"))
    hubs = reps.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").drop("last")
    members = materialize(reps.join(hubs, ["band", "hash"]).select("band", "hash", "rep", "hub"), "buckets")
    bags = materialize(bags_of(rows, firsts.withColumnRenamed("node", "rep").join(members.select("rep").distinct(), "rep", "left_semi")), "bags")
    stars = materialize(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = materialize(verify(stars, bags, threshold).select("a", "b"), "links")
    final = components(links.union(links_between(members, links, stars, bags, threshold)))
    rooted = copies.join(final, F.col("first.node") == F.col("node"), "left").select("key", "first", F.coalesce("root", "first.node").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    named = rooted.join(heads, "root").select("key", F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("head"))
    out = signed.select("doc_id", "digest", "key", "node").join(named, "key", "left")
    of_known = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    return out.select("doc_id", "digest", of_known(F.col("class_id")).alias("class_id"), F.coalesce(of_known(F.col("node") == F.col("head")), F.lit(True)).alias("kept"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of its class), kept (the first row with that id) of each row."""
    return _classified(docs, id_col, text_col, threshold).select("doc_id", "class_id", "kept")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with one row of each class; rows without an id all stay."""
    kept = _classified(docs, "doc_id", "text", threshold).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    mark = "digest"
    while mark in {c.lower() for c in docs.columns}:
        mark += "_"
    marked = docs.withColumn(mark, digest(F.col("text")))
    named = marked.join(kept, (marked["doc_id"] == kept["kept_id"]) & (marked[mark] == kept["kept_digest"]), "left_semi").dropDuplicates(["doc_id", mark])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
